"""Operator 13: periodic runs of words by internal pattern matching, and texts with their repeats collapsed.

A run is a stretch of words with smallest period q, at least ``times`` q and ``least`` words long, that no neighbouring
word extends. Since it is longer than three periods, for the power of two m with m/2 < q <= m it holds a dyadic block
(m words at a multiple of m) that is followed or preceded at distance q by the same words. Within such a block, whose
length is no less than q, the occurrences of the block form an arithmetic progression of difference q. So:

1. Suffixes are sorted by prefix doubling, within each document alone; the ranks at level m give each block the interval
   of the suffix array that holds its occurrences. Places of their own rank need no more refinement.
2. For each block the neighbouring windows of m places, behind it and before it, are asked for the nearest occurrence: range
   successor and predecessor in a wavelet tree over the suffix array. The nearest occurrence and the block are two terms of
   the progression; their difference, if it exceeds m/2, is the candidate period (a smaller one is a lower level's).
3. A candidate is extended to both sides as far as words q apart agree, once for each run, and kept if it is long enough.
   The nearest occurrence rules out any smaller period.

Documents are worked off in slices of bounded bytes, in place: no shuffle. A text beyond a slice stands alone.

Cases: a null or blank text has no words and no runs, and collapses to an empty text; words are told apart by 64-bit
hashes; equal rows give equal results; other columns are ignored unless kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn

SPACES = r"[\x20\x09-\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Wavelet:
    """A wavelet tree over numbers below 2^bits, level by level: counts and order statistics of intervals, many at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            p = np.packbits(bit, bitorder="little")
            packed[: len(p)] = p
            packed = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((b, packed, before, len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than x."""
        count = np.zeros(len(lo), np.int64)
        for b, packed, before, zeros in self.levels:
            lo1, hi1 = self._ones(packed, before, lo), self._ones(packed, before, hi)
            one = (x >> b & 1).astype(bool)
            count += np.where(one, hi - hi1 - lo + lo1, 0)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least value (from 0) of each interval."""
        value = np.zeros(len(lo), np.int64)
        for b, packed, before, zeros in self.levels:
            lo1, hi1 = self._ones(packed, before, lo), self._ones(packed, before, hi)
            below = hi - hi1 - lo + lo1
            one = n >= below
            value |= one.astype(np.int64) << b
            n = n - np.where(one, below, 0)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return value


def blocks(rank: np.ndarray, order: np.ndarray, ends: np.ndarray):
    """Prefix doubling: sorts ``order`` within groups in place; yields m and the dyadic blocks (place, interval) at each level.

    ``rank``: the slot in ``order`` at which each place's group begins; ``ends``: where each place's text ends. Only groups
    of several places are refined: a block outside them has no other occurrence, at this level or any later one.
    """
    n, m = len(order), 1
    slots = np.arange(n)
    while True:
        size = np.bincount(rank[order[slots]], minlength=n)
        slots = slots[size[rank[order[slots]]] > 1]
        at = order[slots]
        block = at[(at % m == 0) & (at + m <= ends[at])]
        block.sort()
        yield m, block, rank[block], rank[block] + size[rank[block]]
        if not len(slots):
            return
        behind = at + m
        then = np.where(behind < ends[at], rank[np.minimum(behind, n - 1)], -1)
        by = np.argsort(rank[at] * (n + 1) + then + 1, kind="stable")
        group, then, at = rank[at[by]], then[by], at[by]
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        m *= 2


def reach(w: np.ndarray, at: int, q: int, stop: int, step: int) -> int:
    """How many places from ``at`` on, forwards or backwards, agree with those q behind them."""
    count, span = 0, 16
    left = (stop - q - at) if step > 0 else at - stop + 1
    while count < left:
        c = min(span, left - count)
        a = at + count if step > 0 else at - count - c + 1
        differ = np.flatnonzero(w[a : a + c] != w[a + q : a + q + c])
        if len(differ):
            return count + int(differ[0] if step > 0 else c - 1 - differ[-1])
        count, span = count + c, span * 4
    return count


def find_runs(h: np.ndarray, begins: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) in order of start and period, of texts whose words have the hashes ``h``.

    ``begins``: the place at which each text begins, and at last the number of words; starts count over all texts.
    """
    n = len(h)
    if n < least:
        return np.zeros((0, 3), np.int64)
    if times < 4:
        raise ValueError("dyadic blocks find all runs of four periods or more")
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    key = tn.mix(h + tn.mix(text.astype(np.uint64) + np.uint64(1)))  # a word of one text is no word of another
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    w, ends = rank.copy(), begins[1:][text]
    # period 1: the neighbouring window of a block of one word is one place
    same = np.concatenate([[False], w[1:] == w[:-1], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2] + 1
    out = [np.stack([start, length, np.ones_like(start)], axis=1)[length >= max(least, times)]]
    asked = [level for level in blocks(rank, order, ends) if level[0] > 1 and len(level[1])]
    if asked:
        m, place, lo, hi = (np.concatenate([np.full(len(level[1]), level[0]) if i == 0 else level[i] for level in asked]) for i in range(4))
        used = np.zeros(n + 1, np.int64)  # the slots that intervals of level 2 and above cover; deeper ones lie within
        np.add.at(used, lo, 1)
        np.add.at(used, hi, -1)
        used = np.cumsum(used)[:n] > 0
        dense = np.concatenate([[0], np.cumsum(used)])
        tree, lo, hi = Wavelet(order[used], int(n).bit_length()), dense[lo], dense[hi]
        own = tree.less(lo, hi, place)
        found = []
        for near in (own + 1, own - 1):
            there = np.flatnonzero((near >= 0) & (near < hi - lo))
            other = tree.nth(lo[there], hi[there], near[there])
            q = np.abs(other - place[there])
            good = (2 * q > m[there]) & (q <= m[there])
            found.append(np.stack([q, np.minimum(other, place[there]), m[there]], axis=1)[good])
        found = np.unique(np.concatenate(found), axis=0)
        seen, runs = (0, -1), []  # period and end of the last run: what begins inside it belongs to it
        for q, p, size in found.tolist():
            if q == seen[0] and p + size + q <= seen[1]:
                continue
            t = text[p]
            back = reach(w, p - 1, q, int(begins[t]), -1)
            on = reach(w, p + size, q, int(begins[t + 1]), 1)
            seen = q, p + size + on + q
            if (whole := back + size + on + q) >= max(least, times * q):
                runs.append((p - back, whole, q))
        out.append(np.array(runs, np.int64).reshape(-1, 3))
    out = np.concatenate(out)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeats(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in some run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def collapse(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 6, times: int = 4) -> DataFrame:
    """``keep`` columns, ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words without the repeats of any run, a space apart."""
    kinds = dict(docs.dtypes)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(batch.num_columns - 1))
            for a, b in tn.slices(offs):
                part, bounds = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, ends, row = tn.words(part, bounds, tn.SPACED)
                begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
                runs = find_runs(tn.span_hashes(part, starts, ends), begins, least, times)
                drop = repeats(runs, len(starts))
                of = np.searchsorted(begins, runs[:, 0], side="right") - 1
                raw, any_run = part.tobytes(), np.bincount(of, minlength=b - a) > 0
                texts = []
                for i, has in enumerate(any_run.tolist()):
                    words = raw[bounds[i] : bounds[i + 1]].split()
                    texts.append(b" ".join([words[j] for j in np.flatnonzero(~drop[begins[i] : begins[i + 1]]).tolist()] if has else words))
                count = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b - a))])
                fields = [pa.array(runs[:, 0] - begins[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"runs array<{RUN}>", "collapsed string"])
    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties: the smallest start, then period. Null without runs."""
    better = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(r, best), r).otherwise(best))


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with some texts turned periodic, as a generator that fell into a loop leaves them.

    With h the crc32 of the decimal id and g = h / 10: if 10 divides h, each word from a = g % n on becomes the word
    a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8) (whole divisions). A null id or text leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", SPACES), ""))
    # a generator stands between the words and their uses: put into one expression, they would be split again for each
    split = slim.select("*", F.explode(F.array(words)).alias("w")).withColumn("g", F.floor(F.col("h") / 10))
    split = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    turned = split.select("doc_id", "text", "w", "n", "a", F.explode(F.array(p)).alias("p"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return turned.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
