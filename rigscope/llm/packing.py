"""Operator 10: mixture-controlled packing of token streams into windows, by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round, which fills one window of ``window`` tokens, a queue
earns its quantum, the window times its target share; it gives the whole tokens that it has earned, and what it has
earned beyond or not yet given is its deficit, which it carries to the next window. Targets are shares of the tokens by
source; sources without one divide what is left by their sizes (without any targets: all by their sizes, so that all
run dry together). When a queue can't earn a whole window's quantum any more, it gives its rest and the others' quanta
grow in proportion: such changes end phases, of which there are at most two a queue.

As quanta are constant within a phase, the deficits after any number of its windows have a closed form: token j of a
queue that gives Q tokens in the phase falls due at (2j + 1) / 2Q of it, and the first w windows hold the w * window
tokens that are due first (ties: queue order). So each task knows the deficits it starts from without a pass over the
windows before it: they are carried across windows and partitions. No deficit reaches a token and a half.

Plan: one pass tokenizes and writes ids (two bytes each) with each row's place in its partition's part of its queue;
totals by (partition, queue) give every part's start and are broadcast if they are few (else joined by shuffle); a
second pass over the written ids cuts the pieces. No row meets another one, so no source is hot.

The ``MOST_QUEUES`` - 1 largest sources have queues of their own. Smaller ones, where there are more, share one queue,
in which each partition's documents stand in the order in which their own queues would have had them due.

Cases: null and empty texts are documents of one token (the closing id); a null source is a queue of its own;
repeated rows are packed each; an empty table gives no rows; other columns are ignored; a target for an unknown source
has no effect; targets must be positive and no more than 1 in sum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from fractions import Fraction
from functools import lru_cache
from heapq import heapify, heappop, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm import tokens as tk
from rigscope.llm.common import BROADCAST_KEYS, written

MOST_QUEUES = 1024
OTHERS = -2
SHARE_UNIT = 1 << 40
REMEMBERED = 1 << 21  # numbers of windows' ends that a worker keeps


@lru_cache(maxsize=2)
def _encoder(path: str) -> tk.Encoder:
    return tk.Encoder(path, tk.spaced_units, ids=True, lower=True)


def apportioned(whole: int, weights: list[int]) -> list[int]:
    """``whole`` tokens divided by weights; what rounding leaves goes to the largest remainders."""
    total = sum(weights)
    out = [whole * w // total for w in weights]
    for s in sorted(range(len(weights)), key=lambda s: (-(whole * weights[s] % total), s))[: whole - sum(out)]:
        out[s] += 1
    return out


def phases(totals: list[int], weights: list[int], window: int) -> list[list[int]]:
    """What each queue gives in each phase; all but the last are whole windows."""
    left, out = list(totals), []
    while (whole := sum(left)) > window:
        earning = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        if not any(earning):  # only queues without a share are left: by size
            earning = list(left)
        total = sum(earning)
        windows = min(n * total // (w * window) for w, n in zip(earning, left, strict=True) if w)
        if windows:
            give = apportioned(windows * window, earning)
        else:
            give, open_ = [0] * len(left), window
            while open_:  # who can't earn the quantum gives its rest, and the others fill the window
                if not any(earning):
                    earning = [n - g for n, g in zip(left, give, strict=True)]
                share = apportioned(open_, earning)
                lacking = [s for s, x in enumerate(share) if x and give[s] + x >= left[s]]
                for s in lacking or range(len(left)):
                    more = min(share[s], left[s] - give[s])
                    give[s], open_ = give[s] + more, open_ - more
                    if s in lacking:
                        earning[s] = 0
        out.append(give)
        left = [n - g for n, g in zip(left, give, strict=True)]
    return [*out, left] if any(left) else out


class Dues:
    """Tokens of each queue among the first w windows of a phase."""

    def __init__(self, totals: list[int], window: int):
        self.q, self.all, self.window = totals, sum(totals), window
        self.n = -(-self.all // window)
        self.made: dict[int, tuple[int, ...]] = {}

    def __call__(self, w: int) -> tuple[int, ...]:
        if w not in self.made:
            if len(self.made) * len(self.q) > REMEMBERED:
                self.made.clear()
            self.made[w] = self._at(min(w * self.window, self.all))
        return self.made[w]

    def deficits(self, w: int) -> list[Fraction]:
        """What each queue has earned and not given after w windows (negative: given in advance)."""
        rank = min(w * self.window, self.all)
        return [Fraction(rank * q, self.all) - c for q, c in zip(self.q, self(w), strict=True)]

    def _at(self, rank: int) -> tuple[int, ...]:
        q, total = self.q, self.all
        if not total:
            return tuple(q)
        c = [(2 * x * rank + total) // (2 * total) for x in q]
        gap = rank - sum(c)
        if gap > 0:  # the tokens due next
            due = [(((2 * c[s] + 1) << 96) // (2 * x), s) for s, x in enumerate(q) if c[s] < x]
            heapify(due)
            for _ in range(gap):
                s = due[0][1]
                c[s] += 1
                if c[s] < q[s]:
                    heapreplace(due, (((2 * c[s] + 1) << 96) // (2 * q[s]), s))
                else:
                    heappop(due)
        elif gap < 0:  # those due last
            due = [(-(((2 * c[s] - 1) << 96) // (2 * x)), -s) for s, x in enumerate(q) if c[s]]
            heapify(due)
            for _ in range(-gap):
                s = -due[0][1]
                c[s] -= 1
                if c[s]:
                    heapreplace(due, (-(((2 * c[s] - 1) << 96) // (2 * q[s])), -s))
                else:
                    heappop(due)
        return tuple(c)

    def window_of(self, s: int, place: int) -> int:
        """The window that holds token ``place`` of queue s."""
        w = max(0, min(self.n - 1, place * self.all // (self.q[s] * self.window)))
        while self(w)[s] > place:
            w -= 1
        while self(w + 1)[s] <= place:
            w += 1
        return w


class Run:
    """All phases: pieces of a row of n tokens at place ``at`` of queue s, as (start, length, sequence, offset)."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.phases = [Dues(give, window) for give in phases(totals, weights, window)]
        self.starts = [[0, *accumulate(d.q[s] for d in self.phases)][:-1] for s in range(len(totals))]
        self.windows = [0, *accumulate(d.n for d in self.phases)]
        self.bases: dict[tuple[int, int], list[int]] = {}

    def base(self, p: int, w: int) -> list[int]:
        """Where each queue's tokens begin in a window."""
        if (p, w) not in self.bases:
            if len(self.bases) * len(self.starts) > REMEMBERED:
                self.bases.clear()
            here, there = self.phases[p](w), self.phases[p](w + 1)
            self.bases[p, w] = [0, *accumulate(b - a for a, b in zip(here, there, strict=True))]
        return self.bases[p, w]

    def pieces(self, s: int, at: int, n: int):
        start = 0
        while start < n:
            p = bisect_right(self.starts[s], at + start) - 1
            dues, before = self.phases[p], self.starts[s][p]
            w = dues.window_of(s, at + start - before)
            while start < n and at + start < before + dues.q[s]:
                place = at + start - before
                if length := min(n - start, dues(w + 1)[s] - place):
                    yield start, length, self.windows[p] + w, self.base(p, w)[s] + place - dues(w)[s]
                    start += length
                w += 1


def weights_of(queues: list[int], sizes: list[int], targets: dict[int, float]) -> list[int]:
    """Whole weights of the queues, from the shares of those that have a target and the sizes of the others."""
    if any(t <= 0 for t in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets must be positive and no more than 1 in sum")
    if not targets:
        return sizes
    rest = max(0, SHARE_UNIT - sum(round(t * SHARE_UNIT) for t in targets.values()))
    others = max(1, sum(n for q, n in zip(queues, sizes, strict=True) if q not in targets))
    return [round(targets[q] * SHARE_UNIT) if q in targets else n * rest // others for q, n in zip(queues, sizes, strict=True)]


def pack(docs: DataFrame, tokenizer: str, closing_id: int, window: int = 2048, text: str = "text", source: str = "source", doc_id: str = "doc_id", texts: bool = False, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, padded_length).

    ``targets``: shares of the tokens by source (see above). ``texts`` adds the pieces' ids as an array. A sequence is
    padded to ``window`` unless it ends at a power of two.
    """
    kind = dict(docs.dtypes)[doc_id]

    def encode(batches):
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        close = np.array([closing_id], encoder.dtype).tobytes()
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(3))
            queues = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in tn.slices(offs):
                totals, flat = encoder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ends, places = np.cumsum(totals), []
                for q, n in zip(queues[a:b].tolist(), (totals + 1).tolist(), strict=True):
                    places.append(seen.get(q, 0))
                    seen[q] = places[-1] + n
                ids = [flat[e - n : e].tobytes() + close for e, n in zip(ends.tolist(), totals.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(places, pa.int64()), pa.array(totals + 1), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "queue", "part", "place", "n", "ids"],
                )

    def queue(name: str):
        c = F.col(f"`{name}`").cast("string")
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40)))

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), queue(source).alias("queue"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = written(slim.mapInArrow(encode, f"doc_id {kind}, source string, queue bigint, part int, place bigint, n bigint, ids binary"), "packing-ids")

    parts = ids.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    most = parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "queue").limit(MOST_QUEUES + 1).collect()
    if len(most) > MOST_QUEUES:
        ids = _with_others(ids, [r["queue"] for r in most[: MOST_QUEUES - 1]])
        parts = ids.groupBy("part", "queue").agg(F.sum("n").alias("n"))
        most = parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()  # MOST_QUEUES rows
    totals = {r["queue"]: r["n"] for r in most}
    queues = sorted(totals)
    named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in (targets or {}).items()], "name string, share double")
    shares = {r["q"]: r["share"] for r in named.select(queue("name").alias("q"), "share").collect()} if targets else {}
    before = F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select(F.col("part").alias("p"), F.col("queue").alias("q"), F.coalesce(before, F.lit(0)).alias("base"))
    starts = written(starts, "packing-starts")
    joined = ids.join(F.broadcast(starts) if starts.count() <= BROADCAST_KEYS else starts, (F.col("part") == F.col("p")) & (F.col("queue") == F.col("q")))

    order, sizes, wide = {q: s for s, q in enumerate(queues)}, [totals[q] for q in queues], load_width(tokenizer)

    weights = weights_of(queues, sizes, shares)

    def cut(batches):
        run = Run(sizes, weights, window)
        for batch in batches:
            rows: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for doc, src, q, at, n, raw in zip(*cols, strict=True):
                values = np.frombuffer(raw, wide).astype("<u4")
                blob = values.tobytes()
                for start, length, sequence, offset in run.pieces(order[q], at, n):
                    rows.append((doc, start, length, zlib.crc32(blob[4 * start : 4 * (start + length)]), n, sequence, offset, src, *([values[start : start + length].tolist()] if texts else ())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([batch.schema.types[0], *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int64())] * texts])], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *["ids"] * texts]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string" + ", ids array<bigint>" * texts
    pieces = joined.select("doc_id", "source", "queue", (F.col("base") + F.col("place")).alias("at"), "n", "ids").mapInArrow(cut, schema)
    whole = sum(sizes)
    filled = F.least(F.lit(window), F.lit(whole) - F.col("sequence_id") * window)
    power = F.bit_count(filled) == 1
    return pieces.withColumn("padded_length", F.when(power, filled).otherwise(F.lit(window)).cast("long"))


def load_width(tokenizer: str):
    return np.uint16 if tk.load(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32


def _with_others(ids: DataFrame, own: list[int]) -> DataFrame:
    """``ids`` with one queue for all but ``own``: in each partition in the order in which these fall due, with places anew."""
    of_own = F.col("queue").isin(own)
    w = W.partitionBy("part", "queue")
    due = (2 * F.col("place") + F.col("n")) / (2 * F.sum("n").over(w))
    rest = ids.where(~of_own).withColumn("due", due)
    again = W.partitionBy("part").orderBy("due", "queue", "place").rowsBetween(W.unboundedPreceding, -1)
    rest = rest.withColumn("place", F.coalesce(F.sum("n").over(again), F.lit(0))).withColumn("queue", F.lit(OTHERS).cast("bigint")).drop("due")
    return written(ids.where(of_own).unionByName(rest), "packing-ids")
