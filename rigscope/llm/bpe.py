"""Operator 12: byte-level BPE encoding by prefix dynamic programming, and decoding.

A rank file gives the bytes of each token; merging always joins the adjacent pair whose union has the least rank. A
sequence of tokens is what merging gives exactly if each adjacent pair of it is left apart by merging (``fits``), and
every prefix of a text has one such sequence. So its last token is unique, and is all that is stored: of the tokens that
end at a place, the one that fits the last token of the prefix before it. An Aho-Corasick automaton lists the tokens
that end at each place; the whole is linear in the text, whatever the text is.

As a prefix's last token depends on nothing behind it, appending extends the column of last tokens exactly; after an
edit the column is recomputed from there until as many places as the longest token has bytes agree with what was stored
(``Prefixes``); ``EditedText`` does so for texts that a pattern splits, re-splitting until the old matches recur.

On Spark, ``encode`` splits whole texts at boundaries that no match crosses, and each distinct unit between these is
matched and encoded once a worker (see ``tokens``); ``decode`` looks up the bytes of ids. There is no shuffle.

Cases: a null text is empty and has no ids; strings of special tokens are ordinary text; repeated rows and ids each
give their own row; other columns are ignored unless kept; an empty table gives no rows; null ids decode to no bytes;
an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm import tokens as tk

START, NONE = -1, -2


class Vocabulary:
    """Tokens of a rank file, how each was merged, and which pairs merging leaves apart."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.length = [len(b) for b in self.bytes_of]
        self.longest = max(self.length, default=0)
        self.head, self.tail, self.late = [-1] * size, [-1] * size, [-1] * size
        self.joint: dict[int, int] = {}
        self.known: list[dict[int, bool]] = [{START: True} for _ in range(size)]  # by right token, then left one
        self.count = 0
        self.automaton = ahocorasick.Automaton()
        for t, b in enumerate(self.bytes_of):
            parts = [t] if len(b) == 1 else self._merged(b, t) if b else []
            if len(parts) == 2:
                self.head[t], self.tail[t], self.late[t] = *parts, t
                self.joint[parts[0] << 24 | parts[1]] = t
            if len(b) == 1 or len(parts) == 2:  # else merging never makes it, and it stands only for a match as a whole
                self.automaton.add_word(b.decode("latin-1"), t)
        self.automaton.make_automaton()

    def _merged(self, data: bytes, below: int) -> list[int]:
        """What merging makes of some bytes with the ranks less than ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves them apart, found by taking back merges, the latest first."""
        first, last = left, right
        limit, late, joint = len(self.late), self.late, self.joint
        while (rank := joint.get(left << 24 | right, limit)) >= limit and (late[left] >= 0 or late[right] >= 0):
            # of equal merges the left one comes first
            if late[left] > late[right]:
                limit, left = late[left], self.tail[left]
            else:
                limit, right = late[right] + 1, self.head[right]
        if self.count >= tk.KEEP_UNITS:
            self.known, self.count = [{START: True} for _ in self.known], 0
        self.known[last][first] = rank >= limit
        self.count += 1
        return rank >= limit

    def extend(self, last: list[int], data: bytes, start: int):
        """Yields the last token of each prefix of ``data`` beyond ``start`` bytes and puts it in ``last``."""
        a = max(0, start - self.longest + 1)
        length, fits = self.length, self.fits
        for end, t in self.automaton.iter(data[a:].decode("latin-1")):
            end += a + 1
            if end <= start or len(last) > end:
                continue
            before = last[end - length[t]]
            if (f := self.known[t].get(before)) or f is None and fits(before, t):
                last.append(t)
                yield end

    def encode(self, match: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (whole := self.ranks.get(match)) is not None:
            return [whole]
        known, length, fits = self.known, self.length, self.fits
        last, done = [START], 0
        for end, t in self.automaton.iter(match.decode("latin-1")):  # as in ``extend``, without its pauses
            if end < done:
                continue
            before = last[end + 1 - length[t]]
            if (f := known[t].get(before)) or f is None and fits(before, t):
                last.append(t)
                done = end + 1
        return self.walk(last, done)

    def walk(self, last: list[int], end: int) -> list[int]:
        """Tokens of a prefix, from its last token back."""
        out = []
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(b): int(i) for b, i in (line.split() for line in f if line.strip())})


class Prefixes:
    """The unique last token of every prefix of one match; appends and edits are exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [START]
        self.append(data)

    def append(self, more: bytes) -> int:
        """Adds bytes; the number of prefixes computed."""
        start, self.data = len(self.data), self.data + more
        return sum(1 for _ in self.vocabulary.extend(self.last, self.data, start))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in the place of some bytes; the number of prefixes computed until old ones hold again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agree, computed = old[: start + 1], 0, 0
        for at in self.vocabulary.extend(self.last, self.data, start):
            computed += 1
            agree = agree + 1 if at > start + len(new) and old[at - shift] == self.last[at] else 0
            if agree >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                break
        return computed

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.walk(self.last, len(self.data))


class EditedText:
    """A text split by a pattern, each match with its prefixes, kept under edits."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.matches = text, [(m.start(), Prefixes(vocabulary, m.group().encode())) for m in self.pattern.finditer(text)]

    def replace(self, start: int, end: int, new: str) -> int:
        """Characters ``start`` to ``end`` give way to ``new``; the number of matches split anew.

        Matching looks at most past the white space behind a match, so it starts anew one match before the last that
        ends before the edit, and stops where a match behind the edit begins where an old one did.
        """
        old, shift = self.matches, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, sum(1 for at, _ in old if at < start) - 2)
        begin = old[first][0] if old else 0
        place = {at + shift: i for i, (at, _) in enumerate(old) if at >= end}
        fresh, rest = [], []
        for m in self.pattern.finditer(self.text, begin):
            if m.start() >= start + len(new) and m.start() in place:
                rest = [(at + shift, p) for at, p in old[place[m.start()] :]]
                break
            fresh.append((m.start(), Prefixes(self.vocabulary, m.group().encode())))
        self.matches = old[:first] + fresh + rest
        return len(fresh)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for _, p in self.matches for i in p.ids()]


class Encoder(tk.Encoder):
    """Ids of many texts; each distinct unit is split by the pattern and encoded once."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        super().__init__(path, tk.led_units, ids=True)

    def open(self, path: str) -> int:
        self.vocabulary = load(path)
        return len(self.vocabulary.bytes_of)

    def tokens_of(self, units: list[bytes]):
        split, encode = self.pattern.findall, self.vocabulary.encode
        return [[i for m in split(u.decode()) for i in encode(m.encode())] for u in units]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the token ids of each whole text. ``ranks``: a rank file that executors see."""
    kinds = dict(docs.dtypes)
    names = [*keep, "ids"]

    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(batch.num_columns - 1))
            for a, b in tn.slices(offs):
                n, flat = encoder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), ids], names=names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids array<int>"])
    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = load(path).bytes_of
    return np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum([len(b) for b in tokens])]


def decoded(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ids in a row, and where each id's begin."""
    flat, at = _table(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(at) - 1):
        raise ValueError("an id outside the vocabulary")
    size = at[ids + 1] - at[ids]
    begin = np.r_[0, np.cumsum(size)]
    return flat[np.arange(begin[-1]) + np.repeat(at[ids] - begin[:-1], size)], begin


def decode(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the bytes of their ids."""
    kinds = [(c, t) for c, t in rows.dtypes if c != "decoded"]
    place = [c for c, _ in kinds].index(ids)

    def run(batches):
        for batch in batches:
            lists = batch.column(place)
            offs = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for a, b in tn.slices(offs * 4):
                out, begin = decoded(flat[offs[a] : offs[b]].astype(np.int64), ranks)
                bounds = begin[offs[a : b + 1] - offs[a]].astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), text], names=[*batch.schema.names, "decoded"])

    return rows.select(*(F.col(f"`{c}`") for c, _ in kinds)).mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kinds), "decoded binary"]))
