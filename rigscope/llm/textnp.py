"""Vectorised text helpers over Arrow string buffers: words, word hashes, shingles.

Everything here works on one bounded slice of an Arrow batch at a time (see ``slices``), so the
memory of a task does not depend on how many rows the batch holds. A text longer than a slice stands alone, and
operators work through it in ``stretches`` cut at white space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
LONG_SPAN = 1024
_U = np.uint64
_LENGTH, _STEP = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SHINGLE = np.random.default_rng(77).integers(0, 1 << 63, 5, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mask(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, false for the bytes in the closed ranges (the separators)."""
    out = np.ones(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Words are runs without ASCII white space.
SPACED = mask((9, 13), (32, 32))
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
ALNUM = mask((0, 47), (58, 64), (91, 96), (123, 127))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 20):
    """Row ranges [a, b) of about ``most`` bytes and at most ``rows`` rows each; a longer text stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def stretches(data: np.ndarray, most: int = 4 * SLICE_BYTES):
    """Byte ranges [a, b) of a long text, of about ``most`` bytes each, cut before white space (a longer word stays whole)."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + most, n)
        if b < n:
            space = np.flatnonzero(~SPACED[data[a + 1 : b]])
            while not len(space) and b < n:
                more = min(b + most, n)
                space = np.flatnonzero(~SPACED[data[b:more]])[:1] + (b - a - 1)
                b = more
            b = a + 1 + int(space[-1]) if len(space) else n
        yield a, b
        a = b


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[data]
    full = offs[:-1] < offs[1:]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[offs[:-1][full]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[offs[1:][full] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time, each mixed in by a bijection; BLAKE2 for very long spans.

    No two spans of equal length up to eight bytes share one, and longer ones only by chance.
    """
    size = ends - starts
    h = mix(size.astype(_U) * _LENGTH + _LENGTH)
    if not len(starts):
        return h
    eights, live = _eights(data), np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        rest = np.minimum(size[live] - done, 8)
        h[live] = mix((h[live] ^ (eights[starts[live] + done] & _TAILS[rest])) * _STEP)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each byte span equals another, byte by byte."""
    size = ends - starts
    same = size == other_ends - others
    eights, live, done = _eights(data), np.flatnonzero(same & (starts != others) & (size > 0)), 0
    while len(live):
        long = size[live] - done > LONG_SPAN
        for i in live[long].tolist():
            same[i] = np.array_equal(data[starts[i] : ends[i]], data[others[i] : other_ends[i]])
        live = live[~long]
        tail = _TAILS[np.minimum(size[live] - done, 8)]
        alike = (eights[starts[live] + done] & tail) == (eights[others[live] + done] & tail)
        same[live[~alike]] = False
        done += 8
        live = live[alike & (size[live] > done)]
    return same


def hashed_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of every word in lower case; ``is_word`` leaves out white space. A long text goes in stretches."""
    if len(offs) == 2 and len(data) > 4 * SLICE_BYTES:
        parts = []
        for a, b in stretches(data):
            low = LOWER[data[a:b]]
            starts, ends, _ = words(low, np.array([0, b - a]), is_word)
            parts.append((span_hashes(low, starts, ends), starts + a, ends + a))
        h, starts, ends = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return h, starts, ends, np.zeros(len(h), np.int64)
    low = LOWER[data]
    starts, ends, row = words(low, offs, is_word)
    return span_hashes(low, starts, ends), starts, ends, row


def shingles(h: np.ndarray, row: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle (k up to 5); a row of fewer words has its whole sequence as one."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, rows = [], []
    if n >= k:
        s = h[: n - k + 1] * _SHINGLE[0]
        for j in range(1, k):
            s = s + h[j : n - k + 1 + j] * _SHINGLE[j]
        whole = row[: n - k + 1] == row[k - 1 :]
        out.append(mix(s[whole]))
        rows.append(row[: n - k + 1][whole])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    for c in range(1, k):
        f = first[count == c]
        if len(f):
            s = h[f] * _SHINGLE[0]
            for j in range(1, c):
                s = s + h[f + j] * _SHINGLE[j]
            out.append(mix(s ^ _U(c * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
            rows.append(row[f])
    out, rows = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return out[order], rows[order]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by row, then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[keep], row[keep]
