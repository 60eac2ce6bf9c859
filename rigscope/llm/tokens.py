"""Batch tokenization that encodes each distinct text unit once.

A tokenizer whose pre-tokenizer never joins across a boundary gives a text the concatenation of what it
gives the units between the boundaries. Two kinds of safe boundary are used: runs of ASCII white space
(tokenizers that drop white space), and a single space between two characters that are not white space
(byte-level tokenizers that attach the space to the word after it). Units repeat heavily, so a worker keeps
the tokens of the units that it has met, up to a fixed number, under their bytes. Units of one slice are brought
together by a 64-bit hash and compared byte by byte, so results are exact.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from rigscope.llm import textnp as tn

KEEP_UNITS = 500_000
_VISIBLE = tn.mask((0, 32))
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_ASCII_LETTERS = ~tn.mask((65, 90), (97, 122))


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _inner_cuts(data: np.ndarray) -> np.ndarray:
    """Positions between a letter (ASCII or Latin-1) and a punctuation mark, in either order."""
    marks, letter = _MARKS[data], _ASCII_LETTERS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    first = letter.copy()
    first[lead] = True
    letter[lead + 1] = True
    return np.flatnonzero((letter[:-1] & marks[1:]) | (marks[:-1] & first[1:])) + 1


def spaced_units(data: np.ndarray, offs: np.ndarray):
    """Units between runs of ASCII white space, for tokenizers that drop it."""
    starts, ends, _ = tn.words(data, offs, tn.SPACED)
    if not len(starts):
        return starts, ends, starts
    inner = np.setdiff1d(_inner_cuts(data), offs, assume_unique=True)
    starts, ends = np.sort(np.r_[starts, inner]), np.sort(np.r_[ends, inner])
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def led_units(data: np.ndarray, offs: np.ndarray):
    """Units that begin at a text's start or at a lone space between two visible characters.

    After bytes that may end a white space character beyond ASCII no boundary is set.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n, bool)
    if n > 2:
        seen = _VISIBLE[data]
        cut[1:-1] = (data[1:-1] == 32) & seen[:-2] & seen[2:]
        at = np.flatnonzero(cut)
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        cut[at[(data[at - 1] >= 128) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))]] = False
    edges = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    cut[last] = False
    cut[_inner_cuts(data)] = True
    cut[edges] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], n], np.searchsorted(offs, starts, side="right") - 1


class Encoder:
    """Token ids of many texts by distinct unit. ``ids`` false: lengths only."""

    keep = KEEP_UNITS

    def __init__(self, path: str, units, ids: bool, lower: bool = False):
        """``lower``: the tokenizer itself folds case, so ASCII letters may be folded before units are told apart."""
        self.units, self.ids, self.lower = units, ids, lower
        self.dtype = np.uint16 if self.open(path) <= 1 << 16 else np.uint32
        self.clear()

    def open(self, path: str) -> int:
        """Loads the tokenizer; the size of its vocabulary."""
        self.tokenizer = load(path)
        return self.tokenizer.get_vocab_size()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.lens = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def tokens_of(self, units: list[bytes]):
        """Token ids of each unit; without ``ids`` their numbers will do."""
        found = self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
        return [x.ids for x in found] if self.ids else list(map(len, found))

    def _learn(self, units: list[bytes]) -> None:
        got = self.tokens_of(units)
        lens = np.fromiter(map(len, got) if self.ids else got, np.int64, len(got))
        base = len(self.lens)
        self.place.update(zip(units, range(base, base + len(lens)), strict=True))
        self.lens = np.concatenate((self.lens, lens))
        if self.ids:
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(lens) - lens))
            self.flat = np.concatenate((self.flat, np.fromiter((i for x in got for i in x), self.dtype, int(lens.sum()))))

    def encode(self, data: np.ndarray, offs: np.ndarray, most: int = 4 * tn.SLICE_BYTES):
        """Tokens of each row, and with ``ids`` the flat token ids of all rows in order.

        A single text of more than ``most`` bytes is worked off in pieces that end where a unit begins.
        """
        if len(offs) == 2 and len(data) > most:
            total, flat, a, size = 0, [], 0, most
            while a < len(data):
                end = min(a + size, len(data))
                starts = self.units(data[a:end], np.array([0, end - a]))[0]
                if end < len(data) and (not len(starts) or not starts[-1]):
                    size *= 2  # one unit fills the piece
                    continue
                end = a + int(starts[-1]) if end < len(data) else end
                n, ids = self._encode(data[a:end], np.array([0, end - a]))
                total, flat, a, size = total + int(n[0]), [*flat, ids], end, most
            return np.array([total]), np.concatenate(flat) if self.ids else None
        return self._encode(data, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray):
        if self.lower and b"<|" not in data.tobytes():
            data = tn.LOWER[data]
        starts, ends, row = self.units(data, offs)
        n = len(offs) - 1
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(0, self.dtype)
        _, first, back = np.unique(tn.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        back = back.ravel()
        like = first[back]
        odd = np.flatnonzero(~tn.equal_spans(data, starts, ends, starts[like], ends[like]))
        if len(odd):  # other units under the hash of one: each counts for itself
            back[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate((first, odd))
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.place) + len(units) > self.keep:
            self.clear()
        get = self.place.get
        place = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        if len(new):
            base = len(self.lens)
            self._learn([units[i] for i in new.tolist()])
            place[new] = base + np.arange(len(new))
        place = place[back]
        lens = self.lens[place]
        totals = np.bincount(row, weights=lens, minlength=n).astype(np.int64)
        if not self.ids:
            return totals, None
        total = int(lens.sum())
        shift = np.repeat(self.at[place] - (np.cumsum(lens) - lens), lens)
        return totals, self.flat[np.arange(total) + shift]
