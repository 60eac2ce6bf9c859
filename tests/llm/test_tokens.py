import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from rigscope.llm import textnp as tn  # noqa: E402
from rigscope.llm import token_counts  # noqa: E402
from rigscope.llm import tokens as tk  # noqa: E402

ODD = [
    None,
    "",
    " ",
    "a   x  y <|endoftext|> b",
    "I'm  don't\n\n x's   ",
    "É   　xé ",
    "(é).x,y!<|endoftext|>a  ,b Ü.×.a ÷,c don't.x's <|ENDOFTEXT|>",
    "日本語 テキスト。abc 12,345.67",
    "x" * 5000,
    "word " * 3000,
    "é á, ≠ \x1c\x1d a\x7fb  c \x85d",
    "'s't 'll ''s .'s x.'s x'. \"it's\"",
    "a,b;c:d e_f g-h",
]


@pytest.mark.parametrize("name,units,ids", [("byte_bpe_50k.json", tk.led_units, True), ("word_bpe_49k.json", tk.spaced_units, True)])
def test_same_as_library(name, units, ids):
    path = public_tokenizers.path(name)
    g = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "'s", "'", ",", ".", "<|endoftext|>", "<", "|", "9", "日", " ", "Σ", "ς", "İ"]
    texts = ODD + ["".join(g.choice(alphabet) for _ in range(g.randrange(60))) for _ in range(400)]
    data, offs = tn.buffer_of(pa.array(texts, pa.string()))
    lens, flat = tk.Encoder(path, units, ids=True, lower=units is tk.spaced_units).encode(data, offs)
    ends = np.cumsum(lens)
    for t, n, e in zip(texts, lens, ends, strict=True):
        assert flat[e - n : e].tolist() == tk.load(path).encode(t or "", add_special_tokens=False).ids, repr(t)


def test_counts(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "x")]
    got = token_counts.with_limit(token_counts.token_counts(docs_of(rows, "n_tokens"), path), 1024).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(tk.load(path).encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(docs_of([]), path).count() == 0


def test_slices_are_bounded():
    offs = np.r_[0, np.cumsum([10] * 100 + [1000] + [0] * 50)]
    parts = list(tn.slices(offs, 100, 20))
    assert [a for a, _ in parts][0] == 0 and parts[-1][1] == 151 and all(b[0] == a[1] for a, b in zip(parts, parts[1:], strict=False))
    assert all(offs[b] - offs[a] <= 100 or b == a + 1 for a, b in parts) and all(b - a <= 20 for a, b in parts)


def test_units_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(tk.Encoder, "keep", 10)
    e = tk.Encoder(public_tokenizers.path("word_bpe_49k.json"), tk.spaced_units, ids=True, lower=True)
    for t in (" ".join(f"w{i}" for i in range(9)), " ".join(f"v{i}" for i in range(9))):
        data, offs = tn.buffer_of(pa.array([t]))
        lens, flat = e.encode(data, offs)
        assert flat.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids and len(e.place) <= 10


@pytest.mark.parametrize("name,units", [("byte_bpe_50k.json", tk.led_units), ("word_bpe_49k.json", tk.spaced_units)])
def test_long_texts_in_pieces(name, units):
    path = public_tokenizers.path(name)
    e = tk.Encoder(path, units, ids=True, lower=units is tk.spaced_units)
    g = random.Random(4)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "'s", "'", ",", ".", "9", "日", "word", "\u3000", "Σ"]
    texts = [t for t in ODD if t] + ["".join(g.choice(alphabet) for _ in range(g.randrange(200, 900))) for _ in range(60)]
    for t in texts:
        data, offs = tn.buffer_of(pa.array([t]))
        for most in (40, 200):
            n, ids = e.encode(data, offs, most)
            assert ids.tolist() == tk.load(path).encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_very_long_text(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "some words, and more of them. " * 500_000
    row = token_counts.token_counts(docs_of([text]), path).first()
    one = len(tk.load(path).encode("some words, and more of them. some words, and more of them. ", add_special_tokens=False).ids) - len(tk.load(path).encode("some words, and more of them. ", add_special_tokens=False).ids)
    assert row["n_bytes"] == len(text) and abs(row["n_tokens"] - one * 500_000) <= 1


@pytest.mark.parametrize("name,units", [("byte_bpe_50k.json", tk.led_units), ("word_bpe_49k.json", tk.spaced_units)])
def test_words_that_polynomial_hashes_confuse(name, units):
    path = public_tokenizers.path(name)
    e = tk.Encoder(path, units, ids=True, lower=units is tk.spaced_units)
    for k in range(10, 15):
        w = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
        texts = [w, w.translate(str.maketrans("ab", "ba"))]
        data, offs = tn.buffer_of(pa.array(texts))
        n, ids = e.encode(data, offs)
        assert ids.tolist() == [i for t in texts for i in tk.load(path).encode(t, add_special_tokens=False).ids]


def test_units_under_one_hash_stay_apart(monkeypatch):
    """Even if all hashes were equal, units are told apart by their bytes."""
    monkeypatch.setattr(tn, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    e = tk.Encoder(public_tokenizers.path("word_bpe_49k.json"), tk.spaced_units, ids=True, lower=True)
    text = "one two three one longwordofmanyletters two longwordofmanyletterz"
    data, offs = tn.buffer_of(pa.array([text]))
    assert e.encode(data, offs)[1].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
