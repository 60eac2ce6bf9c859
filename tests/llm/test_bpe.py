import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from rigscope.llm import bpe  # noqa: E402
from rigscope.llm import textnp as tn  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a   x  y <|endoftext|> b", "I'm  don't\n\n x's   ", "É   　xé ", "日本語 テキスト。abc 12,345.67", "a" * 3000, "ab" * 2000, "word " * 500, "'s't 'll ''s .'s", "\x00\x1c \x85d", "👩‍👩‍👧 éa"]


@pytest.fixture(scope="module")
def library():
    v = bpe.load(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def random_texts(n, seed=0):
    g = random.Random(seed)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "'s", "'", ",", "the", "ing", "9", "日", " ", "Σ", "о", "ка", "ü", "ab", "ba", "\t"]
    return ["".join(g.choice(alphabet) for _ in range(g.randrange(80))) for _ in range(n)]


def test_matches_equal_the_library(library):
    v = bpe.load(PATH)
    g = random.Random(3)
    vocabulary = [b for b in v.bytes_of if b]
    for i in range(1500):  # raw bytes, as one match each
        data = b"".join(g.choice(vocabulary) for _ in range(g.randrange(1, 5))) if i % 2 else bytes(g.choice(b"aab e\xc3\xa9") for _ in range(g.randrange(1, 40)))
        assert v.encode(data) == library._core_bpe.encode_single_piece(data), data
    for t in ["aaaaaaa", "abababababab", "eeee" * 9]:
        assert v.encode(t.encode()) == library._core_bpe.encode_single_piece(t.encode())


def test_texts_equal_the_library(library):
    texts = ODD + random_texts(500)
    data, offs = tn.buffer_of(pa.array(texts, pa.string()))
    lens, flat = bpe.Encoder(PATH, public_tokenizers.PATTERN).encode(data, offs)
    ends = np.cumsum(lens)
    for t, n, e in zip(texts, lens, ends, strict=True):
        assert flat[e - n : e].tolist() == library.encode_ordinary(t or ""), repr(t)


def test_appends_and_edits_of_a_match():
    v, g = bpe.load(PATH), random.Random(5)
    data = bytes(g.choice(b"etaoin shrdlu") for _ in range(4000))
    p = bpe.Prefixes(v)
    for a in range(0, len(data), 37):
        p.append(data[a : a + 37])
    assert p.last == bpe.Prefixes(v, data).last and p.ids() == v.encode(data)
    for _ in range(60):
        a = g.randrange(len(p.data))
        b, new = min(len(p.data), a + g.randrange(9)), bytes(g.choice(b"aeiou st") for _ in range(g.randrange(6)))
        computed = p.replace(a, b, new)
        assert p.last == bpe.Prefixes(v, p.data).last
        assert computed < 1000 + v.longest * 4  # near the edit, not the whole


def test_edited_texts(library):
    v, g = bpe.load(PATH), random.Random(6)
    text = " ".join(random_texts(40, 1))
    e = bpe.EditedText(v, public_tokenizers.PATTERN, text)
    assert e.ids() == library.encode_ordinary(text)
    for new in random_texts(80, 2):
        a = g.randrange(len(e.text) + 1)
        fresh = e.replace(a, min(len(e.text), a + g.randrange(12)), new[:10])
        assert e.ids() == library.encode_ordinary(e.text) and fresh < 40
    e.append("  tail's")
    assert e.ids() == library.encode_ordinary(e.text)


def test_on_spark(spark, docs_of, library):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "x"), (99, "lorem ipsum, dolor " * 60_000)]
    got = bpe.decode(bpe.encode(docs_of(rows, "ids"), PATH, public_tokenizers.PATTERN), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=key) == want
    assert bpe.decode(bpe.encode(docs_of([]), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_unknown_ids(spark):
    assert spark.createDataFrame([(1, None), (2, [])], "a int, ids array<int>").transform(lambda d: bpe.decode(d, PATH)).collect()[0]["decoded"] == b""
    with pytest.raises(ValueError):
        bpe.decoded(np.array([10**6]), PATH)
