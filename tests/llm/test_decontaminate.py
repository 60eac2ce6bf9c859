import hashlib
import random
import re

import pytest

from rigscope.llm import decontaminate

from .conftest import LETTERS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LETTERS))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(window, len(w))
            wins.setdefault(str(i), set()).update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, ws in wins.items():
            for x in ws:
                for s in range(len(w) - len(x) + 1):
                    if tuple(w[s : s + len(x)]) == x:
                        hit.update(range(s, s + len(x)))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, word string")
    rows = decontaminate.decontaminate(docs, b).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in rows), key=repr)


def case(seed=0):
    g = random.Random(seed)
    word = lambda: g.choice("the of and to in éa zü x1 B2 cat dog sun".split()) if g.random() < 0.7 else f"w{g.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(g.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for i in range(25)]
    items += [(90, None), (91, " ... "), (None, "never seen words here"), (3, items[3][1]), (2, "another text of item two which is longer than the window of words so")]
    docs = []
    for i in range(80):
        t = [word() for _ in range(g.randrange(0, 120))]
        for _ in range(g.randrange(3)):
            x = (items[g.randrange(25)][1] or "").split()
            cut = x[g.randrange(len(x)) :] if g.random() < 0.3 else x
            at = g.randrange(len(t) + 1)
            t[at:at] = [c.upper() if g.random() < 0.2 and c.isascii() else c for c in cut]
        docs.append((i, g.choice([" ", ", ", "\n"]).join(t)))
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (6, "other text of a known id"), (None, items[6][1]), (203, " ".join([items[7][1]] * 40))]
    return docs, items


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 60])
def test_brute_force(spark, docs_of, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "STRETCH", 4096 if rows > 60 else 17)
    docs, items = case()
    assert got(spark, docs_of(docs, "word"), items) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    assert got(spark, docs_of([]), [(1, "a b")]) == []
    assert got(spark, docs_of(["a b c"]), []) == [(0, 3, 0, (), False)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_no_python_in_plan(spark, docs_of):
    b = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = decontaminate.decontaminate(docs_of(["a b c"]), b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_equal_rows(spark, docs_of):
    """Equal rows cost their own row each and are grouped once."""
    item = " ".join(f"q{i}" for i in range(16))
    docs = [(7, f"before {item} after")] * 5000 + [(8, f"before {item} after")] * 5000 + [(9, "clean words here")]
    rows = got(spark, docs_of(docs).repartition(4), [(1, item)])
    assert len(rows) == 10001 and rows[0] == (7, 18, 16, ("1",), True) and rows[-1] == (9, 3, 0, (), False)
    assert len(set(rows)) == 3


def test_very_long_text(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(40))
    text = " ".join(f"w{i % 997}" for i in range(300_000)) + " " + " ".join([item] * 3) + " end"
    row = got(spark, docs_of([text]), [(1, item), (2, "w996 w0 w1")])[0]
    assert row[:2] == (0, 300_121) and row[3] == ("1", "2") and row[2] == 120 + 3 * (300_000 // 997)


def test_document_made_of_items(spark, docs_of):
    """5,000 items of 40 words in one document; no match carries the document's words."""
    items = [(i, " ".join(f"w{(i * 40 + j) * 7919 % 1_000_003}" for j in range(40))) for i in range(5000)]
    rows = got(spark, docs_of([" ".join(t for _, t in items), "clean words"]), items)
    assert rows[0][:3] == (0, 200_000, 200_000) and len(rows[0][3]) == 5000 and rows[1][2] == 0


def test_items_of_one_repeated_word(spark, docs_of):
    items = [(i, " ".join(["a"] * (100 + i))) for i in range(50)] + [(99, " ".join(["a b"] * 60))]
    docs = [" ".join(["a"] * 200_000), " ".join(["a b"] * 5000), "a " * 12 + "c", "x " + "a " * 13 + "y"]
    rows = got(spark, docs_of(docs), items)
    assert rows[0][1:3] == (200_000, 200_000) and len(rows[0][3]) == 50
    assert rows[1][1:4] == (10_000, 10_000, ("99",)) and rows[2][1:4] == (13, 0, ()) and rows[3][1:3] == (15, 13)


def test_spans_are_stretches_of_hit_words(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(20))
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    row = decontaminate.decontaminate(docs_of([f"x {item} y z {item} {item} w"]), b).first()
    assert [tuple(x) for x in row["spans"]] == [(1, 20), (23, 62)] and row["n_hit"] == 60
