import re

import pytest

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def docs_of(spark):
    """Documents from texts; ids from 0, or (id, text) pairs; an extra column with a clashing name."""

    def make(rows, extra="score"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x") for i, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, `{extra}` string")

    return make


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LETTERS))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])
