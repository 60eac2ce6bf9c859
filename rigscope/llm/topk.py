"""Operator 2: exact top-k inner products by aggregation of sorted lists without random access.

In a block of candidates each component is a list sorted by value. A query reads a list from the top where its own
component is positive and from the bottom where it is negative, so that what a list gives (the product) never rises.
It reads all lists down to one level of what they give, and then to lower levels: lists of large weight are read deep
before lists of small weight are read at all. A candidate's upper bound is the sum of what it gave and, for entries to
come, of the level (or its list's top, if that is less); its lower bound takes the list's far end. The threshold is the
k-th best of the scores resolved so far, and of the lower bounds while there are fewer. Candidates whose upper bounds
lie below it are outsiders and are dropped, each for the query that drops it; reading goes on for the others alone until
all their entries are read, which resolves their scores. No list is ever looked up at a candidate's place.

The first candidates of a task (``FIRST_BLOCK``) are a block of their own and the next ones blocks of twice the size, up to
``LAST_BLOCK``, so that a threshold stands before most is read.

Queries are a fiftieth of the rows and grow with them: they are dealt to blocks of about ``QUERIES_A_BLOCK`` vectors or
``NUMBERS_A_BLOCK`` numbers at most, and a block at a time is broadcast. Candidates are read in place, never shuffled; each task keeps k scores a
query, and only these are shuffled.

How much is read depends on the data: with a few large components a query stops after a few per cent; with 64 alike and
independent ones (as in the test tables) it reads three fifths of the entries of 2,000 vectors and half of those of 10,000.

Cases: null vectors and such with null, NaN or infinite components take no part; vectors meet only vectors of
their length; rows of a query's id are its own; further rows of one id and vector, or of one id and score, count once;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none; other columns are
ignored. Sums too large for exact doubles are computed with Python's integers; scores beyond a long count as the nearest
long, and products 256 * x beyond a double as the nearest double.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.llm.common import written

CANDIDATES_A_BLOCK = 4_096
QUERIES_A_BLOCK = 20_000
NUMBERS_A_BLOCK = 1 << 21  # of queries, and an eighth of them of candidates: long vectors make smaller blocks
FIRST_BLOCK, FINE_BLOCK, LAST_BLOCK = 32, 1_024, 4_096
#: About which shares of all entries are read at each level: many levels while blocks are small, few in full blocks.
EARLY = (0.02, 0.05, 0.1, 0.2)  # passed over where not even some first candidates would be dropped
FINE, COARSE = (*EARLY, *np.arange(0.34, 0.92, 0.03).tolist()), (*EARLY, 0.42, 0.5, 0.58, 0.68, 0.8)
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
MOST_DOUBLE = np.finfo(np.float64).max


def exact_type(q: np.ndarray, x: np.ndarray) -> np.dtype:
    """The narrowest type in which all sums of products are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.dtype(np.float32) if most < 2**24 else np.dtype(np.float64) if most < 2**53 else np.dtype(object)


def kth(values: np.ndarray, k: int, lowest):
    """The k-th largest; ``lowest`` where there are fewer."""
    n = len(values)
    if n < k:
        return lowest
    return sorted(values)[n - k] if values.dtype == object else np.partition(values, n - k)[n - k]


class Best:
    """The k best (score, id) that each query has met."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]

    def add(self, i: int, scores: list, ids: list) -> None:
        self.rows[i] = sorted({*self.rows[i], *((-min(max(int(s), LEAST), MOST), c) for s, c in zip(scores, ids, strict=True))})[: self.k]

    def least(self, i: int, lowest):
        return -self.rows[i][-1][0] if len(self.rows[i]) == self.k else lowest


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, best: Best, first: int = 0, count: bool = False) -> int:
    """Reads the lists of a block (distinct rows ``x``) for some queries and tells ``best`` what qualifies.

    Returns, if asked to ``count``, the number of entries read by all queries, for candidates not yet dropped.
    """
    kind, entries = exact_type(q, x), 0
    lowest = -(1 << 4096) if kind == object else kind.type(-np.inf)
    q, x = q.astype(kind), x.astype(kind)
    ends = np.sort(x, axis=0)[[0, -1]]  # of the lists
    some, ones, own = x[:: max(1, len(x) // 32)], np.ones(x.shape[1], kind), np.isin(q_ids, x_ids)
    for i in range(len(q)):
        others, given = np.arange(len(x)), x * q[i]
        if own[i]:
            others = np.flatnonzero(x_ids != q_ids[i])
            given = given[others]
        tops, far = np.maximum(*(ends * q[i])), np.minimum(*(ends * q[i]))
        sample, least = np.sort((some * q[i]).ravel()), best.least(first + i, lowest)
        if kind == object and least <= LEAST:  # all that is less counts as much
            least = lowest
        early = least == lowest  # too few scores so far
        for share in FINE if len(x) <= FINE_BLOCK else COARSE:
            level = sample[int((1 - share) * (len(sample) - 1))]
            if early:
                least = max(least, kth(np.where(given >= level, given, far) @ ones, best.k, lowest))
            bound = np.minimum(level, tops)
            if share in EARLY and (np.maximum(given[:32], bound) @ ones >= least).all():
                continue
            upper = np.maximum(given, bound) @ ones
            stays = np.flatnonzero(upper >= (min(least, MOST) if kind == object else least))
            if len(stays) < len(given):
                if count:
                    entries += int((np.delete(given, stays, axis=0) >= level).sum())
                others, given = others[stays], given.take(stays, axis=0)
                if not len(others):
                    break
        if not len(others):
            continue
        entries += given.size
        scores = given @ ones
        good = np.flatnonzero(scores >= (min(least, MOST) if kind == object else best.least(first + i, lowest)))
        if len(good):
            best.add(first + i, scores[good].tolist(), x_ids[others[good]].tolist())
    return entries


def usable(ids: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and rows floor(scale * component), of the rows that take part."""
    ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, vectors))
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = len(vectors)
    if not n:
        return {}
    length = np.where(np.asarray(vectors.is_valid()), np.asarray(vectors.value_lengths().fill_null(0)), -1)
    length = np.where(np.asarray(ids.is_valid()), length, -1)
    flat = vectors.flatten()  # leaves null rows out
    with np.errstate(over="ignore"):
        given = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
        values = np.where(np.isfinite(given), np.clip(np.floor(given * scale), -MOST_DOUBLE, MOST_DOUBLE), np.nan)
    at = np.cumsum(np.maximum(np.asarray(vectors.value_lengths().fill_null(0)), 0)) - np.maximum(length, 0)
    numbers = ids.fill_null(0).to_numpy()
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        v = values[at[rows][:, None] + np.arange(size)[None, :]]
        sound = np.isfinite(v).all(axis=1)
        out.setdefault(int(size), []).append((numbers[rows[sound]], v[sound]))
    return {size: (np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])) for size, parts in out.items()}


def whole(v: np.ndarray) -> np.ndarray:
    """Whole numbers that doubles can't all hold exactly in sums, as Python's integers."""
    return v if float(np.abs(v).max(initial=0)) < 2**53 else np.array([[int(c) for c in row] for row in v], dtype=object).reshape(v.shape)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct (id, row); ids are compared as the whole numbers that they are."""
    order = np.argsort(ids, kind="stable")
    twice = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    if not len(twice):
        return np.arange(len(ids))
    seen, keep = set(), np.ones(len(ids), bool)
    for i in np.unique(order[np.concatenate([twice, twice + 1])]).tolist():  # rows whose id occurs again
        key = int(ids[i]), x[i].tobytes()
        keep[i] = key not in seen
        seen.add(key)
    return np.flatnonzero(keep)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best of all other rows."""
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").alias("embedding"))
    queries = rows.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull())
    n, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES_A_BLOCK), -(-n * longest // NUMBERS_A_BLOCK))
    dealt = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "topk-queries")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = []
    for b in range(blocks):
        table = dealt.where(F.col("block") == b).select("vec_id", "embedding").orderBy("vec_id").toArrow()  # a block: of bounded size
        shared = vectors.sparkSession.sparkContext.broadcast(usable(table.column(0), table.column(1), scale))
        near = rows.mapInArrow(_reader(shared, k, scale), "query_id long, vec_id long, score long")
        ranked = near.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-found"))
    return reduce(DataFrame.unionByName, found)


def _reader(shared, k: int, scale: int):
    """For mapInArrow: the k best of the partition's rows for each query of the block."""

    def read(batches):
        asked = shared.value
        best = {size: Best(len(ids), k) for size, (ids, _) in asked.items()}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size in asked}
        begun = dict.fromkeys(asked, FIRST_BLOCK)

        def block(size: int) -> None:
            parts, waiting[size] = waiting[size], []
            ids, x = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
            one = distinct_rows(ids, x)
            ids, x = ids[one], whole(x[one])
            q_ids, q = asked[size]
            q = whole(q)
            a = 0
            while a < len(ids):  # a threshold from few candidates first
                b = a + begun[size]
                search(q, q_ids, x[a:b], ids[a:b], best[size])
                a, begun[size] = b, min(2 * begun[size], LAST_BLOCK)

        for batch in batches:
            for size, (ids, v) in usable(batch.column(0), batch.column(1), scale).items():
                if size in asked:
                    most = max(16, min(CANDIDATES_A_BLOCK, NUMBERS_A_BLOCK // 8 // size))
                    for a in range(0, len(ids), most):
                        waiting[size].append((ids[a : a + most], v[a : a + most]))
                        if sum(len(i) for i, _ in waiting[size]) >= most:
                            block(size)
        for size, parts in waiting.items():
            if parts:
                block(size)
        out = [(int(q), c, -s) for size, b in best.items() for q, row in zip(asked[size][0], b.rows, strict=True) for s, c in row]
        for a in range(0, max(len(out), 1), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[a : a + 10_000]], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return read
