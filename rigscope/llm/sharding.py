"""Operator 7: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` arcs of a hash ring. A text's hash names its arc, so that equal texts start at the
same place. A shard takes keys up to its bound; keys that find it full go on clockwise to the next shard that has
room. With bounds of floor or ceil of rows / shards, whose sum is the number of rows, counts are at most one apart
(law "rows"), and only overflow leaves its place on the ring.

A million equal texts lie on one arc, so no arc is ever put in order by one task: rows are spread over arc and
salt, counted, and numbered within (arc, salt). Which numbers of an arc go to which shard depends on the counts of
the arcs alone (shards x vnodes numbers, whatever the size of the table) and is worked out once.

Cases: a null text is an empty one; ties and repeated rows are told apart by nothing but their number, so the
result is the same whichever comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.llm.common import written

ROWS_A_GROUP = 2_000
CELLS = 1 << 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order, no two in one cell of the ring."""
    if shards * vnodes > CELLS // 2:
        raise ValueError(f"at most {CELLS // 2} virtual nodes fit on the ring")
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest()) % CELLS
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = s
    return sorted(at.items())


def assign(counts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first number, last number, shard, first slot) for the arcs' counts.

    Round by round, what is left of every arc asks the shard of the next virtual node clockwise; a shard takes what
    it has room for in ring order, and keeps it. Numbers of an arc are given out from 0 up.
    """
    n, room, used = len(counts), list(bounds), [0] * len(bounds)
    given, left, runs = [0] * n, list(counts), []
    for step in range(n):
        waiting = [a for a in range(n) if left[a]]
        if not waiting:
            break
        for a in waiting:
            s = owners[(a + step) % n]
            if take := min(left[a], room[s]):
                runs.append((a, given[a], given[a] + take - 1, s, used[s]))
                given[a] += take
                left[a] -= take
                room[s] -= take
                used[s] += take
    return runs


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard of every row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    points = ring_points(shards, vnodes)
    owners, n = [s for _, s in points], len(points)
    # arc i: the cells after point i - 1 up to point i; what lies beyond the last point belongs to arc 0
    spans = [(points[i - 1][0] + 1 if i else 0, p, i) for i, (p, _) in enumerate(points)]
    if points[-1][0] + 1 < CELLS:
        spans.append((points[-1][0] + 1, CELLS - 1, 0))
    cells = spark.createDataFrame(spans, "a int, b int, arc int").select(F.explode(F.sequence("a", "b")).alias("cell"), "arc")
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(CELLS)).cast("int").alias("cell"),
    )
    rows = written(slim.join(F.broadcast(cells), "cell").drop("cell").withColumn("uid", F.monotonically_increasing_id()), "sharding-rows")

    by_arc = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most shards * vnodes rows
    counts = [by_arc.get(i, 0) for i in range(n)]
    whole = sum(counts)
    runs = assign(counts, owners, [whole // shards + (s < whole % shards) for s in range(shards)])
    salts = spark.createDataFrame([(i, -(-c // ROWS_A_GROUP) or 1) for i, c in enumerate(counts)], "arc int, salts int")
    rows = rows.join(F.broadcast(salts), "arc").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))
    before = F.sum("n").over(W.partitionBy("arc").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    bases = rows.groupBy("arc", "salt").agg(F.count("*").alias("n")).select("arc", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("arc", "salt").orderBy("uid")) - 1
    ranked = rows.withColumn("rank", rank).join(bases, ["arc", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    homes = spark.createDataFrame(list(enumerate(owners)), "arc int, home_shard int")
    table = spark.createDataFrame(runs, "run_arc int, a long, b long, shard int, slot0 long")
    return (
        ranked.join(F.broadcast(table), (F.col("arc") == F.col("run_arc")) & F.col("rank").between(F.col("a"), F.col("b")))
        .join(F.broadcast(homes), "arc")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("a")).alias("slot"), "home_shard")
    )
