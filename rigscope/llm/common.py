"""Shared pieces of the llm operators: reading tables, cutting lineage, stable names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.session import shared_dir

BROADCAST_KEYS = 1_000_000
FEW_KEYS = 100_000  # of a table joined with texts; a row takes 130 bytes of the driver and of each executor, thrice that while it is made
MARK_BITS, MARK_PARTS = 28, 16  # 2^28 bits, 32 MB, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Gives a list that gathers the tables ``written`` within, so that they can be discarded once they are used up."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to, out.discarded = path, False
    if _made:
        _made[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        df.discarded = True


def fold(id_column: str, k: int):
    """crc32 of the id as text, modulo k; a null id has fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % k, F.lit(0))


def scored(docs: DataFrame, keep: tuple[str, ...], text: str, kernel, model, rows: int = 1 << 20) -> DataFrame:
    """``docs`` with columns c0, c1 ... for ``keep`` and s for ``kernel(model, bytes, offsets)``; names never clash."""
    kinds = dict(docs.dtypes)
    carried = [F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)]
    at = keep.index(text) if text in keep and kinds[text] == "string" else len(keep)
    if at == len(keep):
        carried.append(F.col(f"`{text}`").cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"c{i}" for i in range(len(keep))), "s"]

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(at))
            parts = [kernel(m, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in tn.slices(offs, rows=rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=names)

    return docs.select(*carried).mapInArrow(run, ", ".join([*(f"c{i} {kinds[k]}" for i, k in enumerate(keep)), "s double"]))


def kept(docs: DataFrame, text: str, kernel, model, condition, rows: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose score meets ``condition``."""
    names = tuple(docs.columns)
    return scored(docs, names, text, kernel, model, rows).where(condition(F.col("s"))).drop("s").toDF(*names)


def marked(keys: DataFrame, n: int):
    """A function of columns of 64-bit hashes: whether each may be among ``keys``, n rows of one such column.

    Only a bitmap is broadcast, of 16 bits a key or more (up to the most), which one other hash in sixteen passes.
    """
    bits = 1 << min(max(16 * n, 1 << 16).bit_length(), MARK_BITS)
    part = bits // MARK_PARTS

    def fill(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at = (c.to_numpy() for c in batch.columns)
            for k in np.unique(chunk).tolist():
                seen.setdefault(k, np.zeros(part, bool))[at[chunk == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in seen.values()], pa.binary())], names=["chunk", "marks"])

    place = F.pmod(keys[keys.columns[0]], F.lit(bits))
    dealt = keys.select(F.floor(place / part).cast("int").alias("chunk"), F.pmod(place, F.lit(part)).alias("at")).repartition(MARK_PARTS, "chunk")
    marks = np.zeros((MARK_PARTS, part // 8), np.uint8)
    for r in dealt.mapInArrow(fill, "chunk int, marks binary").collect():
        marks[r["chunk"]] = np.frombuffer(r["marks"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(marks.ravel())

    @F.arrow_udf("boolean")
    def may(place: pa.Array) -> pa.Array:
        at = place.to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda h: may(F.pmod(h, F.lit(bits)))


def without(docs: DataFrame, gone: DataFrame, on, here, there: str) -> DataFrame:
    """``docs`` without the rows that match one of ``gone``: broadcast if these are few.

    Else by shuffle, but only of documents whose hash ``here`` may be among those that ``gone`` has as ``there``.
    """
    n = gone.count()
    if n <= FEW_KEYS:
        return docs.join(F.broadcast(gone), on, "left_anti")
    may = marked(gone.select(there), n)
    return docs.where(~may(here)).union(docs.where(may(here)).join(gone.hint("merge"), on, "left_anti"))
