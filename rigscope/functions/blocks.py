"""What a row takes from the rows before it, for sequences too long for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carried(df: DataFrame, by: list[str], order: str, values: list[str], block: int = 1 << 16) -> DataFrame:
    """Adds previous_<value> and first_<value>: those of the row before, and of the first row, of each sequence.

    Sequences are cut into blocks of ``block`` numbers of ``order`` (whole, from 0, none twice). Rows look back within
    their block; a block's first row takes what the last block before it that has rows ends with, from one small row a
    block. So no task orders more than a block of rows, or one row for each block of a sequence. Nulls of ``order`` look
    nowhere and are no one's first.
    """
    both = F.struct(*values)
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    ends = cut.where(F.col(order).isNotNull()).groupBy(*by, "_block").agg(F.max_by(both, order).alias("_last"), F.min_by(both, order).alias("_begin"))
    along = W.partitionBy(*by).orderBy("_block")
    ends = ends.select(*by, "_block", F.lag("_last").over(along).alias("_before"), F.first("_begin").over(along).alias("_first"))
    within = W.partitionBy(*by, "_block").orderBy(order)
    joined = cut.withColumn("_at", F.row_number().over(within)).withColumn("_near", F.lag(both).over(within)).join(ends, [*by, "_block"], "left")
    look = F.when(F.col("_block").isNotNull(), F.when(F.col("_at") == 1, F.col("_before")).otherwise(F.col("_near")))
    out = joined.withColumn("_look", look)
    return out.select(*df.columns, *(F.col(f"_look.{v}").alias(f"previous_{v}") for v in values), *(F.col(f"_first.{v}").alias(f"first_{v}") for v in values))
