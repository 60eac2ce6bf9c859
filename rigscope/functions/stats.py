"""Statistics shared by the analyses, as column expressions.

Population deviations unless a name says otherwise; percentiles interpolate linearly; histograms have half-open bins
and a closed last one; coefficients of variation are percentages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.session import stored

BROADCAST_ROWS = 200_000

# Bin edges.
RANGE_EDGES = (0, 10, 20, 30, 40, 50, 100)  # metres; used for ranges and for depths


def spread(c: Column, prefix: str, *which: str) -> list[Column]:
    """Aggregates named <prefix>_<which>: min, max, mean, std, median, p25, p75, range.

    The percentiles are elements of one aggregate, whose map of values is kept once.
    """
    ranks = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    made = {
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "mean": lambda: F.avg(c),
        "std": lambda: F.stddev_pop(c),
        "median": lambda: ranks[1],
        "p25": lambda: ranks[0],
        "p75": lambda: ranks[2],
        "range": lambda: F.max(c) - F.min(c),
    }
    return [made[w]().alias(f"{prefix}_{w}") for w in which]


def selected(df: DataFrame, by: list[str], column: Column, quantiles: dict[str, float], small: int = 10_000, bins: int = 1024) -> DataFrame:
    """``by`` and an exact, interpolated percentile for each of ``quantiles``, by counting instead of keeping values.

    Each wanted rank has a range of values that holds it. A range of more than ``small`` values is cut into ``bins``; counts
    by bin, at most that many a group and task, tell which bin holds the rank, and the least and greatest value in it are
    the new range. So memory depends neither on a group's size nor on how many values differ; ranges narrow by three
    digits a pass. Ranges of few values, all alike or not, are sorted at last. Nulls and NaNs don't count; a group without
    other values gives no row.
    """
    v = df.select(*by, column.cast("double").alias("v")).where("not isnan(v)")
    ends = stored(v.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"), "selected-ends")
    place = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil))))
    want = ends.select(*by, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    edge, ready = [*by, "lo", "hi", "below"], []

    def inside(ranges: DataFrame) -> DataFrame:
        """The values of each distinct range; the ranges, a few a group, are broadcast if these are few."""
        one = stored(ranges.select(*edge).distinct(), "selected-ranges")
        return v.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, by).where("v >= lo and v <= hi")

    while True:
        want = stored(want, "selected-ranks")
        ready.append(want.where((F.col("inside") <= small) | (F.col("lo") == F.col("hi"))))
        large = want.where((F.col("inside") > small) & (F.col("lo") < F.col("hi")))
        if large.isEmpty():
            break
        # halves, as the width of a range may be beyond a double
        b = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = inside(large).groupBy(*edge, b.alias("b")).agg(F.count("v").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(W.partitionBy(*edge).orderBy("b")) - F.col("c") + F.col("below")
        found = large.select(*edge, "rank").join(counts.withColumn("before", before), edge).where("rank >= before and rank < before + c")
        want = found.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("before").alias("below"), F.col("c").alias("inside"))
    last = reduce(DataFrame.unionByName, ready)
    alike = last.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
    several = last.where("lo < hi")
    ordered = inside(several).withColumn("rank", F.row_number().over(W.partitionBy(*edge).orderBy("v")) - 1 + F.col("below"))
    values = alike.unionByName(several.select(*edge, "rank").join(ordered, [*edge, "rank"]).select(*by, "rank", F.col("v").alias("value")))
    known = values.join(ends.select(*by, "n"), by)
    at = lambda f, p: F.max(F.when(F.col("rank") == f(p).cast("long"), F.col("value")))
    parts = [c for i, p in enumerate(place.values()) for c in (at(F.floor, p).alias(f"a{i}"), at(F.ceil, p).alias(f"b{i}"))]
    out = known.groupBy(*by, "n").agg(*parts)
    return out.select(*by, *((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p))).alias(name) for i, (name, p) in enumerate(place.items())))


def bin_label(a: float, b: float, unit: str = "m") -> str:
    return f"{a:g}_{b:g}{unit}"


def histogram(c: Column, prefix: str, edges: Sequence[float] = RANGE_EDGES) -> list[Column]:
    """A count per bin, as columns named by the bins."""
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        upper = c <= b if i == len(edges) - 2 else c < b
        out.append(F.count_if((c >= a) & upper).alias(f"{prefix}_{bin_label(a, b)}"))
    return out


def share(condition: Column, of: Column | None = None) -> Column:
    """Percentage of rows that meet the condition; null without rows."""
    return F.try_divide(F.count_if(condition) * 100.0, of if of is not None else F.count(F.lit(1)))


def cv(std: Column, mean: Column) -> Column:
    """100 * std / mean; null where the mean is 0."""
    return F.try_divide(std * 100.0, mean)


def cv_or_zero(std: Column, mean: Column) -> Column:
    """100 * std / mean; 0 where the mean isn't positive."""
    return F.when(mean > 0, std * 100.0 / mean).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    """A flag that is never null."""
    return F.coalesce(condition, F.lit(False))


def rounded(df, digits: int, nudge: float = 0.0):
    """All double columns rounded, for reports."""
    return df.select(*(F.round(F.col(f"`{n}`") + nudge, digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))
