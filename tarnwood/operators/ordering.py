"""Positions in a global order without a window over one partition.

Rows are cut into ranges of the leading order column at approximate quantiles; ranges are counted (a few rows), and each
range numbers its own rows. All functions state their order explicitly, since rows have none of their own."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, lead: str, n: int) -> Column:
    """Number of the range that holds the leading column's value."""
    cuts = sorted({*df.select(F.col(lead).cast("double").alias("_x")).approxQuantile("_x", [i / n for i in range(1, n)], 0.002)})
    return F.lit(0) if not cuts else sum((F.when(F.col(lead).cast("double") > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _offsets(df: DataFrame, weight: Column) -> Column:
    totals = sorted((r["_range"], r["n"] or 0) for r in df.groupBy("_range").agg(F.sum(weight).alias("n")).collect())
    before = dict(zip((t[0] for t in totals), itertools.accumulate((t[1] for t in totals), initial=0)))
    if not before:
        return F.lit(0)
    return F.element_at(F.create_map(*[F.lit(x).cast("long" if isinstance(x, int) else "double") for kv in before.items() for x in kv]), F.col("_range").cast("long"))


def numbered(df: DataFrame, order: list[str], name: str = "pos", ranges: int = 64) -> DataFrame:
    """Add name: 0-based position in the order of the columns; the first must be numeric or a time and not null."""
    cut = df.withColumn("_range", _ranges(df, order[0], ranges))
    w = Window.partitionBy("_range").orderBy(*order)
    return cut.withColumn(name, (F.row_number().over(w) - 1 + _offsets(cut, F.lit(1))).cast("long")).drop("_range")


def numbered_by_text(df: DataFrame, key: Column, name: str = "pos", ranges: int = 64) -> DataFrame:
    """Add name: 0-based position in the order of a text. Ranges are cut at texts of a bounded sample (those of least hash), so
    texts that share long beginnings are dealt as evenly as others. df is read three times; persist what is costly."""
    rows = df.withColumn("_key", key)
    sample = sorted(r["_key"] for r in rows.select("_key").filter("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(20 * ranges).collect())
    cut = rows.withColumn("_range", sum((F.when(F.col("_key") > c, 1).otherwise(0) for c in sample[20::20]), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1 + _offsets(cut, F.lit(1))
    return cut.withColumn(name, place.cast("long")).drop("_range", "_key")


def running(df: DataFrame, order: str, weight: str, name: str, ranges: int = 64) -> DataFrame:
    """Add name: sum of weight over the rows up to this one in the order of a numeric column without repeats."""
    cut = df.withColumn("_range", _ranges(df, order, ranges))
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn(name, (F.sum(weight).over(w) + _offsets(cut, F.col(weight))).cast("long")).drop("_range")


def average_ranks(df: DataFrame, col: str, name: str, ranges: int = 64) -> DataFrame:
    """Distinct values of col with their average rank: (count of smaller values) + (ties + 1) / 2."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    cut = counts.withColumn("_range", _ranges(counts, col, ranges))
    w = Window.partitionBy("_range").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(w), F.lit(0)) + _offsets(cut, F.col("_n"))
    return cut.select(col, (below + (F.col("_n") + 1) / 2).cast("double").alias(name))


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> list[float]:
    """Exact values at 0-based ranks of a sorted numeric column (nulls apart): a sketch brackets each, a count confirms."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n = x.count()
    out = []
    for r in ranks:
        eps = 0.002
        lo, hi = x.approxQuantile("x", [max(0.0, r / n - 3 * eps), min(1.0, r / n + 3 * eps)], eps)
        below = x.filter(F.col("x") < lo).count()
        counts = x.filter(F.col("x").between(lo, hi)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        out.append(running(counts, "x", "n", "upto").filter(F.col("upto") > r - below).orderBy("x").first()["x"])
    return out
