"""Time series by key: trend scores, gaps, extrema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trend_score(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Add score: the weighted slope over up to three steps (.1 .3 .6 for the newest last; .3 .6 and .3 if fewer), scaled by
    the room to the series' extreme; steps of slope 0 and the first get the mean slope. Rounded to 4 places."""
    w, whole = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    x = F.col(value)
    d = [F.lag(value, i - 1).over(w) - F.lag(value, i).over(w) if i > 1 else x - F.lag(value, 1).over(w) for i in (1, 2, 3)]
    out = df.withColumn("_i", F.row_number().over(w)).withColumns({"_d1": d[0], "_d2": d[1], "_d3": d[2], "_hi": F.max(value).over(whole), "_lo": F.min(value).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    slope = F.when(F.col("_i") == 1, 0.0).when(F.col("_i") == 2, 0.3 * F.col("_d1")).when(F.col("_i") == 3, 0.3 * F.col("_d2") + 0.6 * F.col("_d1")).otherwise(0.1 * F.col("_d3") + 0.3 * F.col("_d2") + 0.6 * F.col("_d1"))
    out = out.withColumn("_slope", slope)
    s = F.signum("_slope")
    room = F.when(s > 0, F.col("_hi") - x).otherwise(x - F.col("_lo"))
    c = F.when((x == F.col("_hi")) | (x == F.col("_lo")), -0.1).otherwise(1.0)
    p = F.round(c * (F.col("_slope") + s * room) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), 4)
    out = out.withColumn("score", F.when(F.col("_slope") == 0, 0.0).otherwise(p)).withColumn("_mean", F.sum("_slope").over(whole) / F.col("_n"))
    return out.withColumn("score", F.when(F.col("score") == 0, F.col("_mean")).otherwise(F.col("score"))).drop("_i", "_d1", "_d2", "_d3", "_hi", "_lo", "_n", "_slope", "_mean")


def gap_ratio(df: DataFrame, by: str, order: str, at: str, window: int = 5) -> DataFrame:
    """Add ratio of the newest gap to the mean gap of up to `window` records before: 0.01 without one before, and with one
    u / (1.2 max(x - u, u))."""
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(-window, -1)
    n, last, first = F.count(at).over(before), F.lag(at, 1).over(w), F.first(at).over(before)
    x = F.col(at)
    ratio = F.when(n == 0, 0.01).when(n == 1, last / (F.greatest(x - last, last) * 1.2)).otherwise((x - last + 0.95) / ((last - first) / (n - 1) + 1))
    return df.withColumn("ratio", ratio)


def local_extrema(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Add extremum: max or min against the first different value on either side (0 beyond an end), null otherwise."""
    w = Window.partitionBy(by).orderBy(order)
    x = F.col(value)
    step = df.withColumn("_p", F.lag(value).over(w)).withColumn("_f", F.lead(value).over(w))
    back = F.last(F.when(x != F.col("_p"), F.col("_p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(x != F.col("_f"), F.col("_f")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = step.withColumn("_b", F.coalesce(back, F.lit(0.0))).withColumn("_a", F.coalesce(ahead, F.lit(0.0)))
    kind = F.when((x > F.col("_b")) & (x > F.col("_a")), "max").when((x < F.col("_b")) & (x < F.col("_a")), "min")
    return out.withColumn("extremum", kind).drop("_p", "_f", "_a", "_b")


def extremum_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, hi_mean, lo_mean) of local_extrema's result; a missing side takes the other."""
    g = df.groupBy(by).agg(F.avg(F.when(F.col("extremum") == "max", F.col(value))).alias("hi"), F.avg(F.when(F.col("extremum") == "min", F.col(value))).alias("lo"))
    return g.select(by, F.coalesce("hi", "lo").alias("hi_mean"), F.coalesce("lo", "hi").alias("lo_mean"))


def islands(df: DataFrame, by: list[str], order: str, gap: Column) -> DataFrame:
    """Add island: number of the run of rows whose distance to the one before satisfies not gap."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w))
