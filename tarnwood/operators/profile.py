"""Feature profiles: one row per numeric column."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, x) rows of the columns as doubles."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*")


def _moments():
    return [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.var_samp("x").alias("var"), F.skewness("x").alias("skew"), (F.kurtosis("x") + 3).alias("kurt")]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """profile() without quartiles and mode: one grouped aggregate."""
    return unpivot(df, columns).groupBy("feature").agg(*_moments())


def profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max, var, skew and kurt (population, normal = 3), median, mode (least on ties).

    Exact quartiles and the mode come from counts of different values, numbered in ranges; no task holds all values of a column.
    approximate: quartiles from a sketch."""
    long = unpivot(df, columns)
    sketch = [F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q")] if approximate else []
    counts = long.filter("x is not null").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("m")).select("feature", F.col("m.x").alias("mode"))
    out = long.groupBy("feature").agg(*_moments(), *sketch).join(F.broadcast(mode), "feature", "left")  # a row for each column
    out = out if approximate else out.join(F.broadcast(_quartiles(counts)), "feature", "left")
    return out.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "var", "skew", "kurt", "mode")


#: Ranges of values of one feature.
_RANGES = 256


def _quartiles(counts: DataFrame) -> DataFrame:
    """(feature, q) from (feature, x, n): linear between the two nearest places, as percentile(). Values are cut into ranges at
    approximate quantiles of the different values, a few rows of counts tell what stands before each range, and each range adds
    up its own."""
    cuts = F.broadcast(counts.groupBy("feature").agg(F.percentile_approx("x", [i / _RANGES for i in range(1, _RANGES)], 1000).alias("cuts")))  # a row for each column
    cut = counts.join(cuts, "feature").select("feature", "x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("range"))
    sums = cut.groupBy("feature", "range").agg(F.sum("n").alias("held"))  # _RANGES rows for each column
    w = Window.partitionBy("feature").orderBy("range")
    before = F.broadcast(sums.select("feature", "range", (F.sum("held").over(w) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy("feature")).alias("all")))
    inside = Window.partitionBy("feature", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = cut.join(before, ["feature", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    asked = places.select("feature", "x", "n", "upto", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("all") - 1) * p).alias("at")) for i, p in enumerate((0.25, 0.5, 0.75))])).alias("a")).select("*", "a.*")
    on = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("x")))
    ends = asked.groupBy("feature", "i").agg(on(F.floor("at")).alias("lo"), on(F.ceil("at")).alias("hi"), F.max("at").alias("at"))
    part = F.col("at") - F.floor("at")
    value = F.when((part == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + part * F.col("hi"))
    return ends.select("feature", F.struct("i", value.alias("v")).alias("s")).groupBy("feature").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias("q"))


def verdicts(profiled: DataFrame) -> DataFrame:
    """Add skew_text (left, right or none) and peaked: kurtosis further than 2 from 3."""
    return profiled.withColumn("skew_text", F.when(F.col("skew") > 0, "right").when(F.col("skew") < 0, "left").otherwise("none")).withColumn("peaked", F.abs(F.col("kurt") - 3) > 2)


def shapiro(values) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test by Royston's approximation, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    nd = NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    if n > 3:
        last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u))
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u))
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-19))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y, mu, sigma = -math.log(g - y), float(np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)), math.exp(float(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)))
    else:
        ln = math.log(n)
        mu, sigma = float(np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)), math.exp(float(np.polyval([0.0030302, -0.082676, -0.4803], ln)))
    return w, 1 - nd.cdf((y - mu) / sigma)


def normality(df: DataFrame, columns: list[str], small: int = 2000) -> DataFrame:
    """(feature, test, statistic, p, normal): Shapiro-Wilk up to `small` values, else Kolmogorov-Smirnov against N(0, 1)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    out = []
    for c in columns:
        x = df.select(F.col(c).cast("double").alias("x")).filter("x is not null")
        n = x.count()
        if n <= small:
            w, p = shapiro([r.x for r in x.collect()])
            out.append((c, "shapiro", w, p, w > 0.5 and p > 0.05))
        else:
            r = KolmogorovSmirnovTest.test(x, "x", "norm", 0.0, 1.0).first()
            out.append((c, "ks", float(r.statistic), float(r.pValue), r.statistic < 0.5 and r.pValue > 0.05))
    return df.sparkSession.createDataFrame(out, "feature string, test string, statistic double, p double, normal boolean")


def feature_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, ints, repeats, level): 1 (discrete) if more than a quarter are whole and more than a fifth repeat, else 3."""
    g = unpivot(df, columns).groupBy("feature").agg(F.count("x").alias("n"), F.sum((F.col("x") % 1 == 0).cast("long")).alias("ints"), (F.count("x") - F.count_distinct("x")).alias("repeats"))
    return g.withColumn("level", F.when((F.col("ints") > F.floor(F.col("n") / 4)) & (F.col("repeats") > F.floor(F.col("n") / 5)), 1).otherwise(3))
