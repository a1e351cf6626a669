"""Scalers and discretizers over named columns; totals are one aggregate, the rest is a projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.operators.ordering import average_ranks

PER_COLUMN, GLOBAL = ("max-min", "max", "stand", "qt"), ("u-max", "u-max-min", "u-stand", "decimal")


def scale(df: DataFrame, columns: list[str], algorithm: str) -> DataFrame:
    """norm: rows to unit length; max-min, max, stand, qt: per column; u-max, u-max-min, u-stand, decimal: over all columns.
    Constant columns scale to 0."""
    c = [F.col(x).cast("double") for x in columns]
    if algorithm == "norm":
        length = F.sqrt(sum((x * x for x in c), F.lit(0.0)))
        return df.withColumns({n: F.coalesce(x / F.nullif(length, F.lit(0.0)), F.lit(0.0)) for n, x in zip(columns, c)})
    if algorithm == "qt":
        out = df
        for n in columns:
            r = average_ranks(df.select(F.col(n).cast("double").alias(n)), n, "_r")
            size = df.filter(F.col(n).isNotNull()).count()
            out = out.withColumn(n, F.col(n).cast("double")).join(r, n, "left").withColumn(n, (F.col("_r") - 1) / max(size - 1, 1)).drop("_r")
        return out
    if algorithm in GLOBAL:
        cells = df.select(F.explode(F.array(*c)).alias("x"))
        t = cells.agg(F.max("x").alias("max"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).first()
        shift, width = {"u-max": (0.0, abs(t["max"] or 0)), "u-max-min": (t["min"], (t["max"] or 0) - (t["min"] or 0)), "u-stand": (t["mean"], t["std"]), "decimal": (0.0, t["max"])}[algorithm]
        return df.withColumns({n: (x - F.lit(shift)) / F.lit(float(width or 0) or None) for n, x in zip(columns, c)})
    if algorithm not in PER_COLUMN:
        raise ValueError(f"unknown scaler {algorithm!r}")
    t = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(c) for k, f in (("hi", F.max), ("lo", F.min), ("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for i, (n, x) in enumerate(zip(columns, c)):
        hi, lo = t[f"hi{i}"], t[f"lo{i}"]
        shift, width = {"max-min": (lo, (hi or 0) - (lo or 0)), "max": (0.0, max(abs(hi or 0), abs(lo or 0))), "stand": (t[f"m{i}"], t[f"s{i}"])}[algorithm]
        out[n] = (x - F.lit(shift)) / F.lit(float(width)) if width else F.when(x.isNotNull(), 0.0)
    return df.withColumns(out)


def discretize_scope(df: DataFrame, col: str, bounds: list[float], replace: str = "label") -> DataFrame:
    """Add cls: 0 for x <= bounds[0], i for bounds[i-1] < x <= bounds[i]; beyond the last bound is an error. replace adds
    replaced: the label, or the max, min or mean of the class."""
    if replace not in ("label", "max", "min", "mean"):
        raise ValueError(f"unknown replacement {replace!r}")
    if list(bounds) != sorted(bounds):
        raise ValueError("bounds must ascend")
    x, cls = F.col(col), F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds))):
        cls = F.when(x <= b, i).otherwise(cls)
    cls = F.when(x > bounds[-1], F.raise_error(F.lit("value above the last bound")).cast("int")).otherwise(cls)
    out = df.withColumn("cls", cls)
    if replace == "label":
        return out.withColumn("replaced", F.col("cls").cast("double"))
    stat = out.groupBy("cls").agg({"max": F.max, "min": F.min, "mean": F.avg}[replace](col).cast("double").alias("replaced"))
    return out.join(F.broadcast(stat), "cls", "left")  # one row per bound


def discretize_auto(df: DataFrame, col: str, mean_multip: float = 1.2) -> DataFrame:
    """(value, cls): a class ends before a gap of at least mean_multip times the gap before it that is wider than the class
    so far. The state runs along the sorted distinct values, which one task reads."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sorted(pdf["value"].tolist())
        out, cls, begin, last = [], 0, None, None
        for i, x in enumerate(v):
            if begin is None:
                begin = x
            elif last is not None and (x - v[i - 1]) >= mean_multip * last and v[i - 1] - begin < x - v[i - 1]:
                cls, begin = cls + 1, x
            if i:
                last = x - v[i - 1]
            out.append(cls)
        return pd.DataFrame({"value": v, "cls": out})

    values = df.select(F.col(col).cast("double").alias("value")).filter("value is not null").distinct()
    return values.groupBy(F.lit(0).alias("_g")).applyInPandas(cut, "value double, cls int")


def mean_deviation(df: DataFrame, col: str) -> DataFrame:
    """(mad, spread): mean absolute deviation from the mean, and max - min."""
    m = F.broadcast(df.agg(F.avg(col).alias("_m")))  # one row
    return df.crossJoin(m).agg(F.avg(F.abs(F.col(col) - F.col("_m"))).alias("mad"), (F.max(col) - F.min(col)).alias("spread"))


def global_extremes(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """df with hi and lo of col per series."""
    w = Window.partitionBy(*by)
    return df.withColumn("hi", F.max(col).over(w)).withColumn("lo", F.min(col).over(w))
