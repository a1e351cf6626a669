"""Missing values, outliers, imputation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions.arrays import euclidean

from .ordering import order_statistics, running

RULES = ("3a", "box", "scope", "discrete")


def is_missing(c: Column, kind: str, markers=()) -> Column:
    """Null, NaN for floating columns, or one of the markers."""
    out = c.isNull()
    if kind in ("double", "float"):
        out = out | F.isnan(c)
    return out | c.isin(list(markers)) if markers else out


def locate_missing(df: DataFrame, row: str, columns: list[str], markers=()) -> DataFrame:
    """(row, col) of every missing cell, in one pass."""
    kinds = dict(df.dtypes)
    cells = F.filter(F.array(*[F.when(is_missing(F.col(c), kinds[c], markers), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(F.col(row).alias("row"), F.explode(cells).alias("col"))


def outlier_condition(df: DataFrame, col: str, method: str, values=(), centered: bool = False) -> Column:
    """Condition that flags outliers of col. 3a: x > 3 population deviations (centered: |x - mean|); box: beyond three times the
    distance of the inner quartiles (rounded to observed values, inwards) from them; scope: outside [values0, values1]; discrete:
    not among values. An unknown method flags nothing."""
    x = F.col(col)
    if method == "3a":
        s, m = df.agg(F.stddev_pop(col), F.avg(col)).first()
        if s is None:
            return F.lit(False)
        return F.abs(x - m) > 3 * s if centered else x > 3 * s
    if method == "box":
        n = df.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).count()
        if not n:
            return F.lit(False)
        hi, lo = order_statistics(df, col, [math.floor(0.75 * (n - 1)), math.ceil(0.25 * (n - 1))])
        return (x > hi + 3 * (hi - lo)) | (x < lo - 3 * (hi - lo))
    if method == "scope":
        return ~x.between(values[0], values[1])
    if method == "discrete":
        return ~x.isin(list(values))
    return F.lit(False)


def outliers(df: DataFrame, row: str, col: str, method: str, values=(), centered: bool = False) -> DataFrame:
    """(row, kind): kind `missing` for null or NaN, `outlier` for flagged rows that are not missing."""
    gone = is_missing(F.col(col), dict(df.dtypes)[col])
    kind = F.when(gone, "missing").when(outlier_condition(df, col, method, values, centered), "outlier")
    return df.select(F.col(row).alias("row"), kind.alias("kind")).filter("kind is not null")


def batch_outliers(df: DataFrame, row: str, rules: dict[str, list[tuple[str, list]]]) -> DataFrame:
    """rules: method -> [(column, values)]. (name, method, kind, row) for all rules in one pass over df."""
    kinds, marks = dict(df.dtypes), []
    for method, entries in rules.items():
        for name, values in entries:
            kind = F.when(is_missing(F.col(name), kinds[name]), "missing").when(outlier_condition(df, name, method, values), "outlier")
            marks.append(F.struct(F.lit(name).alias("name"), F.lit(method).alias("method"), kind.alias("kind")))
    return df.select(F.col(row).alias("row"), F.explode(F.array(*marks)).alias("m")).select("m.name", "m.method", "m.kind", "row").filter("kind is not null")


def impute_window_mean(df: DataFrame, col: str, order: list[str], by: list[str] = (), window: int = 50, place: float = 0.0) -> DataFrame:
    """Missing values become the mean of the present ones among the `window` rows before and `window - 1` after."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-window, window - 1)
    return df.withColumn(col, F.coalesce(F.col(col), F.avg(col).over(w), F.lit(place)))


def lagrange(xs, ys, x: float) -> float:
    """Value at x of the polynomial through the points."""
    out = 0.0
    for i, a in enumerate(xs):
        term = float(ys[i])
        for j, b in enumerate(xs):
            if i != j:
                term *= (x - b) / (a - b)
        out += term
    return out


def impute_in_order(df: DataFrame, col: str, order: str, by: str, window: int = 5, method: str = "lagrange", place: float = 0.0) -> DataFrame:
    """Fill missing values one after another, so that earlier fills feed later ones; one series per `by` in memory.

    method: mean or lagrange over the present neighbours in [i - window, i + window - 1]."""
    if method not in ("mean", "lagrange"):
        raise ValueError(f"unknown imputation method {method!r}")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        v = pdf[col].astype(float).tolist()
        for i, x in enumerate(v):
            if x == x:
                continue
            near = [j for j in range(max(0, i - window), min(len(v), i + window)) if j != i and v[j] == v[j]]
            v[i] = place if not near else sum(v[j] for j in near) / len(near) if method == "mean" else lagrange(near, [v[j] for j in near], i)
        pdf[col] = v
        return pdf

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField(f.name, DoubleType() if f.name == col else f.dataType) for f in df.schema])
    return df.groupBy(by).applyInPandas(fill, schema)


#: Queries that are broadcast at most, rows that give each query its first bound, and numbers of a vector written out as columns.
_QUERIES, _FIRST, _WIDTH = 400_000, 2000, 256


def _within(q: DataFrame, r: DataFrame, width: int) -> DataFrame:
    """(q_id, r_id, dist) of the pairs of q (q_id, _q, _far) and r (r_id, _r) that are not further than _far; a missing bound
    or distance stays. With a width, all vectors are of so many numbers, none missing, and become columns: a sum of columns is
    compiled, where one over arrays is interpreted. It adds in the same order."""
    if width:
        flat = lambda df, v: df.withColumns({f"{v}{i}": F.coalesce(F.get(v, F.lit(i)).cast("double"), F.lit(0.0)) for i in range(width)}).drop(v)
        q, r = flat(q, "_q"), flat(r, "_r")
        diff = [F.col(f"_q{i}") - F.col(f"_r{i}") for i in range(width)]
        dist = F.sqrt(sum((d * d for d in diff), F.lit(0.0)))
    else:
        dist = euclidean(F.col("_q"), F.col("_r"))
    near = q.join(r, (F.col("q_id") != F.col("r_id")) & F.coalesce(dist <= F.col("_far"), F.lit(True)))
    return near.select("q_id", "r_id", dist.alias("dist"))


def nearest(queries: DataFrame, rows: DataFrame, q_id: str, r_id: str, q_vec: str, r_vec: str, k: int) -> DataFrame:
    """(q_id, r_id, dist, rank): the k nearest rows of each query by Euclidean distance, ties by r_id. A query set against
    all rows: the kth distance among some of the rows bounds each query, and no pair beyond it is sorted or moves."""
    q, r = queries.select(F.col(q_id).alias("q_id"), F.col(q_vec).alias("_q")), rows.select(F.col(r_id).alias("r_id"), F.col(r_vec).alias("_r"))
    width = r.agg(F.max(F.size("_r"))).first()[0] or 0
    even = lambda v: F.coalesce((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
    n, odd = r.agg(F.count(F.lit(1)), F.count_if(~even("_r"))).first()
    asked, odd_q = q.agg(F.count(F.lit(1)), F.count_if(~even("_q"))).first()
    written = width if width <= _WIDTH and not odd and not odd_q else 0
    few = F.broadcast if asked <= _QUERIES else lambda df: df
    w = Window.partitionBy("q_id").orderBy("dist", "r_id")
    free = q.withColumn("_far", F.lit(None).cast("double"))
    if n > 2 * _FIRST:
        some = r.filter(F.pmod(F.xxhash64("r_id"), F.lit(n // _FIRST)) == 0)
        first = _within(few(free), some, written).withColumn("n", F.row_number().over(w)).filter(F.col("n") == k)
        free = q.join(first.select("q_id", F.col("dist").alias("_far")), "q_id", "left")
    return _within(few(free), r, written).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def impute_knn(df: DataFrame, row: str, features: list[str], target: str, k: int = 3, classify: bool = True, queries: Column | None = None) -> DataFrame:
    """Fill a missing target from the k nearest rows that have it: majority (ties to the smallest label) or mean.

    With one feature every missing row is filled, without a search over pairs; a row without the feature is neither filled nor
    used. With several, `queries` states the rows to fill, each of which is compared with all rows."""
    need, have = df.filter(F.col(target).isNull()), df.filter(F.col(target).isNotNull())
    if queries is not None:
        need = need.filter(queries)
    if len(features) == 1:
        x = F.col(features[0]).cast("double")
        ask = need.select(F.col(row).alias("id"), x.alias("at")).filter("at is not null and not isnan(at)")
        known = have.select(F.col(row).alias("r_id"), x.alias("v"), F.col(target).alias("label")).filter("v is not null and not isnan(v)")
        return ask.join(_voted(nearest_values(ask.select("at").distinct(), known, k), "at", classify), "at").select(F.col("id").alias(row), F.col("label").alias(target))
    vec = F.array(*[F.col(c).cast("double") for c in features])
    near = nearest(need.select(row, vec.alias("qv")), have.select(F.col(row).alias("_r"), vec.alias("rv")), row, "_r", "qv", "rv", k)
    got = _voted(near.join(have.select(F.col(row).alias("r_id"), F.col(target).alias("label")), "r_id"), "q_id", classify)
    return got.select(F.col("q_id").alias(row), F.col("label").alias(target))


def _voted(near: DataFrame, by: str, classify: bool) -> DataFrame:
    """(by, label): the label of most of the near rows, the smallest of several; or their mean."""
    if not classify:
        return near.groupBy(by).agg(F.avg("label").alias("label"))
    votes = near.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(by).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def nearest_values(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(at, r_id, label): the k rows of known (r_id, v, label) nearest to each different value `at`, ties by r_id.

    The k different values on either side of `at`, with k rows of each, hold them. Values are numbered in ranges, and the
    neighbours follow by an equi-join on these numbers."""
    kept = known.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("r_id"))).filter(F.col("n") <= k).drop("n")
    both = kept.select(F.col("v").alias("x"), F.lit(1).alias("k"), F.lit(0).alias("a")).unionAll(asked.select(F.col("at").alias("x"), F.lit(0), F.lit(1)))
    places = running(both.groupBy("x").agg(F.max("k").alias("k"), F.max("a").alias("a")), "x", "k", "upto")
    numbers = places.filter("k = 1").select(F.col("x").alias("v"), F.col("upto").alias("place"))
    near = places.filter("a = 1").select(F.col("x").alias("at"), F.explode(F.sequence(F.col("upto") - (k - 1), F.col("upto") + k)).alias("place")).join(numbers, "place").join(kept, "v")
    w = Window.partitionBy("at").orderBy(F.abs(F.col("at") - F.col("v")), "r_id")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("at", "r_id", "label")


def write_back(df: DataFrame, filled: DataFrame, row: str, target: str) -> DataFrame:
    """df with its missing targets taken from `filled` (row, target)."""
    got = filled.select(row, F.col(target).alias("_filled"))
    return df.join(got, row, "left").withColumn(target, F.coalesce(target, "_filled")).drop("_filled")
