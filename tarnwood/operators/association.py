"""Association between two columns, and importance of attributes in a decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import average_ranks

MEASURES = ("pearson", "spearman", "kendal", "cov", "mutual_info")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("value"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are present; ranks come from counts of distinct values."""
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ranked = cells.join(average_ranks(both, "a", "ra"), "a").join(average_ranks(both, "b", "rb"), "b")
    n, sa, sb, sab, saa, sbb = (F.sum("n"), F.sum(F.col("n") * F.col("ra")), F.sum(F.col("n") * F.col("rb")), F.sum(F.col("n") * F.col("ra") * F.col("rb")), F.sum(F.col("n") * F.col("ra") ** 2), F.sum(F.col("n") * F.col("rb") ** 2))
    return ranked.agg(((n * sab - sa * sb) / F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))).alias("value"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b. Rows are first counted per pair of values; concordant pairs come from running sums over the grid of values, so
    the cost is (pairs of values) x (values of a), whatever the number of rows: meant for ordinal columns."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    xs = cells.select(F.col("x").alias("at")).distinct()
    # rows with a smaller x: at each x, per y
    left = xs.join(cells, F.col("x") < F.col("at")).groupBy("at", "y").agg(F.sum("n").alias("n"), F.lit(0.0).alias("own"))
    here = cells.select(F.col("x").alias("at"), "y", F.lit(0.0).alias("n"), F.col("n").alias("own"))
    grid = left.unionByName(here).groupBy("at", "y").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    w = Window.partitionBy("at").orderBy("y")
    less = grid.withColumn("less", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("more", F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    score = less.agg(F.sum(F.col("own") * (F.col("less") - F.col("more"))).alias("s"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tx = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(pairs("n").alias("tx"), F.sum("n").alias("all"))
    ty = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ty"))
    total = F.col("all") * (F.col("all") - 1) / 2
    return score.crossJoin(tx).crossJoin(ty).select((F.col("s") / F.sqrt((total - F.col("tx")) * (total - F.col("ty")))).alias("value"))


def scaled_covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg((F.covar_samp(a, b) / F.nullif((F.max(a) - F.avg(a)) * (F.max(b) - F.avg(b)), F.lit(0.0))).alias("value"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """In bits, over values as text; each pair of values is a key of its own."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    na, nb, n = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b")), cells.agg(F.sum("n").alias("all"))
    m = cells.withColumn("na", na).withColumn("nb", nb).crossJoin(n)
    return m.agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("value"))


def measure(name: str):
    """Measure by name; unknown names raise ValueError."""
    by = {"pearson": pearson, "spearman": spearman, "kendal": kendall, "cov": scaled_covariance, "mutual_info": mutual_information}
    if name not in by:
        raise ValueError(f"unknown measure {name!r}")
    return by[name]


def recommended(a: int, b: int) -> list[str]:
    """Measures for two levels (0 nominal, 1 ordinal, 2 interval, 3 ratio)."""
    lo, hi = sorted((a, b))
    if lo == 0:
        return ["mutual_info"] if hi < 2 else []
    if hi == 1:
        return ["spearman", "kendal"]
    return ["pearson"] if lo == 1 else ["pearson", "cov"]


def association_matrix(df: DataFrame, levels: dict[str, int]) -> DataFrame:
    """(f1, f2, value) for every ordered pair: 1 on the diagonal, null where nothing is recommended, 0.6 and 0.4 of the first
    and second measure where two are. Pairs of pearson and cov share one aggregate over the table."""
    names = sorted(levels)
    pairs = [(a, b, recommended(levels[a], levels[b])) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide, rest = [], {}
    for a, b, ms in pairs:
        for m in ms:
            if m == "pearson":
                wide.append(F.corr(a, b).alias(f"{m}:{a}:{b}"))
            elif m == "cov":
                wide.append((F.covar_samp(a, b) / F.nullif((F.max(a) - F.avg(a)) * (F.max(b) - F.avg(b)), F.lit(0.0))).alias(f"{m}:{a}:{b}"))
            else:
                rest[f"{m}:{a}:{b}"] = measure(m)(df, a, b).first()["value"]
    got = rest | (df.agg(*wide).first().asDict() if wide else {})
    out = [(a, a, 1.0) for a in names]
    for a, b, ms in pairs:
        v = [got[f"{m}:{a}:{b}"] for m in ms]
        x = None if not v or None in v else v[0] if len(v) == 1 else 0.6 * v[0] + 0.4 * v[1]
        out += [(a, b, x), (b, a, x)]
    return df.sparkSession.createDataFrame(out, "f1 string, f2 string, value double")


def rough_importance(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(attribute, importance): after duplicate rows are removed, the share of the original rows that become duplicates when
    the attribute is left out (target not compared)."""
    n0 = df.count()
    rows = df.select(*columns, target).dropDuplicates()
    rests = {c: [x for x in columns if x != c] for c in columns}
    agg = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(*[F.col(x) for x in rest]) if rest else F.lit(0)).alias(c) for c, rest in rests.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("attribute"), ((F.col("n") - F.col(c)) / F.lit(float(max(n0, 1)))).alias("importance")) for c in columns])
    return agg.select(F.explode(cells).alias("x")).select("x.*")
