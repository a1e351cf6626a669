"""Queries over numeric tables: profiles, quality, scaling, association, series, mining, sampling, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwood.functions import arrays, scaling
from tarnwood.operators import association, mining, ordering, profile, quality, sampling, series, vectors
from tarnwood.session import table

QUERIES, ORACLES = {}, {}
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, *columns: str) -> DataFrame:
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in names})


def _features(columns: list[str], t: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {t}" for c in columns)


_PROFILE = f"""
WITH f AS ({_features(NUMERIC, 'lineitem')}), m AS (SELECT feature, avg(x) AS mu FROM f GROUP BY feature),
mo AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, x) AS r FROM f GROUP BY feature, x)
SELECT f.feature, count(x) AS "count", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1,
 round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max, round(var_samp(x) / 1000, 4) AS var,
 round(avg((x - mu) ^ 3) / avg((x - mu) ^ 2) ^ 1.5, 4) AS skew, round(avg((x - mu) ^ 4) / avg((x - mu) ^ 2) ^ 2, 4) AS kurt,
 round((SELECT x FROM mo WHERE mo.feature = f.feature AND r = 1), 4) AS mode
FROM f JOIN m ON m.feature = f.feature GROUP BY f.feature
"""


@query(_PROFILE)
def profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.profile(table(spark, sf, "lineitem"), NUMERIC).withColumn("var", F.col("var") / 1000), 4)


@query(f"""
WITH f AS ({_features(NUMERIC, 'lineitem')}), m AS (SELECT feature, avg(x) AS mu FROM f GROUP BY feature),
s AS (SELECT f.feature, count(x) AS "count", avg((x - mu) ^ 3) / avg((x - mu) ^ 2) ^ 1.5 AS skew, avg((x - mu) ^ 4) / avg((x - mu) ^ 2) ^ 2 AS kurt FROM f JOIN m ON m.feature = f.feature GROUP BY f.feature)
SELECT feature, "count", CASE WHEN skew > 0 THEN 'right' WHEN skew < 0 THEN 'left' ELSE 'none' END AS skew_text, abs(kurt - 3) > 2 AS peaked FROM s
""")
def profile_verdicts(spark, sf):
    """Only the moments are computed: the verdicts need no order statistics."""
    return profile.verdicts(profile.moments(table(spark, sf, "lineitem"), NUMERIC)).select("feature", "count", "skew_text", "peaked")


@query()
def normality_tests(spark, sf):
    return profile.normality(table(spark, sf, "orders"), ["o_totalprice"]).unionByName(profile.normality(table(spark, sf, "supplier"), ["s_acctbal"]))


@query(f"""
WITH f AS ({_features(['l_quantity', 'l_extendedprice', 'l_linenumber'], 'lineitem')}),
g AS (SELECT feature, count(x) AS n, CAST(sum(CASE WHEN x % 1 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ints, count(x) - count(DISTINCT x) AS repeats FROM f GROUP BY feature)
SELECT *, CAST(CASE WHEN ints > floor(n / 4) AND repeats > floor(n / 5) THEN 1 ELSE 3 END AS INTEGER) AS level FROM g
""")
def feature_types(spark, sf):
    return profile.feature_types(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])


def labelled(spark, sf) -> DataFrame:
    """Documents with their labels; unlabelled ones have nulls."""
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


@query("""
WITH d AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id AS row, 'quality' AS col FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic IS NULL
""")
def missing_locator(spark, sf):
    return quality.locate_missing(labelled(spark, sf), "doc_id", ["quality", "toxic"])


@query("SELECT event_id AS row, 'outlier' AS kind FROM events, (SELECT stddev_pop(value) AS s FROM events) WHERE value > 3 * s")
def outlier_3a(spark, sf):
    return quality.outliers(table(spark, sf, "events"), "event_id", "value", "3a")


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders),
b AS (SELECT max(CASE WHEN r = CAST(floor(0.75 * (n - 1)) AS BIGINT) THEN x END) AS hi, max(CASE WHEN r = CAST(ceil(0.25 * (n - 1)) AS BIGINT) THEN x END) AS lo FROM o)
SELECT o_orderkey AS row, 'outlier' AS kind FROM o, b WHERE x > hi + 3 * (hi - lo) OR x < lo - 3 * (hi - lo)
""")
def outlier_box(spark, sf):
    return quality.outliers(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", "box")


@query("SELECT p_partkey AS row, 'outlier' AS kind FROM part WHERE NOT p_size BETWEEN 5 AND 45")
def outlier_scope(spark, sf):
    return quality.outliers(table(spark, sf, "part"), "p_partkey", "p_size", "scope", (5, 45))


@query("SELECT o_orderkey AS row, 'outlier' AS kind FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def outlier_discrete(spark, sf):
    return quality.outliers(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "discrete", ("F", "O"))


@query("""
WITH s AS (SELECT stddev_pop(p_retailprice) AS s FROM part)
SELECT 'p_size' AS name, 'scope' AS method, 'outlier' AS kind, p_partkey AS row FROM part WHERE NOT p_size BETWEEN 5 AND 45
UNION ALL SELECT 'p_retailprice', '3a', 'outlier', p_partkey FROM part, s WHERE p_retailprice > 3 * s
UNION ALL SELECT 'p_size', 'discrete', 'outlier', p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)
""")
def outlier_batch(spark, sf):
    return quality.batch_outliers(table(spark, sf, "part"), "p_partkey", {"scope": [("p_size", [5, 45])], "3a": [("p_retailprice", [])], "discrete": [("p_size", [1, 2, 3])]})


@query("""
WITH d AS (SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS q FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(coalesce(q, avg(q) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING), 0), 6) AS quality FROM d
""")
def impute_window_mean(spark, sf):
    df = labelled(spark, sf).withColumn("quality", F.col("quality").cast("double"))
    return rounded(quality.impute_window_mean(df, "quality", ["doc_id"], ["source"]).select("doc_id", "quality"))


@query()
def impute_lagrange(spark, sf):
    df = labelled(spark, sf).withColumn("quality", F.col("quality").cast("double")).select("doc_id", "source", "quality")
    return quality.impute_in_order(df, "quality", "doc_id", "source", window=3)


@query("""
WITH d AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS v, quality FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT q.doc_id, r.quality, row_number() OVER (PARTITION BY q.doc_id ORDER BY sqrt((q.v - r.v) * (q.v - r.v)), r.doc_id) AS k
 FROM d q JOIN d r ON q.quality IS NULL AND r.quality IS NOT NULL),
v AS (SELECT doc_id, quality, count(*) AS c FROM n WHERE k <= 3 GROUP BY doc_id, quality)
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, quality) AS r FROM v) WHERE r = 1
""")
def impute_knn(spark, sf):
    """Every row without a label gets that of the three labelled rows nearest by length."""
    return quality.impute_knn(labelled(spark, sf), "doc_id", ["n_chars"], "quality")


@query(f"SELECT d.doc_id, coalesce(l.quality, f.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN ({ORACLES['impute_knn']}) f USING (doc_id)")
def impute_knn_written_back(spark, sf):
    """All rows, the filled ones with their new label."""
    rows = labelled(spark, sf).select("doc_id", "n_chars", "quality")
    return quality.write_back(rows, quality.impute_knn(rows, "doc_id", ["n_chars"], "quality"), "doc_id", "quality").select("doc_id", "quality")


for _name, _sql in {
    "max-min": "(x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0)",
    "max": "x / max(abs(x)) OVER ()",
    "stand": "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()",
}.items():
    def _scaler(spark, sf, _name=_name):
        return rounded(scaling.scale(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], _name), 6)

    QUERIES[f"scale_{_name.replace('-', '_')}"] = _scaler
    ORACLES[f"scale_{_name.replace('-', '_')}"] = f"SELECT o_orderkey, round({_sql}, 6) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)"

_CELLS = "cells AS (SELECT p_size AS x FROM part UNION ALL SELECT p_retailprice FROM part), t AS (SELECT max(x) AS hi, min(x) AS lo, avg(x) AS m, stddev_pop(x) AS s FROM cells)"
for _name, _e in {"u-max": "x / abs(hi)", "u-max-min": "(x - lo) / (hi - lo)", "u-stand": "(x - m) / s", "decimal": "x / hi"}.items():
    def _global(spark, sf, _name=_name):
        return rounded(scaling.scale(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], _name), 6)

    QUERIES[f"scale_{_name.replace('-', '_')}"] = _global
    ORACLES[f"scale_{_name.replace('-', '_')}"] = f"WITH {_CELLS} SELECT p_partkey, round({_e.replace('x /', 'CAST(p_size AS DOUBLE) /').replace('(x ', '(CAST(p_size AS DOUBLE) ')}, 6) AS p_size, round({_e.replace('x /', 'p_retailprice /').replace('(x ', '(p_retailprice ')}, 6) AS p_retailprice FROM part, t"


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_retailprice FROM part")
def scale_norm(spark, sf):
    return rounded(scaling.scale(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "norm"))


@query("""
WITH c AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT x, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM c)
SELECT x AS l_quantity, round((r - 1) / (sum(n) OVER () - 1), 6) AS scaled, n FROM r
""")
def scale_quantile(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", F.col("l_quantity").alias("scaled"))
    return rounded(scaling.scale(df, ["scaled"], "qt").groupBy("l_quantity", "scaled").agg(F.count(F.lit(1)).alias("n")), 6, "scaled")


@query("""
WITH c AS (SELECT p_partkey, p_size, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS cls FROM part)
SELECT p_partkey, CAST(cls AS INTEGER) AS cls, round(avg(p_size) OVER (PARTITION BY cls), 6) AS replaced FROM c
""")
def discretize_scope(spark, sf):
    return rounded(scaling.discretize_scope(table(spark, sf, "part"), "p_size", [10, 25, 50], "mean").select("p_partkey", "cls", "replaced"))


@query()
def discretize_auto(spark, sf):
    return scaling.discretize_auto(table(spark, sf, "part"), "p_retailprice")


@query("SELECT round(avg(abs(value - m)), 6) AS mad, round(max(value) - min(value), 6) AS spread FROM events, (SELECT avg(value) AS m FROM events)")
def mean_deviation(spark, sf):
    return rounded(scaling.mean_deviation(table(spark, sf, "events"), "value"))


@query("SELECT 'pearson' AS measure, round(corr(l_quantity, l_extendedprice), 6) AS value FROM lineitem UNION ALL SELECT 'cov', round(covar_samp(l_quantity, l_extendedprice) / ((max(l_quantity) - avg(l_quantity)) * (max(l_extendedprice) - avg(l_extendedprice))), 6) FROM lineitem")
def pearson_cov(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(association.pearson(df, "l_quantity", "l_extendedprice").select(F.lit("pearson").alias("measure"), "value").unionByName(association.scaled_covariance(df, "l_quantity", "l_extendedprice").select(F.lit("cov").alias("measure"), "value")))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS value FROM r
""")
def spearman(spark, sf):
    return rounded(association.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""
WITH c AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
tx AS (SELECT sum(n * (n - 1) / 2) AS t, sum(n) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS u FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(s / sqrt((a * (a - 1) / 2 - t) * (a * (a - 1) / 2 - u)), 6) AS value FROM s, tx, ty
""")
def kendall(spark, sf):
    return rounded(association.kendall(table(spark, sf, "lineitem"), "l_quantity", "l_discount"))


@query("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)
SELECT round(sum(n / t * log2(n * t / (na * nb))), 6) AS value FROM w
""")
def mutual_info(spark, sf):
    return rounded(association.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""
WITH m AS (SELECT corr(l_quantity, l_extendedprice) * 0.6 + 0.4 * covar_samp(l_quantity, l_extendedprice) / ((max(l_quantity) - avg(l_quantity)) * (max(l_extendedprice) - avg(l_extendedprice))) AS qe,
 corr(l_quantity, l_linenumber) AS ql, corr(l_extendedprice, l_linenumber) AS el FROM lineitem)
SELECT f1, f2, round(v, 6) AS value FROM (
 SELECT 'l_quantity' AS f1, 'l_extendedprice' AS f2, qe AS v FROM m UNION ALL SELECT 'l_extendedprice', 'l_quantity', qe FROM m UNION ALL SELECT 'l_quantity', 'l_linenumber', ql FROM m
 UNION ALL SELECT 'l_linenumber', 'l_quantity', ql FROM m UNION ALL SELECT 'l_extendedprice', 'l_linenumber', el FROM m UNION ALL SELECT 'l_linenumber', 'l_extendedprice', el FROM m
 UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0 UNION ALL SELECT 'l_linenumber', 'l_linenumber', 1.0)
""")
def assoc_matrix(spark, sf):
    return rounded(association.association_matrix(table(spark, sf, "lineitem"), {"l_quantity": 3, "l_extendedprice": 3, "l_linenumber": 1}))


@query("""
WITH d AS (SELECT DISTINCT l_linenumber, l_returnflag, l_linestatus, l_discount FROM lineitem), n AS (SELECT count(*) AS n0 FROM lineitem), k AS (SELECT count(*) AS k FROM d)
SELECT 'l_linenumber' AS attribute, round((k - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM d))) / n0, 6) AS importance FROM n, k
UNION ALL SELECT 'l_returnflag', round((k - (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_linestatus FROM d))) / n0, 6) FROM n, k
UNION ALL SELECT 'l_linestatus', round((k - (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_returnflag FROM d))) / n0, 6) FROM n, k
""")
def rough_importance(spark, sf):
    return rounded(association.rough_importance(table(spark, sf, "lineitem"), ["l_linenumber", "l_returnflag", "l_linestatus"], "l_discount"))


_TREND = """
WITH s AS (SELECT user_id, event_id, value AS x, row_number() OVER w AS i, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c,
 max(value) OVER p AS hi, min(value) OVER p AS lo, count(*) OVER p AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), p AS (PARTITION BY user_id)),
d AS (SELECT *, CASE WHEN i = 1 THEN 0.0::DOUBLE WHEN i = 2 THEN 0.3::DOUBLE * (x - a) WHEN i = 3 THEN 0.3::DOUBLE * (a - b) + 0.6::DOUBLE * (x - a) ELSE 0.1::DOUBLE * (b - c) + 0.3::DOUBLE * (a - b) + 0.6::DOUBLE * (x - a) END AS k FROM s),
p AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE (CASE WHEN x = hi OR x = lo THEN -0.1::DOUBLE ELSE 1 END) * (k + sign(k) * (CASE WHEN k > 0 THEN hi - x ELSE x - lo END)) / nullif(hi - lo, 0) END AS v, sum(k) OVER (PARTITION BY user_id) / n AS mk FROM d)
SELECT user_id, event_id, round(CASE WHEN round(v, 4) = 0 THEN mk ELSE round(v, 4) END, 4) AS score FROM p
"""


@query(_TREND)
def trend_score(spark, sf):
    return rounded(series.trend_score(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "score"), 4)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
w AS (SELECT *, count(t) OVER b AS n, lag(t) OVER o AS l, first_value(t) OVER b AS f FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id), b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, round(CASE WHEN n = 0 THEN 0.01 WHEN n = 1 THEN l / (greatest(t - l, l) * 1.2) ELSE (t - l + 0.95) / ((l - f) / (n - 1) + 1) END, 5) AS ratio FROM w
""")
def gap_ratio(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("i", F.row_number().over(w))
    return rounded(series.gap_ratio(e, "user_id", "i", "t").select("user_id", "event_id", "ratio"), 5)


_EXTREMA = """
WITH s AS (SELECT user_id, event_id, value AS x, lag(value) OVER w AS p, lead(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT user_id, event_id, x, coalesce(last_value(CASE WHEN x <> p THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS b,
 coalesce(first_value(CASE WHEN x <> f THEN f END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS a FROM s),
e AS (SELECT user_id, event_id, x, CASE WHEN x > b AND x > a THEN 'max' WHEN x < b AND x < a THEN 'min' END AS extremum FROM t)
"""


@query(_EXTREMA + "SELECT user_id, event_id, extremum FROM e")
def local_extrema(spark, sf):
    return series.local_extrema(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "extremum")


@query(_EXTREMA + ", g AS (SELECT user_id, avg(CASE WHEN extremum = 'max' THEN x END) AS h, avg(CASE WHEN extremum = 'min' THEN x END) AS l FROM e GROUP BY user_id) SELECT user_id, round(coalesce(h, l), 6) AS hi_mean, round(coalesce(l, h), 6) AS lo_mean FROM g")
def extremum_means(spark, sf):
    return rounded(series.extremum_means(series.local_extrema(table(spark, sf, "events"), "user_id", "event_id", "value"), "user_id", "value"))


def baskets(spark, sf) -> DataFrame:
    """Brands of an order's lines."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), "l_partkey")
    return li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("tid").agg(F.collect_list("p_brand").alias("items"))


_BASKET = "r AS (SELECT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT item, count(*) AS cnt FROM r GROUP BY item)"


@query(f"WITH {_BASKET} SELECT * FROM f")
def item_freq(spark, sf):
    return mining.item_frequency(baskets(spark, sf))


@query(f"""
WITH {_BASKET}, k AS (SELECT DISTINCT r.tid, r.item FROM r JOIN f USING (item) WHERE cnt >= 3),
p AS (SELECT a.item AS a, b.item AS b, '' AS c, count(*) AS support FROM k a JOIN k b ON a.tid = b.tid AND a.item < b.item GROUP BY 1, 2),
t AS (SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS support FROM k a JOIN k b ON a.tid = b.tid AND a.item < b.item JOIN k c ON c.tid = b.tid AND b.item < c.item GROUP BY 1, 2, 3),
u AS (SELECT * FROM p UNION ALL SELECT * FROM t),
m AS (SELECT u.a, u.b, u.c, u.support, arg_min(f.item, (-f.cnt, f.item)) AS max_item, max(f.cnt) AS max_val FROM u JOIN f ON f.item IN (u.a, u.b, u.c) GROUP BY ALL)
SELECT CASE WHEN c = '' THEN a || ',' || b ELSE a || ',' || b || ',' || c END AS items, support, max_item, max_val, round(support / max_val, 6) AS confidence FROM m WHERE support / max_val >= 0.02
""")
def apriori_pairs_triples(spark, sf):
    out = mining.apriori(baskets(spark, sf), confidence=0.02)
    return rounded(out.withColumn("items", F.array_join("items", ",")))


_ORDERED = f"{_BASKET}, o AS (SELECT tid, list(item ORDER BY cnt DESC, item) AS items, CAST(sum(cnt) AS BIGINT) AS total FROM r JOIN f USING (item) GROUP BY tid HAVING max(cnt) >= 2)"


@query(f"WITH {_ORDERED} SELECT tid, array_to_string(items, ',') AS items, total FROM o")
def ordered_baskets(spark, sf):
    return mining.ordered_baskets(baskets(spark, sf)).withColumn("items", F.array_join("items", ","))


_PREFIX = f"{_ORDERED}, p AS (SELECT array_to_string(items[1:n], ',') AS path, n, count(*) AS support FROM (SELECT items, unnest(range(1, len(items) + 1)) AS n FROM o) GROUP BY 1, 2)"


@query(f"WITH {_PREFIX} SELECT path, support FROM p")
def fp_prefix_counts(spark, sf):
    return mining.prefix_counts(mining.ordered_baskets(baskets(spark, sf))).withColumn("path", F.array_join("path", ","))


@query(f"WITH {_ORDERED}, p AS (SELECT DISTINCT items[1:n] AS path FROM (SELECT items, unnest(range(1, len(items) + 1)) AS n FROM o)) SELECT array_to_string(path, ',') AS path FROM p WHERE path NOT IN (SELECT path[1:len(path) - 1] FROM p WHERE len(path) > 1)")
def fp_leaf_paths(spark, sf):
    return mining.leaf_paths(mining.prefix_counts(mining.ordered_baskets(baskets(spark, sf)))).select(F.array_join("path", ",").alias("path"))


@query(f"""
WITH {_ORDERED}, p AS (SELECT DISTINCT items[1:n] AS path FROM (SELECT items, unnest(range(1, len(items) + 1)) AS n FROM o)),
l AS (SELECT path FROM p WHERE path NOT IN (SELECT path[1:len(path) - 1] FROM p WHERE len(path) > 1)),
i AS (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM l), a AS (SELECT path[i] AS item, unnest(list_distinct(path[1:i - 1])) AS ancestor FROM i WHERE i > 1)
SELECT item, ancestor, count(*) AS paths FROM a GROUP BY ALL
""")
def fp_ancestors(spark, sf):
    return mining.ancestor_counts(mining.leaf_paths(mining.prefix_counts(mining.ordered_baskets(baskets(spark, sf)))))


@query()
def fp_growth_rules(spark, sf):
    return mining.frequent_sets(baskets(spark, sf), 0.01, 0.05)[1].select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.round("confidence", 6).alias("confidence"))


_TRIPLES = "t AS (SELECT DISTINCT 'c' || o_custkey AS head, 'status' AS relation, o_orderstatus AS tail FROM orders UNION SELECT DISTINCT 'c' || o_custkey, 'priority', o_orderpriority FROM orders), e AS (SELECT name, dense_rank() OVER (ORDER BY name) AS id FROM (SELECT head AS name FROM t UNION SELECT tail FROM t)), rel AS (SELECT a.id AS start_id, t.relation AS name, b.id AS end_id FROM t JOIN e a ON a.name = head JOIN e b ON b.name = tail)"


def _relation(spark, sf):
    o, head = table(spark, sf, "orders"), F.concat(F.lit("c"), F.col("o_custkey")).alias("head")
    triples = o.select(head, F.lit("status").alias("relation"), F.col("o_orderstatus").alias("tail")).unionAll(o.select(head, F.lit("priority"), "o_orderpriority")).distinct()
    return mining.encode_triples(triples)[1]


@query(f"WITH {_TRIPLES} SELECT start_id, name, end_id FROM rel")
def triples_encode(spark, sf):
    return _relation(spark, sf).withColumns({c: F.col(c).cast("long") for c in ("start_id", "end_id")})


@query(f"WITH {_TRIPLES}, n AS (SELECT start_id AS id, end_id AS other, name FROM rel UNION ALL SELECT end_id, start_id, name FROM rel) SELECT id, name, count(*) AS degree FROM n GROUP BY id, name")
def graph_degrees(spark, sf):
    return mining.neighbours(_relation(spark, sf)).groupBy(F.col("id").cast("long").alias("id"), "name").agg(F.count(F.lit(1)).alias("degree"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"


@query(f"WITH d AS (SELECT a.vec_id AS q_id, b.vec_id AS r_id, {_DIST} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, r_id) AS rank FROM d) SELECT q_id, r_id, round(dist, 5) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def knn_exact(spark, sf):
    """A search: vectors whose id is divisible by 100 against all."""
    e = table(spark, sf, "embeddings")
    return rounded(quality.nearest(e.filter("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("qv")), e.select("vec_id", F.col("embedding").alias("rv")), "vec_id", "vec_id", "qv", "rv", 10), 5)


@query(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_DIST}, 5) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id")
def pairwise_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(vectors.pairwise_distance(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding"), 5)


@query()
def kmeans_tree_search(spark, sf):
    e = table(spark, sf, "embeddings")
    nodes, leaves = vectors.build_tree(e, "vec_id", "embedding", [6, 3])
    return vectors.search_tree_proven(e.filter("vec_id % 100 = 0"), nodes, leaves, "vec_id", "embedding", "vec_id", [3, 4], 10)


@query()
def pca_components(spark, sf):
    return vectors.principal_strengths(table(spark, sf, "embeddings"), "embedding")


@query()
def svd_values(spark, sf):
    return vectors.singular_values(table(spark, sf, "embeddings"), "embedding")


@query()
def factor_analysis(spark, sf):
    return vectors.factor_loadings(table(spark, sf, "embeddings"), "embedding")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= (SELECT round_even(count(*) * 0.8, 0) FROM events) THEN 'train' ELSE 'test' END AS part FROM events")
def split_train_test(spark, sf):
    return sampling.split(table(spark, sf, "events"), ["event_id"]).select("event_id", "part")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 120) AS BIGINT) AS batch FROM events")
def batches(spark, sf):
    return sampling.batches(table(spark, sf, "events"), ["event_id"], 120).select("event_id", "batch")


@query("SELECT event_type, event_id, r - 1 AS pos FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 200")
def first_n_per_class(spark, sf):
    return sampling.first_per_class(table(spark, sf, "events"), "event_type", ["event_id"]).select("event_type", "event_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT conv_id, turn, text AS question, a AS answer FROM (SELECT *, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def dialog_pairs(spark, sf):
    return sampling.dialogue_pairs(table(spark, sf, "conversations"))


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_suppliers(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey").distinct()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf):
    return rounded(table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("""
WITH e AS (SELECT *, list_position(['click', 'view', 'purchase'], event_type) AS k FROM events)
SELECT event_id, array_to_string(list_transform(range(0, 5), lambda c: CASE WHEN c = coalesce(k, 0) THEN 1 ELSE 0 END), ',') AS hot FROM e
""")
def one_hot_type(spark, sf):
    label = F.array_position(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(arrays.one_hot(F.coalesce(label, F.lit(0)).cast("int"), 5), ",").alias("hot"))


@query("""
WITH s AS (SELECT i AS step FROM range(0, 1000) t(i))
SELECT step, round(0.0003 * sqrt(4000.0) * least((step + 1) * pow(4000.0, -1.5), pow(step + 1, -0.5)), 10) AS noam, round(CASE WHEN step < 100 THEN 0.01 * step / 100.0 ELSE 0.01 * (1 - least(step, 1000) / 1000.0) END, 10) AS warm,
 round((0.1 - 0.001) * (1 - least(step, 1000) / 1000.0) + 0.001, 10) AS poly, round(0.05 * pow(0.1, step / 20000.0), 10) AS expo FROM s
""")
def lr_schedules(spark, sf):
    s = spark.range(1000).select(F.col("id").alias("step"))
    step = F.col("step")
    return rounded(s.select("step", arrays.noam_rate(step, 0.0003).alias("noam"), arrays.warmup_linear_rate(step, 0.01, 1000, 100).alias("warm"), arrays.polynomial_rate(step).alias("poly"), arrays.exponential_rate(step).alias("expo")), 10)


@query("SELECT p AS pos, i, round(CASE WHEN i % 2 = 0 THEN sin(p / pow(10000.0, (i - i % 2) / 16.0)) ELSE cos(p / pow(10000.0, (i - i % 2) / 16.0)) END, 6) AS v FROM range(0, 64) a(p), range(0, 16) b(i)")
def position_encoding(spark, sf):
    t = spark.range(64).select(F.col("id").alias("pos"), F.posexplode(arrays.position_encoding(F.col("id"), 16)).alias("i", "v"))
    return rounded(t.withColumn("i", F.col("i").cast("long")))


@query("SELECT p_partkey, round(0.9 * (CASE WHEN p_size % 3 = c THEN 1.0 ELSE 0.0 END) + 0.1 / 3, 6) AS v, CAST(c AS INTEGER) AS c FROM part, range(0, 3) t(c)")
def label_smoothing(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(arrays.label_smoothing(F.transform(arrays.one_hot(F.col("p_size") % 3, 3), lambda v: v.cast("double")))).alias("c", "v"))
    return rounded(p.select("p_partkey", "v", "c"))


@query("SELECT p_partkey, round(p_size / 10.0 / (1 + exp(-p_size / 10.0)), 6) AS swish, round(0.5 * p_size / 10.0 * (1 + tanh(sqrt(2 / pi()) * (p_size / 10.0 + 0.044715 * pow(p_size / 10.0, 3)))), 6) AS gelu, CAST(floor((p_size - 3 + 1) / 2) AS BIGINT) AS width FROM part")
def activations(spark, sf):
    x = F.col("p_size") / 10.0
    return rounded(table(spark, sf, "part").select("p_partkey", arrays.swish(x).alias("swish"), arrays.gelu(x).alias("gelu"), arrays.cnn_width(F.col("p_size"), 3, 2).alias("width")))


@query("""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_avg(e) AS m FROM r),
v AS (SELECT vec_id, e, m, list_avg(list_transform(e, lambda x: (x - m) * (x - m))) AS v FROM m)
SELECT vec_id, round((e[1] - m) / sqrt(v + 1e-8), 5) AS first, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS top, round(exp(e[1] - list_max(e)) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS p FROM v
""")
def norm_softmax(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    t = table(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    return t.select("vec_id", F.round(arrays.layer_norm(F.col("e"))[0], 5).alias("first"), arrays.argmax(F.col("e")).alias("top"), F.round(arrays.softmax(F.col("e"))[0], 6).alias("p"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf):
    n = F.broadcast(table(spark, sf, "nation")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT event_id FROM events EXCEPT ALL SELECT event_id FROM events WHERE event_type = 'click'")
def set_difference(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id").exceptAll(e.filter("event_type = 'click'").select("event_id"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf):
    from tarnwood.streaming.events import tumbling

    return tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type FROM events)
SELECT start, event_type, count(*) AS n FROM (SELECT day AS start, event_type FROM d UNION ALL SELECT day - INTERVAL 1 DAY, event_type FROM d) GROUP BY 1, 2
""")
def sliding_events(spark, sf):
    from tarnwood.streaming.events import sliding

    return sliding(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def largest_orders(spark, sf):
    """A report of the first five: the limit is the feature."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def session_events(spark, sf):
    from tarnwood.streaming.events import sessions

    out = sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def numbered_events(spark, sf):
    return ordering.numbered(table(spark, sf, "events").select("event_id"), ["event_id"])
