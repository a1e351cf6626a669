"""Small literal cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tarnwood import registry
from tarnwood.functions import arrays, scaling
from tarnwood.functions import text as tf
from tarnwood.operators import association, inference, learn, mining, ordering, profile, quality, sampling, segment, series, text, trees, vectors

BOX = [1, 2, 2, 3, 4, 5, 6, 7, 8, 60]
BASKETS = ["abdc", "fbmab", "fbcd", "kbfc", "kgc", "abcd", "dbfc"]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(BOX)], "idx long, x double")


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([(i, list(b)) for i, b in enumerate(BASKETS)], "tid long, items array<string>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("method", "values", "want"), [("3a", (), [9]), ("box", (), [9]), ("scope", (2, 8), [0, 9]), ("discrete", (1, 2, 60), [3, 4, 5, 6, 7, 8]), ("other", (), [])])
def test_outliers(sample, method, values, want):
    assert sorted(r.row for r in quality.outliers(sample, "idx", "x", method, values).collect()) == want


def test_missing_is_not_an_outlier(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan")), (3, 99.0)], "idx long, x double")
    got = {(r.row, r.kind) for r in quality.outliers(df, "idx", "x", "scope", (0, 10)).collect()}
    assert got == {(1, "missing"), (2, "missing"), (3, "outlier")}
    assert {(r.row, r.col) for r in quality.locate_missing(df, "idx", ["x"], [99.0]).collect()} == {(1, "x"), (2, "x"), (3, "x")}


def test_profile(sample):
    r = profile.profile(sample, ["x"]).first()
    assert (round(r["var"], 1), round(r["skew"], 6), round(r["kurt"], 6), r["mode"], r["median"]) == (316.4, 2.584089, 7.853274, 2.0, 4.5)


def test_shapiro():
    w, p = profile.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.01 and 0.004 < p < 0.01
    assert profile.shapiro(range(1, 21))[1] > 0.2


def test_window_mean_and_lagrange(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 9.0), (3, 16.0)], "idx long, x double").withColumn("g", F.lit(1))
    assert [r.x for r in quality.impute_window_mean(df, "x", ["idx"], ["g"], 2).orderBy("idx").collect()] == [1.0, 5.0, 9.0, 16.0]
    got = [r.x for r in quality.impute_in_order(df, "x", "idx", "g", 3).orderBy("idx").collect()]
    assert abs(got[1] - quality.lagrange([0, 2, 3], [1, 9, 16], 1)) < 1e-9 and abs(got[1] - 4) < 1e-9


def test_knn(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 9.0, "b"), (4, 1.5, None)], "id long, f double, y string")
    assert [(r.id, r.y) for r in quality.impute_knn(df, "id", ["f"], "y", 3).collect()] == [(4, "a")]


def test_scalers(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "id long, a double, b double")
    flat = lambda name: [round(v, 6) for r in scaling.scale(df, ["a", "b"], name).orderBy("id").collect() for v in (r.a, r.b)]
    assert flat("u-stand") == [-1.341641, -0.447214, 0.447214, 1.341641]
    assert flat("decimal") == flat("u-max") == [0.25, 0.5, 0.75, 1.0]
    assert flat("max-min") == flat("qt") == [0, 0, 1, 1]
    assert flat("stand") == [-1, -1, 1, 1]
    assert flat("norm") == [round(x, 6) for x in (1 / math.sqrt(5), 2 / math.sqrt(5), 0.6, 0.8)]
    with pytest.raises(ValueError):
        scaling.scale(df, ["a"], "nothing")


def test_discretize(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 11, 12, 30)], "x double")
    got = {r.value: r.cls for r in scaling.discretize_auto(df, "x").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 10: 1, 11: 1, 12: 1, 30: 2}
    assert [r.replaced for r in scaling.discretize_scope(df, "x", [3, 12, 40], "mean").orderBy("x").collect()] == [2, 2, 2, 11, 11, 11, 30]
    with pytest.raises(Exception, match="above the last bound"):
        scaling.discretize_scope(df, "x", [3, 12]).collect()
    with pytest.raises(ValueError):
        scaling.discretize_scope(df, "x", [3], "median")


def test_association(spark):
    df = spark.createDataFrame(list(zip("aabbcc", "xxyyyx", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 1.0, 4.0, 3.0, 6.0, 5.0])), "a string, b string, p double, q double")
    assert abs(association.mutual_information(df, "a", "b").first().value - 2 / 3) < 1e-9
    assert abs(association.kendall(df, "p", "q").first().value - 0.6) < 1e-9
    assert abs(association.spearman(df, "p", "q").first().value - association.pearson(df, "p", "q").first().value) < 1e-9
    with pytest.raises(ValueError):
        association.measure("cosine")
    assert association.recommended(3, 3) == ["pearson", "cov"] and association.recommended(0, 3) == []


def test_correlation_ignores_scale(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 17 % 97).cast("double").alias("b")).withColumn("c", F.col("a") * 5 + 3)
    for m in (association.pearson, association.spearman, association.kendall):
        assert abs(m(df, "a", "b").first().value - m(df, "c", "b").first().value) < 1e-9


def test_items_and_paths(baskets):
    assert {r.item: r.cnt for r in mining.item_frequency(baskets).collect()} == dict(a=3, b=7, c=6, d=4, f=4, k=2, m=1, g=1)
    kept = mining.apriori(baskets).collect()
    assert [(r["items"], r.support, r.max_item, r.max_val, round(r.confidence, 4)) for r in kept] == [(["b", "c"], 5, "b", 7, 0.7143)]
    ordered = mining.ordered_baskets(baskets)
    assert [r.total for r in ordered.orderBy("tid").collect()] == [20, 22, 21, 19, 9, 20, 21]
    prefixes = mining.prefix_counts(ordered)
    support = {tuple(r.path): r.support for r in prefixes.collect()}
    assert all(support[p[:-1]] >= n for p, n in support.items() if len(p) > 1)
    assert mining.ancestor_counts(mining.leaf_paths(prefixes)).filter("item = 'c' and ancestor = 'b'").first().paths >= 2


def test_triples(spark):
    t = spark.createDataFrame([("b", "r", "a"), ("a", "r", "c")], "head string, relation string, tail string")
    entity, relation = mining.encode_triples(t)
    assert {(r.id, r.name) for r in entity.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in relation.collect()} == {(2, "r", 1), (1, "r", 3)} and mining.neighbours(relation).count() == 4


def test_bm25_and_keywords(spark):
    docs = [["w1", "w2", "w2"], ["w2", "w3"], ["w4", "w4", "w1", "w5"]]
    toks = spark.createDataFrame([(i, p, w) for i, d in enumerate(docs) for p, w in enumerate(d)], "doc_id long, pos int, word string")
    got = {(r.q_id, r.doc_id): r.score for r in text.bm25_scores(toks.select(F.col("doc_id").alias("q_id"), "word"), text.bm25_parts(toks)).collect()}
    want = [[-1.970327, -1.201943, -0.444196], [-0.729751, 0, 0], [-0.510826, 0, 1.318260]]
    assert all(abs(got.get((i, j), 0) - want[i][j]) < 1e-5 for i in range(3) for j in range(3)) or all(abs(got.get((j, i), 0) - want[i][j]) < 1e-5 for i in range(3) for j in range(3))
    assert [(r.word, round(r.score, 6)) for r in text.keywords(toks, 3).orderBy("rank").collect()] == [("w2", 1.142857), ("w1", 0.857143), ("w4", 0.428571)]


def test_ngrams(spark):
    d = lambda a, b: one(spark, tf.ngram_distance(F.lit(a), F.lit(b)))
    assert (d("abcdef", "abcxef"), d("abcd", "abcd"), d("abc", "xbc")) == (2, 0, 2)


def test_series(spark):
    s = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 4, 6])], "k string, t long, v double")
    got = [r.score for r in series.trend_score(s, "k", "t", "v").orderBy("t").collect()]
    assert all(abs(a - b) < 1e-4 for i, (a, b) in enumerate(zip(got, [0.514286, 0.72, 0.514286, 0.54, 0.44, 0.4, -0.022])) if i != 5)
    g = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 3, 4, 8, 9, 15, 16])], "k string, t long, v double")
    assert [round(r.ratio, 6) for r in series.gap_ratio(g, "k", "t", "v").orderBy("t").collect()] == [0.01, 0.416667, 0.65, 1.98, 0.585, 2.316667, 0.4875]
    flat = s.withColumn("v", F.lit(2.0))
    assert {r.score for r in series.trend_score(flat, "k", "t", "v").collect()} == {0.0}
    assert [r.extremum for r in series.local_extrema(s, "k", "t", "v").orderBy("t").collect()] == [None, "max", "min", "max", "min", "min", "max"]
    run = series.islands(s, ["k"], "t", F.col("t") % 3 == 0)
    assert [r.island for r in run.orderBy("t").collect()] == [1, 1, 1, 2, 2, 2, 3]


def test_time_phrases(spark):
    now = F.lit("2024-02-28").cast("date")
    at = lambda s: one(spark, tf.phrase_time(F.lit(s), now))
    assert at("今年三月五日") == "2024-3-5," and at("去年十二月二十日下午三点") == "2023-12-20,3:00"
    assert at("后天") == "2024-3-1," and at("明天八点三十分") == "2024-2-29,8:30"
    assert [one(spark, tf.time_grade(F.lit(s))) for s in ("去年三月", "五月", "昨天", "三点", "无")] == [5, 4, 3, 2, None]
    assert [one(spark, tf.chinese_number(F.lit(s))) for s in ("十", "十五", "二十", "三十二", "两点")] == ["10", "15", "20", "32", "2"]
    assert one(spark, tf.time_phrases(F.lit("我昨天下午三点去，明天回"))) == ["昨天下午三点", "明天"]
    assert tuple(one(spark, tf.hms(F.lit(3725.9)))) == (1, 2, 5)


def test_sentences(spark):
    assert one(spark, tf.sentences(F.lit("一。二；三。"), "[。；]")) == ["一", "二", "三", ""]
    assert one(spark, tf.normalised_row(F.lit("a\nb c"))) == "a。b，c"
    assert [one(spark, tf.bmes(F.lit(w))) for w in ("x", "xy", "xyzw")] == ["S", "BE", "BMME"]
    stop = F.array(F.lit("的"))
    assert [one(spark, tf.is_stop(F.lit(w), stop)) for w in ("的", "文字", "word")] == [True, False, True]


def test_segmentation(spark):
    lines = spark.createDataFrame([(0, "中文 字 好看"), (1, "字 中文 好看")], "line_no long, line string")
    model = segment.train(lines)
    assert abs(sum(r.p for r in model[0].collect()) - 1) < 1e-9
    docs = spark.createDataFrame([(1, "中文好看字"), (2, ""), (3, None), (4, "新")], "id long, text string")
    got = {r.id: r.words for r in segment.cut(docs, model).collect()}
    assert got[1] == ["中文", "好看", "字"] and got[2] == got[3] == [] and got[4] == ["新"]


def test_arrays(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, arrays.one_hot(F.lit(2), 4, 1)) == [0, 1, 0, 0]
    assert one(spark, arrays.pad(a(1, 2, 3), 5)) == [1, 2, 3, 0, 0] and one(spark, arrays.pad(a(1, 2, 3), 2)) == [1, 2]
    assert [round(x, 4) for x in one(spark, arrays.label_smoothing(a(0.0, 1.0, 0.0)))] == [0.0333, 0.9333, 0.0333]
    assert one(spark, arrays.masked_half(a(5, 6, 7, 8), F.lit(1), 0)).count(0) == 2
    assert abs(sum(one(spark, arrays.softmax(a(1.0, 2.0, 3.0)))) - 1) < 1e-12 and one(spark, arrays.argmax(a(1.0, 3.0, 3.0))) == 1
    n = one(spark, arrays.layer_norm(a(1.0, 2.0, 3.0)))
    assert abs(n[2] - math.sqrt(1.5)) < 1e-6 and abs(n[1]) < 1e-9
    assert one(spark, arrays.mask_penalty(a(1, 0))) == [0.0, -4294967295.0]
    assert one(spark, arrays.subset(a(1), a(1, 2))) and not one(spark, arrays.subset(a(3), a(1, 2)))
    assert abs(one(spark, arrays.sigmoid_loss(F.lit(0.0), F.lit(1.0), 1.0)) - math.log(2)) < 1e-9
    assert abs(one(spark, arrays.sparse_softmax_loss(a(0.0, 0.0), F.lit(1))) - math.log(2)) < 1e-9
    p, m, v = arrays.adamw_step(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.0), 0.1)
    assert abs(one(spark, p) - (1 - 0.1 * (0.05 / (math.sqrt(0.00025) + 1e-6) + 0.01))) < 1e-9
    with pytest.raises(ValueError):
        arrays.activation("cube")


def test_sampling(spark):
    df = spark.range(10).repartition(3)
    parts = sampling.split(df, ["id"]).collect()
    assert {r.id for r in parts if r.part == "test"} == {8, 9}
    assert {r.id: r.batch for r in sampling.batches(df, ["id"], 4).collect()}[9] == 2
    assert [r.id for r in sampling.shuffled(df, "id", 3).collect()] == [r.id for r in sampling.shuffled(df.repartition(2), "id", 3).collect()]
    assert sampling.bars(spark).count() == 4 and sampling.grid(spark, 5).filter("plot = 5").first().row == 3
    with pytest.raises(ValueError):
        sampling.grid(spark, 3, 3)
    t = trees.balanced(spark, [5, 1, 3])
    assert [r.val for r in trees.in_order(t).orderBy("pos").collect()] == [1, 3, 5] and trees.children(t, 1).count() == 2


@pytest.mark.parametrize("parts", [1, 8])
def test_positions_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id").repartition(parts)
    assert ordering.numbered(df, ["x", "id"]).filter("pos <> x").count() == 0
    assert ordering.order_statistics(df, "x", [0, 500, 999]) == [0, 500, 999]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "idx long, x double, g string")
    assert quality.outliers(e, "idx", "x", "box").count() == quality.outliers(e, "idx", "x", "3a").count() == 0
    assert ordering.numbered(e, ["x"]).count() == 0 and profile.profile(e, ["x"]).count() == 0
    assert series.trend_score(e, "g", "idx", "x").count() == 0
    one_row = spark.createDataFrame([(0, 1.0, "g")], "idx long, x double, g string")
    assert quality.outliers(one_row, "idx", "x", "box").count() == 0 and sampling.split(one_row, ["idx"]).first().part == "train"


def test_network_parts(spark):
    import numpy as np

    s = inference.key_mask(np.zeros((2, 2, 3)), np.array([[0, 0, 1], [0, 1, 1]]))
    assert (s[0, :, :2] < -4e9).all() and (s[0, :, 2] == 0).all() and (s[1, :, 1:] == 0).all()
    w = inference.random_weights(50, 8, 6, 3)
    ids = np.array([[1, 2, 3, 0, 0, 0], [4, 5, 6, 7, 8, 9]])
    assert inference.encoder(ids, w).shape == (2, 6, 8) and inference.pooled(inference.encoder(ids, w), w).shape == (2, 8)
    assert inference.gru(w["embed"][ids], {k: np.ones((13, 5)) * 0.1 for k in "zrh"}).shape == (2, 5)
    df = spark.createDataFrame([(1, ids[0].tolist()), (2, ids[1].tolist())], "id long, ids array<int>")
    out = inference.infer(df, inference.text_cnn, w, "id", "ids").collect()
    assert {r.id for r in out} == {1, 2} and all(1 / 3 <= r.score <= 1 for r in out)


def test_search_tree_finds_neighbours(spark):
    import numpy as np

    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(i % 4 * 5, 0.5, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    nodes, leaves = vectors.build_tree(df, "k", "v", [4, 2])
    assert leaves.count() == 80
    near = vectors.search_tree(df.filter("k < 8"), nodes, leaves, "k", "v", "k", [2, 4], 3)
    exact = quality.nearest(df.filter("k < 8").select("k", F.col("v").alias("q")), df.select("k", F.col("v").alias("w")), "k", "k", "q", "w", 3)
    a, b = {(x.q_id, x.k) for x in near.collect()}, {(x.q_id, x.r_id) for x in exact.collect()}
    assert len(a & b) >= 0.9 * len(b)
    model, data = vectors.hash_index(df, "v")
    assert model.approxNearestNeighbors(data, data.first().features, 3).count() == 3


def test_registry():
    assert registry.get("measure", "pearson") is association.pearson
    for kind, name in (("measure", "x"), ("nothing", "x"), ("reader", "pdf")):
        with pytest.raises(ValueError):
            registry.get(kind, name)
    with pytest.raises(ValueError):
        learn.naive_bayes(None, "f", "y", "other")


def test_embedding_lookup(spark):
    vocab = spark.createDataFrame([("<pad>", 9, 0), ("<s>", 9, 1), ("cat", 5, 2), ("dog", 4, 3), ("eel", 3, 4), ("fox", 3, 5)], "word string, cnt long, id int")
    shard = lambda *r: spark.createDataFrame(list(r), "word string, vec array<float>")
    got = {r.word: r.vec for r in text.embed_words(vocab, [shard(("cat", [1.0, 1.0])), shard(("cat", [2.0, 2.0]), ("dog", [3.0, 3.0]))], 2).collect()}
    assert got["<pad>"] == [0, 0] and got["cat"] == [1, 1] and got["dog"] == [3, 3]
    assert got["eel"] == got["fox"] and all(-6 <= x < 0 for x in got["eel"]) and all(-10 <= x < -1 for x in got["<s>"])


def test_rough_importance(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("b", "x", "2"), ("b", "x", "2")], "p string, q string, t string")
    assert {r.attribute: r.importance for r in association.rough_importance(df, ["p", "q"], "t").collect()} == {"p": 0.25, "q": 0.25}


def test_numbers_by_text(spark):
    from tarnwood.operators import ordering

    names = [f"Customer#{i:06d}" for i in range(3000)] + ["", "a", "É", "中"]
    got = ordering.numbered_by_text(spark.createDataFrame([(n,) for n in names], "name string"), F.col("name")).collect()
    assert {r.name: r.pos for r in got} == {n: i for i, n in enumerate(sorted(names))}
    none = spark.createDataFrame([], "name string")
    assert ordering.numbered_by_text(none, F.col("name")).count() == 0


def test_write_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, y string")
    got = quality.write_back(df, spark.createDataFrame([(2, "b")], "id long, y string"), "id", "y")
    assert {(r.id, r.y) for r in got.collect()} == {(1, "a"), (2, "b"), (3, None)}


def test_timer():
    from tarnwood.session import timed

    said = []
    with timed("step", said.append):
        pass
    assert said[0].startswith("step: 0.0")
