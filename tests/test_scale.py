"""Steps whose work must grow no faster than their input, with the same results as plain counting."""

import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tarnwood.functions import text as tf
from tarnwood.operators import mining, profile, quality, text, vectors
from tarnwood.plans import texts


def test_chunks_take_one_pass(spark):
    texts = [None, "", "a", "ab\ncd", "x\U0001f600yz日", "qä" * 150_000 + "z"]
    began = time.perf_counter()
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(tf.chunks(F.col("t")).alias("c")).collect()]
    assert got == [None if t is None else [t[i : i + 2] for i in range(0, len(t), 2)] for t in texts]
    assert time.perf_counter() - began < 15  # counting from the text's beginning takes minutes


def test_hashed_sentence_vectors_are_means_over_repeated_words(spark):
    r = random.Random(2)
    rows = [(i, j, " ".join(r.choice(["a", "b", "c", "d", f"once{i}x{j}"]) for _ in range(r.randrange(6)))) for i in range(30) for j in range(4)]
    rows = [(i, j, t.replace("0", "z").replace("1", "y")) for i, j, t in rows]
    df = spark.createDataFrame([(i, j, "".join(c if not c.isdigit() else "klmnopqrst"[int(c)] for c in t)) for i, j, t in rows], "doc_id int, sent int, sentence string")
    counts = Counter(w for x in df.collect() for w in x.sentence.split())
    vec = {x.word: x.v for x in spark.createDataFrame([(w,) for w in counts], "word string").select("word", F.array(*[F.pmod(F.xxhash64("word", F.lit(j)), F.lit(1000)) / 1000.0 for j in range(1, 5)]).alias("v")).collect()}
    want = {}
    for x in df.collect():
        if kept := [vec[w] for w in x.sentence.split() if counts[w] > 1]:
            want[x.doc_id, x.sent] = np.mean(kept, 0)
    made = text.hashed_sentence_vectors(df, ["doc_id", "sent"], 4)
    got = {(x.doc_id, x.sent): x.vec for x in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    joined = {(x.doc_id, x.sent): x.vec for x in text.sentence_vectors(df, ["doc_id", "sent"], spark.createDataFrame([(w, list(map(float, v))) for w, v in vec.items() if counts[w] > 1], "word string, vec array<double>")).collect()}
    assert joined.keys() == want.keys() and all(np.allclose(joined[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_textrank_keeps_no_row_for_a_pair_of_words(spark):
    r = random.Random(4)
    docs = [[r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.randrange(40))] for _ in range(60)] + [["alone"], ["twin", "twin"], []]
    near = Counter((d[i], d[j]) for d in docs for i in range(len(d)) for j in range(max(0, i - 4), min(len(d), i + 5)) if d[i] != d[j])
    links = Counter()
    for (a, _), n in near.items():
        links[a] += n
    rank = dict.fromkeys(links, 1.0)
    for _ in range(7):
        rank = {w: 0.15 + 0.85 * sum(rank[a] * n / links[a] for (a, b), n in near.items() if b == w) for w in links}
    want = sorted(rank.items(), key=lambda x: (-x[1], x[0]))[:12]
    toks = spark.createDataFrame([(i, p, w) for i, d in enumerate(docs) for p, w in enumerate(d)], "doc_id long, pos int, word string")
    texts_ = spark.createDataFrame([(d,) for d in docs] + [(None,)], "words array<string>")
    for got in (text.textrank_words(toks, 12, rounds=7), text.textrank_texts(texts_, 12, rounds=7)):
        rows = got.orderBy("rank").collect()
        assert [x.word for x in rows] == [w for w, _ in want] and [x["rank"] for x in rows] == list(range(1, 13))
        assert all(abs(x.score - s) < 1e-9 for x, (_, s) in zip(rows, want))
    assert text.textrank_texts(texts_.filter("size(words) = 0"), 5).count() == 0


def _brute(rows, asked, k):
    out = set()
    for i, q in rows:
        if asked(i):
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v))), j) for j, v in rows if j != i)[:k]
            out |= {(i, j, n, round(x, 9)) for n, (x, j) in enumerate(d, 1)}
    return out


def test_nearest_sorts_only_what_a_bound_leaves(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randrange(6)) for _ in range(4)]) for i in range(4500)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    near = quality.nearest(df.filter("id % 500 = 0"), df.select(F.col("id").alias("r"), F.col("v").alias("rv")), "id", "r", "v", "rv", 7)
    assert {(x.q_id, x.r_id, x["rank"], round(x.dist, 9)) for x in near.collect()} == _brute(rows, lambda i: i % 500 == 0, 7)
    assert "zip_with" not in near._jdf.queryExecution().optimizedPlan().toString()  # interpreted for each pair
    odd = df.unionAll(spark.createDataFrame([(9000, [1.0]), (9001, None), (9002, [1.0, None, 2.0, 3.0])], "id long, v array<float>"))
    got = quality.nearest(df.filter("id % 500 = 0"), odd.select(F.col("id").alias("r"), F.col("v").alias("rv")), "id", "r", "v", "rv", 3).orderBy("q_id", "rank").collect()
    assert [(x.r_id, x.dist) for x in got[:3]] == [(9000, None), (9001, None), (9002, None)]  # no distance sorts first


def test_pairwise_distance_streams_rows_by_the_set(spark):
    r = random.Random(7)
    rows = [(i, [float(r.randrange(9)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = {(i, j): math.dist(v, w) for i, v in rows if i % 10 == 0 for j, w in rows if i != j}
    made = vectors.pairwise_distance(df.filter("id % 10 = 0"), df, "id", "v")
    got = {(x.a_id, x.b_id): x.dist for x in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    odd = df.unionAll(spark.createDataFrame([(900, None)], "id long, v array<float>"))
    assert vectors.pairwise_distance(df.filter("id % 10 = 0"), odd, "id", "v").filter("dist is null").count() == 30
    assert vectors.pairwise_distance(df.filter("id < 0"), df, "id", "v").count() == 0


def test_keywords_of_documents_move_a_row_for_each_word_and_task(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30))) if i else None) for i in range(80)], "doc_id long, text string")
    made = text.keywords_of(docs, 6)
    assert [tuple(x) for x in made.orderBy("rank").collect()] == [tuple(x) for x in text.keywords(text.tokens(docs), 6).orderBy("rank").collect()]
    assert not re.search(r"hashpartitioning\(word#\d+, doc_id", made._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(word#\d+, doc_id", texts.QUERIES["keywords_tfdf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())


def test_keyword_summary_does_not_move_the_sentences_words(spark):
    plan = text.keyword_summary(spark.createDataFrame([(1, "a b. a c")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter") :].split("\n")[1]
    assert "length" in left and not re.search(r", w#|AS w#", left)


def test_profile_gathers_no_column_in_a_task(spark):
    r = random.Random(10)
    rows = [(r.choice([None, float(r.randrange(900)), r.random()]), None, float(r.randrange(3))) for _ in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    made = profile.profile(df, ["a", "b", "c"])
    got = {x.feature: x for x in made.collect()}
    for i, c in enumerate("ac"):
        v = [x["abc".index(c)] for x in rows if x["abc".index(c)] is not None]
        assert np.allclose([got[c].q1, got[c]["median"], got[c].q3], np.percentile(v, [25, 50, 75]), rtol=1e-12)
        n = Counter(v)
        assert got[c]["mode"] == min(x for x in n if n[x] == max(n.values()))
    assert (got["b"]["count"], got["b"].q1, got["b"]["mode"]) == (0, None, None)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "mode(" not in plan


def test_bm25_moves_words_asked_for_by_document(spark):
    r = random.Random(11)
    docs = spark.createDataFrame([(i, None if i == 3 else " ".join(r.choice("abcdefghijkl") for _ in range(r.randrange(25)))) for i in range(70)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, r.choice("abcdefzy")) for i in range(9) for _ in range(4)], "q_id long, word string")
    made = text.bm25_of(docs, asked)
    got = {(x.q_id, x.doc_id): x.score for x in made.collect()}
    want = {(x.q_id, x.doc_id): x.score for x in text.bm25_scores(asked, text.bm25_parts(text.tokens(docs))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for q in ("bm25_scores", "bm25_topk"):
        assert not re.search(r"hashpartitioning\(q_id#\d+L?, doc_id", texts.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())


def test_each_different_phrase_is_read_once(spark):
    o = texts.QUERIES["time_expressions"](spark, "/root/testdata/sf0.001")
    plan = o._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan
    df = spark.createDataFrame([(1, "x 2024年5月3日7点 y"), (2, "none"), (3, None), (4, "x 2024年5月3日7点 y"), (5, "明天"), (6, None)], "i int, t string")
    got = {r.i: (r.grade, r.time) for r in text.time_of_texts(df, "t", F.lit("2024-05-15").cast("date")).collect()}
    day = F.lit("2024-05-15").cast("date")
    plain = df.withColumn("f", F.get(tf.time_phrases(F.col("t")), F.lit(0))).select("i", tf.time_grade(F.col("f")), tf.phrase_time(F.col("f"), day))
    assert got == {r[0]: (r[1], r[2]) for r in plain.collect()} and got[1] == (5, "2024-5-3,7:00") and got[5] == (3, "2024-5-16,")


def test_item_sets_are_made_in_their_basket(spark):
    r = random.Random(12)
    baskets = [(i, [r.choice("abcdefghij" + "klmnopqrstuvwxyz" * (i % 9 == 0)) for _ in range(r.randrange(7))]) for i in range(120)]
    for least, group in ((3, 1), (8, 4)):
        made = mining.apriori(spark.createDataFrame(baskets, "tid long, items array<string>"), least_single=least, confidence=0.05, least_group=group)
        n, sets = Counter(x for _, b in baskets for x in b), Counter()
        for _, b in baskets:
            kept = sorted({x for x in b if n[x] >= least})
            sets.update(c for k in (2, 3) for c in combinations(kept, k))
        want = {(c, s, min(c, key=lambda x: (-n[x], x))) for c, s in sets.items() if s >= group and s / max(n[x] for x in c) >= 0.05}
        assert {(tuple(x["items"]), x.support, x.max_item) for x in made.collect()} == want
        assert "hashpartitioning(tid" not in made._jdf.queryExecution().executedPlan().toString()
