"""Queries that must do the whole job on the tables they are registered for."""

import random

from tarnwood.operators import inference, segment, text
from tarnwood.plans import texts
from tarnwood.session import table

SF = "/root/testdata/sf0.01"


def test_tree_search_recall_on_embeddings(spark):
    exact = {(r.q_id, r["rank"]): r.dist for r in texts.QUERIES["knn_exact"](spark, SF).collect()}
    got = {(r.q_id, r["rank"]): round(r.dist, 5) for r in texts.QUERIES["kmeans_tree_search"](spark, SF).collect()}
    assert got.keys() == exact.keys() and all(abs(got[x] - exact[x]) <= 2e-5 for x in exact)


def test_every_document_is_cut_and_summarised(spark):
    docs = table(spark, SF, "documents")
    cut = texts.QUERIES["hmm_segmentation"](spark, SF)
    assert sorted(r.id for r in cut.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    centres = texts.QUERIES["summary_centres"](spark, SF)
    assert "doc_id" in centres.columns and centres.join(docs, "doc_id", "left_semi").count() == centres.count() > 0


def test_texts_side_by_side_are_cut_as_one_by_one():
    r = random.Random(3)
    start, trans = {"B": 0.6, "S": 0.4}, {("B", "E"): 0.7, ("B", "M"): 0.3, ("M", "E"): 0.5, ("M", "M"): 0.5, ("E", "B"): 0.5, ("E", "S"): 0.5, ("S", "B"): 0.5, ("S", "S"): 0.5}
    emit = {(s, c): r.random() for s in "BEMS" for c in "abcdef" if r.random() < 0.8}
    lines = ["".join(r.choice("abcdefxy") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    assert segment.viterbi_all(lines, start, trans, emit) == [segment.viterbi(x, start, trans, emit) for x in lines]


def test_topics_use_the_whole_vocabulary(spark):
    import numpy as np

    r = random.Random(5)
    docs = [[f"w{j}" for j in r.sample(range(700), 12)] for _ in range(300)]
    toks = spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in d], "doc_id long, word string")
    vocab = sorted({w for d in docs for w in d if sum(w in x for x in docs) >= 2})
    m = np.array([[float(d.count(w)) for w in vocab] for d in docs])
    m *= np.log((len(docs) + 1) / ((m > 0).sum(0) + 1))
    got = [x.strength for x in text.topic_strengths(toks).orderBy("topic").collect()]
    assert len(vocab) > 500 and np.allclose(got, np.linalg.svd(m, compute_uv=False)[:4], rtol=1e-6)
    assert {x.word for x in text.topics(toks).collect()} <= set(vocab)


def test_cnn_reads_whole_texts(spark):
    import numpy as np

    toks = text.tokens(table(spark, SF, "documents"))
    vocab = text.vocabulary(toks)
    w = inference.random_weights(vocab.count(), 16, 32, 15)
    ids = {r.doc_id: list(r.ids) for r in text.encode(toks, vocab).filter("size(ids) > 32").limit(50).collect()}
    got = {r.doc_id: r.score for r in texts.QUERIES["cnn_inference"](spark, SF).collect()}
    assert ids and all(abs(got[i] - inference.softmax(inference.text_cnn(np.array([x]), w)).max()) < 1e-9 for i, x in ids.items())


def test_every_missing_row_is_filled_as_by_brute_force(spark):
    from tarnwood.operators import quality

    r = random.Random(8)
    rows = [(i, r.choice([None, float("nan"), 7.0, 7.0, float(r.randrange(40)), r.random() * 40]), r.choice([None, None, "a", "b", "c"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, f double, y string")
    known = [x for x in rows if x[2] and x[1] is not None and x[1] == x[1]]
    want = {}
    for i, f, y in rows:
        if y is None and f is not None and f == f:
            near = [x[2] for x in sorted(known, key=lambda x: (abs(f - x[1]), x[0]))[:3]]
            want[i] = min(set(near), key=lambda v: (-near.count(v), v))
    assert {x.id: x.y for x in quality.impute_knn(df, "id", ["f"], "y").collect()} == want
    none = df.filter("y is null")
    assert quality.impute_knn(none, "id", ["f"], "y").count() == 0 == quality.impute_knn(df.limit(0), "id", ["f"], "y").count()
