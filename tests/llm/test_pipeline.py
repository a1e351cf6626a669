from brute import exact_rows, leak_rows, near_rows

import corpus_pipeline
from tarnwood.llm.language_id import has_letter


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if r[1] is not None and has_letter(r[1])]
    rows = [r for r, e in zip(rows, exact_rows(rows)) if e[3]]
    rows = [r for r, e in zip(rows, near_rows(rows)) if e[0] == e[1]]
    rows = [r for r, e in zip(rows, leak_rows(rows, items)) if not e[5]]
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in rows}
    assert out.filter("sample = 1").count() == len(rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_rows(spark, docs):
    kept = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 in ids and ids.isdisjoint({2, 3, 4, 5, 6, 7, 8, 15, 21})


def test_benchmark_passages_go(spark, docs):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = [(100, f"Before it, {items[0][1]} after. End"), (101, items[1][1]), (102, f"{items[2][1]} {items[3][1]}"), (103, " ".join(items[4][1].split()[:9]) + "\tÀÉ x"), (104, "No: passage. "), (105, None), (105, f"a {items[0][1]}")]
    df = docs.sparkSession.createDataFrame([(i, t, "en", "s", -1, i, "d", i) for i, t in planted], docs.schema)
    stage = dict(corpus_pipeline.STAGES)["decontaminate"]
    kept = {(r.doc_id, r.text, r.n_chars) for r in stage(spark, df, sf).collect()}
    assert kept == {(100, "Before it, after. End", 21), (103, "ÀÉ x", 4), (104, "No: passage. ", -1), (105, None, -1), (105, "a ", 2)}
    real = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in (real, stage(spark, real, sf)))
    assert sum(e[3] > 0 for e in leak_rows(before, items)) == 3 and not any(e[3] for e in leak_rows(after, items))
    clean = [r for r, e in zip(before, leak_rows(before, items)) if not e[3]]
    assert set(clean) <= set(after) and len(after) == len(before)
