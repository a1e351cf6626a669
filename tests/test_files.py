"""Readers, writers and streams over temporary files."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwood.operators import mining
from tarnwood.sources import readers, writers
from tarnwood.streaming import events

SF = "/root/testdata/sf0.001"


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(50)))
    p = str(tmp_path / "a.txt")
    assert readers.nth_line(spark, p, 17) == "line 17" and readers.nth_line(spark, p, 99) is None
    assert readers.read_rows(spark, p).count() == 50


def test_rows_by_suffix(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x,y z\n,\n1,2\n")
    assert {r.line for r in readers.read_rows(spark, str(tmp_path / "a.CSV")).collect()} >= {"x。y，z", "1。2"}
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:document>')
    assert [r.line for r in readers.read_rows(spark, str(tmp_path / "a.docx")).collect()] == ["one，two", ""]
    with pytest.raises(ValueError):
        readers.read_rows(spark, "a.pdf")


def test_encodings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/u").write_bytes("中文 ü".encode())
    (tmp_path / "in/g").write_bytes("中文".encode("gb18030"))
    got = {r.path[-1]: (r.text, r.encoding) for r in readers.read_decoded(spark, str(tmp_path / "in")).collect()}
    assert got == {"u": ("中文 ü", "utf-8"), "g": ("中文", "gb18030")}
    assert readers.list_files(spark, str(tmp_path / "in")).count() == 2 and readers.decode(None) == (None, None)


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("cat 1 2 3\nbig dog 4 5 6\nbad\n")
    got = {r.word: r.vec for r in readers.read_text_vectors(spark, str(tmp_path / "v.txt"), 3).collect()}
    assert got == {"cat": [1, 2, 3], "dog": [4, 5, 6]}
    (tmp_path / "v.bin").write_bytes(b"2 2\n" + b"cat " + struct.pack("<2f", 1, 2) + b"\ndog " + struct.pack("<2f", 3, 4))
    assert {r.word: r.vec for r in readers.read_word2vec(spark, str(tmp_path / "v.bin")).collect()} == {"cat": [1, 2], "dog": [3, 4]}


def test_structured_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": "x"}')
    assert tuple(readers.read_json(spark, str(tmp_path / "a.json")).first()) == (1, "x")
    (tmp_path / "a.xml").write_text("<r><p id='1'><n>A</n></p><p id='2'><n>B</n></p></r>")
    assert readers.read_xml(spark, str(tmp_path / "a.xml"), "p").count() == 2
    (tmp_path / "t.csv").write_text("a,r,b\nshort,row\nc,r,d\n")
    assert readers.read_triples(spark, str(tmp_path / "t.csv")).count() == 2
    (tmp_path / "stop.txt").write_text("the\n\nof\nthe\n")
    assert readers.stop_words(spark, str(tmp_path / "stop.txt")).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, label string")
    writers.write_predictions(df, str(tmp_path / "p"))
    assert {r.value for r in spark.read.text(str(tmp_path / "p")).collect()} == {"0\tx", "1\ty"}
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["idx", "label"]
    m = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "a", 1.0), ("b", "b", 1.0)], "f1 string, f2 string, value double")
    writers.write_matrix(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["f1", "a", "b"]
    writers.write_shards(spark.range(10), ["id"], str(tmp_path / "s"), 4)
    assert {r.shard: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()} == {0: 4, 1: 4, 2: 2}
    writers.write_graph(*mining.encode_triples(spark.createDataFrame([("a", "r", "b")], "head string, relation string, tail string")), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/entity")).count() == 2
    writers.copy_recent(spark, str(tmp_path / "g"), str(tmp_path / "recent"), "2020-01-01T00:00:00")
    assert spark.read.parquet(str(tmp_path / "recent")).count() > 0


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), src.schema, 10)
    events.run_to_end(events.tumbling(stream, late="1000 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    whole = events.tumbling(src.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() <= whole.count()
    events.run_to_end(events.running_gaps(stream), str(tmp_path / "gaps"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "gaps")).count() == src.count()
    assert events.sessions(src.withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def test_npy(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a.npy", np.arange(12).reshape(3, 2, 2))
    np.save(tmp_path / "b.npy", np.array(7.5))
    got = {(r.path.rsplit("/", 1)[1], r.row): list(r["values"]) for r in readers.read_npy(spark, str(tmp_path)).collect()}
    assert got == {("a.npy", 0): [0, 1, 2, 3], ("a.npy", 1): [4, 5, 6, 7], ("a.npy", 2): [8, 9, 10, 11], ("b.npy", 0): [7.5]}
