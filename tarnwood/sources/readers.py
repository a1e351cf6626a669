"""Readers, found by name or by file suffix. Paths may be in any store that Spark reads."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.functions.text import normalised_row

#: Tried in order after UTF-8.
ENCODINGS = ["utf-8", "gb18030", "gbk", "gb2312", "big5", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "shift_jis", "euc-kr", "latin-1"]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def decode(data: bytes | None) -> tuple[str | None, str | None]:
    """Text and encoding of the first encoding that fits, (None, None) if none does."""
    for name in ENCODINGS if data is not None else []:
        try:
            return data.decode(name), name
        except UnicodeError:
            continue
    return None, None


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of each file; UTF-8 is checked by Spark, only other files go through Python."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))

    def rest(batches):
        for pdf in batches:
            got = [decode(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [g[0] for g in got], "encoding": [g[1] for g in got]})

    good = files.filter("text is not null").select("path", "text", F.lit("utf-8").alias("encoding"))
    return good.unionByName(files.filter("text is null").select("path", "content").mapInPandas(rest, "path string, text string, encoding string"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, numbered from 0 in file order: lines keep their place within a file's split."""
    lines = spark.read.text(path)
    numbered = lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    at, before = 0, {}
    for part, n in counts:
        before[part], at = at, at + n
    if not before:
        return lines.select(F.lit(0).cast("long").alias("line_no"), F.col("value").alias("line"))
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), F.col("_part").cast("int"))
    return numbered.select((F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + offset).alias("line_no"), F.col("value").alias("line"))


def nth_line(spark: SparkSession, path: str, n: int) -> str | None:
    row = read_lines(spark, path).filter(F.col("line_no") == n).first()
    return row.line if row else None


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line): cells of each row joined by a full stop, empty rows dropped."""
    rows = spark.read.csv(path)
    return rows.select(normalised_row(F.concat_ws("。", *rows.columns)).alias("line")).filter("line <> ''")


def read_txt_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(normalised_row(F.col("value")).alias("line"))


def docx_paragraphs(data: bytes) -> list[str]:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(ns + "t")) for p in root.iter(ns + "p")]


def read_docx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line): paragraphs of Word files."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"line": [p for c in pdf["content"] for p in docx_paragraphs(c)]}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line string").select(normalised_row(F.col("line")).alias("line"))


READERS = {"csv": read_csv_rows, "txt": read_txt_rows, "docx": read_docx_rows}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix, whatever its case. pdf needs a plug-in: READERS["pdf"] = f(spark, path)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix} files")
    return READERS[suffix](spark, path)


def read_text_vectors(spark: SparkSession, path: str, width: int = 200) -> DataFrame:
    """(word, vec) of lines `word v1 ... vn`; words may hold spaces, then the last part is the key."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > width)
    return rows.select(F.element_at("p", F.size("p") - width).alias("word"), F.slice("p", -width, width).cast("array<float>").alias("vec"))


def word2vec_frames(data: bytes, block: int = 10_000):
    """Entries of a binary word2vec file, `block` of them at a time."""
    head, at = data.split(b"\n", 1)[0], data.index(b"\n") + 1
    n, width = map(int, head.split())
    words, vectors = [], []
    for i in range(n):
        stop = data.index(b" ", at)
        words.append(data[at:stop].lstrip(b"\n").decode("utf-8", "replace"))
        vectors.append(np.frombuffer(data, "<f4", width, stop + 1))
        at = stop + 1 + 4 * width
        if len(words) == block or i == n - 1:
            yield pd.DataFrame({"word": words, "vec": vectors})
            words, vectors = [], []


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for c in pdf["content"]:
                yield from word2vec_frames(c)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, vec array<float>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values): one row for each entry of the first axis of each array, flattened. Pickled arrays are refused."""

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                flat = np.atleast_1d(a).reshape(len(np.atleast_1d(a)), -1).astype(float)
                for i in range(0, len(flat), 4096):
                    part = flat[i : i + 4096]
                    yield pd.DataFrame({"path": p, "row": np.arange(i, i + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, values array<double>")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail) of CSV rows with three cells or more and no NUL."""
    rows = spark.read.text(path).filter(~F.col("value").contains("\0")).select(F.from_csv("value", "head string, relation string, tail string").alias("t")).select("t.*")
    return rows.filter("tail is not null")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()
