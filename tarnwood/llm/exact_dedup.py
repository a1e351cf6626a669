"""Exact dedup [native]: skew-safe combining of equal texts.

Equal texts meet in three steps, each of which compares the full normalised text beside its SHA-256: Spark's partial
aggregation removes copies inside a task, salted groups (digest, text, salt) spread one text over `salts` reducers, and
the salt winners are combined per (digest, text). A group is never gathered as a list: only a minimum and a count move.

Cases: null text counts as empty; repeated doc_ids are one row each with the same answer; a null doc_id loses to any
other id and stays only in a group that has no other; ties are equal ids and all stay; very long texts are compared whole;
empty tables give no rows; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, small_side, stage


def normalised(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=_sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    digest: spreads and joins texts. Where two different texts share one (tests use a weak digest), the last join
    compares the texts as well; the table of groups tells whether that happened."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = rows.withColumn("salt", _salt(salts)).groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    several = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    told = stage(several.filter("n_texts > 1 or group_size > 1"), "groups")
    if not told.filter("n_texts > 1").isEmpty():
        joined = rows.join(groups, ["digest", "norm"])
    else:  # each digest stands for one compared text, and a digest that is not told for one row
        lone = rows.select("doc_id", "digest", (F.col("digest") if digest is _sha256 else _sha256(F.col("norm"))).alias("text_sha256"), _salt(salts).alias("salt"))
        told = told.drop("n_texts")
        if told.count() <= BROADCAST_ROWS:
            joined = lone.join(F.broadcast(told), "digest", "left")
        else:  # a large group's rows meet its one line in `salts` tasks
            joined = lone.join(told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"], "left")
        joined = joined.withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    sha = F.col("text_sha256") if "text_sha256" in joined.columns else _sha256(F.col("norm"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat id and text are one row and stay together."""
    gone = exact_dedup(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    gone = small_side(gone, "copies")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["_sha"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
