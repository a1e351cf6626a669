"""From raw documents to sampled token ids: language ID, exact dedup, near-dedup, decontamination, piece sampling.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before it kept.
Stages but the last return the columns of documents. run() applies them in order to documents; between stages the rows are
staged as Parquet in the shared folder, so a lost executor repeats one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwood.llm import decontaminate, exact_dedup, language_id, near_dedup, spm_lattice
from tarnwood.llm.common import stage, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: a null text, or one without any letter. Repeated rows are judged alike; very long texts
    are scored whole; where no row has a language to learn from, all are without one; extra columns stay; no rows give none."""
    return language_id.keep_known(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of least doc_id stays; rows that repeat id and text stay together. Null counts as empty; a null id
    stays only in a group without another; very long texts are compared whole; extra columns stay; no rows give none."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of least doc_id stays (of several with that id, the text of least digest). A row
    is known by id and words; texts without words are one class; a null id is the least; extra columns stay; no rows give none."""
    return near_dedup.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of two or more benchmark items go; from the others, the words that a window of any item covers
    are cut out (n_chars, where it is there, is told anew), and a document of no other words goes. A row is known by id and text,
    so rows that repeat both are treated alike and another text of that id is judged for itself; null and empty texts stay; an
    empty benchmark keeps all; extra columns stay; no rows give none."""
    return decontaminate.cut_contaminated(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars" if "n_chars" in docs.columns else None)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different segmentations of each text, with inclusion scores. Null and empty texts have one empty segmentation; texts
    that can be cut in one way only give one row; repeated rows give equal rows; no rows give none."""
    return spm_lattice.sample_encode(docs, k=2)


STAGES = [("language_id", keep_known_languages), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontaminate", remove_benchmark), ("piece_sampling", sample_pieces)]
#: The sampling stages cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
