"""Splits, batches, first rows per class, dialogue pairs, chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def split(df: DataFrame, order: list[str], ratio: float = 0.8) -> DataFrame:
    """Add part: train for the first round(n * ratio) rows in order, test for the others."""
    n = df.count()
    return numbered(df, order, "_pos").withColumn("part", F.when(F.col("_pos") < round(n * ratio), "train").otherwise("test")).drop("_pos")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add batch: rows in order, `size` to a batch, the last one shorter."""
    return numbered(df, order, "_pos").withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")


def first_per_class(df: DataFrame, cls: str, order: list[str], n: int = 200) -> DataFrame:
    """Add pos (from 0); the first n rows of each class, cut before the shuffle by Spark's group limit."""
    w = Window.partitionBy(cls).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).withColumn("pos", F.col("pos") - 1)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order drawn from hashes of the key, the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def drop_empty(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter((F.size(x) > 0) & (F.size(y) > 0))


def dialogue_pairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, question, answer): a user's turn and the assistant's that follows it."""
    w = Window.partitionBy(conv).orderBy(turn)
    nxt = df.withColumn("answer", F.lead(text).over(w)).withColumn("next_role", F.lead(role).over(w))
    return nxt.filter((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(conv, turn, F.col(text).alias("question"), "answer")


def ordered_dict(df: DataFrame, by: str = "value", descending: bool = True) -> DataFrame:
    """Rows (key, value, pos) ranked by value or key, ties by pos; adds rank."""
    lead = F.desc(by) if descending else F.asc(by)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(lead, "pos")))


def bars(spark, values=(15.0, 50.0, 22.0, 80.0)) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "x int, y double")


def grid(spark, n: int, columns: int = 2) -> DataFrame:
    """(plot, row, col) of n plots in one or two columns, from 1."""
    if columns not in (1, 2):
        raise ValueError("one or two columns")
    i = F.col("id") + 1
    return spark.range(n).select(i.alias("plot"), F.ceil(i / columns).alias("row"), ((i - 1) % columns + 1).alias("col"))


THEME = {"background": "#ffffff", "grid": "#e5e5e5", "title_size": 16, "label_size": 12}
