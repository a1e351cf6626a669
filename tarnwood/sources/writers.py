"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_matrix(long: DataFrame, path: str) -> None:
    """A square matrix from (f1, f2, value)."""
    write_csv(long.groupBy("f1").pivot("f2").agg(F.first("value")).orderBy("f1"), path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    write_json(vocab.select("word", "id"), path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by(df: DataFrame, column: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_predictions(df: DataFrame, path: str, index: str = "idx", label: str = "label") -> None:
    df.select(index, label).write.mode("overwrite").option("sep", "\t").csv(path)


def write_shards(df: DataFrame, order: list[str], path: str, rows: int = 1_000_000) -> None:
    """Parquet shards of `rows` rows in order."""
    from tarnwood.operators.ordering import numbered

    write_by(numbered(df, order, "_n").withColumn("shard", F.floor(F.col("_n") / rows)).drop("_n"), "shard", path)


def copy_recent(spark, source: str, target: str, after: str) -> None:
    """Files changed after a time (yyyy-MM-ddTHH:mm:ss), as (path, content) rows."""
    spark.read.format("binaryFile").option("recursiveFileLookup", True).option("modifiedAfter", after).load(source).write.mode("overwrite").parquet(target)


def write_graph(entity: DataFrame, relation: DataFrame, path: str) -> None:
    write_csv(entity, f"{path}/entity")
    write_csv(relation, f"{path}/relation")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
