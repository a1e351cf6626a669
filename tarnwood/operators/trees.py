"""Trees as adjacency rows (id, parent_id, slot, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def balanced(spark: SparkSession, values: list) -> DataFrame:
    """A binary search tree of the distinct values, each root in the middle of its range; slot 0 is left, 1 right."""
    xs, out = sorted(set(values)), []

    stack = [(0, len(xs), None, None)]
    while stack:
        a, b, parent, slot = stack.pop()
        if a >= b:
            continue
        m = (a + b) // 2
        out.append((m, parent, slot, float(xs[m])))
        stack += [(a, m, m, 0), (m + 1, b, m, 1)]
    return spark.createDataFrame(out, "id int, parent_id int, slot int, val double")


def in_order(tree: DataFrame) -> DataFrame:
    return tree.withColumn("pos", F.row_number().over(Window.orderBy("val")) - 1)


def children(tree: DataFrame, parent: int) -> DataFrame:
    return tree.filter(F.col("parent_id") == parent).orderBy("slot")


def update_value(tree: DataFrame, node: int, val: float) -> DataFrame:
    return tree.withColumn("val", F.when(F.col("id") == node, F.lit(val)).otherwise(F.col("val")))
