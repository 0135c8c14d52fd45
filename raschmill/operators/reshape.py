"""Wide and long forms, and tables that compare estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def responses_wide(df: DataFrame, items: list[str]) -> DataFrame:
    """One row for each person, one column for each item: its first score in order of the score (the least)."""
    return df.groupBy("id").pivot("Item", items).agg(F.min("score"))


def params_long(items: DataFrame, names: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """Item, parameter, value."""
    return items.select("Item", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("Item", list(names), "parameter", "value")


def compare(truth: DataFrame, **estimates: DataFrame) -> DataFrame:
    """estimator, Item, parameter, estimate, truth, error for long tables of parameters."""
    t = truth.select("Item", "parameter", F.col("value").alias("truth"))
    out = None
    for name, e in estimates.items():
        one = e.select(F.lit(name).alias("estimator"), "Item", "parameter", F.col("value").alias("estimate")).join(t, ["Item", "parameter"])
        out = one if out is None else out.unionByName(one)
    return out.withColumn("error", F.abs(F.col("estimate") - F.col("truth")))


def merge_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge."""
    return left.join(right, key, "full")
