"""Response tables from and to files, and from a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raschmill.config import ResponseSchema

RESPONSES = T.StructType([T.StructField("id", T.StringType()), T.StructField("Item", T.StringType()), T.StructField("Scale", T.StringType()), T.StructField("score", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    """A CSV file with a header; the schema is declared, not inferred by an extra pass."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_parquet(spark: SparkSession, path: str, names: ResponseSchema | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table; only the columns of the model are read."""
    df = spark.read.parquet(path)
    return (names or ResponseSchema()).standard(df, extra)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def grid(spark: SparkSession, persons: int, items: int, scales: int = 1) -> DataFrame:
    """id, Scale, Item, LocalItem of every person with every item; items are numbered through the scales."""
    own = spark.range(1, persons + 1).withColumnRenamed("id", "id")
    per = F.explode(F.sequence(F.lit(1), F.lit(scales)))
    rows = own.select("id", per.alias("Scale"))
    return rows.select("id", "Scale", F.explode(F.sequence(F.lit(1), F.lit(items))).alias("LocalItem")).withColumn("Item", (F.col("Scale") - 1) * items + F.col("LocalItem"))
