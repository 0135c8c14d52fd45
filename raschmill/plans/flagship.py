"""The flagship query: filter, score under given parameters, and sum up each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raschmill.operators.prep import drop_perfect_scores
from raschmill.operators.scoring import probabilities, with_parameters
from raschmill.plans.views import abilities, items, responses


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item, n, mean_score, mean_expected, loglik of the answers that survive the perfect-score filter."""
    r = drop_perfect_scores(responses(spark, sf_dir))
    rows = probabilities(with_parameters(r, items(r).select("Item", "A", "B", "C", "D"), abilities(r)))
    return rows.groupBy("Item").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("p").alias("mean_expected"), F.sum("loglik").alias("loglik"))
