"""Simulated persons, items and answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raschmill.functions.links import inv_logit, softplus
from raschmill.functions.model import p_correct
from raschmill.operators.normalise import normalise

#: Items whose table goes to every task, so that answers stay where their person is.
FEW = 100_000


def linear(preds: dict[str, float]) -> Column:
    """Sum of covariates times their effects."""
    total = F.lit(0.0)
    for name, effect in preds.items():
        total = total + effect * F.col(name)
    return total


def _normal(key: str, seed: int) -> Column:
    """A standard normal draw that depends on the key and the seed only, however rows are dealt (Box and Muller)."""
    u = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * seed + j)), 11) + 0.5) * 2.0**-53 for j in range(2)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * np.pi * u[1])


def sim_persons(spark: SparkSession, n: int | DataFrame, corr: list[list[float]], mean: list[float], sd: list[float], seed: int = 1, covariates: DataFrame | None = None, effects: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """id, Scale, ability with given correlations, means and deviations for each scale (1..).

    n: so many persons, 1.., or a table with the id of each.
    covariates: id and the columns that ``effects`` names for a scale; they are added to its abilities.
    """
    k = len(mean)
    root = np.linalg.cholesky(np.array(corr, dtype=float)) * np.array(sd, dtype=float)[:, None]
    own, draw = (spark.range(1, n + 1), F.randn) if isinstance(n, int) else (n, lambda s: _normal("id", s))
    df = own.select("id", *[draw(seed + j).alias(f"z{j}") for j in range(k)])
    values = []
    for i in range(k):
        total = F.lit(float(mean[i]))
        for j in range(i + 1):
            total = total + float(root[i, j]) * F.col(f"z{j}")
        values.append(F.struct(F.lit(i + 1).alias("Scale"), total.alias("ability")))
    out = df.select("id", F.explode(F.array(*values)).alias("v")).select("id", "v.Scale", "v.ability")
    if covariates is None or not effects:
        return out
    own = F.lit(0.0)
    for scale, preds in effects.items():
        own = F.when(F.col("Scale") == scale, linear(preds)).otherwise(own)
    return out.join(covariates, "id").select("id", "Scale", (F.col("ability") + own).alias("ability"))


def sim_items(spark: SparkSession, per_scale: int, scales: int = 1, a_mean: float = 0.5, a_sd: float = 0.0, b_mean: float = 0.0, b_sd: float = 1.0, c_mean: float = -2.0, c_sd: float = 1.0, seed: int = 11, natural_a: bool = False, covariates: DataFrame | None = None, effects: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Item, Scale, A, B, C, D. A is the softplus of its draw, or the draw itself if natural_a; C = inv_logit of its draw.

    covariates: Item and the columns that ``effects`` names for A, B or C; they are added to the draws.
    """
    df = spark.range(1, per_scale * scales + 1).select(F.col("id").alias("Item"), (F.floor((F.col("id") - 1) / per_scale) + 1).cast("int").alias("Scale"))
    draws = {"A": a_mean + a_sd * F.randn(seed), "B": b_mean + b_sd * F.randn(seed + 1), "C": c_mean + c_sd * F.randn(seed + 2)}
    df = df.select("Item", "Scale", *[v.alias(k) for k, v in draws.items()])
    if covariates is not None and effects:
        df = df.join(covariates, "Item").withColumns({k: F.col(k) + linear(v) for k, v in effects.items()})
    return df.select("Item", "Scale", (F.col("A") if natural_a else softplus(F.col("A"))).alias("A"), "B", inv_logit(F.col("C")).alias("C"), F.lit(1.0).alias("D"))


def shift(df: DataFrame, column: str, preds: dict[str, float]) -> DataFrame:
    """Add covariate effects to a parameter."""
    return df.withColumn(column, F.col(column) + linear(preds))


def answer(rows: DataFrame, u: Column) -> DataFrame:
    """p and score of rows with ability, A, B, C, D; u is uniform."""
    p = p_correct(F.col("ability"), F.col("A"), F.col("B"), F.col("C"), F.col("D"))
    return rows.withColumn("p", p).withColumn("score", (u < F.col("p")).cast("int"))


def sim_irt(spark: SparkSession, persons: int | DataFrame = 100, items: int = 200, scales: int = 1, a_mean: float = 1.0, a_sd: float = 0.0, b_mean: float = 0.0, b_sd: float = 1.0, c_mean: float = -2.0, c_sd: float = 1.0, ability_mean: float = 0.0, ability_sd: float = 1.0, seed: int = 1, answered: int | None = None, item_covariates: DataFrame | None = None, item_effects: dict[str, dict[str, float]] | None = None, person_covariates: DataFrame | None = None, ability_effects: dict[int, dict[str, float]] | None = None, normal: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, items, abilities). With ``answered``, each person has that many random items of each scale.

    persons: so many, 1.., or a table with the id of each. Covariates (by Item, by id) are added with their effects and
    come along on the answers. Items are keyed by number over all scales, so covariates of one scale never drop the
    others. ``normal`` brings the abilities of each scale to median 0 and quartiles one apart, and its items with them,
    before answers are drawn.
    """
    item = sim_items(spark, items, scales, a_mean, a_sd, b_mean, b_sd, c_mean, c_sd, seed + 100, natural_a=True, covariates=item_covariates, effects=item_effects)
    eye = np.eye(scales).tolist()
    person = sim_persons(spark, persons, eye, [ability_mean] * scales, [ability_sd] * scales, seed, person_covariates, ability_effects)
    if normal:
        item, person = normalise(item, person, by_scale=True)
    rows = person if person_covariates is None else person.join(person_covariates, "id")
    bank = item if item_covariates is None else item.join(item_covariates, "Item")
    own = F.transform(F.sequence(F.lit(1), F.lit(items)), lambda i: (F.col("Scale") - 1) * items + i)
    if answered is not None:  # chosen in the person's row, before there are rows of answers to be dealt out
        own = F.transform(own, lambda i: F.struct(F.xxhash64("id", i, F.lit(seed)).alias("by"), i.alias("Item")))
        own = F.slice(F.array_sort(own), 1, answered)["Item"]
    rows = rows.withColumn("Item", F.explode(own)).join(F.broadcast(bank) if items * scales <= FEW else bank, ["Item", "Scale"])
    rows = answer(rows.withColumn("u", F.rand(seed + 200)), F.col("u"))
    more = [c for key, side in (("Item", item_covariates), ("id", person_covariates)) if side is not None for c in side.columns if c != key]
    return rows.select("id", "Item", "Scale", F.col("ability").alias("Ability"), "A", "B", "C", F.lit(0.0).alias("pcorrect"), "score", "p", *more), item, person
