"""Scoring answers under given parameters: probabilities, likelihoods, information, fit of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raschmill.functions.model import Terms, p_observed, row_loglik

PARAMETERS = ("A", "B", "C", "D")


def with_parameters(responses: DataFrame, items: DataFrame, abilities: DataFrame) -> DataFrame:
    """Answers with A, B, C, D of their item and the ability of their person on its scale.

    Plain equi-joins: Catalyst broadcasts the item table where it is small enough, else sorts.
    """
    have = [c for c in PARAMETERS if c in items.columns]
    full = items.select("Item", *have, *[F.lit(1.0 if c in "AD" else 0.0).alias(c) for c in PARAMETERS if c not in have])
    return responses.join(full, "Item").join(abilities.select("id", "Scale", "ability"), ["id", "Scale"])


def terms() -> Terms:
    return Terms(*[F.col(c) for c in ("ability", *PARAMETERS)])


def probabilities(scored: DataFrame) -> DataFrame:
    """p (of a correct answer), p_observed and loglik for each answer."""
    t = terms()
    return scored.withColumn("p", t.p).withColumn("p_observed", p_observed(F.col("score"), F.col("p"))).withColumn("loglik", row_loglik(F.col("p_observed")))


def total_loglik(rows: DataFrame, training: Column | None = None) -> DataFrame:
    """One row: the log-likelihood of the training rows, that of the others, and the numbers of both."""
    on = training if training is not None else F.lit(True)
    return rows.agg(
        F.sum(F.when(on, F.col("loglik"))).alias("train_loglik"),
        F.sum(F.when(~on, F.col("loglik"))).alias("holdout_loglik"),
        F.count_if(on).alias("n_train"),
        F.count_if(~on).alias("n_holdout"),
        F.exp(F.avg(F.when(~on, F.col("loglik")))).alias("holdout_geomean_p"),
    )


def score_contributions(scored: DataFrame) -> DataFrame:
    """Derivatives of each answer's log-likelihood by ability and item parameters."""
    g = terms().gradients(F.col("score"))
    return scored.select("*", *[v.alias(k) for k, v in g.items()])


def gradient_sums(contributions: DataFrame, *keys: str) -> DataFrame:
    names = ("gAbility", "gA", "gB", "gC", "gD")
    return contributions.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def item_information(scored: DataFrame) -> DataFrame:
    """Information about ability that the answers to each item carry."""
    return scored.groupBy("Item").agg(F.sum(terms().information).alias("information"), F.count(F.lit(1)).alias("n"))


def ability_se(scored: DataFrame, prior_sd: float | None = None) -> DataFrame:
    """Standard errors of abilities from the curvature of the likelihood, without and with the prior; null without information."""
    k = scored.groupBy("id", "Scale").agg(F.sum(terms().loglik_curvature(F.col("score"))).alias("curvature"))
    lik = F.when(F.col("curvature") != 0, F.sqrt(1 / F.abs(F.col("curvature"))))
    out = k.withColumn("se_lik", lik)
    return out if prior_sd is None else out.withColumn("se_post", F.sqrt(1 / F.abs(F.col("curvature") - 1 / prior_sd**2)))


def item_se(scored: DataFrame) -> DataFrame:
    """Standard errors of A and B of each item from the inverse of their 2 x 2 information."""
    t = terms()
    w = (t.d - t.c) * t.s * (1 - t.s)
    w = w * w / (t.p * (1 - t.p))
    dist = t.theta - t.b
    k = scored.groupBy("Item").agg(F.sum(w * dist * dist).alias("iaa"), F.sum(-w * t.a * dist).alias("iab"), F.sum(w * t.a * t.a).alias("ibb"))
    det = F.col("iaa") * F.col("ibb") - F.col("iab") * F.col("iab")
    safe = F.when(det > 0, det)
    return k.select("Item", F.sqrt(F.col("ibb") / safe).alias("se_A"), F.sqrt(F.col("iaa") / safe).alias("se_B"))


def item_covariance(scored: DataFrame, free: tuple[str, ...] = PARAMETERS) -> DataFrame:
    """Item, parameter_1, parameter_2, covariance: the inverse of each item's expected information about its free parameters.

    Null where the information is singular. One aggregation by item; the small inverses are made where their rows are.
    """
    t = terms()
    q = t.p * (1 - t.p)
    inner = (t.d - t.c) * t.s * (1 - t.s)
    by = {"A": inner * (t.theta - t.b), "B": -inner * t.a, "C": 1 - t.s, "D": t.s}
    sums = [F.sum(by[x] * by[y] / q).alias(f"{x}{y}") for n, x in enumerate(free) for y in free[n:]]
    names = [(x, y) for x in free for y in free]

    def inverses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = len(free)
            h = np.zeros((len(f), k, k))
            for n, x in enumerate(free):
                for m, y in enumerate(free[n:], n):
                    h[:, n, m] = h[:, m, n] = f[f"{x}{y}"]
            good = np.isfinite(h).all(axis=(1, 2))
            good[good] = np.linalg.cond(h[good]) < 1e14
            cov = np.full_like(h, np.nan)
            cov[good] = np.linalg.inv(h[good])
            for n, x in enumerate(free):
                for m, y in enumerate(free):
                    yield pd.DataFrame({"Item": f["Item"], "parameter_1": x, "parameter_2": y, "covariance": pd.Series(cov[:, n, m], index=f.index)})

    kind = scored.schema["Item"].dataType.simpleString()
    out = scored.groupBy("Item").agg(*sums).mapInPandas(inverses, f"Item {kind}, parameter_1 string, parameter_2 string, covariance double")
    return out.withColumn("covariance", F.nanvl("covariance", F.lit(None).cast("double")))


def ability_covariance(scored: DataFrame, scales: list, sd: list[float], corr: list[list[float]] | None = None) -> DataFrame:
    """id, Scale_1, Scale_2, covariance of a person's abilities: the inverse of their expected information plus the prior's precision.

    Scales that a person has no answers on are there with what the prior says.
    """
    k = len(scales)
    cov = (np.eye(k) if corr is None else np.array(corr, float)) * np.outer(sd, sd)
    precision = np.linalg.inv(cov + (1e-6 * np.eye(k) if k > 1 else 0))
    own = [F.coalesce(F.sum(F.when(F.col("Scale") == s, terms().information)), F.lit(0.0)).alias(f"i{n}") for n, s in enumerate(scales)]

    def inverses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = np.repeat(precision[None], len(f), 0)
            h[:, range(k), range(k)] += f[[f"i{n}" for n in range(k)]].to_numpy(float)
            inv = np.linalg.inv(h)
            for n, x in enumerate(scales):
                for m, y in enumerate(scales):
                    yield pd.DataFrame({"id": f["id"], "Scale_1": x, "Scale_2": y, "covariance": pd.Series(inv[:, n, m], index=f.index)})

    kinds = {c: scored.schema[c].dataType.simpleString() for c in ("id", "Scale")}
    return scored.groupBy("id").agg(*own).mapInPandas(inverses, f"id {kinds['id']}, Scale_1 {kinds['Scale']}, Scale_2 {kinds['Scale']}, covariance double")


def item_fit(rows: DataFrame) -> DataFrame:
    """Observed and expected share of correct answers by item."""
    return rows.groupBy("Item").agg(F.avg("score").alias("mean_observed"), F.avg("p").alias("mean_expected"), F.count(F.lit(1)).alias("n"))


def item_curve(items: DataFrame, low: float = -3.0, high: float = 3.0, steps: int = 600, rescale: bool = False) -> DataFrame:
    """Item, theta, p on a grid of abilities; with ``rescale`` theta is shown in standard deviations of the grid from its mean."""
    theta = F.lit(low) + F.col("g") * ((high - low) / steps)
    g = items.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("theta", theta)
    grid = np.linspace(low, high, steps + 1)
    shown = (F.col("theta") - float(grid.mean())) / float(grid.std(ddof=1)) if rescale else F.col("theta")
    return g.select("Item", shown.alias("theta"), Terms(F.col("theta"), *[F.col(c) for c in PARAMETERS]).p.alias("p"))


def gauss_hermite(n: int = 5) -> tuple[list[float], list[float]]:
    """Nodes and weights of a standard normal."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return x.tolist(), (w / np.sqrt(2 * np.pi)).tolist()


def integrated_probability(scored: DataFrame, sd: Column, points: int = 5) -> DataFrame:
    """p_integrated: the observed answer's probability, averaged over a normal of the ability with this deviation."""
    nodes, weights = gauss_hermite(points)
    total = F.lit(0.0)
    for x, w in zip(nodes, weights):
        p = Terms(F.col("ability") + x * sd, *[F.col(c) for c in PARAMETERS]).p
        total = total + w * p_observed(F.col("score"), p)
    return scored.withColumn("p_integrated", total)


def check_p(scored: DataFrame, known: str) -> DataFrame:
    """One row: the summed squared difference of probabilities computed anew and those in a column."""
    return probabilities(scored).agg(F.sum(F.pow(F.col("p") - F.col(known), 2)).alias("difference"), F.count(F.lit(1)).alias("n"))


def rmse(df: DataFrame, truth: str, estimate: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(estimate), 2))).alias("rmse"))
