"""Moments behind priors: outlier fences, fixed tables, empirical Bayes, covariates, correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raschmill.functions.links import logit, softplus_inverse


#: Values up to this number are sorted on the driver; beyond it ranks are found by counting.
FEW = 100_000
BOXES = 1024


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values of given ranks (from 1), exactly, without gathering the values."""
    found = grouped_order_statistics(df, value, (), {(): ranks})
    return [found[()][k] for k in ranks]


def grouped_order_statistics(df: DataFrame, value: str, keys: tuple[str, ...], ranks: dict[tuple, list[int]]) -> dict[tuple, dict[int, float]]:
    """group -> rank -> value, exactly, for all groups and ranks at once (groups: few).

    Each pass counts the values of every interval that is still open in BOXES equal boxes, with the least and
    greatest value of each box; a rank goes on in the box that holds it, until the open intervals hold at most FEW
    values, which are then sorted here. So the number of jobs does not depend on the number of groups.
    """
    names = [f"k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("v")).where("v is not null")
    kinds = "".join(f"{n} {d.schema[n].dataType.simpleString()}, " for n in names)
    ends = {tuple(r[n] for n in names): (r["lo"], r["hi"], r["n"]) for r in d.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).collect()}
    # (group, rank) -> least and greatest value of its interval, values in it, values below it
    at = {(g, k): (*ends[g], 0) for g, ks in ranks.items() for k in ks}

    def inside() -> DataFrame:
        open_ = sorted({(*g, lo, hi) for (g, _), (lo, hi, _, _) in at.items() if lo < hi}, key=str)
        side = F.broadcast(df.sparkSession.createDataFrame(open_, f"{kinds}lo double, hi double"))  # at most one row for each group and rank
        same = F.lit(True)
        for n in names:
            same = same & d[n].eqNullSafe(side[n])
        return d.join(side, same & d["v"].between(side["lo"], side["hi"])).select(*[d[n] for n in names], "v", "lo", "hi")

    while sum({(g, lo): n for (g, _), (lo, hi, n, _) in at.items() if lo < hi}.values()) > FEW:
        box = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BOXES), F.lit(BOXES - 1)).alias("box")
        boxes: dict[tuple, list] = {}
        for r in inside().groupBy(*names, "lo", "hi", box).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("box").collect():
            boxes.setdefault((tuple(r[n] for n in names), r["lo"], r["hi"]), []).append(r)
        for (g, k), (lo, hi, _, below) in list(at.items()):
            if lo < hi:
                for r in boxes[g, lo, hi]:
                    if below + r["n"] >= k:
                        at[g, k] = (r["a"], r["b"], r["n"], below)
                        break
                    below += r["n"]
    left: dict[tuple, list[float]] = {}
    if any(lo < hi for lo, hi, _, _ in at.values()):
        for r in inside().collect():
            left.setdefault((tuple(r[n] for n in names), r["lo"], r["hi"]), []).append(r["v"])
    out: dict[tuple, dict[int, float]] = {g: {} for g in ranks}
    for (g, k), (lo, hi, _, below) in at.items():
        out[g][k] = lo if lo == hi else sorted(left[g, lo, hi])[k - below - 1]
    return out


def fences(df: DataFrame, value: str, *keys: str, times: float = 1.5) -> DataFrame:
    """Hinges and the bounds beyond which values are outliers, for each group (scales: few).

    A hinge is the mean of the two order statistics around depth floor((n + 3) / 2) / 2 from either end.
    """
    d = df.where(F.col(value).isNotNull())
    counts = {tuple(r[k] for k in keys): r["n"] for r in d.groupBy(*keys).agg(F.count(value).alias("n")).collect() if r["n"]}
    depths = {g: (math.floor(((n + 3) // 2) / 2), math.ceil(((n + 3) // 2) / 2)) for g, n in counts.items()}
    ranks = {g: sorted({a, b, n + 1 - b, n + 1 - a}) for (g, n), (a, b) in zip(counts.items(), depths.values())}
    found = grouped_order_statistics(d, value, keys, ranks) if counts else {}
    rows = []
    for g, n in counts.items():
        a, b = depths[g]
        low, high = (found[g][a] + found[g][b]) / 2, (found[g][n + 1 - b] + found[g][n + 1 - a]) / 2
        step = times * (high - low)
        rows.append((*g, low, high, low - step, high + step))
    schema = "".join(f"`{key}` {df.schema[key].dataType.simpleString()}, " for key in keys) + "lower_hinge double, upper_hinge double, low double, high double"
    return df.sparkSession.createDataFrame(rows, schema)


def trim(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows whose value lies within the fences of its group."""
    f = fences(df, value, *keys).select(*keys, "low", "high")
    joined = df.join(f, list(keys)) if keys else df.crossJoin(f)
    return joined.where(F.col(value).between(F.col("low"), F.col("high"))).select(*df.columns)


def spread(sd: Column, multiplier: float) -> Column:
    return sd * multiplier + 1e-5


def empirical_moments(params: DataFrame, value: str, *keys: str, multiplier: float = 2.0) -> DataFrame:
    """Mean and widened deviation of parameters without outliers."""
    return trim(params, value, *keys).groupBy(*keys).agg(F.avg(value).alias("mean"), spread(F.stddev_samp(value), multiplier).alias("sd"), F.count(value).alias("n"))


def priors_from_fixed(fixed: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """One row: prior means and deviations of raw parameters from a table of fixed A, B, C, D (those it has).

    A probability of 1 or more has no logit and does not count.
    """
    inside = lambda c: F.when((F.col(c) + 1e-8 > 0) & (F.col(c) + 1e-8 < 1), logit(F.col(c) + 1e-8))
    raw = {"a": ("A", lambda c: softplus_inverse(F.col(c))), "b": ("B", F.col), "c": ("C", inside), "d": ("D", inside)}
    raw = fixed.select(*[f(c).alias(k) for k, (c, f) in raw.items() if c in fixed.columns])
    cols = []
    for k in raw.columns:
        cols += [F.avg(k).alias(f"{k}_mean"), spread(F.stddev_samp(k), multiplier).alias(f"{k}_sd")]
    return raw.agg(*cols)


def ability_priors_from_fixed(abilities: DataFrame, multiplier: float = 2.0) -> tuple[dict[str, float], dict[str, float], dict[tuple[str, str], float]]:
    """(means, widened deviations, correlations of pairs) by scale, from a table id, Scale, ability; a few numbers for each scale."""
    rows = abilities.groupBy("Scale").agg(F.avg("ability").alias("m"), spread(F.stddev_samp("ability"), multiplier).alias("s")).collect()
    corr = ability_correlations(abilities.where("ability is not null")).collect()
    fine = lambda v: v is not None and math.isfinite(v)
    return (
        {str(r["Scale"]): r["m"] for r in rows if fine(r["m"])},
        {str(r["Scale"]): r["s"] for r in rows if fine(r["s"])},
        {(str(r[0]), str(r[1])): max(-0.99, min(0.99, r["corr"])) for r in corr if fine(r["corr"]) and r[0] != r[1]},
    )


def covariate_means(df: DataFrame, key: str, preds: tuple[str, ...]) -> DataFrame:
    """Mean of row-level covariates by person or item."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in preds])


def standardised_effects(rows: DataFrame, params: DataFrame, betas: dict[str, float], value: str, *keys: str) -> DataFrame:
    """covariate, beta, effect = beta * sd(covariate over rows) / sd(parameter), for each group of parameters (scales)."""
    spark = rows.sparkSession
    names = list(betas)
    sds = rows.agg(*[F.stddev_samp(c).alias(c) for c in names]).unpivot([], names, "covariate", "sd_x")
    b = spark.createDataFrame(list(betas.items()), "covariate string, beta double")
    sd = params.groupBy(*keys).agg(F.stddev_samp(value).alias("sd_par"))
    ratio = F.when(F.col("sd_par") != 0, F.col("beta") * F.col("sd_x") / F.col("sd_par"))
    return b.join(sds, "covariate").crossJoin(sd).select(*keys, "covariate", "beta", ratio.alias("effect"))  # a few rows each


def ability_correlations(abilities: DataFrame) -> DataFrame:
    """scale_a, scale_b, corr over persons that have both; null where a scale does not vary."""
    one = abilities.select("id", F.col("Scale").alias("scale_a"), F.col("ability").alias("a"))
    two = abilities.select("id", F.col("Scale").alias("scale_b"), F.col("ability").alias("b"))
    varies = (F.stddev_samp("a") > 0) & (F.stddev_samp("b") > 0)
    g = one.join(two, "id").groupBy("scale_a", "scale_b").agg(F.covar_samp("a", "b").alias("v"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), varies.alias("varies"))
    return g.select("scale_a", "scale_b", F.when(F.col("varies"), F.try_divide(F.col("v"), F.col("sa") * F.col("sb"))).alias("corr"))


def normal_log_density(x: Column, mean: Column | float, sd: Column | float) -> Column:
    """Without its constant, as far as it depends on x."""
    z = (x - mean) / sd
    return -0.5 * z * z
