"""Linear rescaling of abilities, difficulties and slopes that leaves probabilities unchanged."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quartiles; the sketch's error in ranks is one in ACCURACY, and NEAR is looked at on both sides of each.
PROBS, ACCURACY, NEAR = (0.25, 0.5, 0.75), 10_000, 0.0005


def _beside(df: DataFrame, few: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with the few rows of constants, one for each value of ``keys`` (or one)."""
    return df.join(F.broadcast(few), list(keys)) if keys else df.crossJoin(F.broadcast(few))


def quartiles(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, q: the exact quartiles of ``col``, those of ``percentile``, which has all distinct values in the memory of one task.

    Cuts from a sketch deal the values into segments, which are counted; values are counted only in those that hold
    a wanted rank. A poor sketch makes these longer, not the quartiles wrong.
    """
    df = df.select(*keys, F.col(col).cast("double").alias("_x"))
    cuts = df.groupBy(*keys).agg(F.percentile_approx("_x", [p + e for p in PROBS for e in (-NEAR, NEAR)], ACCURACY).alias("_c"))
    segment = sum((F.col("_x") > F.col("_c")[i]).cast("int") for i in range(2 * len(PROBS)))
    # Nulls have a segment of no rows: a filter would be pushed below exchanges of ``df``, which could then not be used again.
    df = _beside(df, cuts, keys).select(*keys, "_x", F.coalesce(segment, F.lit(-1)).alias("_s"))
    place = [(F.col("_all") - 1) * p for p in PROBS]
    ranks = [f(x) for x in place for f in (F.floor, F.ceil)]
    holds = lambda r: (F.col("_from") <= r) & (r < F.col("_from") + F.col("_n"))
    own = Window.partitionBy(*keys)
    counted = df.groupBy(*keys, "_s").agg(F.count("_x").alias("_n"))
    counted = counted.select("*", F.sum("_n").over(own).alias("_all"), (F.sum("_n").over(own.orderBy("_s")) - F.col("_n")).alias("_from"))
    wanted = counted.where(reduce(or_, map(holds, ranks))).select(*keys, "_s", "_all", F.col("_from").alias("_start"))
    values = _beside(df, wanted, (*keys, "_s")).groupBy(*keys, "_s", "_all", "_start", "_x").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys, "_s").orderBy("_x")
    values = values.select("*", (F.col("_start") + F.sum("_n").over(up) - F.col("_n")).alias("_from"))
    at = values.groupBy(*keys).agg(F.max("_all").alias("_all"), *[F.max(F.when(holds(r), F.col("_x"))).alias(f"_v{i}") for i, r in enumerate(ranks)])
    q = []
    for i, x in enumerate(place):
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        q.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high))
    at = at.select(*keys, F.array(*q).alias("q"))
    return cuts.select(*keys).join(F.broadcast(at), list(keys), "left") if keys else at  # also where all are null


def _constants(source: DataFrame, col: str, robust: bool, scale: float, keys: tuple[str, ...]) -> DataFrame:
    """keys, _m, _s: centre and spread, as median and interquartile range, or mean and standard deviation."""
    if robust:
        q = F.col("q")
        return quartiles(source, col, keys).select(*keys, q[1].alias("_m"), ((q[2] - q[0]) / scale).alias("_s"))
    return source.groupBy(*keys).agg(F.avg(col).alias("_m"), (F.stddev_samp(col) / scale).alias("_s"))


def normalise(items: DataFrame, persons: DataFrame, base: str = "Ability", scale: float = 1.0, mean: float = 0.0, robust: bool = True, by_scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items (Item, [Scale,] A, B, ...) and persons (id, Scale, ability) on a scale where ``base`` has the given spread and mean.

    base: "Ability" or "B". With ``by_scale`` the constants are those of each scale. A spread of zero gives nulls.
    The constants are one aggregate row (or one for each scale), joined without coming to the driver.
    """
    if base not in ("Ability", "B"):
        raise ValueError("base must be 'Ability' or 'B'")
    source, col = (persons, "ability") if base == "Ability" else (items, "B")
    keys = ("Scale",) if by_scale else ()
    k = _constants(source, col, robust, scale, keys)
    join = lambda df: _beside(df, k, keys)
    spread = F.when(F.col("_s") != 0, F.col("_s"))
    put = lambda c: (F.col(c) - F.col("_m")) / spread + mean
    new_items = join(items).withColumn("B", put("B")).withColumn("A", F.col("A") * spread)
    return new_items.select(*items.columns), join(persons).withColumn("ability", put("ability")).select(*persons.columns)
