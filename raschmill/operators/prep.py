"""Preparation: audits, fixpoint filter, dictionaries, fixed and free parameters, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from raschmill.storage import cut


def null_audit(df: DataFrame) -> DataFrame:
    """One row: the number of nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def require_complete(df: DataFrame) -> None:
    """Raise if any value is null, if the score is no number, or if one is neither 0 nor 1; one pass."""
    if not isinstance(df.schema["score"].dataType, NumericType):
        raise TypeError("score must be numeric")
    odd = F.count_if(~F.col("score").isin(0, 1))
    found = df.agg(odd, *[F.count_if(F.col(c).isNull()) for c in df.columns]).first()
    bad = {c: n for c, n in zip(df.columns, found[1:]) if n}
    if bad:
        raise ValueError(f"missing values: {bad}")
    if found[0]:
        raise ValueError(f"{found[0]} scores are neither 0 nor 1")


def means(df: DataFrame, key: str) -> DataFrame:
    """Mean score and number of answers by item or person."""
    return df.groupBy(key).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def with_mean(df: DataFrame, key: str, name: str) -> DataFrame:
    """The group's mean score on every row, by aggregation and join: no group is gathered in one task."""
    return df.join(df.groupBy(key).agg(F.avg("score").alias(name)), key)


def is_perfect(mean: Column, tol: float = 0.001) -> Column:
    return F.abs(mean - 0.5) + tol >= 0.5


def drop_perfect_scores(df: DataFrame, score: str = "score", item: str = "Item", person: str = "id", tol: float = 0.001) -> DataFrame:
    """Without items, then persons, whose scores are all 0 or all 1, until none is left.

    The loop runs on counts for each person and item, made once; only the ends, the rows of items and
    persons that stay, are taken from the table by anti-joins.
    """
    cells = cut(df.groupBy(F.col(person).alias("p"), F.col(item).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s")))
    gone: dict[str, list[DataFrame]] = {"i": [], "p": []}
    again = True
    while again:
        again = False
        for key in ("i", "p"):
            bad = cut(cells.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("m")).where(is_perfect(F.col("m"), tol)).select(key))
            if bad.limit(1).count():
                again = True
                gone[key].append(bad)
                cells = cut(cells.join(bad, key, "left_anti"))
    out = df
    for key, name in (("i", item), ("p", person)):
        if gone[key]:
            out = out.join(reduce(DataFrame.unionByName, gone[key]).withColumnRenamed(key, name), name, "left_anti")
    return out.select(*df.columns)


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """original, new: codes 1.. of the distinct keys in their order.

    The window has no partition key, but only runs over the distinct keys of a dictionary of items or
    scales; persons are joined on their own keys and need no code.
    """
    return df.select(F.col(key).alias("original")).distinct().select("original", F.dense_rank().over(Window.orderBy("original")).alias("new"))


def first_per_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the row that comes first by ``order`` (then by value) in each group."""
    return df.groupBy(key).agg(F.min(F.struct(order, value)).alias("f")).select(key, F.col(f"f.{value}").alias(value))


def item_scales(df: DataFrame, order: str) -> DataFrame:
    """The scale of each item: the one of its first row."""
    return first_per_group(df, "Item", "Scale", order)


def free_slots(setup: DataFrame, key: str, is_free: Column) -> DataFrame:
    """Number of each free parameter in the order of the key; 0 if fixed. For dictionaries of items."""
    free = is_free.cast("int")
    return setup.withColumn("slot", F.when(free == 1, F.sum(free).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))).otherwise(0).cast("int"))


def item_setup(items: DataFrame, pl: int, fixed: DataFrame | None = None) -> DataFrame:
    """Item, A, B, C, D with null for what is to be estimated.

    ``fixed`` overlays values, but ``pl`` decides: below 2 every A is 1, below 3 every C is 0. A fixed D holds for
    any ``pl``, without one it is 1 below 4.
    """
    base = {"A": None if pl > 1 else 1.0, "B": None, "C": None if pl > 2 else 0.0, "D": None if pl > 3 else 1.0}
    if fixed is None:
        return items.select("Item", *[F.lit(v).cast("double").alias(k) for k, v in base.items()])
    have = [c for c in base if c in fixed.columns]
    f = fixed.select("Item", *[F.col(c).cast("double").alias(f"f_{c}") for c in have])
    joined = items.select("Item").join(f, "Item", "left")
    have = [c for c in have if not (c == "A" and pl < 2 or c == "C" and pl < 3)]
    return joined.select("Item", *[F.coalesce(F.col(f"f_{k}") if k in have else F.lit(None).cast("double"), F.lit(v).cast("double")).alias(k) for k, v in base.items()])


def ability_setup(persons: DataFrame, scales: list[str], fixed: DataFrame | None = None) -> DataFrame:
    """id, Scale, ability for every person and scale, null for what is to be estimated.

    ``fixed`` has a column for each scale; nulls in it are free.
    """
    dense = persons.select("id").distinct().select("id", F.explode(F.array(*[F.lit(s) for s in scales])).alias("Scale"))
    if fixed is None:
        return dense.withColumn("ability", F.lit(None).cast("double"))
    have = [s for s in scales if str(s) in fixed.columns]
    if not have:
        return dense.withColumn("ability", F.lit(None).cast("double"))
    long = fixed.select("id", *[F.col(f"`{s}`").cast("double").alias(str(s)) for s in have]).unpivot("id", [str(s) for s in have], "s", "ability")
    dense = dense.withColumn("s", F.col("Scale").cast("string"))
    return dense.join(long, ["id", "s"], "left").select("id", "Scale", "ability")


def restrict(fixed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of a fixed table whose key occurs in the data."""
    return fixed.join(present.select(key).distinct(), key, "left_semi")


def top_k_per_person(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k answers of each person in an order (random numbers make it a sample)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)


def weighted_key(u: Column, weight: Column) -> Column:
    """Key whose smallest values are a weighted sample without replacement; u uniform in (0, 1)."""
    return -F.ln(u) / weight


def closeness_weight(ability: Column, difficulty: Column, greatest: Column) -> Column:
    """Weight of an item for a person: largest where difficulty and ability agree."""
    return F.exp(0.001 + greatest - F.abs(difficulty - ability))


def split_within_person(df: DataFrame, order: list[Column | str], share: float) -> DataFrame:
    """is_training: the first share of each person's answers in an order."""
    w = Window.partitionBy("id")
    rank, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return df.withColumn("is_training", rank <= F.ceil(n * share))


def split_by_person(df: DataFrame, hashed: Column, holdout: int, parts: int) -> DataFrame:
    """is_training: false for all answers of the persons in one part of ``parts``."""
    return df.withColumn("is_training", F.pmod(hashed, F.lit(parts)) != holdout)


def sample_rows(df: DataFrame, seed: int) -> DataFrame:
    """The rows in a random order."""
    return df.orderBy(F.rand(seed))
