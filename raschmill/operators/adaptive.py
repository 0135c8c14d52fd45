"""Adaptive testing: which item a person gets next, and the session log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raschmill.config import IrtConfig, Priors
from raschmill.functions.model import Terms
from raschmill.operators.fit import fit_irt
from raschmill.storage import cut

_LOG = ("id", "Item", "Scale", "score")


def remaining_items(persons: DataFrame, items: DataFrame, given: DataFrame) -> DataFrame:
    """Every item of the bank that a person has not had: id, Item and the bank's columns.

    What a person has had is a list no longer than the bank, and is taken from the bank's list in the person's row.
    """
    had = given.groupBy("id").agg(F.collect_set("Item").alias("had"))
    bank = items.agg(F.collect_list("Item").alias("bank"))  # one row
    own = persons.join(had, "id", "left").crossJoin(F.broadcast(bank))
    left = F.when(F.col("had").isNull(), F.col("bank")).otherwise(F.array_except("bank", "had"))
    return own.select(*persons.columns, F.explode(left).alias("Item")).join(items, "Item").select(*persons.columns, *items.columns)


def next_items(candidates: DataFrame, k: int = 1, target_ease: float | None = None) -> DataFrame:
    """The k best items of each person: most informative, or with the probability nearest to .5 + target_ease; ties by Item.

    candidates: id, Item, ability, A, B, C, D.
    """
    t = Terms(*[F.col(c) for c in ("ability", "A", "B", "C", "D")])
    value = F.round(t.information if target_ease is None else -F.abs(t.p - 0.5 - target_ease), 12)
    w = Window.partitionBy("id").orderBy(F.desc("value"), "Item")
    return candidates.withColumn("value", value).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def session(persons: DataFrame, items: DataFrame, respond: Callable[[DataFrame, int], DataFrame], rounds: int, log: DataFrame | None = None, k: int = 1, target_ease: float | None = None, config: IrtConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, abilities) after ``rounds`` of choosing, answering, fitting and appending.

    persons: id; items: Item, Scale, A, B, C, D, which stay fixed. ``respond`` is given the chosen items
    (id, Item, Scale, ability, A, B, C, D) and the round, and returns them with a score. Abilities start at 0 and are
    fitted to the whole log after each round, whose tables are written.
    """
    config = config or IrtConfig(pl=4, ebayes=False, est_means=(), priors=Priors(default_sd=1.0))
    config = replace(config, drop_perfect_scores=False)
    start = persons.select("id").crossJoin(F.broadcast(items.select("Scale").distinct())).withColumn("ability", F.lit(0.0))  # scales: few
    abilities = cut(start)
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("id", persons), ("Item", items), ("Scale", items))}
    log = log if log is not None else persons.sparkSession.createDataFrame([], f"id {kinds['id']}, Item {kinds['Item']}, Scale {kinds['Scale']}, score int")
    for n in range(rounds):
        open_items = remaining_items(persons.select("id"), items, log).join(abilities, ["id", "Scale"])
        chosen = cut(respond(next_items(open_items, k, target_ease).drop("value", "rank"), n))
        log = cut(append(log, chosen))
        fitted = fit_irt(log, config=config, fixed_items=items.select("Item", "A", "B", "C", "D")).persons
        abilities = cut(start.withColumnRenamed("ability", "none").join(fitted, ["id", "Scale"], "left").select("id", "Scale", F.coalesce("ability", "none").alias("ability")))
    return log, abilities


def append(log: DataFrame, answers: DataFrame) -> DataFrame:
    """The session log with new answers at its end."""
    return log.select(*_LOG).unionByName(answers.select(*_LOG))
