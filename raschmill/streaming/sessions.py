"""The adaptive-testing session log as a stream: an extension, the batch form is operators.adaptive.

Answers arrive with a time; the item bank is static. For every person and window the score function
and the information at a reference ability are summed, from which an ability step follows. The
watermark bounds the state: answers later than it are dropped, as a stream must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raschmill.functions.model import Terms


def running_scores(answers: DataFrame, items: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", reference: float = 0.0) -> DataFrame:
    """window, id, Scale, gradient, information, n of a stream (or table) of answers id, Item, Scale, score, time."""
    rows = answers.withWatermark(time, late) if answers.isStreaming else answers
    t = Terms(F.lit(reference), *[F.col(c) for c in ("A", "B", "C", "D")])
    rows = rows.join(items.select("Item", "A", "B", "C", "D"), "Item")
    g = t.gradients(F.col("score"))["gAbility"]
    return rows.groupBy(F.window(time, window).alias("window"), "id", "Scale").agg(F.sum(g).alias("gradient"), F.sum(t.information).alias("information"), F.count(F.lit(1)).alias("n"))
