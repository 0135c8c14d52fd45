"""Weighted likelihood estimates of ability, by bisection on arrays of many persons at once.

A person's answers on a scale are first counted by item, so the list in a row is as long as the
scale has items, however many answers there are. Bisection runs over the lists of a batch of rows
together and leaves out persons that are done: one pass, no job for each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPANSIONS = 10
TOLERANCE = 0.001
_STEPS = 40
#: Cells that are worked on together.
_CELLS = 250_000


def cells(scored: DataFrame) -> DataFrame:
    """id, Scale, cells: for each item its parameters and the numbers of right and wrong answers."""
    one = scored.groupBy("id", "Scale", "Item", "A", "B", "C", "D").agg(F.count_if(F.col("score") == 1).alias("n1"), F.count_if(F.col("score") == 0).alias("n0"))
    cell = F.struct("Item", "A", "B", "C", "D", "n1", "n0")
    return one.groupBy("id", "Scale").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def gradient(theta: Column, items: Column) -> Column:
    """J / (2 I) + dlogL / dtheta of a list of cells."""

    def add(acc: Column, x: Column) -> Column:
        s = 1 / (1 + F.exp(-x["A"] * (theta - x["B"])))
        width = x["D"] - x["C"]
        p = x["C"] + width * s
        d1 = x["A"] * width * s * (1 - s)
        d2 = x["A"] * d1 * (1 - 2 * s)
        n, q = x["n1"] + x["n0"], p * (1 - p)
        return F.struct(
            (acc["i"] + n * d1 * d1 / q).alias("i"),
            (acc["j"] + n * d1 * d2 / q).alias("j"),
            (acc["l"] + x["n1"] * d1 / p - x["n0"] * d1 / (1 - p)).alias("l"),
        )

    zero = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("j"), F.lit(0.0).alias("l"))
    return F.aggregate(items, zero, add, lambda t: t["j"] / (2 * t["i"]) + t["l"])


def wle_of(model, responses: DataFrame | None = None, **how: float) -> DataFrame:
    """id, Scale, wle, wle_se of a fitted model's persons (or of other answers) under its item parameters."""
    rows = model.responses if responses is None else responses
    return wle(cells(rows.select("id", "Scale", "Item", "score").join(model.items.select("Item", "A", "B", "C", "D"), "Item")), **how)


def wle(by_person: DataFrame, low: float = -5.0, high: float = 5.0, tolerance: float = TOLERANCE) -> DataFrame:
    """id, Scale, wle, wle_se.

    While the gradient has one sign at both ends the interval is widened, first downwards by its width,
    then upwards by the new one, at most EXPANSIONS times; then it is halved until half of it is within
    the tolerance. Persons whose answers hold no information have nulls.
    """
    keys = by_person.select("id", "Scale")
    schema = keys.schema.add("wle", "double").add("wle_se", "double")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                theta, se = _bisect(_Cells(part.column("cells")), low, high, tolerance)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("Scale"), pa.array(theta, from_pandas=True), pa.array(se, from_pandas=True)], names=schema.names)

    return by_person.select("id", "Scale", "cells").mapInArrow(solve, schema)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with at most _CELLS cells together, or single rows."""
    ends, at = np.cumsum(b.column("cells").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _CELLS, side="right")))
        yield b.slice(at, to - at)
        at = to


class _Cells:
    """The cells of some persons, one after the other."""

    def __init__(self, lists: pa.ListArray):
        items = lists.flatten()
        for k in ("A", "B", "C", "D", "n1", "n0"):
            setattr(self, k, items.field(k).to_numpy(zero_copy_only=False).astype(float))
        self.persons = len(lists)
        self.owner = np.repeat(np.arange(self.persons), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    def of(self, some: np.ndarray) -> _Cells:
        """Those of some persons, which are numbered anew."""
        out, keep, number = object.__new__(_Cells), some[self.owner], np.cumsum(some) - 1
        for k in ("A", "B", "C", "D", "n1", "n0"):
            setattr(out, k, getattr(self, k)[keep])
        out.persons, out.owner = int(some.sum()), number[self.owner[keep]]
        return out

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """As gradient(), of every person."""
        s = 1 / (1 + np.exp(-self.A * (theta[self.owner] - self.B)))
        width = self.D - self.C
        p, d1 = self.C + width * s, self.A * width * s * (1 - s)
        d2, q, n = self.A * d1 * (1 - 2 * s), p * (1 - p), self.n1 + self.n0
        i, j, l = (np.bincount(self.owner, x, self.persons) for x in (n * d1 * d1 / q, n * d1 * d2 / q, self.n1 * d1 / p - self.n0 * d1 / (1 - p)))
        return np.where(i != 0, j / (2 * i), np.nan) + l


def _sign(g: np.ndarray) -> np.ndarray:
    """Undefined gradients are alike and above all others, as in the engine."""
    return np.where(np.isnan(g), 2.0, np.sign(g))


def _bisect(cells: _Cells, low: float, high: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and their standard errors (not a number where there is none)."""
    with np.errstate(all="ignore"):
        lo, hi = np.full(cells.persons, float(low)), np.full(cells.persons, float(high))
        left, own = np.arange(cells.persons), cells
        at_low = np.empty(cells.persons)
        for k in range(EXPANSIONS + 1):
            below, above = _sign(own.gradient(lo[left])), _sign(own.gradient(hi[left]))
            at_low[left] = below
            same = below == above
            if k == EXPANSIONS or not same.any():
                break
            left, own = left[same], own.of(same)
            span = hi[left] - lo[left]
            lo[left], hi[left] = lo[left] - span, hi[left] + 2 * span
        left, own = np.arange(cells.persons), cells
        for _ in range(_STEPS):
            wide = (hi[left] - lo[left]) / 2 > tolerance
            if not wide.all():
                left, own = left[wide], own.of(wide)
            if not len(left):
                break
            mid = lo[left] + (hi[left] - lo[left]) / 2
            same = _sign(own.gradient(mid)) == at_low[left]
            lo[left], hi[left] = np.where(same, mid, lo[left]), np.where(same, hi[left], mid)
        theta = lo + (hi - lo) / 2
        theta[np.isnan(cells.gradient(theta))] = np.nan  # no information
        slope = (cells.gradient(theta - 0.01) - cells.gradient(theta + 0.01)) / 0.02
        return theta, np.where(slope != 0, np.sqrt(np.abs(1 / slope)), np.nan)
