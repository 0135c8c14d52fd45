"""Simulation with covariates over whole tables, and the quartiles that bring its abilities to one scale."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raschmill.operators import simulate
from raschmill.operators.normalise import quartiles
from raschmill.plans.queries import QUERIES
from raschmill.plans.views import table

SF = "/root/testdata/sf0.01"
Q = [0.25, 0.5, 0.75]


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_every_customer_answers(spark):
    got = QUERIES["sim_with_covariates"](spark, SF).cache()
    own = table(spark, SF, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10_000).alias("own"))
    each = got.groupBy("id", "Scale").agg(F.count_distinct("Item").alias("n"), F.min("Item").alias("least"), F.max("Item").alias("most"), F.min("balance").alias("balance"), F.count_distinct("Ability").alias("abilities"))
    rows = own.join(each, "id", "left").collect()
    assert got.count() == 20 * own.count() and len(rows) == 2 * own.count()
    for r in rows:
        assert (r["n"], r["abilities"]) == (10, 1) and r["balance"] == r["own"]
        assert 20 * (r["Scale"] - 1) < r["least"] <= r["most"] <= 20 * r["Scale"]
    got.unpersist()


def test_abilities_of_each_scale_are_normal(spark):
    got = QUERIES["sim_with_covariates"](spark, SF).select("id", "Scale", "Ability").distinct()
    for r in got.groupBy("Scale").agg(F.percentile("Ability", Q).alias("q")).collect():
        assert r["q"][1] == pytest.approx(0, abs=1e-9) and r["q"][2] - r["q"][0] == pytest.approx(1)


def test_no_task_holds_all_abilities(spark):
    """``percentile`` has every distinct value in one map: 60 times sf0.1 did not fit into 750 MB."""
    assert "percentile(" not in _plan(QUERIES["sim_with_covariates"](spark, SF))


def test_quartiles_are_those_of_percentile(spark):
    draw = random.Random(3)
    odd = [None, float("nan"), float("-inf"), 0.0, -0.0]
    tables = [spark.createDataFrame([(i % 3, draw.choice(odd) if i % 4 == 0 else draw.gauss(0, 1)) for i in range(500)], "g int, v double"), spark.range(60_000).select((F.col("id") % 2).alias("g"), F.randn(5).alias("v")), spark.range(40_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 11).cast("double").alias("v"))]
    for df in (*tables, *(spark.range(n).select(F.lit(1).alias("g"), F.randn(n).alias("v")) for n in (1, 2, 5))):
        for keys in ((), ("g",)):
            got, want = ({r[:-1]: np.array(r["q"]) for r in x.collect()} for x in (quartiles(df, "v", keys), df.groupBy(*keys).agg(F.percentile("v", Q).alias("q"))))
            assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)
    assert quartiles(tables[0].where("v > 99 and not isnan(v)"), "v").first()["q"] == [None] * 3
    none = spark.range(4).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("v"))
    assert {r["g"]: r["q"] for r in quartiles(none, "v", ("g",)).collect()} == {0: [1.0] * 3, 1: None}


def test_draws_by_key_do_not_depend_on_how_rows_are_dealt(spark):
    ids = spark.range(5, 60_005, 3)
    one, other = (simulate.sim_persons(spark, x, [[1.0, 0.5], [0.5, 1.0]], [0.0, 1.0], [1.0, 2.0], seed=4).toPandas().pivot(index="id", columns="Scale", values="ability") for x in (ids.coalesce(1), ids.repartition(7)))
    assert one.equals(other) and len(one) == 20_000
    assert one.mean().to_numpy() == pytest.approx([0, 1], abs=0.05) and one.std().to_numpy() == pytest.approx([1, 2], rel=0.03)
    assert np.corrcoef(one[1], one[2])[0, 1] == pytest.approx(0.5, abs=0.03)
