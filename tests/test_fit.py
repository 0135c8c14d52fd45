import numpy as np
import pytest
from pyspark.sql import functions as F

from raschmill.config import IrtConfig, Priors
from raschmill.operators.fit import fit_irt, linearised
from raschmill.operators.simulate import answer, sim_irt
from raschmill.storage import cut


def joined(a, b, key, x, y):
    rows = a.join(b, key).select(F.col(x).cast("double"), F.col(y).cast("double")).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_two_parameters_are_recovered(spark):
    answers, items, persons = sim_irt(spark, 1500, 20, 1, a_mean=1.2, a_sd=0.3, c_mean=-20, c_sd=0.01, seed=3)
    answers = cut(answers)
    m = fit_irt(answers, config=IrtConfig(pl=2, max_sweeps=12, normalise=True))
    truth = cut(items.select("Item", F.col("A").alias("ta"), F.col("B").alias("tb")))
    a, ta = joined(m.items, truth, "Item", "A", "ta")
    b, tb = joined(m.items, truth, "Item", "B", "tb")
    assert np.corrcoef(b, tb)[0, 1] > 0.98 and np.corrcoef(a, ta)[0, 1] > 0.75
    t, tt = joined(m.persons, cut(persons.withColumnRenamed("ability", "tt")), ["id", "Scale"], "ability", "tt")
    assert np.corrcoef(t, tt)[0, 1] > 0.85
    assert m.history[-1] > m.history[0] and m.predict().where("p is null").count() == 0


def test_fixed_items_stay_and_holdout_is_predicted(spark):
    answers, items, _ = sim_irt(spark, 150, 12, 2, c_mean=-20, c_sd=0.01, seed=9)
    answers = cut(answers.withColumn("train", F.xxhash64("id", "Item") % 10 != 0))
    fixed = cut(items.where("Item % 3 = 0").select("Item", "A", "B", "C", "D"))
    m = fit_irt(answers, config=IrtConfig(pl=2, ebayes=False, max_sweeps=4, training="train", drop_perfect_scores=False), fixed_items=fixed)
    b, tb = joined(m.items, fixed.select("Item", F.col("B").alias("tb")), "Item", "B", "tb")
    assert np.abs(b - tb).max() < 1e-12
    assert m.persons.count() == 300 and m.predict().count() == answers.count()


def test_person_and_item_covariates(spark):
    answers, items, persons = sim_irt(spark, 1500, 20, 1, c_mean=-20, c_sd=0.01, seed=21)
    rows = cut(answers).withColumn("x", (F.xxhash64("id") % 100) / 50.0).withColumn("z", (F.xxhash64("Item") % 100) / 50.0)
    rows = rows.withColumn("ability", F.col("Ability") + 0.8 * F.col("x")).withColumn("B", F.col("B") - 0.5 * F.col("z")).withColumn("D", F.lit(1.0))
    rows = cut(answer(rows.drop("score", "p"), F.rand(4)))
    people = cut(persons.select("id", F.col("ability").alias("1")))
    m = fit_irt(rows, config=IrtConfig(ebayes=False, max_sweeps=10, person_preds=("x",)))
    assert m.effects["ability:1"]["x"] == pytest.approx(0.8, abs=0.25)
    k = fit_irt(rows, config=IrtConfig(ebayes=False, max_sweeps=8, b_preds=("z",), priors=Priors(b_sd=1.0)), fixed_persons=people.withColumn("1", F.col("1")))
    assert "b" in k.effects and np.isfinite(k.effects["b"]["z"])


def test_effects_of_each_item(spark):
    answers, _, _ = sim_irt(spark, 1200, 8, 1, c_mean=-20, c_sd=0.01, seed=31)
    rows = cut(answers).withColumn("z", (F.xxhash64("id", "Item") % 100) / 50.0).withColumn("true", F.when(F.col("Item") <= 4, 1.0).otherwise(-1.0))
    rows = rows.withColumn("B", F.col("B") + F.col("true") * F.col("z")).withColumn("D", F.lit(1.0)).withColumn("ability", F.col("Ability"))
    rows = cut(answer(rows.drop("score", "p"), F.rand(5)))
    m = fit_irt(rows, config=IrtConfig(ebayes=False, max_sweeps=6, b_preds=("z",), item_specific_betas=True))
    own = {r["Item"]: r["beta_b_z"] for r in m.raw_items.collect()}
    assert all((v > 0.4) == (i <= 4) for i, v in own.items()) and m.effects == {}


def test_scales_that_correlate(spark):
    from raschmill.operators.simulate import sim_items, sim_persons
    from raschmill.sources.responses import grid

    item = cut(sim_items(spark, 15, 2, a_mean=1.0, c_mean=-20, c_sd=0.01, natural_a=True, seed=2))
    person = cut(sim_persons(spark, 600, [[1, 0.7], [0.7, 1]], [0.0, 0.0], [1.0, 1.0], seed=8))
    rows = cut(answer(grid(spark, 600, 15, 2).join(item, ["Item", "Scale"]).join(person, ["id", "Scale"]), F.rand(6)).select("id", "Item", "Scale", "score"))
    m = fit_irt(rows, config=IrtConfig(max_sweeps=6, ebayes_multiplier=1.0))
    w = m.persons.groupBy("id").pivot("Scale", [1, 2]).agg(F.first("ability")).toPandas()
    assert abs(np.corrcoef(w["1"], w["2"])[0, 1] - 0.7) < 0.15


def test_single_answer_and_three_four_parameters(spark):
    one = spark.createDataFrame([(1, "a", 1)], "id int, Item string, score int")
    fixed = spark.createDataFrame([("a", 1.0, -5.0)], "Item string, A double, B double")
    m = fit_irt(one, config=IrtConfig(drop_perfect_scores=False, ebayes=False, max_sweeps=30), fixed_items=fixed)
    assert np.isfinite(m.persons.first()["ability"])
    answers, _, _ = sim_irt(spark, 300, 10, 1, seed=4)
    answers = cut(answers)
    for pl in (3, 4):
        got = fit_irt(answers, config=IrtConfig(pl=pl, careful=pl == 4, ebayes=False, max_sweeps=3)).items
        assert got.where("not (C >= 0 and C < 0.5 and D > 0.5 and D <= 1)").count() == 0


def test_linearised_effect():
    assert linearised(lambda x: 2 * x, 0.3, 0.7) == pytest.approx(1.4)
