import math

import pytest
from pyspark.sql import functions as F

from raschmill.operators import adaptive, moments, reshape, scoring, simulate
from raschmill.operators import wle as wle_ops
from raschmill.operators.normalise import normalise


@pytest.fixture(scope="module")
def sim(spark):
    answers, items, persons = simulate.sim_irt(spark, 200, 20, 2, a_sd=0.2, seed=5)
    return answers.select("id", "Item", "Scale", "score", "p").cache(), items.cache(), persons.cache()


def test_simulated_probabilities_are_recomputed(spark, sim):
    answers, items, persons = sim
    got = scoring.check_p(scoring.with_parameters(answers.withColumnRenamed("p", "known"), items, persons), "known").first()
    assert got["difference"] < 1e-8 and got["n"] == 200 * 40


def test_probabilities_do_not_change_with_the_scale(spark, sim):
    answers, items, persons = sim
    for how in ({}, {"robust": False}, {"base": "B", "scale": 2.0, "mean": 1.0}, {"by_scale": True}):
        i, t = normalise(items, persons, **how)
        assert scoring.check_p(scoring.with_parameters(answers.withColumnRenamed("p", "known"), i, t), "known").first()["difference"] < 1e-8
    with pytest.raises(ValueError):
        normalise(items, persons, base="A")


def test_held_out_and_training_likelihoods_add_up(spark, sim):
    answers, items, persons = sim
    rows = scoring.probabilities(scoring.with_parameters(answers, items, persons)).withColumn("t", F.col("Item") % 7 != 0)
    one, both = scoring.total_loglik(rows).first(), scoring.total_loglik(rows, F.col("t")).first()
    assert both["train_loglik"] + both["holdout_loglik"] == pytest.approx(one["train_loglik"])
    assert 0.4 < both["holdout_geomean_p"] < 1


def test_standard_errors_by_differences(spark, sim):
    answers, items, persons = sim
    s = scoring.with_parameters(answers, items, persons)
    se = {(r["id"], r["Scale"]): r["se_lik"] for r in scoring.ability_se(s).collect()}
    h = 1e-3
    parts = {}
    for k in (-h, 0, h):
        moved = scoring.probabilities(s.withColumn("ability", F.col("ability") + k)).groupBy("id", "Scale").agg(F.sum("loglik").alias("l"))
        parts[k] = {(r["id"], r["Scale"]): r["l"] for r in moved.collect()}
    for key, v in list(se.items())[:50]:
        curve = (parts[h][key] - 2 * parts[0][key] + parts[-h][key]) / h**2
        assert v == pytest.approx(1 / math.sqrt(abs(curve)), rel=1e-2)


def gradient(theta, cells):
    i = j = lg = 0.0
    for a, b, c, d, y in cells:
        s = 1 / (1 + math.exp(-a * (theta - b)))
        p = c + (d - c) * s
        d1 = a * (d - c) * s * (1 - s)
        d2 = a * d1 * (1 - 2 * s)
        i, j, lg = i + d1 * d1 / (p * (1 - p)), j + d1 * d2 / (p * (1 - p)), lg + (d1 / p if y else -d1 / (1 - p))
    return j / (2 * i) + lg


def test_wle_is_a_root(spark, sim):
    answers, items, persons = sim
    s = scoring.with_parameters(answers, items, persons)
    got = {(r["id"], r["Scale"]): r for r in wle_ops.wle(wle_ops.cells(s)).collect()}
    rows = {}
    for r in s.where("id <= 20").collect():
        rows.setdefault((r["id"], r["Scale"]), []).append((r["A"], r["B"], r["C"], r["D"], r["score"]))
    for key, cells in rows.items():
        t = got[key]["wle"]
        assert gradient(t - 0.002, cells) * gradient(t + 0.002, cells) <= 0
        assert got[key]["wle_se"] == pytest.approx(math.sqrt(abs(0.02 / (gradient(t - 0.01, cells) - gradient(t + 0.01, cells)))), rel=1e-6)


def test_wle_of_perfect_patterns(spark):
    rows = [(p, i, 1, p % 2, 1.0, (i - 5) / 2, 0.0, 1.0) for p in (1, 2) for i in range(10)] + [(3, i, 1, 0, 1.5, 0.0, 0.2, 1.0) for i in range(5)]
    s = spark.createDataFrame(rows, "id int, Item int, Scale int, score int, A double, B double, C double, D double")
    got = {r["id"]: r["wle"] for r in wle_ops.wle(wle_ops.cells(s)).collect()}
    assert got[1] > 2 and got[2] < -2 and all(math.isfinite(v) for v in got.values())


def test_integration_without_spread_is_the_probability(spark, sim):
    answers, items, persons = sim
    s = scoring.with_parameters(answers, items, persons)
    r = scoring.integrated_probability(scoring.probabilities(s), F.lit(0.0)).where(F.abs(F.col("p_integrated") - F.col("p_observed")) > 1e-12)
    assert r.count() == 0
    assert sum(scoring.gauss_hermite(7)[1]) == pytest.approx(1)


def test_correlations_of_constant_abilities_are_null(spark):
    t = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.0), (1, 2, 0.5), (2, 2, 1.5)], "id int, Scale int, ability double")
    got = {(r[0], r[1]): r[2] for r in moments.ability_correlations(t).collect()}
    assert got[1, 1] is None and got[1, 2] is None and got[2, 2] == pytest.approx(1)


def test_adaptive_round(spark, sim):
    _, items, persons = sim
    bank = items.where("Scale = 1")
    people = persons.where("Scale = 1 and id <= 5")
    log = spark.createDataFrame([(1, 1, 1, 1)], "id long, Item long, Scale int, score int")
    left = adaptive.remaining_items(people.select("id"), bank, log)
    assert left.count() == 5 * 20 - 1
    nxt = adaptive.next_items(left.join(people, ["id", "Scale"]), 2)
    assert nxt.count() == 10
    easy = adaptive.next_items(left.join(people, ["id", "Scale"]), 1, target_ease=0.2)
    log = adaptive.append(log, simulate.answer(easy, F.rand(1)))
    assert log.count() == 6 and log.where("score is null").count() == 0
    assert adaptive.remaining_items(people.select("id"), bank, log).count() == 94


def test_shapes(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (1, "b", 1), (2, "b", 0)], "id int, Item string, score int")
    assert sorted(tuple(r) for r in reshape.responses_wide(df, ["a", "b"]).collect()) == [(1, 0, 1), (2, None, 0)]


def test_stream_of_answers_equals_batch(spark, tmp_path):
    from raschmill.streaming.sessions import running_scores

    rows = [(i % 3, i % 4, 1, i % 2, f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, Item int, Scale int, score int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    bank = spark.createDataFrame([(i, 1.0, i / 2 - 1, 0.1, 1.0) for i in range(4)], "Item int, A double, B double, C double, D double")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = running_scores(stream, bank).writeStream.format("memory").queryName("sessions").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["id"], str(r["window"]), r["n"], round(r["gradient"], 9), round(r["information"], 9))
    assert sorted(map(key, spark.table("sessions").collect())) == sorted(map(key, running_scores(df, bank).collect()))


def test_wle_uses_arrays_of_whole_batches(spark, monkeypatch):
    """Many persons in one pass, in slices of any size; no interpreted loop of the engine is left in the plan."""
    rows = [(p, 1, i, 0.8 + 0.1 * i, i - 2.0, 0.1 * (i % 2), 1.0, int((p * 7 + i * 3) % 5 < 2)) for p in range(40) for i in range(5)]
    c = wle_ops.cells(spark.createDataFrame(rows, "id int, Scale int, Item int, A double, B double, C double, D double, score int"))
    df = wle_ops.wle(c)
    assert "aggregate(sequence" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {r["id"]: (r["wle"], r["wle_se"]) for r in df.collect()}
    monkeypatch.setattr(wle_ops, "_CELLS", 1)
    assert {r["id"]: (r["wle"], r["wle_se"]) for r in wle_ops.wle(c).collect()} == want and len(want) == 40


def test_wle_without_information_is_null(spark):
    c = wle_ops.cells(spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 1.0, 1), (2, 1, 2, 1.0, 0.0, 0.0, 1.0, 1)], "id int, Scale int, Item int, A double, B double, C double, D double, score int"))
    got = {r["id"]: (r["wle"], r["wle_se"]) for r in wle_ops.wle(c).collect()}
    assert got[1] == (None, None) and got[2][0] is not None
