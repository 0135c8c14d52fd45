"""Details that a user of the surveyed package relies on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raschmill.config import IrtConfig, Priors
from raschmill.operators import adaptive, fit, moments, prep, scoring, simulate
from raschmill.operators import wle as wle_ops
from raschmill.operators.fit import fit_irt
from raschmill.plans.views import abilities, items, responses
from raschmill.storage import cut

SF = "/root/testdata/sf0.001"


def test_pl_decides_over_fixed_items(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "Item string")
    fixed = spark.createDataFrame([("a", 1.7, 0.3, 0.2, 0.9)], "Item string, A double, B double, C double, D double")
    got = {pl: {r["Item"]: tuple(r)[1:] for r in prep.item_setup(keys, pl, fixed).collect()} for pl in (1, 2, 3, 4)}
    assert got[1] == {"a": (1.0, 0.3, 0.0, 0.9), "b": (1.0, None, 0.0, 1.0)}
    assert got[2] == {"a": (1.7, 0.3, 0.0, 0.9), "b": (None, None, 0.0, 1.0)}
    assert got[3] == {"a": (1.7, 0.3, 0.2, 0.9), "b": (None, None, None, 1.0)}
    assert got[4]["b"] == (None, None, None, None)


@pytest.mark.parametrize("bad", [0.7, 2.0, -1.0, float("nan")])
def test_scores_are_checked_before_they_are_cast(spark, bad):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0), (1, "b", bad)], "id int, Item string, score double")
    with pytest.raises(ValueError):
        fit_irt(rows)


def test_curve_on_a_rescaled_grid(spark):
    bank = spark.createDataFrame([("a", 1.0, 0.0, 0.1, 1.0)], "Item string, A double, B double, C double, D double")
    plain, scaled = (scoring.item_curve(bank, -3, 3, 60, rescale=x).toPandas() for x in (False, True))
    t = plain["theta"].to_numpy()
    assert np.allclose(scaled["theta"], (t - t.mean()) / t.std(ddof=1)) and np.allclose(scaled["p"], plain["p"])


def test_ranks_of_groups_at_once(spark, monkeypatch):
    monkeypatch.setattr(moments, "FEW", 10)
    monkeypatch.setattr(moments, "BOXES", 8)
    r = random.Random(2)
    rows = [(g, r.choice([r.gauss(g or 0, 1), 0.5, 1e6])) for g in [1, 2, None] * 150] + [(3, 7.0), (4, None)]
    got = {x["g"]: x for x in moments.fences(spark.createDataFrame(rows, "g int, v double"), "v", "g").collect()}
    assert set(got) == {1, 2, 3, None}
    for g, x in got.items():
        v = sorted(b for a, b in rows if a == g and b is not None)
        n = len(v)
        d = ((n + 3) // 2) / 2
        a, b = int(d), int(-(-d // 1))
        assert (x["lower_hinge"], x["upper_hinge"]) == pytest.approx(((v[a - 1] + v[b - 1]) / 2, (v[n - a] + v[n - b]) / 2))


def test_covariances_against_inverses(spark):
    rows = [(i, s, j, 1) for i in range(40) for s in (1, 2) for j in range(6) if (i, s) != (0, 2)]
    df = spark.createDataFrame(rows, "id int, Scale int, Item int, score int").withColumns({"ability": F.col("id") / 10 - 2, "A": 0.8 + F.col("Item") / 10, "B": F.col("Item") / 3 - 1, "C": F.lit(0.15), "D": F.lit(0.95)})
    got = {}
    for r in scoring.item_covariance(df).collect():
        got.setdefault(r["Item"], {})[r["parameter_1"], r["parameter_2"]] = r["covariance"]
    th = np.array([i / 10 - 2 for i, s, j, _ in rows if j == 3])
    a, b, c, d = 0.8 + 0.3, 0.0, 0.15, 0.95
    sg = 1 / (1 + np.exp(-a * (th - b)))
    p = c + (d - c) * sg
    g = np.stack([(d - c) * sg * (1 - sg) * (th - b), -(d - c) * sg * (1 - sg) * a, 1 - sg, sg]) / np.sqrt(p * (1 - p))
    want = np.linalg.inv(g @ g.T)
    assert np.allclose([[got[3][x, y] for y in "ABCD"] for x in "ABCD"], want, rtol=1e-6)
    one = {(r["Scale_1"], r["Scale_2"]): r["covariance"] for r in scoring.ability_covariance(df, [1, 2], [1.0, 2.0], [[1.0, 0.5], [0.5, 1.0]]).where("id = 0").collect()}
    info = df.where("id = 0").select(F.sum(scoring.terms().information)).first()[0]
    want = np.linalg.inv(np.linalg.inv(np.array([[1.0, 1.0], [1.0, 4.0]]) + 1e-6 * np.eye(2)) + np.diag([info, 0.0]))
    assert np.allclose([[one[1, 1], one[1, 2]], [one[2, 1], one[2, 2]]], want, rtol=1e-6)
    none = df.withColumn("A", F.lit(0.0))
    assert scoring.item_covariance(none).where("covariance is not null").count() == 0


def test_partly_fixed_persons_have_the_margin_of_the_prior(spark):
    """Two of three scales are free for some persons: the objective's prior is the normal of those two alone."""
    rows = spark.createDataFrame([(i, j, s, (i * 7 + j * 3 + s) % 2) for i in range(6) for s in (1, 2, 3) for j in (10 * s, 10 * s + 1)], "id int, Item int, Scale int, score int")
    fixed = spark.createDataFrame([(0, None, 0.4, None), (1, -0.2, None, 0.3), (2, 0.1, 0.1, 0.1)], "id int, `1` double, `2` double, `3` double")
    corr = {("1", "2"): 0.5, ("2", "1"): 0.5, ("1", "3"): 0.2, ("3", "1"): 0.2, ("2", "3"): -0.3, ("3", "2"): -0.3}
    config = IrtConfig(ebayes=False, drop_perfect_scores=False, est_means=(), priors=Priors(default_sd=1.5, ability_corr=corr))
    cov = np.array([[1.0, 0.5, 0.2], [0.5, 1.0, -0.3], [0.2, -0.3, 1.0]]) * 2.25 + 1e-6 * np.eye(3)
    got = []
    for most in (fit.LOCAL, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(fit, "LOCAL", most)
            model = fit_irt(rows, config=config, fixed_persons=fixed, fixed_sweeps=2)
        got.append(model.history[-1])
    t = {(r["id"], r["Scale"]): r["ability"] for r in model.persons.collect()}
    still = {(0, 2), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}
    loglik = model.predict().agg(F.sum("loglik")).first()[0]
    prior = -0.5 * sum((r["B"] / 10) ** 2 for r in model.items.collect())
    for i in range(6):
        at = [n for n, s in enumerate((1, 2, 3)) if (i, s) not in still]
        v = np.array([t[i, n + 1] for n in at])
        prior -= 0.5 * v @ np.linalg.inv(cov[np.ix_(at, at)]) @ v if at else 0.0
    assert got[0] == pytest.approx(got[1], abs=1e-9) and got[0] == pytest.approx(loglik + prior, abs=1e-6)


def test_effects_come_raw_linearised_and_standardised(spark):
    r = responses(spark, SF)
    m = fit_irt(r, config=IrtConfig(pl=2, ebayes=False, max_sweeps=5, person_preds=("x1",), a_preds=("x2",)))
    got = {(x["parameter"], x["Scale"]): x for x in m.covariate_effects.collect()}
    assert set(got) == {("ability", 1), ("ability", 2), ("A", None)}
    sd = m.responses.agg(F.stddev_samp("x1")).first()[0]
    for s in (1, 2):
        own = m.persons.where(f"Scale = {s}").agg(F.stddev_samp("ability")).first()[0]
        b = m.effects[f"ability:{s}"]["x1"]
        assert got["ability", s]["beta"] == got["ability", s]["linearised"] == b
        assert got["ability", s]["standardised"] == pytest.approx(b * sd / own)
    raw = m.raw_items.agg(F.avg("a")).first()[0]
    f = lambda x: np.logaddexp(0, x)
    assert got["A", None]["linearised"] == pytest.approx(m.effects["a"]["x2"] * (f(raw + 0.01) - f(raw - 0.01)) / 0.02)
    own = fit_irt(r, config=IrtConfig(ebayes=False, max_sweeps=2, b_preds=("x1",), item_specific_betas=True))
    assert own.covariate_effects.where("parameter = 'B' and Item is not null").count() == own.items.count()


def test_wle_of_a_fit(spark):
    m = fit_irt(responses(spark, SF), config=IrtConfig(ebayes=False, max_sweeps=3))
    rows = scoring.with_parameters(m.responses, m.items.drop("Scale"), m.persons)
    want = {(r["id"], r["Scale"]): r["wle"] for r in wle_ops.wle(wle_ops.cells(rows)).collect()}
    assert {(r["id"], r["Scale"]): r["wle"] for r in wle_ops.wle_of(m).collect()} == want and len(want) > 50


@pytest.mark.parametrize("how", [{}, {"integrate_sd": 0.4}], ids=str)
def test_integrated_fits_agree_and_converge(spark, how):
    r = responses(spark, SF)
    got = []
    for most in (fit.LOCAL, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(fit, "LOCAL", most)
            got.append(fit_irt(r, config=IrtConfig(ebayes=False, integrate_points=3, max_sweeps=3, tol=0.0, **how)).history)
    assert np.allclose(*got, rtol=1e-8)
    if not how:
        assert fit_irt(r, config=IrtConfig(ebayes=False, integrate_points=5)).converged


def test_integral_against_quadrature(spark):
    """With a fixed deviation the objective is that of the integrated probabilities."""
    r = responses(spark, SF)
    m = fit_irt(r, config=IrtConfig(ebayes=False, use_priors=False, integrate_points=5, integrate_sd=0.5), fixed_sweeps=2)
    rows = scoring.with_parameters(m.responses, m.items.drop("Scale"), m.persons)
    want = scoring.integrated_probability(rows, F.lit(0.5)).agg(F.sum(F.ln("p_integrated"))).first()[0]
    assert m.history[-1] == pytest.approx(want, rel=1e-9)


def test_priors_from_fixed_persons_and_items(spark):
    r = responses(spark, SF)
    fixed = abilities(r).groupBy("id").pivot("Scale", [1, 2]).agg(F.first("ability"))
    m = fit_irt(r, config=IrtConfig(ebayes=False, priors_from_fixed=True, est_means=()), fixed_persons=fixed.where("id % 2 = 0"), fixed_items=items(r).where("brand % 2 = 0").select("Item", "B", "D"), fixed_sweeps=1)
    assert np.isfinite(m.history[-1])
    mean, sd, corr = moments.ability_priors_from_fixed(spark.createDataFrame([(i, s, float(i * s % 7)) for i in range(20) for s in (1, 2)], "id int, Scale int, ability double"))
    a, b = (np.array([i * s % 7 for i in range(20)], float) for s in (1, 2))
    assert mean["1"] == pytest.approx(a.mean()) and sd["2"] == pytest.approx(2 * b.std(ddof=1) + 1e-5) and corr["1", "2"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_simulated_covariates(spark):
    bank = spark.range(1, 41).select(F.col("id").alias("Item"), (F.col("id") % 5).cast("double").alias("z"))
    people = spark.range(1, 301).select("id", (F.col("id") % 3).cast("double").alias("x"))
    answers, item, person = simulate.sim_irt(spark, 300, 20, 2, a_sd=0.0, b_sd=0.0, c_sd=0.0, ability_sd=0.0, item_covariates=bank, item_effects={"A": {"z": 0.1}, "B": {"z": 0.5}, "C": {"z": -0.2}}, person_covariates=people, ability_effects={1: {"x": 0.7}, 2: {"x": -1.0}})
    for r in item.join(bank, "Item").collect():
        assert (r["A"], r["B"]) == pytest.approx((1 + 0.1 * r["z"], 0.5 * r["z"])) and r["C"] == pytest.approx(1 / (1 + np.exp(2 + 0.2 * r["z"])))
    assert all(r["ability"] == pytest.approx((0.7 if r["Scale"] == 1 else -1.0) * r["x"]) for r in person.join(people, "id").collect())
    assert answers.count() == 300 * 40 and {"x", "z"} <= set(answers.columns)
    _, item, person = simulate.sim_irt(spark, 400, 10, normal=True)
    q = person.agg(F.percentile("ability", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert q[1] == pytest.approx(0, abs=1e-9) and q[2] - q[0] == pytest.approx(1)


def test_adaptive_session(spark):
    bank = cut(simulate.sim_items(spark, 30, 1, a_mean=1.5, c_mean=-20, c_sd=0.01, natural_a=True, seed=5))
    people = cut(spark.range(40).select("id", (F.col("id") / 10 - 2).alias("true")))
    draw = lambda rows, n: simulate.answer(rows.join(people, "id").withColumn("own", F.col("ability")).withColumn("ability", F.col("true")), F.rand(n)).withColumn("ability", F.col("own"))
    log, t = adaptive.session(people.select("id"), bank, draw, 4, k=3)
    assert log.count() == 480 == log.select("id", "Item").distinct().count()
    got = t.join(people, "id").toPandas()
    assert np.corrcoef(got["ability"], got["true"])[0, 1] > 0.7
