"""Fits run to the tolerance, and both ways of sweeping agree."""

import numpy as np
import pytest

from raschmill.config import IrtConfig
from raschmill.operators import fit
from raschmill.operators.fit import fit_irt
from raschmill.plans import queries
from raschmill.plans.views import items, responses

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fit_2pl", "fit_3pl", "fit_4pl", "fit_fixed_items", "fit_person_preds", "fit_item_preds", "fit_ebayes"])
def test_registered_fits_converge(spark, monkeypatch, name):
    made = []

    def kept(*a, **b):
        made.append(fit_irt(*a, **b))
        return made[-1]

    monkeypatch.setattr(queries, "fit_irt", kept)
    assert queries.QUERIES[name](spark, SF).count() > 0
    m = made[0]
    print(name, m.sweeps, m.history[-1])
    assert m.converged and len(m.history) > 1
    assert abs(m.history[-1] - m.history[-2]) < 1e-8 * m.responses.count()


def test_no_result_without_convergence(spark):
    with pytest.raises(ArithmeticError):
        queries._fitted(spark, SF, pl=2, max_sweeps=2)


@pytest.mark.parametrize("how", [dict(pl=4, a_preds=("x2",), b_preds=("x1",)), dict(pl=2, person_preds=("x1",), ebayes=True), dict(pl=3, use_priors=False)], ids=str)
def test_sweeps_in_the_driver_equal_those_on_tables(spark, monkeypatch, how):
    r = responses(spark, SF)
    fixed = items(r).where("brand % 5 = 0").select("Item", "A", "B", "C", "D") if how["pl"] == 4 else None
    got = []
    for most in (fit.LOCAL, 0):
        monkeypatch.setattr(fit, "LOCAL", most)
        m = fit_irt(r, config=IrtConfig(**({"ebayes": False, "max_sweeps": 4, "tol": 0.0} | how)), fixed_items=fixed)
        got.append((m.history, m.items.toPandas().sort_values("Item")[["A", "B", "C", "D"]].to_numpy(), m.persons.toPandas().sort_values(["id", "Scale"])["ability"].to_numpy(), [b for k in sorted(m.effects) for b in m.effects[k].values()]))
    for a, b in zip(*got):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-7)
