import math

import pytest
from pyspark.sql import functions as F

from raschmill.functions import links
from raschmill.functions.model import Terms


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_links_are_inverse_and_safe(spark):
    for x in (-10.0, -3.0, 0.0, 0.5, 4.0):  # further down 0.5 + a tiny number has no digits left
        v = F.lit(x)
        got = one(spark, links.softplus_inverse(links.softplus(v)), links.lower_asymptote_inverse(links.lower_asymptote(v)), links.upper_asymptote_inverse(links.upper_asymptote(v)), links.logit(links.inv_logit(v)))
        assert all(abs(g - x) < 1e-3 for g in got)
    big = one(spark, links.softplus(F.lit(800.0)), links.inv_logit(F.lit(800.0)), links.inv_logit(F.lit(-800.0)))
    assert tuple(big) == (800.0, 1.0, 0.0)


def test_derivatives_by_differences(spark):
    base = dict(theta=0.4, a=1.3, b=-0.2, c=0.15, d=0.93)
    h = 1e-5

    def p(**k):
        v = base | k
        return v["c"] + (v["d"] - v["c"]) / (1 + math.exp(-v["a"] * (v["theta"] - v["b"])))

    t = Terms(*[F.lit(v) for v in base.values()])
    for score in (0, 1):
        ll = lambda **k: math.log(p(**k) if score else 1 - p(**k))
        g = t.gradients(F.lit(score))
        got = one(spark, *g.values(), t.slope, t.curve, t.loglik_curvature(F.lit(score)))
        want = [(ll(**{k: base[k] + h}) - ll(**{k: base[k] - h})) / (2 * h) for k in ("theta", "a", "b", "c", "d")]
        want.append((p(theta=0.4 + h) - p(theta=0.4 - h)) / (2 * h))
        want += [(f(theta=0.4 + 1e-4) - 2 * f() + f(theta=0.4 - 1e-4)) / 1e-8 for f in (p, ll)]
        assert list(got) == pytest.approx(want, abs=1e-5)
