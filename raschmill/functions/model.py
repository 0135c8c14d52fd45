"""The four-parameter response model: probabilities, log-likelihood, derivatives, information.

z = A (theta - B), s = 1 / (1 + exp(-z)), P = C + (D - C) s.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .links import inv_logit

#: Added to a probability before its logarithm is taken.
TINY = 1e-20


def p_correct(theta: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return c + (d - c) * inv_logit(a * (theta - b))


def p_observed(score: Column, p: Column) -> Column:
    """Probability of the answer that was given."""
    return F.when(score == 1, p).otherwise(1 - p)


def row_loglik(p_obs: Column) -> Column:
    return F.ln(p_obs + TINY)


@dataclass(frozen=True)
class Terms:
    """Expressions of one answer; theta, a, b, c, d are natural parameters."""

    theta: Column
    a: Column
    b: Column
    c: Column
    d: Column

    @property
    def s(self) -> Column:
        return inv_logit(self.a * (self.theta - self.b))

    @property
    def p(self) -> Column:
        return self.c + (self.d - self.c) * self.s

    @property
    def slope(self) -> Column:
        """dP / dtheta."""
        return self.a * (self.d - self.c) * self.s * (1 - self.s)

    @property
    def curve(self) -> Column:
        """Second derivative of P by theta."""
        return self.a * self.a * (self.d - self.c) * self.s * (1 - self.s) * (1 - 2 * self.s)

    @property
    def information(self) -> Column:
        """Fisher information of one answer about theta."""
        return self.slope * self.slope / (self.p * (1 - self.p))

    def residual(self, score: Column) -> Column:
        return (score - self.p) / (self.p * (1 - self.p))

    def gradients(self, score: Column) -> dict[str, Column]:
        """Derivatives of the log-likelihood by theta and the natural item parameters."""
        r = self.residual(score)
        inner = r * (self.d - self.c) * self.s * (1 - self.s)
        return {"gAbility": inner * self.a, "gA": inner * (self.theta - self.b), "gB": -inner * self.a, "gC": r * (1 - self.s), "gD": r * self.s}

    def loglik_curvature(self, score: Column) -> Column:
        """Second derivative of the log-likelihood by theta."""
        q = F.when(score == 1, self.p).otherwise(1 - self.p)
        sign = F.when(score == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return sign * self.curve / q - (self.slope / q) * (self.slope / q)
