"""Maximum a posteriori fit of the response model by block-coordinate Fisher scoring.

The table of answers is counted once by person, item and covariates. A sweep then updates abilities
(one aggregation by person and scale), item parameters (one by item, each a 4 x 4 system solved where
its row is), and estimated means. Covariate effects, and the means that go with them, take a joint step with the
parameters they are added to: each person's or item's own system is eliminated (Schur complement), a small system of
sums is solved in the driver, and its solution goes back into each system. In turn they would hardly move, as a shift of all
parameters along a covariate changes nothing but their priors. Beyond LOCAL counted answers, person
and item parameters stay distributed tables and only sums over everything come to the driver; each sweep's
tables are written to the shared folder, so lineage does not grow and a lost executor costs one step. Up to
LOCAL the same sweeps run on arrays in the driver, as a fit to the tolerance can take hundreds of them.

Beyond JOINT counted answers, fits to the tolerance that have no more than JOINT_SIZE item parameters and only what joint.py knows
(no covariates of persons, effects of each item, integration, careful or empirical priors) take joint Newton steps instead: the same
objective in some tens of passes.

In fits to the tolerance, steps of a person or an item that turn back are halved (and grow again later):
with asymptotes, undamped scoring can go round in circles.

If both means are estimated and no ability or difficulty is fixed, the posterior does not depend on a
constant added to all of both: the grand mean of the abilities is moved to zero in every sweep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raschmill.config import IrtConfig, Priors, ResponseSchema
from raschmill.functions.links import inv_logit, lower_asymptote, softplus, upper_asymptote
from raschmill.functions.model import TINY, Terms
from raschmill.operators import joint
from raschmill.operators.moments import ability_correlations, ability_priors_from_fixed, empirical_moments, priors_from_fixed
from raschmill.operators.normalise import normalise
from raschmill.operators.prep import ability_setup, drop_perfect_scores, item_setup, require_complete, restrict
from raschmill.operators.scoring import gauss_hermite, probabilities, with_parameters
from raschmill.storage import cut, drop

RAW = ("a", "b", "c", "d")
NATURAL = {"a": "A", "b": "B", "c": "C", "d": "D"}
#: Largest change of a parameter in one sweep.
LIMIT = 1.0
#: Least share of its step that a person or item takes after turning back again and again.
LEAST = 1 / 64
#: Product of two steps from which on, below zero, the second turns back; rounding does not count.
TURN = 1e-10
#: Counted answers, and abilities, up to which the sweeps run in the driver.
LOCAL = 1_000_000
#: Counted answers beyond which, and item parameters up to which, fits to the tolerance take joint steps.
JOINT, JOINT_SIZE = LOCAL, 600
#: Length of the first joint step, and the most.
REACH, FARTHEST = 3.0, 50.0
#: Root of the curvature, with as many answers as ANSWERS, from which on joint steps are measured in shorter units, and the least of these.
BEND, ANSWERS, NARROW = 10.0, 600_000, 0.02


@dataclass
class IrtModel:
    """A fit: natural item parameters, abilities by scale, effects of covariates, and how it went."""

    items: DataFrame
    persons: DataFrame
    effects: dict[str, dict[str, float]]
    objective: float
    sweeps: int
    converged: bool
    raw_items: DataFrame
    responses: DataFrame
    history: list[float] = field(default_factory=list)
    #: parameter, Scale (of abilities), Item (of its own effects), covariate, beta, linearised (on the natural parameter), standardised.
    covariate_effects: DataFrame | None = None

    def predict(self, responses: DataFrame | None = None) -> DataFrame:
        """p, p_observed and loglik of answers under the final parameters."""
        return probabilities(with_parameters(self.responses if responses is None else responses, self.items, self.persons))


def _effect(kind: str, preds: tuple[str, ...], betas: dict[str, dict[str, float]]) -> Column | None:
    total = None
    for x in preds:
        if b := betas.get(kind, {}).get(x, 0.0):
            total = b * F.col(x) if total is None else total + b * F.col(x)
    return total


def _own(k: str, x: str) -> str:
    """Column of an item's own effect."""
    return f"beta_{k}_{x}"


def _natural(raw: dict[str, Column]) -> dict[str, Column]:
    """Fixed values are used as they are, free ones go through their link."""
    f = lambda k: F.col(f"fixed_{k}")
    return {
        "a": F.when(f("a"), F.col("a")).otherwise(softplus(raw["a"])),
        "b": F.when(f("b"), F.col("b")).otherwise(raw["b"]),
        "c": F.when(f("c"), F.col("c")).otherwise(lower_asymptote(raw["c"])),
        "d": F.when(f("d"), F.col("d")).otherwise(upper_asymptote(raw["d"])),
    }


class _Fit:
    def __init__(self, cells: DataFrame, items: DataFrame, theta: DataFrame, scales: list[str], config: IrtConfig):
        self.cells, self.items, self.theta, self.scales, self.config = cells, items, theta, scales, config
        self.betas: dict[str, dict[str, float]] = {}
        self.priors = config.priors
        self.preds = {"a": config.a_preds, "b": config.b_preds, "c": config.c_preds, "d": config.d_preds}
        flags = items.agg(*[F.count_if(~F.col(f"fixed_{k}")).alias(k) for k in RAW], F.count_if(F.col("fixed_b")).alias("b_fixed")).first()
        self.free = {k: flags[k] > 0 for k in RAW}
        self.anchored = flags["b_fixed"] > 0 or theta.where("fixed").limit(1).count() > 0
        self.means: dict[str, float] = {}
        self.history: list[float] = []
        self.damped = True
        self.nodes = list(zip(*gauss_hermite(config.integrate_points))) if config.integrate_points else [(0.0, 1.0)]
        sd = F.when(F.col("fixed"), 0.0).otherwise(float(config.integrate_sd or 0.0))
        self.theta = theta.withColumns({"t_step": F.lit(0.0), "t_rate": F.lit(1.0), "sd": sd})
        self.partly = bool(config.priors.ability_corr or len(scales) > 1) and theta.where("fixed").limit(1).count() > 0
        self.items = items = items.withColumns({**{f"step_{k}": F.lit(0.0) for k in RAW}, "rate": F.lit(1.0)})

        if config.item_specific_betas:
            self.items = items.withColumns({_own(k, x): F.lit(0.0) for k in RAW for x in self.preds[k]})

    def item_effect(self, k: str) -> Column | None:
        """Sum of covariates times their effects on a raw item parameter; None without any."""
        if not self.config.item_specific_betas:
            return _effect(k, self.preds[k], self.betas)
        total = None
        for x in self.preds[k]:
            total = F.col(_own(k, x)) * F.col(x) if total is None else total + F.col(_own(k, x)) * F.col(x)
        return total

    # ---- the model's rows

    def rows(self) -> DataFrame:
        """Counted answers with natural parameters A, B, C, D, th, and derivatives of P by the raw ones."""
        r = self.cells.join(self.items, "Item").join(self.theta.withColumnRenamed("fixed", "fixed_t"), ["id", "Scale"])
        raw = {k: F.col(k) if (e := self.item_effect(k)) is None else F.col(k) + e for k in RAW}
        shift = F.lit(0.0)
        for s in self.scales:
            e = _effect(f"ability:{s}", self.config.person_preds, self.betas)
            if e is not None:
                shift = F.when(F.col("Scale") == s, e).otherwise(shift)
        r = r.select("*", *[v.alias(f"raw_{k}") for k, v in raw.items()], F.when(F.col("fixed_t"), F.col("ability")).otherwise(F.col("ability") + shift).alias("th"))
        nat = _natural({k: F.col(f"raw_{k}") for k in RAW})
        r = r.select("*", *[v.alias(f"n{NATURAL[k]}") for k, v in nat.items()])
        half = lambda k: 0.5 * inv_logit(F.col(f"raw_{k}")) * (1 - inv_logit(F.col(f"raw_{k}")))
        u = {k: F.lit(0.0) for k in ("P", "t", *RAW)}
        for x, weight in self.nodes:  # one, at the ability, unless the likelihood is integrated
            th = F.col("th") + x * F.col("sd") if x else F.col("th")
            sg = Terms(th, *[F.col(c) for c in ("nA", "nB", "nC", "nD")]).s
            bell = (F.col("nD") - F.col("nC")) * sg * (1 - sg)
            own = {
                "P": F.col("nC") + (F.col("nD") - F.col("nC")) * sg,
                "t": bell * F.col("nA"),
                "a": bell * (th - F.col("nB")) * inv_logit(F.col("raw_a")),
                "b": -bell * F.col("nA"),
                "c": (1 - sg) * half("c"),
                "d": sg * half("d"),
            }
            u = {k: v + weight * own[k] for k, v in u.items()}
        r = r.withColumn("P", F.greatest(F.least(u.pop("P"), F.lit(1 - 1e-12)), F.lit(1e-12)))
        r = r.select("*", *[F.when(F.col(f"fixed_{k}"), 0.0).otherwise(v).alias(f"u_{k}") for k, v in u.items()])
        pq = F.col("P") * (1 - F.col("P"))
        return r.withColumn("r", (F.col("s") - F.col("n") * F.col("P")) / pq).withColumn("w", F.col("n") / pq)

    # ---- priors

    def _sd(self, name: str) -> float:
        return getattr(self.priors, f"{name}_sd")

    def _mean(self, name: str) -> float:
        return self.means.get(name, getattr(self.priors, f"{name}_mean"))

    def _by_scale(self, what: str) -> Column:
        p = self.priors
        named, default = (p.ability_mean, p.default_mean) if what == "mean" else (p.ability_sd, p.default_sd)
        out = F.lit(float(default))
        for s in self.scales:
            v = self.means.get(f"ability:{s}", named.get(str(s), default)) if what == "mean" else named.get(str(s), default)
            out = F.when(F.col("Scale") == s, F.lit(float(v))).otherwise(out)
        return out

    def _covariance(self) -> np.ndarray:
        """Of abilities over the scales, as the prior has it."""
        p, k = self.priors, len(self.scales)
        corr = np.array([[1.0 if i == j else p.ability_corr.get((str(self.scales[i]), str(self.scales[j])), 0.0) for j in range(k)] for i in range(k)])
        sd = np.array([p.ability_sd.get(str(s), p.default_sd) for s in self.scales])
        return corr * np.outer(sd, sd) + (1e-6 * np.eye(k) if k > 1 else 0)

    def _precision(self, free: list[bool]) -> np.ndarray:
        """Of the free abilities of a person, in their own margin of the prior; 0 in the rows of fixed ones."""
        at = np.flatnonzero(free)
        out = np.zeros((len(free), len(free)))
        if len(at):
            out[np.ix_(at, at)] = np.linalg.inv(self._covariance()[np.ix_(at, at)])
        return out

    def _prior_pull(self) -> DataFrame:
        """id, Scale, pull (gradient of the ability prior), hold (its information)."""
        dev = self.theta.select("id", "Scale", (F.col("ability") - self._by_scale("mean")).alias("dev"))
        if not self.priors.ability_corr:
            sd = self._by_scale("sd")
            return dev.select("id", "Scale", (-F.col("dev") / (sd * sd)).alias("pull"), (1 / (sd * sd)).alias("hold"))
        bit = F.lit(0)
        for n, s in enumerate(self.scales):
            bit = F.when(F.col("Scale") == s, 1 << n).otherwise(bit)
        dev = self.theta.select("id", "Scale", (F.col("ability") - self._by_scale("mean")).alias("dev"), "fixed")
        masks = [(1 << len(self.scales)) - 1]
        dev = dev.withColumn("mask", F.lit(masks[0]))
        if self.partly:  # which scales of a person are free; few rows each
            dev = dev.withColumn("mask", F.sum(F.when(~F.col("fixed"), bit).otherwise(0)).over(Window.partitionBy("id")).cast("int"))
            masks = [r[0] for r in dev.select("mask").distinct().collect()]
        pairs = []
        for mask in masks:
            q = self._precision([bool(mask >> n & 1) for n in range(len(self.scales))])
            pairs += [(mask, s, o, float(q[i, j])) for i, s in enumerate(self.scales) for j, o in enumerate(self.scales)]
        kind = self.theta.schema["Scale"].dataType.simpleString()
        side = F.broadcast(self.theta.sparkSession.createDataFrame(pairs, f"mask int, Scale {kind}, other {kind}, q double"))  # scales squared for each pattern that occurs
        rows = dev.withColumnRenamed("Scale", "other").join(side, ["mask", "other"])
        hold = F.sum(F.when(F.col("Scale") == F.col("other"), F.col("q")))
        return rows.groupBy("id", "Scale").agg((-F.sum(F.col("q") * F.col("dev"))).alias("pull"), F.when(hold > 0, hold).otherwise(1.0).alias("hold"))

    # ---- steps

    def step_abilities(self) -> None:
        preds = self.config.person_preds
        info = F.col("w") * F.col("u_t") * F.col("u_t")
        aggs = [F.sum(F.col("r") * F.col("u_t")).alias("g"), F.sum(info).alias("i")]
        for n, x in enumerate(preds):
            aggs += [F.sum(info * F.col(x)).alias(f"c{n}"), F.sum(F.col("r") * F.col("u_t") * F.col(x)).alias(f"gb{n}")]
            aggs += [F.sum(info * F.col(x) * F.col(y)).alias(f"hb{n}_{m}") for m, y in enumerate(preds[: n + 1])]
        sums = self.rows().groupBy("id", "Scale").agg(*aggs)
        t = self.theta.join(sums, ["id", "Scale"], "left")
        t = t.na.fill(0.0, [c for c in sums.columns if c not in ("id", "Scale")])
        if self.config.use_priors:
            t = t.join(self._prior_pull(), ["id", "Scale"]).withColumns({"g": F.col("g") + F.col("pull"), "i": F.col("i") + F.col("hold")})
        else:
            t = t.withColumn("i", F.col("i") + 1e-6)
        rest = F.col("g")
        if preds:
            t = cut(t)
            mean = self._joint_mean()
            own = [F.col(f"c{n}") for n in range(len(preds))] + [-F.col("hold")] * mean
            sums = [F.sum(-x * F.col("g") / F.col("i")).alias(f"v{n}") for n, x in enumerate(own)]
            sums += [F.sum(-x * y / F.col("i")).alias(f"s{n}_{m}") for n, x in enumerate(own) for m, y in enumerate(own[: n + 1])]
            sums += [F.sum(f"gb{n}").alias(f"gb{n}") for n in range(len(preds))] + [F.sum(f"hb{n}_{m}").alias(f"hb{n}_{m}") for n in range(len(preds)) for m in range(n + 1)]
            sums += [F.sum("hold").alias("held"), F.sum("pull").alias("pulled")] * mean
            for r in t.where("not fixed").groupBy("Scale").agg(*sums).collect():
                k = len(preds)
                hb, gb = np.zeros((k + mean, k + mean)), np.zeros(k + mean)
                for n in range(k + mean):
                    gb[n] = r[f"v{n}"] + (r[f"gb{n}"] if n < k else -r["pulled"])
                    for m in range(n + 1):
                        hb[n, m] = hb[m, n] = r[f"s{n}_{m}"] + (r[f"hb{n}_{m}"] if n < k else r["held"] if m == n else 0.0)
                step = self._effects_step([(f"ability:{r['Scale']}", x) for x in preds], hb, gb)
                rest = F.when(F.col("Scale") == r["Scale"], F.col("g") - sum((float(d) * c for d, c in zip(step, own)), F.lit(0.0))).otherwise(rest)
        change = F.greatest(F.least(rest / F.col("i"), F.lit(LIMIT)), F.lit(-LIMIT))
        t = t.withColumn("change", change)
        rate = F.when(F.col("change") * F.col("t_step") < -TURN, F.greatest(F.col("t_rate") / 2, F.lit(LEAST))).otherwise(F.least(F.col("t_rate") * 1.5, F.lit(1.0))) if self.damped else F.col("t_rate")
        t = t.withColumn("t_rate", rate)
        self.theta = cut(t.select("id", "Scale", F.when(F.col("fixed"), F.col("ability")).otherwise(F.col("ability") + F.col("t_rate") * F.col("change")).alias("ability"), "fixed", F.col("change").alias("t_step"), "t_rate", "sd"))

    def step_sds(self) -> None:
        """Deviations for the integral: from the curvature of the likelihood at the abilities, no more than the prior's."""
        t = Terms(*[F.col(c) for c in ("th", "nA", "nB", "nC", "nD")])
        curve = F.col("s") * t.loglik_curvature(F.lit(1)) + (F.col("n") - F.col("s")) * t.loglik_curvature(F.lit(0))
        k = self.rows().groupBy("id", "Scale").agg(F.sum(curve).alias("k"))
        sd = F.least(F.sqrt(1 / F.abs(F.when(F.col("k") != 0, F.col("k")))), self._by_scale("sd"))
        t = self.theta.drop("sd").join(k, ["id", "Scale"], "left").withColumn("sd", F.when(F.col("fixed"), 0.0).otherwise(F.coalesce(sd, F.lit(0.0))))
        self.theta = cut(t.select(*self.theta.columns))

    def _joint_mean(self) -> bool:
        return self.config.use_priors and "ability" in self.config.est_means

    def _effects_step(self, names: list[tuple[str, str]], hb: np.ndarray, gb: np.ndarray) -> np.ndarray:
        """The joint step of effects (and means behind them), after the parameters are eliminated; effects move by it."""
        k, hold = len(names), 1 / self.priors.beta_sd**2 if self.config.use_priors else 0.0
        now = np.array([self.betas.get(kind, {}).get(x, 0.0) for kind, x in names])
        hb, gb = hb + 1e-6 * np.eye(len(gb)), gb.copy()
        hb[range(k), range(k)] += hold
        gb[:k] -= hold * now
        step = np.clip(np.linalg.solve(hb, gb), -LIMIT, LIMIT)
        for (kind, x), v, d in zip(names, now, step):
            self.betas.setdefault(kind, {})[x] = float(v + d)
        return step

    def _item_effects(self) -> list[tuple[str, str]]:
        return [] if self.config.item_specific_betas else [(k, x) for k in RAW for x in self.preds[k] if self.free[k]]

    def _item_means(self, live: list[str]) -> list[str]:
        """Parameters whose estimated mean takes the joint step."""
        return [k for k in live if self.config.use_priors and NATURAL[k] in self.config.est_means and self.preds[k]] if self._item_effects() else []

    def step_items(self) -> None:
        if not any(self.free.values()):
            return
        live, names = [k for k in RAW if self.free[k]], self._item_effects()
        aggs = [F.sum(F.col("r") * F.col(f"u_{k}")).alias(f"g_{k}") for k in live]
        aggs += [F.sum(F.col("w") * F.col(f"u_{x}") * F.col(f"u_{y}")).alias(f"i_{x}{y}") for n, x in enumerate(live) for y in live[n:]]
        for n, (k, x) in enumerate(names):
            aggs += [F.sum(F.col("r") * F.col(f"u_{k}") * F.col(x)).alias(f"gb{n}")] + [F.sum(F.col("w") * F.col(f"u_{y}") * F.col(f"u_{k}") * F.col(x)).alias(f"c_{y}{n}") for y in live]
            aggs += [F.sum(F.col("w") * F.col(f"u_{k}") * F.col(f"u_{j}") * F.col(x) * F.col(y)).alias(f"hb{n}_{m}") for m, (j, y) in enumerate(names[: n + 1])]
        sums = self.rows().groupBy("Item").agg(*aggs)
        joined = self.items.join(sums, "Item", "left").na.fill(0.0, [c for c in sums.columns if c != "Item"])
        system = _System(live, self.config.use_priors, [self._sd(k) for k in live], [self._mean(k) for k in live], self.damped, names, self._item_means(live))
        step = None
        if names:
            joined = cut(joined)
            size = len(names) + len(system.means)

            def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    hb, gb = system.eliminated(f)
                    yield pd.DataFrame([[*hb.ravel(), *gb]], columns=parts)

            parts = [f"p{n}" for n in range(size * size + size)]
            got = joined.mapInPandas(partial, ", ".join(f"{x} double" for x in parts)).agg(*[F.sum(x).alias(x) for x in parts]).first()
            flat = np.array([got[x] for x in parts])
            step = self._effects_step(names, flat[: size * size].reshape(size, size), flat[size * size :])

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield system.move(f, step)[columns]

        columns = self.items.columns
        self.items = cut(joined.mapInPandas(solve, self.items.schema))
        if self.config.item_specific_betas and self.config.item_preds:
            self.step_own_betas()

    def step_own_betas(self) -> None:
        """One effect for each item and covariate: a scoring step for each by itself."""
        pairs = [(k, x) for k in RAW for x in self.preds[k] if self.free[k]]
        hold = 1 / self.priors.beta_sd**2 if self.config.use_priors else 0.0
        aggs = []
        for i, (k, x) in enumerate(pairs):
            aggs += [F.sum(F.col("r") * F.col(f"u_{k}") * F.col(x)).alias(f"g{i}"), F.sum(F.col("w") * F.pow(F.col(f"u_{k}") * F.col(x), 2)).alias(f"h{i}")]
        t = self.items.join(self.rows().groupBy("Item").agg(*aggs), "Item", "left").na.fill(0.0, [f"{c}{i}" for i in range(len(pairs)) for c in "gh"])
        new = {}
        for i, (k, x) in enumerate(pairs):
            b = F.col(_own(k, x))
            new[_own(k, x)] = b + F.greatest(F.least((F.col(f"g{i}") - b * hold) / (F.col(f"h{i}") + hold + 1e-6), F.lit(LIMIT)), F.lit(-LIMIT))
        self.items = cut(t.withColumns(new).select(*self.items.columns))

    def step_means(self) -> None:
        """Estimated means are the averages of their elements; then the location."""
        by = {r["Scale"]: r for r in self.theta.groupBy("Scale").agg(F.avg(F.when(~F.col("fixed"), F.col("ability"))).alias("m"), F.sum("ability").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
        own = self.items.agg(*[F.avg(F.when(~F.col(f"fixed_{k}"), F.col(k))).alias(k) for k in RAW]).first()
        centre = 0.0
        if not self.anchored and {"ability", "B"} <= set(self.config.est_means):
            centre = sum(r["t"] for r in by.values()) / max(1, sum(r["n"] for r in by.values()))
            self.theta = self.theta.withColumn("ability", F.col("ability") - centre)
            self.items = self.items.withColumn("b", F.col("b") - centre)
        if "ability" in self.config.est_means:
            self.means |= {f"ability:{s}": r["m"] - centre for s, r in by.items() if r["m"] is not None}
        for k in RAW:
            if NATURAL[k] in self.config.est_means and own[k] is not None:
                self.means[k] = own[k] - (centre if k == "b" else 0.0)

    def objective(self) -> float:
        q = self.rows().agg(F.sum(F.col("s") * F.ln(F.col("P") + TINY) + (F.col("n") - F.col("s")) * F.ln(1 - F.col("P") + TINY))).first()[0] or 0.0
        if not self.config.use_priors:
            return q
        dens = lambda v, m, s: -0.5 * F.pow((v - m) / s, 2)
        if self.priors.ability_corr:
            t = self.theta.join(self._prior_pull(), ["id", "Scale"])
            q += t.agg(F.sum(0.5 * F.col("pull") * (F.col("ability") - self._by_scale("mean")))).first()[0] or 0.0
        else:
            q += self.theta.where("not fixed").agg(F.sum(dens(F.col("ability"), self._by_scale("mean"), self._by_scale("sd")))).first()[0] or 0.0
        got = self.items.agg(*[F.sum(F.when(~F.col(f"fixed_{k}"), dens(F.col(k), self._mean(k), self._sd(k)))).alias(k) for k in RAW]).first()
        q += sum(got[k] or 0.0 for k in RAW)
        if self.config.item_specific_betas and self.config.item_preds:
            own = [F.sum(F.pow(F.col(_own(k, x)), 2)) for k in RAW for x in self.preds[k]]
            q -= 0.5 * sum(v or 0.0 for v in self.items.agg(*own).first()) / self.priors.beta_sd**2
        return q - 0.5 * sum((b / self.priors.beta_sd) ** 2 for v in self.betas.values() for b in v.values())

    def tables(self) -> None:
        """items and theta are tables that stand as they are."""

    def sweep(self) -> None:
        if self.config.integrate_points and self.config.integrate_sd is None:
            self.step_sds()
        self.step_abilities()
        self.step_items()
        self.step_means()

    def run(self, sweeps: int, tol: float) -> bool:
        last = None
        for _ in range(sweeps):
            self.sweep()
            now = self.objective()
            if not math.isfinite(now):
                raise ArithmeticError("the objective is not finite")
            self.history.append(now)
            if last is not None and abs(now - last) < tol:
                return True
            last = now
        return False


class _System:
    """The scoring steps of items that carry their sums g_x, i_xy, and those with covariates c_xn, gbn, hbn_m."""

    def __init__(self, live: list[str], use: bool, sds: list[float], mus: list[float], damped: bool, names: list[tuple[str, str]], means: list[str]):
        self.live, self.use, self.sds, self.mus, self.damped, self.names, self.means = live, use, np.array(sds), np.array(mus), damped, names, means

    def own(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """value, gradient, information, what is fixed, and information with effects and means, of each item."""
        k, live = len(self.live), self.live
        value = f[live].to_numpy(float)
        g = f[[f"g_{x}" for x in live]].to_numpy(float).copy()
        h = np.zeros((len(f), k, k))
        for n, x in enumerate(live):
            for m in range(n, k):
                h[:, n, m] = h[:, m, n] = f[f"i_{x}{live[m]}"]
        fixed = f[[f"fixed_{x}" for x in live]].to_numpy(bool)
        c = np.zeros((len(f), k, len(self.names) + len(self.means)))
        for n in range(len(self.names)):
            c[:, :, n] = f[[f"c_{x}{n}" for x in live]].to_numpy(float)
        if self.use:
            g = g - (value - self.mus) / np.square(self.sds)
            h[:, range(k), range(k)] += 1 / np.square(self.sds)
            for n, x in enumerate(self.means, len(self.names)):
                c[:, live.index(x), n] = -1 / self.sds[live.index(x)] ** 2
        h[:, range(k), range(k)] += 1e-6
        g[fixed] = 0
        c[np.repeat(fixed[:, :, None], c.shape[2], 2)] = 0
        h[np.repeat(fixed[:, :, None], k, 2) | np.repeat(fixed[:, None, :], k, 1)] = 0
        h[:, range(k), range(k)] += fixed
        return value, g, h, fixed, c

    def eliminated(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """What these items add to the system of effects and means."""
        value, g, h, fixed, c = self.own(f)
        size = c.shape[2]
        solved = np.linalg.solve(h, np.concatenate((c, g[:, :, None]), axis=2))
        hb, gb = -np.einsum("nkm,nkl->ml", c, solved[:, :, :-1]), -np.einsum("nkm,nk->m", c, solved[:, :, -1])
        for n in range(len(self.names)):
            gb[n] += f[f"gb{n}"].sum()
            for m in range(n + 1):
                x = f[f"hb{n}_{m}"].sum()
                hb[n, m] += x
                if m < n:
                    hb[m, n] += x
        for n, x in enumerate(self.means, len(self.names)):
            at = self.live.index(x)
            free = ~fixed[:, at]
            hb[n, n] += free.sum() / self.sds[at] ** 2
            gb[n] += ((value[:, at] - self.mus[at])[free]).sum() / self.sds[at] ** 2
        return hb.reshape(size, size), gb

    def move(self, f: pd.DataFrame, step_of_effects: np.ndarray | None = None) -> pd.DataFrame:
        live = self.live
        value, g, h, fixed, c = self.own(f)
        if step_of_effects is not None:
            g = g - c @ step_of_effects
        step = np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -LIMIT, LIMIT)
        f = f.copy()
        if self.damped:
            last, rate = f[[f"step_{x}" for x in live]].to_numpy(float), f["rate"].to_numpy(float)
            f["rate"] = np.where((step * last).sum(1) < -TURN, np.maximum(rate / 2, LEAST), np.minimum(rate * 1.5, 1.0))
        f[[f"step_{x}" for x in live]] = step
        f[live] = np.where(fixed, value, value + f[["rate"]].to_numpy(float) * step)
        return f


class _LocalFit(_Fit):
    """The same sweeps on arrays in the driver; persons, items and answers are in the order of their keys."""

    def __init__(self, cells: DataFrame, items: DataFrame, theta: DataFrame, scales: list[str], config: IrtConfig):
        super().__init__(cells, items, theta, scales, config)
        self.t = self.theta.toPandas().sort_values(["id", "Scale"], ignore_index=True)
        self.i = self.items.toPandas().sort_values("Item", ignore_index=True)
        c = cells.toPandas().sort_values(["id", "Scale", "Item", *config.preds], ignore_index=True)
        self.at_t = pd.MultiIndex.from_frame(self.t[["id", "Scale"]]).get_indexer(pd.MultiIndex.from_frame(c[["id", "Scale"]]))
        self.at_i = pd.Index(self.i["Item"]).get_indexer(c["Item"])
        place = {s: n for n, s in enumerate(scales)}
        self.scale_t = self.t["Scale"].map(place).to_numpy()
        self.scale = self.scale_t[self.at_t]
        self.n, self.s = c["n"].to_numpy(float), c["s"].to_numpy(float)
        self.x = {x: c[x].to_numpy(float) for x in config.preds}

    def tables(self) -> None:
        spark = self.cells.sparkSession
        made = [cut(spark.createDataFrame(list(f[d.columns].itertuples(index=False, name=None)), d.schema)) for f, d in ((self.t, self.theta), (self.i, self.items))]
        self.theta, self.items = made

    def answers(self) -> dict[str, np.ndarray]:
        """P, r, w and the derivatives u_ of every counted answer."""
        raw, own, fixed = {}, {}, {k: self.i[f"fixed_{k}"].to_numpy(bool)[self.at_i] for k in RAW}
        for k in RAW:
            own[k] = self.i[k].to_numpy(float)[self.at_i]
            raw[k] = own[k] + sum((b * self.x[x] for x, b in self.betas.get(k, {}).items()), 0.0)
        shift = np.zeros(len(self.n))
        for n, s in enumerate(self.scales):
            for x, b in self.betas.get(f"ability:{s}", {}).items():
                shift += np.where(self.scale == n, b * self.x[x], 0.0)
        still = self.t["fixed"].to_numpy(bool)[self.at_t]
        th = self.t["ability"].to_numpy(float)[self.at_t] + np.where(still, 0.0, shift)
        sig = {k: _sigmoid(raw[k]) for k in "acd"}
        A = np.where(fixed["a"], own["a"], np.logaddexp(0, raw["a"]))
        B = np.where(fixed["b"], own["b"], raw["b"])
        C = np.where(fixed["c"], own["c"], 0.5 * sig["c"])
        D = np.where(fixed["d"], own["d"], 0.5 + 0.5 * sig["d"])
        half = {k: 0.5 * sig[k] * (1 - sig[k]) for k in "cd"}
        sd = self.t["sd"].to_numpy(float)[self.at_t]
        out = dict.fromkeys(("u_a", "u_b", "u_c", "u_d", "u_t", "P"), 0.0)
        for x, weight in self.nodes:
            t = th + x * sd
            sg = _sigmoid(A * (t - B))
            bell = (D - C) * sg * (1 - sg)
            own = {"u_a": bell * (t - B) * sig["a"], "u_b": -bell * A, "u_c": (1 - sg) * half["c"], "u_d": sg * half["d"], "u_t": bell * A, "P": C + (D - C) * sg}
            out = {k: v + weight * own[k] for k, v in out.items()}
        P = np.clip(out.pop("P"), 1e-12, 1 - 1e-12)
        out = {u: np.where(still if u == "u_t" else fixed[u[-1]], 0.0, v) for u, v in out.items()}
        pq = P * (1 - P)
        return out | {"P": P, "r": (self.s - self.n * P) / pq, "w": self.n / pq, "natural": (th, A, B, C, D)}

    def step_sds(self) -> None:
        th, A, B, C, D = self.answers()["natural"]
        sg = _sigmoid(A * (th - B))
        p = np.clip(C + (D - C) * sg, 1e-300, 1.0)
        q = np.maximum(1 - p, 1e-300)
        first, second = A * (D - C) * sg * (1 - sg), A * A * (D - C) * sg * (1 - sg) * (1 - 2 * sg)
        curve = self.s * (second / p - (first / p) ** 2) + (self.n - self.s) * (-second / q - (first / q) ** 2)
        k = np.bincount(self.at_t, curve, len(self.t))
        most = np.array([self.priors.ability_sd.get(str(s), self.priors.default_sd) for s in self.scales], float)[self.scale_t]
        sd = np.where(k != 0, np.minimum(np.sqrt(1 / np.abs(np.where(k != 0, k, 1.0))), most), 0.0)
        self.t = self.t.assign(sd=np.where(self.t["fixed"].to_numpy(bool), 0.0, sd))

    def deviation(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the abilities from their means, with pull and hold of the prior."""
        p = self.priors
        mean = np.array([self.means.get(f"ability:{s}", p.ability_mean.get(str(s), p.default_mean)) for s in self.scales], float)
        dev = self.t["ability"].to_numpy(float) - mean[self.scale_t]
        if not p.ability_corr:
            sd = np.array([p.ability_sd.get(str(s), p.default_sd) for s in self.scales], float)[self.scale_t]
            return dev, -dev / sd**2, 1 / sd**2
        k = len(self.scales)  # every person has a row for each scale
        free = ~self.t["fixed"].to_numpy(bool).reshape(-1, k)
        by, pull, hold = dev.reshape(-1, k), np.zeros((len(dev) // k, k)), np.ones((len(dev) // k, k))
        for own in np.unique(free, axis=0):
            here, q = (free == own).all(axis=1), self._precision(own.tolist())
            pull[here], hold[here] = -(by[here] @ q), np.where(np.diag(q) > 0, np.diag(q), 1.0)
        return dev, pull.ravel(), hold.ravel()

    def step_abilities(self) -> None:
        m, k = self.answers(), len(self.t)
        g, i = np.bincount(self.at_t, m["r"] * m["u_t"], k), np.bincount(self.at_t, m["w"] * m["u_t"] ** 2, k)
        if self.config.use_priors:
            _, pull, hold = self.deviation()
            g, i = g + pull, i + hold
        else:
            i = i + 1e-6
        preds, free = self.config.person_preds, ~self.t["fixed"].to_numpy(bool)
        if preds:
            mean, g = self._joint_mean(), g.copy()
            for n, scale in enumerate(self.scales):
                here, own = self.scale == n, np.flatnonzero((self.scale_t == n) & free)
                x = np.stack([self.x[p][here] for p in preds], 1)
                info = (m["w"] * m["u_t"] ** 2)[here]
                c = np.stack([np.bincount(self.at_t[here], info * x[:, j], k) for j in range(len(preds))], 1)[own]
                hb, gb = x.T @ (x * info[:, None]), x.T @ (m["r"] * m["u_t"])[here]
                if mean:
                    c = np.column_stack((c, -hold[own]))
                    hb = np.pad(hb, ((0, 1), (0, 1)))
                    hb[-1, -1], gb = hold[own].sum(), np.append(gb, -pull[own].sum())
                hb, gb = hb - c.T @ (c / i[own][:, None]), gb - c.T @ (g[own] / i[own])
                g[own] -= c @ self._effects_step([(f"ability:{scale}", p) for p in preds], hb, gb)
        step, last, rate = np.clip(g / i, -LIMIT, LIMIT), self.t["t_step"].to_numpy(float), self.t["t_rate"].to_numpy(float)
        if self.damped:
            rate = np.where(step * last < -TURN, np.maximum(rate / 2, LEAST), np.minimum(rate * 1.5, 1.0))
        self.t = self.t.assign(ability=self.t["ability"] + np.where(self.t["fixed"], 0.0, rate * step), t_step=step, t_rate=rate)

    def step_items(self) -> None:
        live = [k for k in RAW if self.free[k]]
        if not live:
            return
        m, k = self.answers(), len(self.i)
        sums = {f"g_{x}": np.bincount(self.at_i, m["r"] * m[f"u_{x}"], k) for x in live}
        sums |= {f"i_{x}{y}": np.bincount(self.at_i, m["w"] * m[f"u_{x}"] * m[f"u_{y}"], k) for n, x in enumerate(live) for y in live[n:]}
        names = self._item_effects()
        for n, (j, x) in enumerate(names):
            sums[f"gb{n}"] = np.bincount(self.at_i, m["r"] * m[f"u_{j}"] * self.x[x], k)
            sums |= {f"c_{y}{n}": np.bincount(self.at_i, m["w"] * m[f"u_{y}"] * m[f"u_{j}"] * self.x[x], k) for y in live}
            sums |= {f"hb{n}_{q}": np.bincount(self.at_i, m["w"] * m[f"u_{j}"] * m[f"u_{l}"] * self.x[x] * self.x[y], k) for q, (l, y) in enumerate(names[: n + 1])}
        system = _System(live, self.config.use_priors, [self._sd(x) for x in live], [self._mean(x) for x in live], self.damped, names, self._item_means(live))
        f = self.i.assign(**sums)
        step = self._effects_step(names, *system.eliminated(f)) if names else None
        self.i = system.move(f, step)[self.i.columns]

    def step_means(self) -> None:
        centre = 0.0
        if not self.anchored and {"ability", "B"} <= set(self.config.est_means):
            centre = float(self.t["ability"].mean())
            self.t, self.i = self.t.assign(ability=self.t["ability"] - centre), self.i.assign(b=self.i["b"] - centre)
        if "ability" in self.config.est_means:
            free = self.t[~self.t["fixed"].to_numpy(bool)]
            self.means |= {f"ability:{s}": float(v) for s, v in free.groupby("Scale")["ability"].mean().items()}
        for k in RAW:
            free = self.i.loc[~self.i[f"fixed_{k}"].to_numpy(bool), k]
            if NATURAL[k] in self.config.est_means and len(free):
                self.means[k] = float(free.mean())

    def objective(self) -> float:
        P = self.answers()["P"]
        q = float((self.s * np.log(P + TINY) + (self.n - self.s) * np.log(1 - P + TINY)).sum())
        if not self.config.use_priors:
            return q
        dev, pull, _ = self.deviation()
        q += 0.5 * float((pull * dev * (True if self.priors.ability_corr else ~self.t["fixed"].to_numpy(bool))).sum())
        for k in RAW:
            free = self.i.loc[~self.i[f"fixed_{k}"].to_numpy(bool), k].to_numpy(float)
            q -= 0.5 * float((((free - self._mean(k)) / self._sd(k)) ** 2).sum())
        return q - 0.5 * sum((b / self.priors.beta_sd) ** 2 for v in self.betas.values() for b in v.values())


class _JointFit(_Fit):
    """The same objective by joint Newton steps: item parameters, effects and means in the driver, persons in blocks."""

    @staticmethod
    def fits(config: IrtConfig, priors: Priors, items: int) -> bool:
        plain = not (config.person_preds or config.item_specific_betas or config.integrate_points or config.careful or config.ebayes or priors.ability_corr)
        return plain and config.use_priors and items * 4 + len(config.item_preds) * 4 <= JOINT_SIZE

    def __init__(self, cells: DataFrame, items: DataFrame, theta: DataFrame, scales: list[str], config: IrtConfig, priors: Priors):
        super().__init__(cells, items, theta, scales, config)
        self.priors = p = priors
        self.rows_of_items = self.items.orderBy("Item").collect()
        of = lambda c, kind: np.array([r[c] for r in self.rows_of_items], kind)
        live, raw, fixed = [k for k in RAW if self.free[k]], {k: of(k, float) for k in RAW}, {k: of(f"fixed_{k}", bool) for k in RAW}
        mean = np.array([p.ability_mean.get(str(s), p.default_mean) for s in scales], float)
        sd = np.array([p.ability_sd.get(str(s), p.default_sd) for s in scales], float)
        self.table = joint.blocks(cells, theta, [r["Item"] for r in self.rows_of_items], scales, config.item_preds)
        self.answers = max(1, cells.agg(F.sum("n")).first()[0] or 0)
        self.few, self.state = theta.count() <= joint.SENT, self.table.select("block", "ability")
        self.point = joint.Point(raw, fixed, live, dict.fromkeys(self._item_effects(), 0.0), mean, sd, "ability" in config.est_means)
        #: Of a step: 1, and for an effect what moves a parameter by 1 over a deviation of its covariate.
        self.units = np.ones(self.point.size)
        if self.point.betas:
            spread = cells.agg(*[F.stddev_pop(x).alias(x) for x in config.item_preds]).first()
            self.units[len(self.rows_of_items) * len(live) :][: len(self.point.betas)] = [1 / spread[x] if spread[x] else 1.0 for _, x in self.point.betas]

    def evaluate(self, p: joint.Point, step: np.ndarray | None) -> tuple[DataFrame, float, np.ndarray, np.ndarray]:
        """A step from the last accepted pass: abilities; objective, gradient and negative second derivatives, with the priors of items and effects."""
        state, q, g, H = joint.evaluate(self.table, self.state, p, self.few, None if step is None else self.point, step)
        at, L = len(self.rows_of_items) * len(p.live), len(p.live)
        for m, k in enumerate(p.live):
            free, sd = np.flatnonzero(~p.fixed[k]), self._sd(k)
            own, value = free * L + m, p.raw[k][free]
            est = NATURAL[k] in self.config.est_means
            dev = value - (value.mean() if est else getattr(self.priors, f"{k}_mean"))  # an estimated mean is at its best, too
            q -= 0.5 * float((dev**2).sum()) / sd**2
            g[own] -= dev / sd**2
            H[np.ix_(own, own)] += (np.eye(len(free)) - (1 / len(free) if est else 0.0)) / sd**2
        for m, b in enumerate(p.betas.values(), at):
            q -= 0.5 * b**2 / self.priors.beta_sd**2
            g[m] -= b / self.priors.beta_sd**2
            H[m, m] += 1 / self.priors.beta_sd**2
        if not self.anchored and {"ability", "B"} <= set(self.config.est_means) and "b" in p.live:
            flat = np.zeros(p.size)  # a constant added to all difficulties and abilities
            flat[p.live.index("b") : at : L], flat[at + len(p.betas) :] = 1.0, 1.0
            H += np.outer(flat, flat) * max(1.0, float(np.abs(np.diag(H)).mean()))
        return state, q, g, H

    def scale(self, H: np.ndarray) -> np.ndarray:
        """Units of a step, shorter (no less than by NARROW) where answers bend the objective much: steep parameters have a narrow valley."""
        bend = np.sqrt(np.abs(np.diag(H)) * ANSWERS / self.answers) * self.units
        return self.units * np.clip((np.maximum(bend, 1e-9) / BEND) ** -0.5, NARROW, 1.0)

    def moved(self, p: joint.Point, step: np.ndarray) -> joint.Point:
        at, L = len(self.rows_of_items) * len(p.live), len(p.live)
        raw = p.raw | {k: np.where(p.fixed[k], p.raw[k], p.raw[k] + step[m:at:L]) for m, k in enumerate(p.live)}
        betas = {k: b + float(step[m]) for m, (k, b) in enumerate(p.betas.items(), at)}
        return replace(p, raw=raw, betas=betas, mu=p.mu + step[at + len(betas) :])

    def run(self, sweeps: int, tol: float) -> bool:
        """Steps within a reach that grows while the quadratic at hand foretells the gain, and shrinks where it does not."""
        best, trial, step, hoped, length, reach, done = None, self.point, None, math.inf, 0.0, REACH, False
        for _ in range(sweeps):
            state, q, g, H = self.evaluate(trial, step)
            if not math.isfinite(q):
                raise ArithmeticError("the objective is not finite")
            if best is None or q >= best[0] - 1e-13 * abs(q):
                change = math.inf if best is None else q - best[0]
                if best is not None and change > 0.75 * hoped and length > 0.8 * reach:
                    reach = min(2 * reach, FARTHEST)
                elif change < 0.25 * hoped and best is not None:
                    reach = length / 2
                best, self.point = (q, g, H), trial
                drop(self.state, self.table)
                self.state = state
                self.history.append(q)
                if abs(change) < tol and done:
                    return True
            else:
                drop(state, self.table)
                if done:  # rounding
                    self.history.append(best[0])
                    return True
                reach = length / 4
            step, hoped, length = joint.trusted_step(best[1], best[2], self.scale(best[2]), reach)
            trial, done = self.moved(self.point, step), hoped < tol and length < 0.99 * reach  # not cut short
        return False

    def tables(self) -> None:
        spark, p = self.cells.sparkSession, self.point
        theta = cut(joint.abilities(self.table, self.state, self.theta.schema, self.scales, self.few))
        centre = 0.0
        if not self.anchored and {"ability", "B"} <= set(self.config.est_means):
            centre = theta.agg(F.avg("ability")).first()[0] or 0.0
            theta = theta.withColumn("ability", F.col("ability") - centre)
        rows = [r.asDict() | {k: float(p.raw[k][n]) - (centre if k == "b" else 0.0) for k in RAW} for n, r in enumerate(self.rows_of_items)]
        self.items = cut(spark.createDataFrame([tuple(r[c] for c in self.items.columns) for r in rows], self.items.schema))
        self.theta = theta
        for (k, x), b in p.betas.items():
            self.betas.setdefault(k, {})[x] = b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _start(items: DataFrame, setup: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.col(n), F.lit({"a": 0.542, "b": 0.0, "c": -4.0, "d": 4.0}[k])).alias(k) for k, n in NATURAL.items()]
    return setup.select("Item", *cols, *[F.col(n).isNotNull().alias(f"fixed_{k}") for k, n in NATURAL.items()])


def fit_irt(responses: DataFrame, names: ResponseSchema | None = None, config: IrtConfig | None = None, fixed_items: DataFrame | None = None, fixed_persons: DataFrame | None = None, start_items: DataFrame | None = None, start_persons: DataFrame | None = None, fixed_sweeps: int | None = None) -> IrtModel:
    """Fit the model. With ``fixed_sweeps`` one stage of exactly so many sweeps runs, for comparisons.

    fixed_items: Item, A, B, C, D (nulls are free); fixed_persons: id and a column for each scale.
    start_items (Item, a, b, c, d raw) and start_persons (id, Scale, ability) are warm starts.
    """
    config, names = config or IrtConfig(), names or ResponseSchema()
    extra = (*config.preds, *((config.training,) if config.training else ()))
    data = cut(names.standard(responses, extra, cast=False))  # the joins behind the answers run once
    require_complete(data)
    data = data.withColumn("score", F.col("score").cast("int"))
    if config.drop_perfect_scores:
        data = drop_perfect_scores(data, tol=config.perfect_tol)
    data = cut(data)
    n_rows = data.count()
    used = data.where(F.col(config.training)) if config.training else data
    cells = cut(used.groupBy("id", "Scale", "Item", *config.preds).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")))
    scales = [r[0] for r in data.select("Scale").distinct().orderBy("Scale").collect()]
    item_keys, persons = data.select("Item").distinct(), data.select("id").distinct()
    if fixed_items is not None:
        fixed_items = restrict(fixed_items, data, "Item")
    if fixed_persons is not None:
        fixed_persons = restrict(fixed_persons, data, "id")
    items = _start(item_keys, item_setup(item_keys, config.pl, fixed_items))
    if start_items is not None:
        warm = start_items.select("Item", *[F.col(k).alias(f"w_{k}") for k in RAW])
        items = items.join(warm, "Item", "left").select("Item", *[F.when(F.col(f"fixed_{k}"), F.col(k)).otherwise(F.coalesce(f"w_{k}", k)).alias(k) for k in RAW], *[f"fixed_{k}" for k in RAW])
    theta = ability_setup(persons, scales, fixed_persons).select("id", "Scale", F.coalesce("ability", F.lit(0.0)).alias("ability"), F.col("ability").isNotNull().alias("fixed"))
    if start_persons is not None:
        warm = start_persons.select("id", "Scale", F.col("ability").alias("w"))
        theta = theta.join(warm, ["id", "Scale"], "left").select("id", "Scale", F.when(F.col("fixed"), F.col("ability")).otherwise(F.coalesce("w", "ability")).alias("ability"), "fixed")

    own = config.priors
    if config.priors_from_fixed and fixed_items is not None:
        m = priors_from_fixed(fixed_items, config.ebayes_multiplier).first().asDict()
        own = replace(own, **{k: v for k, v in m.items() if v is not None and math.isfinite(v)})
    if config.priors_from_fixed and fixed_persons is not None:
        long = theta.where("fixed").select("id", "Scale", "ability")
        mean, sd, corr = ability_priors_from_fixed(long, config.ebayes_multiplier)
        own = replace(own, ability_mean={**own.ability_mean, **mean}, ability_sd={**own.ability_sd, **sd}, ability_corr=corr)
    items, theta = cut(items), cut(theta)
    local = not config.item_specific_betas and cells.count() <= LOCAL and theta.count() <= LOCAL
    if fixed_sweeps is None and cells.count() > JOINT and _JointFit.fits(config, own, items.count()):
        f = _JointFit(cells, items, theta, scales, config, own)
    else:
        f = (_LocalFit if local else _Fit)(cells, items, theta, scales, config)
        f.priors = own
    tol = config.tol if config.tol is not None else 1e-8 * n_rows
    converged = True
    if fixed_sweeps is not None:
        f.damped = False
        for _ in range(fixed_sweeps):
            f.sweep()
        f.history.append(f.objective())
    else:
        if config.careful:
            f.priors = replace(own, a_sd=0.1, b_sd=1.0, c_sd=0.01, d_sd=0.01, default_sd=1.0, ability_sd={})
            converged = f.run(config.max_sweeps, tol * 100)
            f.priors = own
        converged = f.run(config.max_sweeps, tol * (10 if config.ebayes else 1)) and converged
        if config.ebayes:
            f.tables()
            f.priors = _empirical_priors(f, own)
            converged = f.run(config.max_sweeps, tol) and converged
    f.tables()
    return _finish(f, data, used, converged)


def _empirical_priors(f: _Fit, own: Priors) -> Priors:
    """Deviations (and correlations) of the parameters as they are, widened, without outliers."""
    out, mult = {}, f.config.ebayes_multiplier
    for k in RAW:
        if f.free[k]:
            m = empirical_moments(f.items.where(~F.col(f"fixed_{k}")), k, multiplier=mult).first()
            if m["sd"] is not None and math.isfinite(m["sd"]):
                out[f"{k}_sd"] = m["sd"]
    free = f.theta.where("not fixed")
    by = {str(r["Scale"]): r for r in empirical_moments(free, "ability", "Scale", multiplier=mult).collect()}
    out["ability_sd"] = {s: r["sd"] for s, r in by.items() if r["sd"] is not None and math.isfinite(r["sd"])}
    if len(f.scales) > 1:
        corr = {(str(r[0]), str(r[1])): r["corr"] for r in ability_correlations(f.theta).collect() if r["corr"] is not None and r[0] != r[1]}
        out["ability_corr"] = {k: max(-0.99, min(0.99, v)) for k, v in corr.items()}
    return replace(own, **out)


def linearised(f_link, raw_mean: float, beta: float, h: float = 0.01) -> float:
    """Effect of a covariate on the natural parameter: central difference of the link at the mean raw value."""
    return beta * (f_link(raw_mean + h) - f_link(raw_mean - h)) / (2 * h)


def _finish(f: _Fit, data: DataFrame, used: DataFrame, converged: bool) -> IrtModel:
    """Effects of mean covariates are added to raw parameters, then the links apply."""
    items, theta, config = f.items, f.theta, f.config
    if config.item_preds:
        items = items.join(data.groupBy("Item").agg(*[F.avg(x).alias(x) for x in config.item_preds]), "Item")
    raw = {k: F.col(k) if (e := f.item_effect(k)) is None else F.col(k) + e for k in RAW}
    natural = items.select("Item", *[v.alias(NATURAL[k]) for k, v in _natural(raw).items()])
    if config.person_preds and any(k.startswith("ability:") for k in f.betas):
        means = data.groupBy("id").agg(*[F.avg(x).alias(x) for x in config.person_preds])
        shift = F.lit(0.0)
        for s in f.scales:
            e = _effect(f"ability:{s}", config.person_preds, f.betas)
            if e is not None:
                shift = F.when(F.col("Scale") == s, e).otherwise(shift)
        theta = theta.join(means, "id").withColumn("ability", F.when(F.col("fixed"), F.col("ability")).otherwise(F.col("ability") + shift))
    persons = theta.select("id", "Scale", "ability")
    scale_of = data.groupBy("Item").agg(F.min("Scale").alias("Scale"))
    natural = natural.join(scale_of, "Item")
    if config.normalise:
        natural, persons = normalise(natural, persons, "Ability", config.normalise_scale, config.normalise_mean, by_scale=True)
    natural, persons = cut(natural), cut(persons)
    return IrtModel(natural, persons, f.betas, f.history[-1], len(f.history), converged, f.items, data, f.history, _effects_table(f, data, natural, persons))


def _effects_table(f: _Fit, data: DataFrame, natural: DataFrame, persons: DataFrame) -> DataFrame | None:
    """Effects as they are, on the natural parameter, and in deviations of covariate (over all answers) and parameter."""
    config, spark = f.config, data.sparkSession
    if not config.preds:
        return None
    sd_x = data.agg(*[F.stddev_samp(x).alias(x) for x in config.preds]).first()
    sd_par = natural.agg(*[F.stddev_samp(NATURAL[k]).alias(k) for k in RAW]).first()
    sd_ability = {r["Scale"]: r["s"] for r in persons.groupBy("Scale").agg(F.stddev_samp("ability").alias("s")).collect()}
    means = f.items.agg(*[F.avg(F.when(~F.col(f"fixed_{k}"), F.col(k))).alias(k) for k in RAW]).first()
    links = {"a": lambda x: float(np.logaddexp(0, x)), "b": lambda x: x, "c": lambda x: 0.5 * float(_sigmoid(np.float64(x))), "d": lambda x: 0.5 + 0.5 * float(_sigmoid(np.float64(x)))}
    kinds = {c: data.schema[c].dataType.simpleString() for c in ("Scale", "Item")}
    schema = f"parameter string, Scale {kinds['Scale']}, Item {kinds['Item']}, covariate string, beta double, linearised double, standardised double"
    ratio = lambda x, sd: float(sd_x[x]) / sd if sd and sd_x[x] is not None else None
    rows, own = [], []
    for s in f.scales:
        for x in config.person_preds:
            b, r = f.betas.get(f"ability:{s}", {}).get(x, 0.0), ratio(x, sd_ability.get(s))
            rows.append(("ability", s, None, x, b, b, None if r is None else b * r))
    for k in RAW:
        for x in f.preds[k]:
            if f.free[k] and means[k] is not None:
                slope, r = linearised(links[k], means[k], 1.0), ratio(x, sd_par[k])
                if config.item_specific_betas:
                    b = F.col(_own(k, x))
                    std = F.lit(None).cast("double") if r is None else b * r
                    lit = lambda v, t: F.lit(v).cast(t)
                    own.append(f.items.where(~F.col(f"fixed_{k}")).select(lit(NATURAL[k], "string").alias("parameter"), lit(None, kinds["Scale"]).alias("Scale"), "Item", lit(x, "string").alias("covariate"), b.alias("beta"), (b * slope).alias("linearised"), std.alias("standardised")))
                else:
                    b = f.betas.get(k, {}).get(x, 0.0)
                    rows.append((NATURAL[k], None, None, x, b, b * slope, None if r is None else b * r))
    out = spark.createDataFrame(rows, schema)
    for o in own:
        out = out.unionByName(o)
    return out


__all__ = ["IrtModel", "fit_irt", "linearised"]
