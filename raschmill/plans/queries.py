"""One query for each operator, over whole tables, and the SQL that DuckDB answers alike.

Doubles are rounded on both sides (6 digits; 4 for iterated results); ``r + 0.0`` turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raschmill.config import IrtConfig
from raschmill.functions import links
from raschmill.functions.model import Terms
from raschmill.operators import adaptive, moments, prep, reshape, scoring, simulate
from raschmill.operators import wle as wle_ops
from raschmill.operators.fit import IrtModel, fit_irt
from raschmill.operators.normalise import normalise
from raschmill.plans.views import SQL, abilities, items, predicted, responses, scored, table, with_items

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that follows the views."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql
        return f

    return put


def rd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rd(n, digits) for n in names})


KEYS = ("id", "Item", "l_orderkey", "l_linenumber", "score")
_K = 'id, "Item", l_orderkey, l_linenumber, score'
COUNT = "cast(count(*) as bigint)"

# ---------------------------------------------------------------- sources and shapes


@query('select id, "Item", "Scale", score from R')
def responses_project(spark, sf):
    return responses(spark, sf).select("id", "Item", "Scale", "score")


@query('select cast(c_custkey as bigint) as id, s as "Scale", i as "LocalItem", (s - 1) * 10 + i as "Item" from customer, (select unnest([1, 2]) as s), (select unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) as i)')
def sim_grid(spark, sf):
    own = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("Scale"))
    return own.select("id", "Scale", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("LocalItem")).withColumn("Item", (F.col("Scale") - 1) * 10 + F.col("LocalItem"))


@query('select cast(count(distinct id) as bigint) as n_persons, cast(count(distinct "Item") as bigint) as n_items, cast(count(distinct "Scale") as bigint) as n_scales, cast(count(*) as bigint) as n_rows from R')
def response_shape(spark, sf):
    return responses(spark, sf).agg(F.count_distinct("id").alias("n_persons"), F.count_distinct("Item").alias("n_items"), F.count_distinct("Scale").alias("n_scales"), F.count(F.lit(1)).alias("n_rows"))


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("select id, " + ", ".join(f"min(case when \"Item\" = '{b}' then score end) as \"{b}\"" for b in _BRANDS) + " from R group by id")
def responses_wide(spark, sf):
    return reshape.responses_wide(responses(spark, sf).select("id", "Item", "score"), _BRANDS)


@query('select "Item", parameter, round(value, 6) + 0.0 as value from (unpivot (select "Item", A, B, C, D from I) on A, B, C, D into name parameter value value)')
def params_long(spark, sf):
    return rounded(reshape.params_long(items(responses(spark, sf))), "value")


@query("""select estimator, "Item", 'B' as parameter, round(estimate, 6) + 0.0 as estimate, round(truth, 6) + 0.0 as truth, round(abs(estimate - truth), 6) + 0.0 as error from (
  select 'first' as estimator, "Item", B + 0.1 as estimate, B as truth from I union all select 'second', "Item", B * 0.9, B from I)""")
def param_comparison(spark, sf):
    i = items(responses(spark, sf))
    long = lambda b: reshape.params_long(i.withColumn("B", b), ("B",))
    out = reshape.compare(long(F.col("B")), first=long(F.col("B") + 0.1), second=long(F.col("B") * 0.9))
    return rounded(out, "estimate", "truth", "error")


@query('select c_custkey as id, n_answers, c_mktsegment from customer full join (select id, cast(count(*) as bigint) as n_answers from R group by id) a on a.id = c_custkey')
def merge_full_outer(spark, sf):
    n = responses(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n_answers"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return reshape.merge_all(c, n, "id").select("id", "n_answers", "c_mktsegment")


@query('select id, "Item", "Scale", score from R where u < 0.5 union all select id, "Item", "Scale", score from R where u >= 0.5')
def append_log(spark, sf):
    r = responses(spark, sf)
    return adaptive.append(r.where("u < 0.5"), r.where("u >= 0.5"))


# ---------------------------------------------------------------- functions

_INV = "1 / (1 + exp(-x))"


@query(f"""select x, round({_INV}, 6) as inv_logit, round(ln({_INV}) - ln(1 - {_INV}), 6) + 0.0 as logit_back, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) as softplus,
  round(x, 6) + 0.0 as softplus_back, round(0.5 * {_INV}, 6) as lower, round(0.5 * {_INV} + 0.5, 6) as upper, round(x, 6) + 0.0 as lower_back, round(x, 6) + 0.0 as upper_back
  from (select distinct (l_quantity - 25) / 5 as x from lineitem)""")
def link_functions(spark, sf):
    x = F.col("x")
    d = table(spark, sf, "lineitem").select(((F.col("l_quantity") - 25) / 5).alias("x")).distinct()
    return d.select(
        "x",
        rd(links.inv_logit(x)).alias("inv_logit"),
        rd(links.logit(links.inv_logit(x))).alias("logit_back"),
        rd(links.softplus(x)).alias("softplus"),
        rd(links.softplus_inverse(links.softplus(x))).alias("softplus_back"),
        rd(links.lower_asymptote(x)).alias("lower"),
        rd(links.upper_asymptote(x)).alias("upper"),
        rd(links.lower_asymptote_inverse(links.lower_asymptote(x))).alias("lower_back"),
        rd(links.upper_asymptote_inverse(links.upper_asymptote(x))).alias("upper_back"),
    )


def _curve_sql(low: float, high: float, steps: int) -> str:
    theta = f"({low}::double + g * ({high - low}::double / {steps}))"
    return f'select "Item", round({theta}, 6) + 0.0 as theta, round(C + (D - C) / (1 + exp(-A * ({theta} - B))), 6) as p from I, (select unnest(range(0, {steps + 1})) as g)'


@query(_curve_sql(-3, 3, 12))
def icc_prob(spark, sf):
    return rounded(scoring.item_curve(items(responses(spark, sf)), -3, 3, 12), "theta", "p")


@query(_curve_sql(-3, 3, 600))
def item_curve(spark, sf):
    return rounded(scoring.item_curve(items(responses(spark, sf))), "theta", "p")


@query(_curve_sql(-3, 3, 600).replace("round((-3::double + g * (6::double / 600)), 6)", f"round((-3::double + g * (6::double / 600)) / {float(np.linspace(-3, 3, 601).std(ddof=1))!r}::double, 6)"))
def item_curve_rescaled(spark, sf):
    return rounded(scoring.item_curve(items(responses(spark, sf)), rescale=True), "theta", "p")


@query(f"select {_K}, round(p, 6) as p, round(p_observed, 6) as p_observed from P")
def prob_observed(spark, sf):
    return rounded(predicted(spark, sf).select(*KEYS, "p", "p_observed"), "p", "p_observed")


@query(f"select {_K}, round(case when score = 1 then p_observed else 1 - p_observed end, 6) as p_correct from P")
def prob_correct(spark, sf):
    p = F.when(F.col("score") == 1, F.col("p_observed")).otherwise(1 - F.col("p_observed"))
    return predicted(spark, sf).select(*KEYS, rd(p).alias("p_correct"))


@query(f"select round(sum(pow(p - round(p, 3), 2)), 6) as difference, {COUNT} as n from P")
def check_p(spark, sf):
    known = scored(spark, sf).withColumn("known", F.round(Terms(*[F.col(c) for c in ("ability", "A", "B", "C", "D")]).p, 3))
    return rounded(scoring.check_p(known, "known"), "difference")


@query(f"select {_K}, round(loglik, 6) as loglik from P")
def row_loglik(spark, sf):
    return rounded(predicted(spark, sf).select(*KEYS, "loglik"), "loglik")


@query(f'select "Item", round(sum(d1 * d1 / (p * (1 - p))), 6) as information, {COUNT} as n from P group by "Item"')
def item_information(spark, sf):
    return rounded(scoring.item_information(scored(spark, sf)), "information")


_CURV = "sum(case when score = 1 then d2 / p - (d1 / p) * (d1 / p) else -d2 / (1 - p) - (d1 / (1 - p)) * (d1 / (1 - p)) end)"


@query(f"""select id, "Scale", round(k, 6) + 0.0 as curvature, case when k <> 0 then round(sqrt(1 / abs(k)), 4) end as se_lik, round(sqrt(1 / abs(k - 0.01)), 4) as se_post
  from (select id, "Scale", {_CURV} as k from P group by id, "Scale")""")
def ability_se(spark, sf):
    return rounded(rounded(scoring.ability_se(scored(spark, sf), 10.0), "curvature"), "se_lik", "se_post", digits=4)


_W = "pow((D - C) * s * (1 - s), 2) / (p * (1 - p))"


@query(f"""select "Item", round(sqrt(ibb / (iaa * ibb - iab * iab)), 6) as "se_A", round(sqrt(iaa / (iaa * ibb - iab * iab)), 6) as "se_B" from (
  select "Item", sum({_W} * pow(ability - B, 2)) as iaa, sum(-{_W} * A * (ability - B)) as iab, sum({_W} * A * A) as ibb from P group by "Item")""")
def item_se(spark, sf):
    return rounded(scoring.item_se(scored(spark, sf)), "se_A", "se_B")


_I2 = f"""(select "Item", iaa, iab, ibb, iaa * ibb - iab * iab as det from (select "Item", sum({_W} * pow(ability - B, 2)) as iaa, sum(-{_W} * A * (ability - B)) as iab, sum({_W} * A * A) as ibb from P group by "Item"))"""


@query(f"""select "Item", 'A' as parameter_1, 'A' as parameter_2, round(ibb / det, 6) as covariance from {_I2} union all select "Item", 'A', 'B', round(-iab / det, 6) + 0.0 from {_I2}
  union all select "Item", 'B', 'A', round(-iab / det, 6) + 0.0 from {_I2} union all select "Item", 'B', 'B', round(iaa / det, 6) from {_I2}""")
def item_cov(spark, sf):
    return rounded(scoring.item_covariance(scored(spark, sf), ("A", "B")), "covariance")


_Q2 = np.linalg.inv(np.array([[1.0, 1.0], [1.0, 4.0]]) + 1e-6 * np.eye(2)).tolist()
_C2 = f"""(select id, a, c, q, a * c - q * q as det from (select id, coalesce(sum(d1 * d1 / (p * (1 - p))) filter (where "Scale" = 1), 0) + {_Q2[0][0]!r}::double as a,
  coalesce(sum(d1 * d1 / (p * (1 - p))) filter (where "Scale" = 2), 0) + {_Q2[1][1]!r}::double as c, {_Q2[0][1]!r}::double as q from P group by id))"""


@query(f"""select id, 1 as "Scale_1", 1 as "Scale_2", round(c / det, 6) as covariance from {_C2} union all select id, 1, 2, round(-q / det, 6) + 0.0 from {_C2}
  union all select id, 2, 1, round(-q / det, 6) + 0.0 from {_C2} union all select id, 2, 2, round(a / det, 6) from {_C2}""")
def ability_cov(spark, sf):
    return rounded(scoring.ability_covariance(scored(spark, sf), [1, 2], [1.0, 2.0], [[1.0, 0.5], [0.5, 1.0]]), "covariance")


def _integrated_sql() -> str:
    x, w = scoring.gauss_hermite(5)
    total = " + ".join(f"{b!r}::double * case when score = 1 then q{i} else 1 - q{i} end" for i, b in enumerate(w))
    ps = ", ".join(f"C + (D - C) / (1 + exp(-A * (ability + {a!r}::double * 0.5 - B))) as q{i}" for i, a in enumerate(x))
    return f"select {_K}, round({total}, 6) as p_integrated from (select *, {ps} from S)"


@query(_integrated_sql())
def integrated_prob(spark, sf):
    return rounded(scoring.integrated_probability(scored(spark, sf), F.lit(0.5)).select(*KEYS, "p_integrated"), "p_integrated")


# ---------------------------------------------------------------- filters, groups, windows


@query(f'select "Item", round(avg(score), 6) as mean_score, {COUNT} as n from R group by "Item"')
def item_means(spark, sf):
    return rounded(prep.means(responses(spark, sf), "Item"), "mean_score")


@query(f"select id, round(avg(score), 6) as mean_score, {COUNT} as n from R group by id")
def person_means(spark, sf):
    return rounded(prep.means(responses(spark, sf), "id"), "mean_score")


@query(f'select {_K}, round(avg(score) over (partition by "Item"), 6) as item_mean from R')
def group_mean_on_rows(spark, sf):
    return rounded(prep.with_mean(responses(spark, sf), "Item", "item_mean").select(*KEYS, "item_mean"), "item_mean")


def _perfect_sql(rounds: int) -> str:
    out, last = "", "R"
    for k in range(rounds):
        for key in ('"Item"', "id"):
            new = f"F{k}{'i' if key != 'id' else 'p'}"
            out += f", {new} as (select * from {last} where {key} in (select {key} from {last} group by {key} having abs(avg(score) - 0.5) + 0.001 < 0.5))"
            last = new
    return out


_FILTERED = _perfect_sql(3)


@query(_FILTERED + ' select id, "Item", "Scale", score from F2p')
def drop_perfect_scores(spark, sf):
    return prep.drop_perfect_scores(responses(spark, sf).select("id", "Item", "Scale", "score"))


@query("""select "Item", round(A, 6) as A from (select "Item", A from I where brand % 2 = 0 union all select 'Brand#99', 1.0) where "Item" in (select "Item" from R)""")
def fixed_items_semi(spark, sf):
    r = responses(spark, sf)
    fixed = items(r).where("brand % 2 = 0").select("Item", "A").unionByName(spark.createDataFrame([("Brand#99", 1.0)], "Item string, A double"))
    return rounded(prep.restrict(fixed, r, "Item"), "A")


@query("select " + ", ".join(f'cast(count(*) - count("{c}") as bigint) as "{c}"' for c in ("id", "Item", "Scale", "score", "x1", "x2")) + " from R")
def null_audit(spark, sf):
    return prep.null_audit(responses(spark, sf).select("id", "Item", "Scale", "score", "x1", "x2"))


_LL = "from P"


def _holdout(spark, sf):
    rows = prep.split_by_person(predicted(spark, sf), F.col("id") * 7, 3, 10)
    return scoring.total_loglik(rows, F.col("is_training"))


@query(f"""select round(sum(case when t then loglik end), 4) as train_loglik, round(sum(case when not t then loglik end), 4) as holdout_loglik, cast(count(*) filter (where t) as bigint) as n_train,
  cast(count(*) filter (where not t) as bigint) as n_holdout from (select *, (id * 7) % 10 <> 3 as t {_LL})""")
def holdout_loglik(spark, sf):
    return rounded(_holdout(spark, sf).drop("holdout_geomean_p"), "train_loglik", "holdout_loglik", digits=4)


@query(f"select round(exp(avg(loglik)), 6) as holdout_geomean_p {_LL} where (id * 7) % 10 = 3")
def holdout_geomean_p(spark, sf):
    return rounded(_holdout(spark, sf).select("holdout_geomean_p"), "holdout_geomean_p")


@query('select "Item" as original, cast(dense_rank() over (order by "Item") as integer) as new from (select distinct "Item" from R)')
def dense_index(spark, sf):
    return prep.dense_index(responses(spark, sf), "Item")


@query('select "Item", min_by(score, l_orderkey * 100 + score) as score from R group by "Item"')
def first_per_group(spark, sf):
    return prep.first_per_group(responses(spark, sf), "Item", "score", "l_orderkey")


@query('select "Item", case when brand % 3 <> 0 then cast(sum(case when brand % 3 <> 0 then 1 else 0 end) over (order by "Item") as integer) else 0 end as slot from I')
def free_param_slots(spark, sf):
    return prep.free_slots(items(responses(spark, sf)).select("Item", "brand"), "Item", F.col("brand") % 3 != 0).select("Item", "slot")


_ORDER = ["u", "l_orderkey", "l_linenumber", "Item", "score"]
_ORDER_SQL = 'u, l_orderkey, l_linenumber, "Item", score'


@query(f"select {_K} from (select *, row_number() over (partition by id order by {_ORDER_SQL}) as k from R) where k <= 5")
def topk_per_person(spark, sf):
    return prep.top_k_per_person(responses(spark, sf), _ORDER, 5).select(*KEYS)


_WEIGHT = "exp(0.001 + max(abs(B - ability)) over (partition by id) - abs(B - ability))"


@query(f'select {_K} from (select *, row_number() over (partition by id order by round(-ln(u) / w, 9), {_ORDER_SQL}) as k from (select *, {_WEIGHT} as w from S)) where k <= 5')
def weighted_topk(spark, sf):
    s = scored(spark, sf)
    s = s.join(s.groupBy("id").agg(F.max(F.abs(F.col("B") - F.col("ability"))).alias("most")), "id")
    w = prep.closeness_weight(F.col("ability"), F.col("B"), F.col("most"))
    return prep.top_k_per_person(s, [F.round(prep.weighted_key(F.col("u"), w), 9), *_ORDER], 5).select(*KEYS)


@query(f"select {_K}, k <= ceil(n * 0.9) as is_training from (select *, row_number() over (partition by id order by {_ORDER_SQL}) as k, count(*) over (partition by id) as n from R)")
def split_within_person(spark, sf):
    return prep.split_within_person(responses(spark, sf), _ORDER, 0.9).select(*KEYS, "is_training")


@query(f"select {_K}, (id * 7) % 10 <> 3 as is_training from R")
def split_by_subject(spark, sf):
    return prep.split_by_person(responses(spark, sf), F.col("id") * 7, 3, 10).select(*KEYS, "is_training")


# ---------------------------------------------------------------- fixed and free parameters


@query('select "Item", case when brand % 2 = 0 then round(A, 6) end as A, case when brand % 3 = 0 then round(B, 6) + 0.0 end as B, 0.0::double as C, 1.0::double as D from I')
def item_setup(spark, sf):
    i = items(responses(spark, sf))
    fixed = i.where("brand % 2 = 0 or brand % 3 = 0").select("Item", F.when(F.col("brand") % 2 == 0, F.col("A")).alias("A"), F.when(F.col("brand") % 3 == 0, F.col("B")).alias("B"), F.lit(0.2).alias("C"))
    return rounded(prep.item_setup(i, 2, fixed), "A", "B")


@query("""select p.id, s as "Scale", case when p.id % 3 = 0 and s = 1 then p.id % 7 / 2 when p.id % 3 = 0 and p.id % 2 = 0 then -0.5 end as ability
  from (select distinct id from R) p, (select unnest([1, 2]) as s)""")
def ability_setup(spark, sf):
    p = responses(spark, sf).select("id").distinct()
    fixed = p.where("id % 3 = 0").select("id", (F.col("id") % 7 / 2).alias("1"), F.when(F.col("id") % 2 == 0, F.lit(-0.5)).alias("2"))
    return prep.ability_setup(p, [1, 2], fixed)


# ---------------------------------------------------------------- likelihood, priors, gradients


@query(f"select round(sum(loglik), 4) as total_loglik, {COUNT} as n from P")
def total_loglik(spark, sf):
    return scoring.total_loglik(predicted(spark, sf)).select(rd("train_loglik", 4).alias("total_loglik"), F.col("n_train").alias("n"))


_RAW_A = "A + ln(1 - exp(-A))"
_PRIOR = f"""(select sum(-0.5 * pow(({_RAW_A} - 0.542) / 1, 2) - 0.5 * pow(B / 10, 2)) from I) + (select sum(-0.5 * pow(ability / 10, 2)) from T)"""


def _log_prior(spark, sf):
    r = responses(spark, sf)
    a = moments.normal_log_density(links.softplus_inverse(F.col("A")), 0.542, 1.0)
    i = items(r).agg(F.sum(a + moments.normal_log_density(F.col("B"), 0.0, 10.0)).alias("i"))
    return i.crossJoin(abilities(r).agg(F.sum(moments.normal_log_density(F.col("ability"), 0.0, 10.0)).alias("t")))  # two single rows


@query(f"select round({_PRIOR}, 4) as log_prior")
def log_prior(spark, sf):
    return _log_prior(spark, sf).select(rd(F.col("i") + F.col("t"), 4).alias("log_prior"))


@query(f"select round((select sum(loglik) from P) + {_PRIOR}, 4) as log_posterior")
def log_posterior(spark, sf):
    both = _log_prior(spark, sf).crossJoin(scoring.total_loglik(predicted(spark, sf)))
    return both.select(rd(F.col("i") + F.col("t") + F.col("train_loglik"), 4).alias("log_posterior"))


_GR = {"gAbility": "r * d1", "gA": "r * (D - C) * s * (1 - s) * (ability - B)", "gB": "-r * d1", "gC": "r * (1 - s)", "gD": "r * s"}
_GSUM = ", ".join(f'round(sum({v}), 4) + 0.0 as "{k}"' for k, v in _GR.items())


@query(f"select {_K}, " + ", ".join(f'round({v}, 6) + 0.0 as "{k}"' for k, v in _GR.items()) + " from G")
def score_contributions(spark, sf):
    return rounded(scoring.score_contributions(scored(spark, sf)).select(*KEYS, *_GR), *_GR)


@query(f'select "Item", {_GSUM} from G group by "Item"')
def gradients(spark, sf):
    return rounded(scoring.gradient_sums(scoring.score_contributions(scored(spark, sf)), "Item"), *_GR, digits=4)


@query(f'select id, "Scale", {_GSUM} from G group by id, "Scale"')
def score_sums(spark, sf):
    return rounded(scoring.gradient_sums(scoring.score_contributions(scored(spark, sf)), "id", "Scale"), *_GR, digits=4)


@query("""select round(corr(ga, gb), 4) as corr_a_b, round(corr(gb, gc), 4) as corr_b_c from (select id, sum(r * (D - C) * s * (1 - s) * (ability - B)) as ga, sum(-r * d1) as gb, sum(r * (1 - s)) as gc from G group by id)""")
def score_correlations(spark, sf):
    g = scoring.gradient_sums(scoring.score_contributions(scored(spark, sf)), "id")
    return g.agg(rd(F.corr("gA", "gB"), 4).alias("corr_a_b"), rd(F.corr("gB", "gC"), 4).alias("corr_b_c"))


@query(f'select "Item", round(avg(score), 6) as mean_observed, round(avg(p), 6) as mean_expected, {COUNT} as n from P group by "Item"')
def item_fit(spark, sf):
    return rounded(scoring.item_fit(predicted(spark, sf)), "mean_observed", "mean_expected")


@query('select "Scale", id % 5 as g, round(sqrt(avg(pow(ability - round(ability, 1), 2))), 6) as rmse from T group by "Scale", id % 5')
def rmse_by_group(spark, sf):
    t = abilities(responses(spark, sf)).withColumn("est", F.round("ability", 1)).withColumn("g", F.col("id") % 5)
    return rounded(scoring.rmse(t, "ability", "est", "Scale", "g"), "rmse")


# ---------------------------------------------------------------- moments


_HINGE = """h as (select g, list(v order by v) as l, cast(count(*) as bigint) as n from V where v is not null group by g),
b as (select g, (l[cast(floor(d) as bigint)] + l[cast(ceil(d) as bigint)]) / 2 as lo, (l[n + 1 - cast(floor(d) as bigint)] + l[n + 1 - cast(ceil(d) as bigint)]) / 2 as hi
  from (select *, ((n + 3) // 2) / 2 as d from h))"""


@query(f""", V as (select o_orderstatus as g, o_totalprice as v, o_orderkey from orders), {_HINGE}
select o_orderkey, g as o_orderstatus, v as o_totalprice from V join b using (g) where v between lo - 1.5 * (hi - lo) and hi + 1.5 * (hi - lo)""")
def outlier_trim(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return moments.trim(o, "o_totalprice", "o_orderstatus")


@query(f""", V as (select "Scale" as g, ability as v from T), {_HINGE}
select g as "Scale", round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v) * 2 + 1e-5, 6) as sd, cast(count(*) as bigint) as n from V join b using (g)
where v between lo - 1.5 * (hi - lo) and hi + 1.5 * (hi - lo) group by g""")
def ebayes_moments(spark, sf):
    return rounded(moments.empirical_moments(abilities(responses(spark, sf)), "ability", "Scale"), "mean", "sd")


_LOGIT_C = "ln(C + 1e-8) - ln(1 - (C + 1e-8))"


_LOGIT_D = "case when D + 1e-8 < 1 then ln(D + 1e-8) - ln(1 - (D + 1e-8)) end"


@query("select " + ", ".join(f"round(avg({e}), 6) + 0.0 as {k}_mean, round(stddev_samp({e}) * 2 + 1e-5, 6) as {k}_sd" for k, e in (("a", _RAW_A), ("b", "B"), ("c", _LOGIT_C), ("d", _LOGIT_D))) + " from I")
def priors_from_fixed(spark, sf):
    out = moments.priors_from_fixed(items(responses(spark, sf)))
    return rounded(out, *out.columns)


@query('select cast("Scale" as varchar) as "Scale", round(avg(ability), 6) + 0.0 as mean, round(stddev_samp(ability) * 2 + 1e-5, 6) as sd from T group by "Scale"')
def ability_priors_from_fixed(spark, sf):
    mean, sd, _ = moments.ability_priors_from_fixed(abilities(responses(spark, sf)))
    return rounded(spark.createDataFrame([(k, mean[k], sd[k]) for k in sorted(mean)], "Scale string, mean double, sd double"), "mean", "sd")


@query("select id, round(avg(x1), 6) as x1, round(avg(x2), 6) as x2 from R group by id")
def covariate_means(spark, sf):
    return rounded(moments.covariate_means(responses(spark, sf), "id", ("x1", "x2")), "x1", "x2")


@query("""select "Scale", covariate, beta, round(beta * sx / sp, 6) + 0.0 as effect from (select 'x1' as covariate, 0.3::double as beta, (select stddev_samp(x1) from R) as sx union all
  select 'x2', -0.2, (select stddev_samp(x2) from R)), (select "Scale", stddev_samp(ability) as sp from T group by "Scale")""")
def covariate_effects_std(spark, sf):
    r = responses(spark, sf)
    return rounded(moments.standardised_effects(r, abilities(r), {"x1": 0.3, "x2": -0.2}, "ability", "Scale"), "effect")


@query("""select a."Scale" as scale_a, b."Scale" as scale_b, round(covar_samp(a.ability, b.ability) / (stddev_samp(a.ability) * stddev_samp(b.ability)), 6) + 0.0 as corr
  from T a join T b using (id) group by a."Scale", b."Scale" """)
def ability_corr(spark, sf):
    return rounded(moments.ability_correlations(abilities(responses(spark, sf))), "corr")


# ---------------------------------------------------------------- normalisation


def _both(i: DataFrame, t: DataFrame) -> DataFrame:
    a = i.select(F.lit("item").alias("kind"), F.col("Item").alias("name"), "Scale", rd("A").alias("A"), rd("B").alias("value"))
    b = t.select(F.lit("person").alias("kind"), F.col("id").cast("string").alias("name"), "Scale", F.lit(None).cast("double").alias("A"), rd("ability").alias("value"))
    return a.unionByName(b)


def _norm_sql(k: str, on: str = "") -> str:
    return f"""{k}
select 'item' as kind, "Item" as name, "Scale", round(A * s, 6) as A, round((B - m) / s, 6) + 0.0 as value from I, K {on.format("I")}
union all select 'person', cast(id as varchar), "Scale", null, round((ability - m) / s, 6) + 0.0 from T, K {on.format("T")}"""


def _normalised(spark, sf, **how):
    r = responses(spark, sf)
    return _both(*normalise(items(r), abilities(r), **how))


@query(_norm_sql(", K as (select median(ability) as m, quantile_cont(ability, 0.75) - quantile_cont(ability, 0.25) as s from T)"))
def normalise_robust(spark, sf):
    return _normalised(spark, sf)


@query(_norm_sql(", K as (select avg(ability) as m, stddev_samp(ability) as s from T)"))
def normalise_classic(spark, sf):
    return _normalised(spark, sf, robust=False)


@query(_norm_sql(", K as (select median(B) as m, quantile_cont(B, 0.75) - quantile_cont(B, 0.25) as s from I)"))
def normalise_by_b(spark, sf):
    return _normalised(spark, sf, base="B")


@query(_norm_sql(', K as (select "Scale" as g, median(ability) as m, quantile_cont(ability, 0.75) - quantile_cont(ability, 0.25) as s from T group by "Scale")', 'where K.g = {}."Scale"'))
def normalise_per_scale(spark, sf):
    return _normalised(spark, sf, by_scale=True)


# ---------------------------------------------------------------- weighted likelihood


def _wle_sql(source: str = "S") -> str:
    """The same bisection with aggregates by person in each step (40 steps, all persons at once)."""
    cells = f', cells as materialized (select id, "Scale", "Item", A, B, C, D, sum(score) as n1, count(*) - sum(score) as n0 from {source} group by id, "Scale", "Item", A, B, C, D)'
    terms = "A * (D - C) * s * (1 - s) as d1, C + (D - C) * s as p"

    def grad(name: str, source: str, theta: str) -> str:
        return f""", {name} as materialized (select id, "Scale", sum((n1 + n0) * d1 * d1 * A * (1 - 2 * s) / (p * (1 - p))) / (2 * sum((n1 + n0) * d1 * d1 / (p * (1 - p)))) + sum(n1 * d1 / p - n0 * d1 / (1 - p)) as g
  from (select *, {terms} from (select c.*, 1 / (1 + exp(-A * ({theta} - B))) as s from cells c join {source} w using (id, "Scale"))) group by id, "Scale")"""

    out, last = cells + ', w0 as materialized (select distinct id, "Scale", -5.0::double as lo, 5.0::double as hi from cells)', "w0"
    for k in range(1, 4):  # intervals of data with both answers are wide enough after three
        out += grad(f"ga{k}", last, "w.lo") + grad(f"gb{k}", last, "w.hi")
        out += f', w{k} as materialized (select id, "Scale", case when sign(ga{k}.g) = sign(gb{k}.g) then lo - (hi - lo) else lo end as lo, case when sign(ga{k}.g) = sign(gb{k}.g) then hi + 2 * (hi - lo) else hi end as hi from {last} join ga{k} using (id, "Scale") join gb{k} using (id, "Scale"))'
        last = f"w{k}"
    out += grad("s0", last, "w.lo")
    for k in range(10, 30):
        out += grad(f"m{k}", last, "w.lo + (w.hi - w.lo) / 2")
        left, mid = f"sign(m{k}.g) = sign(s0.g)", "lo + (hi - lo) / 2"
        out += f', w{k} as materialized (select id, "Scale", case when (hi - lo) / 2 > 0.001 and {left} then {mid} else lo end as lo, case when (hi - lo) / 2 > 0.001 and not ({left}) then {mid} else hi end as hi from {last} join m{k} using (id, "Scale") join s0 using (id, "Scale"))'
        last = f"w{k}"
    out += f', e as materialized (select id, "Scale", lo + (hi - lo) / 2 as wle from {last})' + grad("gl", "e", "w.wle - 0.01") + grad("gh", "e", "w.wle + 0.01")
    return out


_WLE = _wle_sql()


def _cells(spark, sf):
    return wle_ops.cells(with_items(responses(spark, sf)))


@query(_WLE + ' select id, "Scale", round(wle, 4) + 0.0 as wle from e')
def wle(spark, sf):
    return rounded(wle_ops.wle(_cells(spark, sf)).select("id", "Scale", "wle"), "wle", digits=4)


@query(_WLE + ' select id, "Scale", round(sqrt(abs(1 / ((gl.g - gh.g) / 0.02))), 4) as wle_se from e join gl using (id, "Scale") join gh using (id, "Scale")')
def wle_se(spark, sf):
    return rounded(wle_ops.wle(_cells(spark, sf)).select("id", "Scale", "wle_se"), "wle_se", digits=4)


@query('select id, "Scale", round(sum(d1 * d2 / (p * (1 - p))) / (2 * sum(d1 * d1 / (p * (1 - p)))) + sum(r * d1), 4) + 0.0 as gradient from G group by id, "Scale"')
def wle_gradient(spark, sf):
    s = scored(spark, sf)
    c = wle_ops.cells(s).join(abilities(s), ["id", "Scale"])
    return c.select("id", "Scale", rd(wle_ops.gradient(F.col("ability"), F.col("cells")), 4).alias("gradient"))


# ---------------------------------------------------------------- fits


def _fit_sql(sweeps: int) -> str:
    """Unrolled sweeps of the one-parameter fit."""
    out = _FILTERED + """, N as materialized (select id, "Scale", "Item", cast(count(*) as double) as n, cast(sum(score) as double) as s from F2p group by id, "Scale", "Item"),
t0 as materialized (select p.id, c."Scale", 0.0::double as v, 0.0::double as mu from (select distinct id from N) p, (select distinct "Scale" from N) c), b0 as materialized (select distinct "Item", 0.0::double as v, 0.0::double as mu from N)"""
    for k in range(1, sweeps + 1):
        j = k - 1
        p = "1 / (1 + exp(-({t}.v - {b}.v)))"
        clip = lambda e: f"greatest(least({e}, 1.0), -1.0)"
        q = p.format(t=f"t{j}", b=f"b{j}")
        out += f""", x{k} as materialized (select id, "Scale", sum(s - n * q) as g, sum(n * q * (1 - q)) as i from (select N.*, {q} as q from N join t{j} using (id, "Scale") join b{j} using ("Item")) group by id, "Scale"),
u{k} as materialized (select id, "Scale", v + {clip('(coalesce(g, 0) - (v - mu) / 100) / (coalesce(i, 0) + 0.01)')} as v from t{j} left join x{k} using (id, "Scale"))"""
        q = p.format(t=f"u{k}", b=f"b{j}")
        out += f""", y{k} as materialized (select "Item", sum(s - n * q) as g, sum(n * q * (1 - q)) as i from (select N.*, {q} as q from N join u{k} using (id, "Scale") join b{j} using ("Item")) group by "Item"),
c{k} as materialized (select "Item", v + {clip('(-g - (v - mu) / 100) / (i + 0.01 + 1e-6)')} as v from b{j} join y{k} using ("Item")),
o{k} as materialized (select avg(v) as o from u{k}), m{k} as materialized (select "Scale", avg(v) as m from u{k} group by "Scale"), z{k} as materialized (select avg(v) as m from c{k}),
t{k} as materialized (select id, "Scale", v - o as v, m - o as mu from u{k} join m{k} using ("Scale"), o{k}), b{k} as materialized (select "Item", v - o as v, m - o as mu from c{k}, z{k}, o{k})"""
    return out + f""" select 'item' as kind, "Item" as name, null as "Scale", round(v, 4) + 0.0 as value from b{sweeps} union all select 'person', cast(id as varchar), "Scale", round(v, 4) + 0.0 from t{sweeps}"""


def _summary(m: IrtModel) -> DataFrame:
    a = m.items.select(F.lit("item").alias("kind"), F.col("Item").alias("name"), F.lit(None).cast("int").alias("Scale"), rd("B", 4).alias("value"))
    return a.unionByName(m.persons.select(F.lit("person").alias("kind"), F.col("id").cast("string").alias("name"), "Scale", rd("ability", 4).alias("value")))


def _fitted(spark, sf, fixed: DataFrame | None = None, **how) -> IrtModel:
    """A fit to the tolerance: sweeps are not counted out, and one that does not get there is an error, not a result."""
    m = fit_irt(responses(spark, sf), config=IrtConfig(**({"ebayes": False, "max_sweeps": 10_000} | how)), fixed_items=fixed)
    if not m.converged:
        raise ArithmeticError(f"no convergence after {m.sweeps} sweeps")
    return m


@query(_fit_sql(4))
def fit_1pl(spark, sf):
    return _summary(fit_irt(responses(spark, sf), config=IrtConfig(ebayes=False), fixed_sweeps=4))  # as many as the SQL has


_SWEPT = _fit_sql(4).partition(" select 'item' as kind")[0] + ', W as (select f.id, f."Scale", f."Item", f.score, 1.0::double as A, b4.v as B, 0.0::double as C, 1.0::double as D from F2p f join b4 using ("Item"))'


@query(_SWEPT + _wle_sql("W") + ' select id, "Scale", round(wle, 3) + 0.0 as wle from e')
def wle_of_fit(spark, sf):
    """Weighted likelihood estimates under the item parameters of a fit."""
    m = fit_irt(responses(spark, sf), config=IrtConfig(ebayes=False), fixed_sweeps=4)
    return rounded(wle_ops.wle_of(m).select("id", "Scale", "wle"), "wle", digits=3)


def _items_of(m: IrtModel) -> DataFrame:
    return m.items.select("Item", "Scale", "A", "B", "C", "D")


@query()
def fit_1pl_converged(spark, sf):
    return _items_of(_fitted(spark, sf))


@query()
def fit_integrated(spark, sf):
    """The likelihood of each answer is integrated along the ability, with deviations from the curvature."""
    return _items_of(_fitted(spark, sf, integrate_points=5))


@query()
def fit_2pl(spark, sf):
    return _items_of(_fitted(spark, sf, pl=2))


@query()
def fit_3pl(spark, sf):
    return _items_of(_fitted(spark, sf, pl=3))


@query()
def fit_4pl(spark, sf):
    return _items_of(_fitted(spark, sf, pl=4))


@query()
def fit_ebayes(spark, sf):
    return _items_of(_fitted(spark, sf, ebayes=True, normalise=True))


@query()
def fit_fixed_items(spark, sf):
    """Half of the items keep their closed-form parameters."""
    return _items_of(_fitted(spark, sf, fixed=items(responses(spark, sf)).where("brand % 2 = 0").select("Item", "A", "B", "C", "D"), pl=2))


def _effects(spark, m: IrtModel) -> DataFrame:
    return m.covariate_effects.select("parameter", F.coalesce(F.col("Scale").cast("string"), F.lit("all")).alias("Scale"), "covariate", "beta", "linearised", "standardised")


@query()
def fit_person_preds(spark, sf):
    return _effects(spark, _fitted(spark, sf, person_preds=("x1",)))


@query()
def fit_item_preds(spark, sf):
    return _effects(spark, _fitted(spark, sf, pl=2, a_preds=("x2",), b_preds=("x1", "x2")))


# ---------------------------------------------------------------- parameters with covariates


@query(f"""select "Item", round(greatest(ra, 0) + ln(1 + exp(-abs(ra))), 6) as A, round(B - 0.2 * m2, 6) + 0.0 as B from (
  select "Item", B, m2, {_RAW_A} + 0.3 * m1 as ra from I join (select "Item", avg(x1) as m1, avg(x2) as m2 from R group by "Item") using ("Item"))""")
def final_item_params(spark, sf):
    r = responses(spark, sf)
    j = items(r).join(moments.covariate_means(r, "Item", ("x1", "x2")), "Item")
    a = links.softplus(links.softplus_inverse(F.col("A")) + simulate.linear({"x1": 0.3}))
    return j.select("Item", rd(a).alias("A"), rd(F.col("B") + simulate.linear({"x2": -0.2})).alias("B"))


@query('select id, "Scale", round(ability + 0.5 * m1 - 0.2 * m2, 6) + 0.0 as ability from T join (select id, avg(x1) as m1, avg(x2) as m2 from R group by id) using (id)')
def final_abilities(spark, sf):
    r = responses(spark, sf)
    j = abilities(r).join(moments.covariate_means(r, "id", ("x1", "x2")), "id")
    return j.select("id", "Scale", rd(F.col("ability") + simulate.linear({"x1": 0.5, "x2": -0.2})).alias("ability"))


@query(f"""select 'A' as parameter, round(0.3 * ((greatest(m + 0.01, 0) + ln(1 + exp(-abs(m + 0.01)))) - (greatest(m - 0.01, 0) + ln(1 + exp(-abs(m - 0.01))))) / 0.02, 6) as effect from (select avg({_RAW_A}) as m from I)
  union all select 'C', round(0.3 * (0.5 / (1 + exp(-(m + 0.01))) - 0.5 / (1 + exp(-(m - 0.01)))) / 0.02, 6) from (select avg({_LOGIT_C}) as m from I)""")
def linearised_betas(spark, sf):
    i = items(responses(spark, sf)).agg(F.avg(links.softplus_inverse(F.col("A"))).alias("a"), F.avg(links.logit(F.col("C") + 1e-8)).alias("c"))
    diff = lambda f, m: 0.3 * (f(F.col(m) + 0.01) - f(F.col(m) - 0.01)) / 0.02
    return i.select(F.explode(F.array(F.struct(F.lit("A").alias("parameter"), rd(diff(links.softplus, "a")).alias("effect")), F.struct(F.lit("C").alias("parameter"), rd(diff(links.lower_asymptote, "c")).alias("effect")))).alias("e")).select("e.*")


# ---------------------------------------------------------------- simulation and adaptive testing


@query("select id, \"Item\", l_orderkey, l_linenumber, round(p, 6) as p, case when u < p then 1 else 0 end as score from P")
def sim_irt_u(spark, sf):
    s = simulate.answer(scored(spark, sf).drop("score"), F.col("u"))
    return rounded(s.select("id", "Item", "l_orderkey", "l_linenumber", "p", "score"), "p")


@query("""select id, "Item", l_orderkey, l_linenumber, round(B + 0.4 * i1, 6) + 0.0 as B, round(ability - 0.3 * p1, 6) + 0.0 as ability, round(C + (D - C) / (1 + exp(-A * ((ability - 0.3 * p1) - (B + 0.4 * i1)))), 6) as p
  from S join (select "Item", avg(x1) as i1 from R group by "Item") using ("Item") join (select id, avg(x2) as p1 from R group by id) using (id)""")
def sim_covariates(spark, sf):
    r = responses(spark, sf)
    by_item = r.groupBy("Item").agg(F.avg("x1").alias("i1"))
    by_person = r.groupBy("id").agg(F.avg("x2").alias("p1"))
    s = scored(spark, sf).join(by_item, "Item").join(by_person, "id")
    s = simulate.shift(simulate.shift(s, "B", {"i1": 0.4}), "ability", {"p1": -0.3})
    s = simulate.answer(s.drop("score"), F.col("u"))
    return rounded(s.select("id", "Item", "l_orderkey", "l_linenumber", "B", "ability", "p"), "B", "ability", "p")


@query('select id, "Item", round(C + (D - C) / (1 + exp(-A * (ability - B))), 6) as p from I join T using ("Scale")')
def sim_response_prob(spark, sf):
    r = responses(spark, sf)
    rows = items(r).join(abilities(r), "Scale")
    return rounded(simulate.answer(rows, F.lit(0.5)).select("id", "Item", "p"), "p")


@query()
def sim_irt(spark, sf):
    n = table(spark, sf, "customer").count()
    return simulate.sim_irt(spark, n, 20, 2, answered=10)[0]


@query()
def sim_persons(spark, sf):
    return simulate.sim_persons(spark, table(spark, sf, "customer").count(), [[1.0, 0.5], [0.5, 1.0]], [0.0, 1.0], [1.0, 2.0])


@query()
def sim_items(spark, sf):
    return simulate.sim_items(spark, table(spark, sf, "part").count(), 2)


@query()
def sim_with_covariates(spark, sf):
    """Answers of simulated persons, one for each customer, to items; the parameters of both depend on covariates."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_acctbal") / 10_000).alias("balance"))
    bank = spark.range(1, 41).select(F.col("id").alias("Item"), (F.col("id") * 7 % 11 / 10).alias("price"))
    return simulate.sim_irt(spark, people.select("id"), 20, 2, answered=10, item_covariates=bank, item_effects={"B": {"price": 0.5}, "C": {"price": -0.2}}, person_covariates=people, ability_effects={1: {"balance": 0.8}, 2: {"balance": -0.3}}, normal=True)[0]


@query()
def cat_session(spark, sf):
    """Two rounds of adaptive testing of all persons: choose, answer, fit, append."""
    r = responses(spark, sf)
    truth = abilities(r).withColumnRenamed("ability", "true")
    draw = lambda rows, n: simulate.answer(rows.join(truth, ["id", "Scale"], "left").withColumn("own", F.col("ability")).withColumn("ability", F.coalesce("true", F.lit(0.0))), F.pmod(F.xxhash64("id", "Item", F.lit(n)), F.lit(1000)) / 1000).withColumn("ability", F.col("own"))
    log, _ = adaptive.session(r.select("id").distinct(), items(r).drop("brand"), draw, 2)
    return log


_REMAIN = '(select p.id, I.* from (select distinct id from R) p, I where not exists (select 1 from R where R.id = p.id and R."Item" = I."Item" and u < 0.5))'


def _candidates(spark, sf):
    r = responses(spark, sf)
    return adaptive.remaining_items(r.select("id").distinct(), items(r), r.where("u < 0.5")), abilities(r)


@query(f'select id, "Item" from {_REMAIN}')
def cat_remaining_items(spark, sf):
    return _candidates(spark, sf)[0].select("id", "Item")


@query(f"""select id, "Item", k as rank from (select id, "Item", cast(row_number() over (partition by id order by round(d1 * d1 / (p * (1 - p)), 12) desc, "Item") as integer) as k from (
  select id, "Item", A * (D - C) * s * (1 - s) as d1, C + (D - C) * s as p from (select m.*, 1 / (1 + exp(-A * (ability - B))) as s from {_REMAIN} m join T on T.id = m.id and T."Scale" = m."Scale"))) where k <= 3""")
def cat_next_item(spark, sf):
    c, t = _candidates(spark, sf)
    return adaptive.next_items(c.join(t, ["id", "Scale"]), 3).select("id", "Item", "rank")
