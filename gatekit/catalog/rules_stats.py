"""Queries over rule importance, intervals, tests, fitted weights and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import array_sum, clip01, hash_uniform, r6
from ..operators import compose as X
from ..operators import fit as FT
from ..operators import models as MD
from ..operators import prepare as P
from ..operators import rules as RU
from ..operators import stats as ST
from ..session import materialised
from ..sources import views as V
from . import sql as S
from .registry import query
from .reports import rounded
from .routes import METHODS

_THETA = "[" + ", ".join(S.num(t) for t in V.THETA) + "]"
_RULES = f"""emb as (select vec_id, label, (label >= 5)::int as y, [x::double for x in embedding] as h from embeddings),
th as (select {_THETA} as theta),
long as (select vec_id, y, unnest(range(64)) as rule, h from emb),
parts as (select vec_id, y, rule, h[rule + 1] as hv, h[rule + 1] * theta[rule + 1] as part, theta[rule + 1] as t from long, th),
full_z as (select vec_id, y, list_reduce(list_prepend(0e0, list(part order by rule)), lambda a, b: a + b) as z from parts group by 1, 2),
pr as (select q.vec_id, q.y, rule, hv, part, t, z, z >= 0 as fu, z - part >= 0 as wo from parts q join full_z f on q.vec_id = f.vec_id)"""
_F1 = "case when 2 * {tp} + {fp} + {fn} = 0 then 0e0 else 2 * {tp} / (2 * {tp} + {fp} + {fn})::double end"


def _f1(which: str, w: str = "1") -> str:
    return _F1.format(
        tp=f"sum(case when y = 1 and {which} then {w} else 0 end)", fp=f"sum(case when y = 0 and {which} then {w} else 0 end)",
        fn=f"sum(case when y = 1 and not {which} then {w} else 0 end)",
    )


_LOFO = S.ctes(_RULES) + f""", lf as (select rule::bigint as rule, {_f1('fu')} as baseline_f1, {_f1('wo')} as f1_without, any_value(t) as theta, avg(abs(hv)) as mean_abs_activation from pr group by rule),
lofo as (select *, baseline_f1 - f1_without as delta_f1, row_number() over (order by round(baseline_f1 - f1_without, 12) desc, mean_abs_activation desc, rule) as rk from lf)"""


@query(
    "rule_importance_lofo",
    _LOFO + "select rule, round(baseline_f1, 6) as baseline_f1, round(f1_without, 6) as f1_without, round(theta, 6) as theta, round(mean_abs_activation, 6) as mean_abs_activation, round(delta_f1, 6) as delta_f1 from lofo",
)
def rule_importance_lofo(spark, sf):
    return rounded(RU.rule_importance_lofo(V.embeddings(spark, sf), V.THETA))


@query(
    "rule_importance_weighted",
    S.ctes(_RULES) + f"select rule::bigint as rule, round({_f1('fu', '(1 + vec_id % 3)')}, 6) as baseline_f1, round({_f1('wo', '(1 + vec_id % 3)')}, 6) as f1_without from pr group by rule",
)
def rule_importance_weighted(spark, sf):
    rows = V.embeddings(spark, sf).withColumn("w", 1 + F.col("vec_id") % 3)
    return rounded(RU.rule_importance_lofo(rows, V.THETA, weight="w").select("rule", "baseline_f1", "f1_without"))


_MAG = ", mg as (select rule::bigint as rule, avg(abs(hv)) as m, abs(any_value(t)) * avg(abs(hv)) as magnitude from pr group by rule), mgr as (select *, row_number() over (order by magnitude desc, rule) as rk from mg)"


@query("rule_importance_magnitude", S.ctes(_RULES) + _MAG + "select rule, round(m, 6) as mean_abs_activation, round(magnitude, 6) as magnitude from mgr")
def rule_importance_magnitude(spark, sf):
    return rounded(RU.rule_importance_magnitude(V.embeddings(spark, sf), V.THETA))


_BOOT = S.ctes(_RULES) + f""", bw as (select vec_id, rep, {S.poisson('u')} as w from (select vec_id, rep, {S.uniform(42, 'rep', 'vec_id')} as u from (select distinct vec_id from pr), (select unnest(range(50)) as rep))),
bf as (select rep, rule, {_f1('fu', 'w')} - {_f1('wo', 'w')} as delta, sum(w * abs(hv)) / sum(w) as m from pr join bw using (vec_id) group by rep, rule),
br as (select *, row_number() over (partition by rep order by round(delta, 12) desc, round(m, 12) desc, rule) as rk from bf),
bt as (select rule::bigint as rule, avg(delta) as mean_delta_f1, stddev_pop(delta) as std_delta_f1, avg((rk <= 6)::int) as top_frequency, avg(rk) as mean_rank from br group by rule)"""


@query(
    "rule_importance_bootstrap",
    _BOOT + "select rule, round(mean_delta_f1, 6) as mean_delta_f1, round(std_delta_f1, 6) as std_delta_f1, round(top_frequency, 6) as top_frequency, round(mean_rank, 6) as mean_rank from bt",
)
def rule_importance_bootstrap(spark, sf):
    return rounded(RU.rule_importance_bootstrap(V.embeddings(spark, sf), V.THETA, "vec_id"))


@query(
    "subset_f1",
    _LOFO + f""", sz as (select p.vec_id, p.y, sum(case when rk <= 12 then part else 0e0 end) >= 0 as q from pr p join lofo l on p.rule = l.rule group by 1, 2)
select round({_f1('q')}, 6) as f1 from sz""",
)
def subset_f1(spark, sf):
    rows = V.embeddings(spark, sf)
    top = RU.top_rules(RU.rule_importance_lofo(rows, V.THETA), 12)
    return rounded(RU.subset_f1(rows, V.THETA, top))


@query(
    "set_jaccard",
    _LOFO + _MAG + """select round((select count(*) from lofo l join mgr m on l.rule = m.rule where l.rk <= 12 and m.rk <= 12)
    / (select count(*) from (select rule from lofo where rk <= 12 union select rule from mgr where rk <= 12))::double, 6) as jaccard""",
)
def set_jaccard(spark, sf):
    rows = V.embeddings(spark, sf)
    a = RU.top_rules(RU.rule_importance_lofo(rows, V.THETA), 12)
    b = RU.top_magnitude(RU.rule_importance_magnitude(rows, V.THETA), 12)
    return rounded(RU.set_jaccard(a, b))


# --- intervals and tests ---------------------------------------------------------------------------

_EVENTS = {
    "action_diff": "action_f0 <> action_nas",
    "accept_to_block": "action_f0 = 'accept' and action_nas = 'block'",
    "false_auto_f0": "action_f0 = 'accept' and (y_true <> y_pred or chi_r)",
    "false_auto_nas": "action_nas = 'accept' and (y_true <> y_pred or chi_r)",
    "false_block_f0": "action_f0 = 'block' and y_true = y_pred and not chi_r and p < 0.35",
    "false_block_nas": "action_nas = 'block' and y_true = y_pred and not chi_r and p < 0.35",
    "critical": "chi_r_crit",
    "critical_blocked": "chi_r_crit and action_nas = 'block'",
}
_SUMS = ", ".join(f"sum({k}) as {k}" for k in _EVENTS)


def _unpivot(src: str) -> str:
    parts = [f"select '{k}' as metric, {k} / n::double as v from {src}" for k in ST.CONFLICT_SHARES]
    parts.append(f"select 'recall_critical' as metric, critical_blocked / greatest(1, critical)::double as v from {src}")
    return " union all ".join(parts)


_BOOT_CI = S.CONFLICTS + ", fl as (select case_id, object_id, 1 as n, " + ", ".join(f"({c})::int as {k}" for k, c in _EVENTS.items()) + f""" from conf),
ob as (select object_id, sum(n) as n, {_SUMS} from fl group by object_id),
{S.bootstrap('fl', ['n', *_EVENTS], 'wc')},
{S.bootstrap('ob', ['n', *_EVENTS], 'wo')},
tt as (select sum(n) as n, {_SUMS} from ob), lc as ({_unpivot('wc')}), lo as ({_unpivot('wo')}), le as ({_unpivot('tt')}),
ic as (select metric, quantile_cont(v, 0.025e0) as a, quantile_cont(v, 0.975e0) as b from lc group by 1), io as (select metric, quantile_cont(v, 0.025e0) as a, quantile_cont(v, 0.975e0) as b from lo group by 1)
select le.metric, round(le.v, 6) as estimate, round(ic.a, 6) as case_low, round(ic.b, 6) as case_high, round(io.a, 6) as object_low, round(io.b, 6) as object_high
    from le join ic on le.metric = ic.metric join io on le.metric = io.metric"""


@query("bootstrap_ci", _BOOT_CI)
def bootstrap_ci(spark, sf):
    return rounded(ST.bootstrap_ci(V.conflict_cases(spark, sf)))


def _mcnemar_sql(a: str, b: str) -> str:
    return S.CONFLICTS + f""", x as (select object_id, chi_r_crit, ({a}) = 'block' as ba, ({b}) = 'block' as bb from conf),
ob as (select object_id, count(*) as n, count(*) filter (where chi_r_crit and not ba and bb) as g, count(*) filter (where chi_r_crit and ba and not bb) as l, sum(bb::int) - sum(ba::int) as diff from x group by 1),
t as (select sum(n) as n, sum(g)::bigint as g, sum(l)::bigint as l, sum(diff) as diff from ob),
{S.bootstrap('ob', ['n', 'diff'], 'bw')},
bs as (select rep, diff / n::double as e from bw),
pv as (select sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2e0))) * 2 as p from (select g + l as m, unnest(range(least(g, l) + 1)) as k from t))
select (g + l)::bigint as n_discordant, round(case when g + l = 0 then 1e0 else least(1e0, p) end, 6) as p_value, round(diff / n::double, 6) as effect_size,
    round((select quantile_cont(e, 0.025e0) from bs), 6) as ci_low, round((select quantile_cont(e, 0.975e0) from bs), 6) as ci_high from t, pv"""


@query("mcnemar", _mcnemar_sql("action_f0", "action_nas"))
def mcnemar(spark, sf):
    return rounded(ST.mcnemar(V.conflict_cases(spark, sf), "action_f0", "action_nas"))


_SHIFTED = S.ladder(S.clip("rho_fml + 0.1e0 * (case_id % 7 - 3)"), (0.25, 0.45, 0.65, 0.82))


@query("mcnemar_close", _mcnemar_sql(METHODS["B6_equal_structure"], _SHIFTED))
def mcnemar_close(spark, sf):
    """Two gates that differ in both directions, so that the p-value is not zero."""
    from ..functions import gates as G

    cases = V.conflict_cases(spark, sf)
    b6 = G.zone_ladder(
        clip01(0.50 * F.col("p") + 0.20 * F.col("u_m") + 0.20 * (1.0 - F.col("i_pre")) + 0.10 * F.col("delta_m")), G.CONFLICT_THETAS
    )
    shifted = G.zone_ladder(clip01(F.col("rho_fml") + 0.1 * (F.col("case_id") % 7 - 3)), G.CONFLICT_THETAS)
    return rounded(ST.mcnemar(cases.withColumn("b6", b6).withColumn("shifted", shifted), "b6", "shifted"))


def _triple_sql(p: str) -> list[str]:
    return [f"greatest(0e0, 1 - {p})", f"greatest(0e0, 1 - abs({p} - 0.5) / 0.25e0)", f"greatest(0e0, {p})"]


def _bits(p: str) -> str:
    m = _triple_sql(p)
    t = "(" + " + ".join(m) + ")"
    return "-(" + " + ".join(f"({v} / {t}) * log2(greatest({v} / {t}, 1e-12))" for v in m) + ")"


_PAIR = f"""emb as (select vec_id, [x::double for x in embedding] as h from embeddings),
twin as (select vec_id, f, h[f + 1] as a, h[f + 1] + 0.03e0 * 1e0 * (2e0 * {S.uniform(42, 'vec_id', 'f')} - 1) as b from (select vec_id, unnest(range(64)) as f, h from emb)),
rk as (select *, row_number() over (partition by vec_id order by abs(a) desc, f) as ra, row_number() over (partition by vec_id order by abs(b) desc, f) as rb from twin),
pd as (select vec_id, {S.clip('0.5e0 + sum(a order by f) / 2')} as pa, {S.clip('0.5e0 + sum(b order by f) / 2')} as pb,
    1 - count(*) filter (where ra <= 5 and rb <= 5) / (count(*) filter (where ra <= 5 or rb <= 5))::double as k from rk group by vec_id),
dist as (select vec_id, abs({_bits('pa')} - {_bits('pb')}) as h, abs(greatest({", ".join(_triple_sql('pa'))}) - greatest({", ".join(_triple_sql('pb'))})) + abs(pa - pb) as o, k from pd)"""


def _pair_rows(spark, sf):
    rows = V.embeddings(spark, sf)
    ones = F.transform("h", lambda _: F.lit(1.0))
    rows = rows.withColumn("x1", ST.perturb(F.col("h"), ones, F.col("vec_id")))
    rows = rows.select(
        "vec_id", "h", "x1", clip01(0.5 + array_sum(F.col("h")) / 2).alias("pa"), clip01(0.5 + array_sum(F.col("x1")) / 2).alias("pb")
    )
    return ST.pair_distances(rows, "pa", "pb", "h", "x1")


@query("pair_distances", S.ctes(_PAIR) + "select vec_id, round(h, 6) as h_distance, round(o, 6) as o_distance, round(k, 6) as k_distance from dist")
def pair_distances(spark, sf):
    return rounded(_pair_rows(spark, sf).select("vec_id", "h_distance", "o_distance", "k_distance"))


@query(
    "distance_constants",
    S.ctes(_PAIR) + """select 'c_H' as constant, round(quantile_cont(h, 0.95e0), 6) as value, count(*)::bigint as n_pairs from dist union all
    select 'c_O', round(quantile_cont(o, 0.95e0), 6), count(*)::bigint from dist union all select 'c_K', round(quantile_cont(k, 0.95e0), 6), count(*)::bigint from dist""",
)
def distance_constants(spark, sf):
    return rounded(ST.distance_constants(_pair_rows(spark, sf)))


# --- fitted weights and models -----------------------------------------------------------

def beta_pairs(spark, sf):
    """Component gaps of the explanation pairs with a score that depends on them."""
    from ..functions import disagreement as DG
    from ..functions.fuzzy import active_rules
    from ..functions.representation import representation_distance

    pairs = V.explanation_pairs(spark, sf)
    l, r = X.side("l"), X.side("r")
    gaps = pairs.select(
        "case_id",
        representation_distance(l["representation"], r["representation"]).alias("repr"),
        DG.jaccard_gap(active_rules(l["rules"], l["activations"]), active_rules(r["rules"], r["activations"])).alias("rules"),
        DG.activation_gap(l["activations"], r["activations"]).alias("activations"),
        F.abs(l["uncertainty"] - r["uncertainty"]).alias("uncertainty"),
        DG.trace_gap(l["trace"], r["trace"]).alias("trace"),
        F.least(F.lit(1.0), l["reduction_loss"] + r["reduction_loss"]).alias("reduction"),
    )
    score = 0.4 * F.col("repr") + 0.1 * F.col("rules") + 0.2 * F.col("activations") + 0.2 * F.col("uncertainty") + 0.1 * F.col("trace")
    return gaps.withColumn("expert_score", clip01(score))


_GAPS = {
    "repr": "g_repr", "rules": "g_rules", "activations": "g_act", "uncertainty": "abs(ul - ur)", "trace": "g_trace", "reduction": "least(1e0, delta_r)",
}
_TARGET = S.clip("0.4e0 * g_repr + 0.1e0 * g_rules + 0.2e0 * g_act + 0.2e0 * abs(ul - ur) + 0.1e0 * g_trace")
_MOMENT_COLUMNS = [*_GAPS, "expert_score"]
_MOMENTS = [(a, b) for i, a in enumerate(_MOMENT_COLUMNS) for b in _MOMENT_COLUMNS[i:]]


# The pairs with their fold, for all queries on the fit of the weights.
_GAP_ROWS = S.PAIRED.rstrip().replace("with ", "with recursive ", 1) + f""", gp as (select case_id, floor({S.uniform(42, "case_id")} * 5)::bigint as fold,
    {", ".join(f"{v} as {k}" for k, v in _GAPS.items())}, {_TARGET} as expert_score from pairs),
"""
_N, _L2 = len(FT.FEATURES), 1e-3


def _simplex(held_out: bool) -> str:
    """CTEs up to fit (fold, i, w): the weights on the simplex by elimination on every choice of features, for all rows, or for the rows outside each fold.

    A choice keeps its features' rows of the optimality equations and puts `weight = 0` for the others, so all have one
    shape; the sum of the weights comes last, as the pivots before it are then positive.
    """
    products = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': sum({a} * {b})}}" for i, a in enumerate(FT.FEATURES) for j, b in enumerate([*FT.FEATURES, "expert_score"]))
    by_fold = f"own as (select fold, n, p.i, p.j, p.v from (select fold, count(*) as n, unnest([{products}]) as p from gp group by fold)),\n"
    others = "(select i, j, sum(v) as v, sum(n) as n from own group by i, j)"
    if held_out:
        learned = f"mo as (select o.fold, o.i, o.j, t.v - o.v as v, t.n - o.n as n from own o join {others} t using (i, j)),\n"
    else:
        learned = f"mo as (select 0 as fold, i, j, v, n from {others}),\n"
    last = _N
    return by_fold + learned + f"""cell as (select fold, i, j, 2e0 / n * v + case when i = j then {2 * _L2} else 0e0 end as v from mo),
face as (select s::int as s from range(1, {2**_N}) t(s)),
e0 as (select fold, s, i, case when j = {_N} then {_N + 1} else j end as j,
        case when j = {_N} then (s >> i & 1) * v when (s >> i & 1) + (s >> j & 1) = 2 then v else (i = j)::int end as v from cell, face
    union all select fold, s, i, {last}, s >> i & 1 from cell, face where j = {_N}
    union all select fold, s, {last}, i, s >> i & 1 from cell, face where j = {_N}
    union all select fold, s, {last}, j, (j > {last})::int from (select distinct fold from cell), face, range({last}, {last + 2}) t(j)),
el as (select 0 as k, fold, s, i::int as i, j::int as j, v::double as v from e0
    union all select k + 1, fold, s, i, j, case when i = k then r / d else v - c * r / d end from (select *,
        max(case when i = k and j = k then v end) over (partition by fold, s) as d, max(case when i = k then v end) over (partition by fold, s, j) as r,
        max(case when j = k then v end) over (partition by fold, s, i) as c from el where k <= {last})),
so as (select fold, s, i, v from el where k = {last + 1} and j = {last + 1}),
ob as (select so.fold, s, -(sum(case when so.i < {_N} then so.v * g.v else so.v end)) / 2 as error from so left join (select fold, i, v from cell where j = {_N}) g on g.fold = so.fold and g.i = so.i
    group by 1, 2 having min(case when so.i < {_N} then so.v end) >= -1e-12),
fit as (select so.fold, i, greatest(so.v, 0e0) as w from so join (select fold, arg_min(s, error) as s from ob group by fold) using (fold, s) where i < {_N})
"""


_NAMED = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FT.FEATURES))


@query(
    "beta_moments",
    S.PAIRED.rstrip() + ", gp as (select floor(" + S.uniform(42, "case_id") + " * 5)::bigint as fold, " + ", ".join(f"{v} as {k}" for k, v in _GAPS.items())
    + f", {_TARGET} as expert_score from pairs) select fold, count(*)::bigint as n, " + ", ".join(f"round(sum({a} * {b}), 6) as {a}_{b}" for a, b in _MOMENTS) + " from gp group by fold",
)
def beta_moments(spark, sf):
    """What the fit of the weights reads from the pairs: sums of products per fold."""
    tagged = beta_pairs(spark, sf).withColumn("fold", F.floor(hash_uniform(42, F.col("case_id")) * 5))
    sums = FT.moments(tagged, "expert_score", by=["fold"])
    return sums.select("fold", "n", *[r6(F.col(f"`{a}*{b}`")).alias(f"{a}_{b}") for a, b in _MOMENTS])


@query(
    "fit_beta_optimality",
    _GAP_ROWS + _simplex(False) + f""", sl as (select c.i, any_value(f.w) as w, sum(case when c.j < {_N} then c.v * o.w else -c.v end) as slope
    from cell c join fit f on f.i = c.i left join fit o on o.i = c.j group by c.i),
lv as (select *, sum(slope * w) over () as level, sum(w) over () as total from sl)
select feature, w between -1e-4 and 1 + 1e-4 as in_range, case when w > 1e-4 then abs(slope - level) <= 1e-4 else slope >= level - 1e-4 end as optimal,
    abs(total - 1) <= 1e-4 as sums_to_one from lv join (values {_NAMED}) v(i, feature) using (i)""",
)
def fit_beta_optimality(spark, sf):
    """Whether the fitted weights meet the conditions of the optimum on the simplex, weight by weight."""
    pairs = beta_pairs(spark, sf)
    sums = FT.moment_sums(pairs)
    return FT.beta_optimality(pairs, FT.fit_beta(pairs, sums=sums), sums=sums)


@query("fit_beta", _GAP_ROWS + _simplex(False) + f"select feature, round(w, 6) as weight from fit join (values {_NAMED}) v(i, feature) using (i)")
def fit_beta(spark, sf):
    return rounded(FT.fit_beta(beta_pairs(spark, sf)))


@query(
    "cv_beta",
    _GAP_ROWS + _simplex(True) + f""", wt as (select fold, list(w order by i) as w from fit group by fold),
pd as (select fold, expert_score as a, {" + ".join(["0e0", *[f"{f} * w[{i + 1}]" for i, f in enumerate(FT.FEATURES)]])} as b, ({" + ".join(FT.FEATURES)}) / {_N}e0 as even from gp join wt using (fold)),
rk as (select *, rank() over (partition by fold order by a) + (count(*) over (partition by fold, a) - 1) / 2e0 as ra,
    rank() over (partition by fold order by b) + (count(*) over (partition by fold, b) - 1) / 2e0 as rb from pd)
select fold::int as fold, (select count(*) from gp)::bigint - count(*)::bigint as n_train, count(*)::bigint as n_test, round(avg((a - even) ** 2), 6) as mse_base, round(avg((a - b) ** 2), 6) as mse_calibrated,
    round(case when stddev_pop(ra) = 0 or stddev_pop(rb) = 0 then 0e0 else corr(ra, rb) end, 6) as spearman from rk group by fold""",
)
def cv_beta(spark, sf):
    return rounded(FT.cv_beta(beta_pairs(spark, sf), "case_id"))


_MODEL_FEATURES = ("quantity", "extendedprice", "discount", "tax")


def _split(spark, sf):
    """What the models read of the cases, with the part of each: stored, for a fit reads it many times."""
    rows = V.cases(spark, sf).select("case_id", "y_true", *_MODEL_FEATURES)
    return materialised(P.stratified_split(rows, "y_true", ["case_id"]))


def _model(spark, sf, kind, **args):
    rows = _split(spark, sf)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    out = MD.fit_and_observe(train, test, _MODEL_FEATURES, "y_true", kind, **args)
    return out.select("case_id", "split", "y_true", "y_pred", r6(F.col("p")).alias("p"), "action", r6(F.col("rho")).alias("rho"))


@query("logistic_score_equations", " union all ".join(f"select '{f}' as term, true as solved" for f in ("intercept", *_MODEL_FEATURES)))
def logistic_score_equations(spark, sf):
    """Whether the fitted coefficients solve the equations of the likelihood: residuals are orthogonal to every feature."""
    rows = _split(spark, sf)
    train = rows.where(F.col("split") == "train")
    scored = MD.score_risk_model(MD.fit_risk_model(train, _MODEL_FEATURES, "y_true", "logistic_regression"), train)
    residual = F.col("y_true") - F.col("p")
    terms = {"intercept": F.lit(1.0), **{f: F.col(f) for f in _MODEL_FEATURES}}
    shares = [F.struct(F.lit(k).alias("term"), (F.abs(F.sum(residual * x)) <= 1e-3 * F.sum(F.abs(residual * x))).alias("solved")) for k, x in terms.items()]
    return scored.agg(F.array(*shares).alias("terms")).select(F.inline("terms"))


@query(
    "forest_scores_every_row",
    S.ctes(S.CASES) + f""", h as (select y_true, {S.uniform(42, "case_id")} as u from cases),
r as (select *, rank() over (partition by y_true order by u) - 1 as k, count(*) over (partition by y_true) as n from h)
select case when k < ceil(n * 0.25e0) then 'test' else 'validation' end as split, y_true::bigint as y_true, count(*)::bigint as n, count(*)::bigint as in_range, count(*)::bigint as gated from r where k < ceil(n * 0.4375e0) group by 1, 2""",
)
def forest_scores_every_row(spark, sf):
    """Rows of the held-out parts, those with a probability, and those whose action is the gate's at that probability."""
    rows = _split(spark, sf)
    out = MD.fit_and_observe(rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train"), _MODEL_FEATURES, "y_true", "random_forest", trees=20)
    again = MD.gate_of(out.select("case_id", "split", "y_true", "p", "proba", F.col("action").alias("given")))
    return again.groupBy("split", F.col("y_true").cast("long").alias("y_true")).agg(
        F.count("*").alias("n"), F.count_if(F.col("p").between(0.0, 1.0)).alias("in_range"), F.count_if(F.col("given") == F.col("action")).alias("gated")
    )


@query("fit_risk_model_logistic")
def fit_risk_model_logistic(spark, sf):
    return _model(spark, sf, "logistic_regression")


@query("fit_risk_model_forest")
def fit_risk_model_forest(spark, sf):
    return _model(spark, sf, "random_forest")
