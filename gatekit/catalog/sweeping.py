"""Queries over ablations, sensitivity sweeps and calibration."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.numeric import r6, r6_scaled
from ..operators import prepare as P
from ..operators import sweeps as W
from ..plans.plan import RISK_TERMS, RISK_WEIGHTS, risk_shares
from ..session import materialised
from ..sources import views as V
from . import sql as S
from .registry import query
from .reports import OBJECTIVE_J, OBJECTIVE_SQL, rounded
from .routes import labelled, routes

_ABL_MODES = ", ".join(f"('{m}')" for m in W.ABLATION_MODES)
_ABL = S.EVALUATION + f""", x as (select p, u, i, auto, mode, mode <> 'no_trace' and chi_r as chi_r, mode <> 'no_trace' and chi_r_crit as chi_r_crit,
    case mode when 'no_delta' then 0e0 when 'f0_only' then greatest(0.25e0, d) else d end as d from ev, (values {_ABL_MODES}) m(mode)),
y as (select *, {S.clip("0.4e0 * p + 0.2e0 * u + 0.15e0 * (1 - i) + 0.1e0 * d + 0.15e0 * chi_r::int")} as rho from x),
z1 as (select *, case when rho < 0.10 then 'accept' when rho < 0.25 then 'lower_confidence' when rho < 0.50 then 'request_more_data' else 'defer_to_human' end as a1 from y),
z2 as (select *, case when u >= 0.45 and a1 = 'accept' then 'lower_confidence' else a1 end as a2 from z1),
z3 as (select *, case when chi_r and a2 = 'accept' then 'request_more_data' else a2 end as a3 from z2),
z4 as (select *, case when mode = 'probability_threshold' then case when p >= 0.80 then 'defer_to_human' when p >= 0.35 then 'lower_confidence' else 'accept' end
    when mode <> 'no_critical_rupture' and chi_r_crit then 'block' when mode <> 'no_topos' and a3 in ('accept', 'lower_confidence') and not auto then 'request_more_data' else a3 end as action,
    {S.proxy()} as proxy from z3)
select mode, count(*)::bigint as n, round(avg((action = proxy)::int), 6) as agreement_proxy, count(*) filter (where chi_r_crit and action <> 'block')::bigint as missed_critical,
    round(case when count(*) filter (where chi_r_crit) = 0 then 1e0 else count(*) filter (where chi_r_crit and action = 'block') / (count(*) filter (where chi_r_crit))::double end, 6) as critical_recall,
    round(avg((action in ('accept', 'lower_confidence') and not auto)::int), 6) as false_auto_accept_rate, round(avg((action = 'block' and not chi_r_crit)::int), 6) as false_block_rate,
    round(avg((action in ('accept', 'lower_confidence'))::int), 6) as auto_coverage, round(avg(d), 6) as mean_reduction_loss from z4 group by mode"""


@query("ablation_modes", _ABL)
def ablation_modes(spark, sf):
    return rounded(W.ablation_modes(V.evaluation_rows(spark, sf)))


_VARIANTS = {
    "full": "rho", "without_gamma": "delta", "without_delta": "gamma", "without_quality_component": "greatest(gamma, delta)",
    "without_representation_selection": "rho", "without_verifier": "rho",
}


@query(
    "route_ablation",
    S.ROUTED
    + ", v as (" + " union all ".join(f"select '{k}' as variant, {e} as x, action from routes" for k, e in _VARIANTS.items()) + f""")
select variant, count(*) filter (where {S.zone3('x')} <> action)::bigint as changed_actions, round(avg(x), 6) as mean_rho from v group by variant""",
)
def route_ablation(spark, sf):
    return W.route_ablation(routes(spark, sf))


@query(
    "route_ablation_wide",
    S.ROUTED
    + f"""select case_id, action as base_action, {S.zone3('delta')} as action_without_gamma, {S.zone3('gamma')} as action_without_delta, {S.zone3('greatest(gamma, delta)')} as action_without_quality_component,
    {S.zone3('delta')} <> action or {S.zone3('gamma')} <> action or {S.zone3('greatest(gamma, delta)')} <> action as action_changed from routes""",
)
def route_ablation_wide(spark, sf):
    return W.route_ablation_wide(routes(spark, sf))


_TH = (0.25, 0.45, 0.65, 0.82)


def _variant_sql(name: str, sources) -> str:
    chi = "(" + " or ".join(sources) + ")"
    crit = "false" if name == "without_critical_flag" else "chi_r_crit"
    return f"select *, '{name}' as mode, {S.ladder(S.clip(f'0.55e0 * p + 0.25e0 * u_m + 0.2e0 * {chi}::int'), _TH, crit)} as action from conf"


@query(
    "conflict_ablation",
    S.CONFLICTS
    + ", v as (select *, 'full' as mode, action_nas as action from conf union all "
    + " union all ".join(_variant_sql(n, s) for n, s in W.CONFLICT_VARIANTS.items())
    + f""" union all select *, 'f0_only', action_f0 from conf)
select *, {OBJECTIVE_J} from (select mode, {OBJECTIVE_SQL}, round(avg((action <> action_nas)::int), 6) as effect_vs_full from v group by mode)""",
)
def conflict_ablation(spark, sf):
    return rounded(W.conflict_ablation(V.conflict_cases(spark, sf)))


@query(
    "sensitivity_grid",
    S.ctes(S.CASES)
    + f""", g as (select round(greatest(round(greatest(1 - p, m), 6), d), 6) as rho, m, d from cases, (values (0e0), (0.1e0), (0.2e0), (0.4e0)) a(m), (values (0.1e0), (0.3e0), (0.5e0), (0.7e0)) b(d))
select m as missing_rate, d as delta, count(*)::bigint as n, count(*) filter (where {S.zone3('rho')} = 'accept')::bigint as n_accept,
    count(*) filter (where {S.zone3('rho')} = 'lower_confidence')::bigint as n_lower_confidence, count(*) filter (where {S.zone3('rho')} = 'audit')::bigint as n_audit, round(avg(rho), 6) as mean_rho from g group by 1, 2""",
)
def sensitivity_grid(spark, sf):
    return rounded(W.sensitivity_grid(V.cases(spark, sf)))


def _values(name: str, values) -> str:
    cells = ", ".join(f"('{v}')" if isinstance(v, str) else f"({S.num(v)})" if isinstance(v, float) else f"({v})" for v in values)
    return f"(values {cells}) {name}_t({name})"


@query(
    "threshold_sweep",
    S.CONFLICTS
    + f""", s1 as (select *, y_true <> y_pred as wrong, topk_jaccard < theta_rank or sign_disagreement > 0 or conflict_rule as chi from conf, {_values('theta_rank', W.THETA_RANKS)}, {_values('crit_policy', W.CRIT_POLICIES)}),
s2 as (select *, case crit_policy when 'broad' then chi when 'medium' then (sign_disagreement > 0 and conflict_rule) or (chi and (p < 0.3 or p > 0.7)) else sign_disagreement > 0 and conflict_rule end as crit from s1),
s3 as (select *, {S.ladder(S.clip('0.55e0 * p + 0.25e0 * u_m + 0.2e0 * chi::int'), _TH, 'crit')} as action from s2),
s4 as (select theta_rank, crit_policy, round(avg(chi::int), 6) as share_conflicts, round(avg(crit::int), 6) as share_critical, round(avg((action <> action_f0)::int), 6) as share_action_diff,
    round(avg((action_f0 = 'accept' and action = 'block')::int), 6) as share_accept_to_block,
    round(count(*) filter (where crit and action = 'block') / greatest(1, count(*) filter (where crit))::double, 6) as recall_critical,
    count(*) filter (where action = 'accept' and (wrong or chi))::bigint as false_auto_accept, count(*) filter (where action = 'block' and not wrong and not chi and p < 0.35)::bigint as false_block from s3 group by 1, 2)
select s4.*, k_top::bigint as k_top, delta_max, gamma_max from s4, {_values('k_top', W.LABEL_GRID['k_top'])}, {_values('delta_max', W.LABEL_GRID['delta_max'])}, {_values('gamma_max', W.LABEL_GRID['gamma_max'])}""",
)
def threshold_sweep(spark, sf):
    out = rounded(W.threshold_sweep(V.conflict_cases(spark, sf)))
    return out.withColumn("k_top", F.col("k_top").cast("long"))


_WS_CONFIGS = [("w_diagnostic", w, 0.65, W._reweighted(RISK_WEIGHTS, w)) for w in W.SHARES_W] + [
    ("theta_high", t, t, risk_shares(RISK_WEIGHTS)) for t in W.THETAS_HIGH
]
_WS_VALUES = ", ".join(
    f"('{k}', {S.num(s)}, {S.num(t)}, " + ", ".join(S.num(w[n]) for n in RISK_TERMS) + ")" for k, s, t, w in _WS_CONFIGS
)


@query(
    "weight_sensitivity",
    S.EVALUATION
    + f""", x as (select *, {S.reference()} as expected, {S.clip('w1 * p + w2 * u + w3 * (1 - i) + w4 * d + w5 * chi_r::int')} as r2 from ev, (values {_WS_VALUES}) c(kind, setting, th, w1, w2, w3, w4, w5)),
y as (select kind, setting, {S.simple_gate('r2', 'u', 'p', 'chi_r', 'th')} as act, expected from x)
select kind, setting, round(avg((act = expected)::int), 6) as accuracy, round(avg((act = 'block')::int), 6) as block_rate from y group by 1, 2""",
)
def weight_sensitivity(spark, sf):
    rows = labelled(spark, sf).withColumnRenamed("reference_action", "expected_action")
    return rounded(W.weight_sensitivity(rows))


def _noise_rho(i: str) -> str:
    return S.clip(f"0.3e0 * p + 0.25e0 * u + 0.2e0 * (1 - {i}) + 0.15e0 * d + 0.1e0 * chi_r::int")


@query(
    "noise_sensitivity",
    S.EVALUATION
    + f""", x as (select *, {S.clip(f"i + amp * (2e0 * {S.uniform(11, 'case_id')} - 1)")} as i2 from ev, {_values('amp', W.NOISE_AMPS)}),
y as (select *, {S.simple_gate(_noise_rho('i'), 'u', 'p', 'chi_r')} as a0, {S.simple_gate(_noise_rho('i2'), 'u', 'p', 'chi_r')} as a1 from x)
select amp, round(avg(abs(i2 - i)), 6) as mean_abs_change, round(avg((a0 <> a1)::int), 6) as action_change_rate from y group by amp""",
)
def noise_sensitivity(spark, sf):
    return rounded(W.noise_sensitivity(V.evaluation_rows(spark, sf)))


# --- calibration -------------------------------------------------------------------------------

_WG = [risk_shares(w) for w in W.WEIGHT_GRID]
_GRID_SQL = (
    "(values " + ", ".join(f"({i}, " + ", ".join(S.num(w[n]) for n in RISK_TERMS) + ")" for i, w in enumerate(_WG)) + ") w(wi, w1, w2, w3, w4, w5), "
    "(values " + ", ".join(f"({i}, " + ", ".join(S.num(x) for x in t) + ")" for i, t in enumerate(W.LADDER_GRID)) + ") t(ti, t1, t2, t3, t4), "
    "(values " + ", ".join(f"({i}, {S.num(x)})" for i, x in enumerate(W.GAMMA_GRID)) + ") g(gi, gm), "
    "(values " + ", ".join(f"({i}, {S.num(x)})" for i, x in enumerate(W.I_MIN_GRID)) + ") im(ii, imin), "
    "(values " + ", ".join(f"({i}, {S.num(x)})" for i, x in enumerate(W.DELTA_MAX_GRID)) + ") dm(di, dmax), "
    "(values " + ", ".join(f"({i}, {S.num(x)})" for i, x in enumerate(W.U_MAX_GRID)) + ") um(ui, umax)"
)
# Equal cases are merged before the 972 configs; the score is the same, the brute force is smaller.
_CAL_METRICS = f""", mg as (select p, u, i, d, chi_r, chi_r_crit, auto, trace_ok, y_true <> y_pred as wrong, part, count(*) as n from src group by all),
x1 as (select *, chi_r or abs(p - i) > gm as r2, chi_r_crit or abs(p - i) > gm + 0.1e0 as c2 from mg, {_GRID_SQL}),
x2 as (select *, {S.clip('w1 * p + w2 * u + w3 * (1 - i) + w4 * d + w5 * r2::int')} as rho, auto and not c2 and trace_ok as a2 from x1),
x3 as (select *, {S.full_gate(r='r2', c='c2', a='a2', th=('t1', 't2', 't3', 't4'), imin='imin', dmax='dmax', umax='umax')} as action,
    {S.proxy(r='r2', c='c2')} as proxy, {S.reference(r='r2', c='c2', w='wrong')} as ref from x2),
m1 as (select part, wi, ti, gi, ii, di, ui, any_value(gm) as gamma_max, any_value(imin) as i_min, any_value(dmax) as delta_max, any_value(umax) as u_max, sum(n)::bigint as n,
    sum(case when action = proxy then n else 0 end) / sum(n)::double as agreement_proxy, sum(case when action = ref then n else 0 end) / sum(n)::double as agreement_reference,
    sum(case when c2 and action <> 'block' then n else 0 end)::bigint as missed_critical,
    case when sum(case when c2 then n else 0 end) = 0 then 1e0 else sum(case when c2 and action = 'block' then n else 0 end) / sum(case when c2 then n else 0 end)::double end as critical_recall,
    sum(case when action in ('accept', 'lower_confidence') and not auto then n else 0 end) / sum(n)::double as false_auto_accept_rate,
    sum(case when action = 'block' and not c2 then n else 0 end) / sum(n)::double as false_block_rate,
    sum(case when action in ('accept', 'lower_confidence') then n else 0 end) / sum(n)::double as auto_coverage from x3 group by part, wi, ti, gi, ii, di, ui),
m2 as (select *, ((((wi * 3 + ti) * 3 + gi) * 3 + ii) * 3 + di) * 3 + ui as config_id, agreement_reference - 5e0 * missed_critical - 2e0 * false_auto_accept_rate - false_block_rate
    - (case when missed_critical > 0 then 100e0 else 0e0 end + case when critical_recall < 1 then 100e0 else 0e0 end
    + case when false_auto_accept_rate > 0.1e0 then 20e0 * (false_auto_accept_rate - 0.1e0) else 0e0 end) as score from m1)"""
_CAL_OUT = """config_id::bigint as config_id, wi::bigint as weights, ti::bigint as ladder, gamma_max, i_min, delta_max, u_max, n, round(agreement_proxy, 6) as agreement_proxy,
    round(agreement_reference, 6) as agreement_reference, missed_critical, round(critical_recall, 6) as critical_recall, round(false_auto_accept_rate, 6) as false_auto_accept_rate,
    round(false_block_rate, 6) as false_block_rate, round(auto_coverage, 6) as auto_coverage, round(score, 6) as score"""


@query("calibrate_gate", S.EVALUATION + ", src as (select *, 'all' as part from ev)" + _CAL_METRICS + f" select {_CAL_OUT} from m2")
def calibrate_gate(spark, sf):
    return rounded(W.calibrate_gate(V.evaluation_rows(spark, sf)))


_SPLIT = S.EVALUATION + f""", h as (select *, {S.uniform(42, "case_id")} as uu from ev),
hr as (select *, rank() over (partition by y_true order by uu) - 1 as k, count(*) over (partition by y_true) as nn from h),
src as (select *, case when k < ceil(nn * 0.25e0) then 'test' when k < ceil(nn * 0.4375e0) then 'validation' else 'train' end as part from hr)"""


@query(
    "calibrate_before_after",
    _SPLIT + _CAL_METRICS
    + f""", best as (select config_id as cid from m2 where part = 'validation' order by round(score, 12) desc, config_id limit 1)
select {_CAL_OUT}, part from m2, best where config_id = cid and part in ('validation', 'test')""",
)
def calibrate_before_after(spark, sf):
    cases = V.evaluation_rows(spark, sf).select(
        "case_id", "p", "u", "interpretability", "reduction_loss", "chi_r", "chi_r_crit", "chi_auto", "trace_valid", "y_true", "y_pred"
    )
    # Stored, for the cuts, the search and the test read them.
    rows = materialised(P.stratified_split(materialised(cases), "y_true", ["case_id"]))
    out = W.calibrate_before_after(rows.where(F.col("split") == "validation"), rows.where(F.col("split") == "test"))
    return rounded(out)


def _draw(name: str) -> str:
    return S.uniform(42, "id", f"'{name}'")


_OW = W.OBJECTIVE_WEIGHTS
_MAN = [S.num(W.MANUAL[w]) for w in _OW]
_FIXED = sum(v for k, v in W.MANUAL.items() if k != "w_r")
_RAW = {w: f"(-ln(1e0 - {_draw(w)}))" for w in _OW}
_GRID_RAW = {w: f"(-ln(1e0 - {_draw(f'grid_{w}')}))" for w in _OW}
_CANDS = f"""cd as (
    select 'manual' as method, 0::bigint as idx, {_MAN[0]} as w_p, {_MAN[1]} as w_u, {_MAN[2]} as w_i, {_MAN[3]} as w_d, {_MAN[4]} as w_r, 0.25e0 as t1, 0.45e0 as t2, 0.65e0 as t3, 0.82e0 as t4
    union all select 'grid', (((a * 5 + b) * 5 + c) * 3 + d)::bigint, wp, wu, wi, wd, 1e0 - wp - wu - wi - wd, 0.2e0, 0.4e0, 0.6e0, 0.8e0 from
        (values (0, 0.05e0), (1, 0.1e0), (2, 0.2e0), (3, 0.3e0), (4, 0.4e0)) x1(a, wp), (values (0, 0.05e0), (1, 0.1e0), (2, 0.2e0), (3, 0.3e0), (4, 0.4e0)) x2(b, wu),
        (values (0, 0.05e0), (1, 0.1e0), (2, 0.2e0), (3, 0.3e0), (4, 0.4e0)) x3(c, wi), (values (0, 0.05e0), (1, 0.1e0), (2, 0.2e0)) x4(d, wd) where 1e0 - wp - wu - wi - wd >= 0
    union all select 'grid', 1000 + id, r1 / s, r2 / s, r3 / s, r4 / s, r5 / s, 0.2e0, 0.4e0, 0.6e0, 0.8e0 from (select id, r1, r2, r3, r4, r5, r1 + r2 + r3 + r4 + r5 as s from
        (select id, {_GRID_RAW['w_p']} as r1, {_GRID_RAW['w_u']} as r2, {_GRID_RAW['w_i']} as r3, {_GRID_RAW['w_d']} as r4, {_GRID_RAW['w_r']} as r5 from (select unnest(range(500)) as id)))
        where id < 500 - (select count(*) from (values (0.05e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) x1(wp), (values (0.05e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) x2(wu),
            (values (0.05e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) x3(wi), (values (0.05e0), (0.1e0), (0.2e0)) x4(wd) where 1e0 - wp - wu - wi - wd >= 0)
    union all select 'random', id, r1 / s, r2 / s, r3 / s, r4 / s, r5 / s, th[1], th[2], th[3], th[4] from
        (select id, r1, r2, r3, r4, r5, r1 + r2 + r3 + r4 + r5 as s, list_sort([0.12e0 + 0.8e0 * q1, 0.12e0 + 0.8e0 * q2, 0.12e0 + 0.8e0 * q3, 0.12e0 + 0.8e0 * q4]) as th from
        (select id, {_RAW['w_p']} as r1, {_RAW['w_u']} as r2, {_RAW['w_i']} as r3, {_RAW['w_d']} as r4, {_RAW['w_r']} as r5,
            {_draw('t1')} as q1, {_draw('t2')} as q2, {_draw('t3')} as q3, {_draw('t4')} as q4 from (select unnest(range(5000)) as id)))
    union all select 'coordinate', id, {_MAN[0]} / ({S.num(_FIXED)} + mv), {_MAN[1]} / ({S.num(_FIXED)} + mv), {_MAN[2]} / ({S.num(_FIXED)} + mv), {_MAN[3]} / ({S.num(_FIXED)} + mv), mv / ({S.num(_FIXED)} + mv), 0.25e0, 0.45e0, 0.65e0, 0.82e0
        from (select id, least(0.7e0, 0.2e0 + id / 1000e0) as mv from (select unnest(range(200)) as id)))"""
_CAL_OBJ = S.ctes(S.conflicts(), _CANDS) + f""", a1 as (select c.*, k.p, k.y_true, k.y_pred, k.chi_r, k.chi_r_crit, k.rho_nas,
    {S.ladder(S.clip('w_p * p + w_u * u_m + w_i * (1 - i_pre) + w_d * delta_m + w_r * chi_r::int'), ('t1', 't2', 't3', 't4'), 'chi_r_crit')} as action from conf k, cd c),
a2 as (select method, idx, any_value(w_p) as w_p, any_value(w_u) as w_u, any_value(w_i) as w_i, any_value(w_d) as w_d, any_value(w_r) as w_r, {OBJECTIVE_SQL},
    avg(least(abs(t1 - rho_nas), abs(t2 - rho_nas), abs(t3 - rho_nas), abs(t4 - rho_nas))) as margin from a1 group by method, idx),
a3 as (select *, {OBJECTIVE_J}, -(w_p * ln(w_p + 1e-12) + w_u * ln(w_u + 1e-12) + w_i * ln(w_i + 1e-12) + w_d * ln(w_d + 1e-12) + w_r * ln(w_r + 1e-12)) as weight_entropy from a2)"""


def _objective_scores(spark, sf):
    return W.calibrate_by_objective(V.conflict_cases(spark, sf), W.objective_candidates(spark))


@query(
    "calibrate_by_objective",
    _CAL_OBJ + """select method, idx, round(w_r, 6) as w_r, missed_critical, false_auto_accept, unsafe_accept, false_block, excessive_defer, objective, round(weight_entropy, 6) as weight_entropy, round(margin, 6) as margin from a3""",
)
def calibrate_by_objective(spark, sf):
    out = _objective_scores(spark, sf)
    return out.select(
        "method", "idx", r6(F.col("w_r")).alias("w_r"), "missed_critical", "false_auto_accept", "unsafe_accept", "false_block", "excessive_defer", "objective",
        r6(F.col("weight_entropy")).alias("weight_entropy"), r6(F.col("margin")).alias("margin"),
    )


@query(
    "best_objective",
    _CAL_OBJ + """select method, idx, objective, round(weight_entropy, 6) as weight_entropy from a3 order by objective, missed_critical, false_auto_accept, unsafe_accept, false_block, excessive_defer,
    round(weight_entropy, 9), round(-margin, 9), method, idx limit 1""",
)
def best_objective(spark, sf):
    best = W.best_objective(_objective_scores(spark, sf))
    return best.select("method", "idx", "objective", r6(F.col("weight_entropy")).alias("weight_entropy"))


@query("zero_loss_count", _CAL_OBJ + "select method, count(*)::bigint as n_candidates, count(*) filter (where objective = 0)::bigint as n_zero_loss from a3 group by method")
def zero_loss_count(spark, sf):
    return W.zero_loss_count(_objective_scores(spark, sf))


_SIMPLEX = S.EVALUATION + f""", mg as (select p, u, i, d, chi_r, {S.reference()} as expected, count(*) as n from ev group by all),
gr as (select a / 20e0 as w1, b / 20e0 as w2, c / 20e0 as w3, e / 20e0 as w4, (20 - a - b - c - e) / 20e0 as w5 from (select unnest(range(1, 17)) as a), (select unnest(range(1, 17)) as b), (select unnest(range(1, 17)) as c), (select unnest(range(1, 17)) as e)
    where a + b + c + e <= 19),
y as (select *, {S.clip('w1 * p + w2 * u + w3 * (1 - i) + w4 * d + w5 * chi_r::int')} as rho, case expected when 'accept' then 0.15e0 when 'lower_confidence' then 0.4e0 when 'request_more_data' then 0.5e0 when 'defer_to_human' then 0.75e0 else 1e0 end as target from mg, gr),
z as (select w1, w2, w3, w4, w5, sum(case when {S.simple_gate('rho', 'u', 'p', 'chi_r')} = expected then n else 0 end) / sum(n)::double as accuracy, sum((rho - target) * (rho - target) * n) / sum(n)::double as mse from y group by 1, 2, 3, 4, 5)
select round(w1, 6) as predicted_risk, round(w2, 6) as uncertainty, round(w3, 6) as interpretability_gap, round(w4, 6) as reduction_loss, round(w5, 6) as diagnostic, round(accuracy, 6) as accuracy, round(mse, 6) as mse,
    round((w1 - 0.3e0) * (w1 - 0.3e0) + (w2 - 0.25e0) * (w2 - 0.25e0) + (w3 - 0.2e0) * (w3 - 0.2e0) + (w4 - 0.15e0) * (w4 - 0.15e0) + (w5 - 0.1e0) * (w5 - 0.1e0), 6) as distance from z"""


@query("calibrate_simplex", _SIMPLEX)
def calibrate_simplex(spark, sf):
    """All 3,876 weightings over the whole log."""
    from ..functions import gates as G

    rows = V.evaluation_rows(spark, sf).select(
        "p", "u", "interpretability", "reduction_loss", "chi_r", "chi_r_crit", (F.col("y_true") != F.col("y_pred")).alias("wrong")
    )
    expected = G.reference_action(F.col("p"), F.col("u"), F.col("interpretability"), F.col("chi_r"), F.col("chi_r_crit"), F.col("wrong"))
    out = W.calibrate_simplex(rows.withColumn("expected_action", expected), W.simplex_grid(spark))
    # Accuracies are shares of the cases and can fall exactly between two six-digit numbers.
    return rounded(out.withColumn("accuracy", r6_scaled(F.col("accuracy"))))


