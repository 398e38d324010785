"""SQL building blocks of the oracle queries (DuckDB dialect)."""

from __future__ import annotations


def num(x: float) -> str:
    """A literal that DuckDB reads as DOUBLE, not DECIMAL."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def clip(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def uniform(seed, *keys: str) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substr(md5({joined}), 1, 13))::bigint / 4503599627370496e0)"


def poisson(u: str) -> str:
    from ..functions.numeric import poisson1_steps

    steps = poisson1_steps()
    arms = " ".join(f"when {u} < {num(s)} then {k}" for k, s in enumerate(steps))
    return f"case {arms} else {len(steps)} end"


def _horner(coefficients, x: str) -> str:
    total = num(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {num(c)})"
    return total


def poisson_weights(kinds: str, out: str, replicates: int = 5000, seed: int = 42) -> str:
    """CTEs that end in `out`: the rows of kinds (units, kind, ...) once per rep with w, a Poisson total of their units."""
    from ..functions import numeric as N

    def tail(q):
        return f"({_horner(N.QUANTILE_C, f'sqrt(-2e0 * ln({q}))')} / ({_horner(N.QUANTILE_D, f'sqrt(-2e0 * ln({q}))')} * sqrt(-2e0 * ln({q})) + 1e0))"

    r = "((u - 0.5e0) * (u - 0.5e0))"
    middle = f"({_horner(N.QUANTILE_A, r)} * (u - 0.5e0) / ({_horner(N.QUANTILE_B, r)} * {r} + 1e0))"
    z = f"case when u < {N.QUANTILE_TAIL!r} then {tail('u')} when u > {1 - N.QUANTILE_TAIL!r} then -{tail('(1e0 - u)')} else {middle} end"
    return f"""{out}_m as (select units, k, sum(exp(-units + k * ln(units) - lgamma(k + 1))) over (partition by units order by k) as cdf from (select distinct units from {kinds} where units <= {N.POISSON_EXACT}), (select unnest(range(150)) as k)),
{out}_l as (select units, list(cdf order by k) as cdfs from {out}_m group by 1),
{out}_u as (select *, greatest({uniform(seed, 'rep', 'kind')}, 1.1102230246251565e-16) as u, {uniform(seed, 'rep', 'kind')} as u0 from {kinds}, (select unnest(range({replicates})) as rep)),
{out}_z as (select *, {z} as z from {out}_u),
{out} as (select {out}_z.*, case when {out}_z.units <= {N.POISSON_EXACT} then len(list_filter(cdfs, lambda c: u0 >= c)) else greatest(0, floor({out}_z.units + sqrt({out}_z.units) * z + (z * z - 1e0) / 6e0 + 0.5e0)) end::bigint as w
    from {out}_z left join {out}_l on {out}_z.units = {out}_l.units)"""


def bootstrap(source: str, sums, out: str, replicates: int = 5000, seed: int = 42) -> str:
    """CTEs that end in `out` (rep, sums): kinds of rows by their sums, a Poisson total per kind and replicate."""
    names = ", ".join(sums)
    kind = " || ',' || ".join(f"({s})::bigint::varchar" for s in sums)
    weighted = ", ".join(f"sum({s} * w)::bigint as {s}" for s in sums)
    return f"""{out}_k as (select {names}, count(*) as units, {kind} as kind from {source} group by {names}),
{poisson_weights(f"{out}_k", f"{out}_w", replicates, seed)},
{out} as (select rep, {weighted} from {out}_w group by rep)"""


def count_if(cond: str) -> str:
    return f"(count(*) filter (where {cond}))::bigint"


def share(cond: str) -> str:
    return f"coalesce(avg(case when {cond} then 1e0 else 0e0 end), 0e0)"


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


def ladder(rho: str, thetas, crit: str | None = None) -> str:
    first = f"when {crit} then 'block' " if crit else ""
    t = [x if isinstance(x, str) else num(x) for x in thetas]
    return (
        f"case {first}when {rho} < {t[0]} then 'accept' when {rho} < {t[1]} then 'lower_confidence' "
        f"when {rho} < {t[2]} then 'request_more_data' when {rho} < {t[3]} then 'defer_to_human' else 'block' end"
    )


def zone3(rho: str) -> str:
    return f"case when {rho} < 0.35 then 'accept' when {rho} < 0.60 then 'lower_confidence' else 'audit' end"


def simple_gate(rho: str, u: str, p: str, blocked: str, high: str = "0.65") -> str:
    return (
        f"case when {blocked} then 'block' when {rho} >= {high} then 'defer_to_human' "
        f"when {rho} >= 0.35 and {u} >= 0.45 then 'request_more_data' when {rho} >= 0.35 then 'lower_confidence' "
        f"when {u} >= 0.45 and {p} >= 0.35 then 'lower_confidence' else 'accept' end"
    )


def full_gate(rho="rho", u="u", i="i", d="d", r="chi_r", c="chi_r_crit", a="auto", t="trace_ok",
              th=("0.10", "0.25", "0.50", "0.75"), imin="0.65", dmax="0.15", umax="0.45") -> str:
    return (
        f"case when {c} then 'block' "
        f"when not {a} then case when {rho} >= {th[2]} then 'defer_to_human' else 'request_more_data' end "
        f"when {rho} < {th[0]} and not {r} and {i} >= {imin} and {d} <= {dmax} and {t} and {u} < {umax} then 'accept' "
        f"when {rho} < {th[1]} and not {r} then 'lower_confidence' "
        f"when {u} >= {umax} or {d} > {dmax} or {i} < {imin} or not {t} then 'request_more_data' "
        f"when {rho} < {th[3]} then 'defer_to_human' else 'block' end"
    )


def proxy(p="p", u="u", i="i", r="chi_r", c="chi_r_crit") -> str:
    return (
        f"case when {c} then 'block' when {r} and {p} >= 0.80 then 'defer_to_human' when {p} >= 0.75 then 'defer_to_human' "
        f"when {u} >= 0.45 or {i} < 0.65 then 'request_more_data' when {p} >= 0.35 then 'lower_confidence' else 'accept' end"
    )


def reference(p="p", u="u", i="i", r="chi_r", c="chi_r_crit", w="y_true <> y_pred") -> str:
    return (
        f"case when {c} then 'block' when ({w}) and {p} >= 0.65 then 'defer_to_human' "
        f"when {r} or {u} >= 0.45 or {i} < 0.65 then 'request_more_data' when {p} >= 0.75 then 'defer_to_human' "
        f"when {p} >= 0.35 then 'lower_confidence' else 'accept' end"
    )


LINE_P = "least(1e0, ((l_quantity - 1) / 49 * 0.7e0 + l_discount * 3) * ((l_quantity - 1) / 49 * 0.7e0 + l_discount * 3) * ((l_quantity - 1) / 49 * 0.7e0 + l_discount * 3))"

_CASE_COLUMNS = f"""
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as case_id,
    l_orderkey as object_id, l_linestatus as segment, l_linenumber as line, {LINE_P} as p,
    (l_returnflag = 'R')::int as y_true, (({LINE_P}) >= 0.5)::int as y_pred,
    l_tax >= 0.07 as chi_r, (l_tax >= 0.08 and l_discount >= 0.08) as chi_r_crit,
    l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount, l_tax as tax,
    l_returnflag as returnflag, l_shipdate as shipdate"""

CASES = f"cases as (select {_CASE_COLUMNS} from lineitem)"
TRACED = f"""cases as (select {_CASE_COLUMNS}, not (o_orderstatus = 'P' and o_orderpriority = '5-LOW') as trace_ok
    from lineitem join orders on l_orderkey = o_orderkey)"""

ENTROPY = "greatest(0e0, least(1e0, -((1 - p) * ln(greatest(1 - p, 1e-12)) + p * ln(greatest(p, 1e-12))) / ln(2e0)))"
MARGIN = "greatest(0e0, least(1e0, 1 - abs((1 - p) - p)))"
HIGH = "case when p >= 0.5 and p <= 0.75 then 4 * p - 2 when p > 0.75 and p <= 1 then 1e0 else 0e0 end"
MEDIUM = "case when p >= 0.25 and p <= 0.5 then 4 * p - 1 when p > 0.5 and p <= 0.75 then 3 - 4 * p else 0e0 end"


def scored(source: str = "cases", loss: str = "0e0", name: str = "scored", trace: str = "trace_ok") -> str:
    """CTEs that score `source`; result has u, i, d, rho, auto, action, confidence."""
    weights = "0.3e0 * p + 0.25e0 * u + 0.2e0 * greatest(0e0, 1 - i) + 0.15e0 * d"
    return f"""
{name}_1 as (select *, {loss} as d, {clip(f"0.7e0 * ({ENTROPY}) + 0.3e0 * ({MARGIN})")} as u from {source}),
{name}_2 as (select *, {clip(f"0.5e0 * u + 0.3e0 * (1 - greatest({HIGH}, {MEDIUM})) + 0.2e0 * 0.01e0")} as ue from {name}_1),
{name}_3 as (select *, exp(-greatest(0e0, 0.2e0 * 0.3e0 + 0.2e0 * 0.33e0 + 0.2e0 * 0.16e0 + 0.2e0 * 0.03e0 + 0.2e0 * ue + 0.1e0 * d)) as i from {name}_2),
{name}_4 as (select *, {clip(weights)} as rho0, p < 0.35 and u < 0.45 and i >= 0.65 and not chi_r_crit and {trace} as auto from {name}_3),
{name} as (select * exclude (rho0), case when chi_r_crit then 1e0 else rho0 end as rho,
    {full_gate(rho="rho0", t=trace)} as action,
    case when chi_r_crit then 0e0 else {clip("(1 - u) * (1 - rho0) * i * (1 - d)")} end as confidence
    from {name}_4)"""


SCORED = ctes(TRACED, scored())

EVALUATION = ctes(TRACED, scored(), """
ev as (select * exclude (d, auto), discount * 2.5e0 as d,
    p < 0.35 and u < 0.45 and i >= 0.65 and not chi_r_crit as auto from scored)""")

ACTIONS = ("accept", "lower_confidence", "request_more_data", "defer_to_human", "block")

# --- routes -------------------------------------------------------------------------------

PAYLOADS = f"""pay as (select case_id, 'model_' || lower(returnflag) as model_name, line,
    case when tax >= 0.08 then p + 1e0 else p end as cp,
    discount * 4 as missing_rate, tax as range_violation,
    coalesce(case line when 1 then 'signal_quality' when 2 then 'image_like_classification' when 3 then 'tabular_regression' end, 'tabular_classification') as task_type,
    'perturb_' || lower(segment) as perturbation,
    round(case when returnflag = 'R' then discount * 6 else 0e0 end, 6) as conflict,
    round(case when line = 3 then tax * 5 else 0e0 end, 6) as interval_w,
    round(case when line = 1 then discount * 8 else 0e0 end, 6) as noise,
    round(case when line = 2 then tax * 8 else 0e0 end, 6) as occlusion,
    0e0 + quantity / 100 + discount * 3 + tax as imp, quantity, discount, tax
    from cases where line not in (6, 7) and (case when tax >= 0.08 then p + 1e0 else p end) <= 1)"""

_SOFT = "case when rho < 0.60 then 'lower_confidence' else 'audit' end"
ROUTES = f"""
route_1 as (select *, round(1 - cp, 6) as uncertainty, round(greatest(missing_rate, range_violation, noise, occlusion), 6) as quality,
    round(greatest(0e0, 1 - least(1e0, imp)), 6) as delta from pay),
route_2 as (select *, greatest(uncertainty, quality, conflict, interval_w) as gamma from route_1),
route_3 as (select *, greatest(gamma, delta, quality, conflict, interval_w) as rho from route_2),
routes as (select *,
    case when gamma = rho then 'gamma' when delta = rho then 'delta' when quality = rho then 'quality' when conflict = rho then 'conflict' else 'interval' end as dominant_component,
    case when interval_w > 0 then 'F_int' when conflict > 0 or quality >= 0.55 then 'NAS' when task_type in ('signal_quality', 'image_like_classification') then 'F_ML' else 'F0' end as representation_class,
    case when rho < 0.35 then 'D_external_tabular_ok'
         when task_type = 'signal_quality' and quality >= 0.70 then 'D_signal_missing_fragments'
         when task_type = 'signal_quality' and quality >= 0.55 then 'D_signal_noise_limit'
         when task_type = 'image_like_classification' and quality >= 0.55 then 'D_image_quality_limit'
         when conflict >= 0.55 then 'D_rule_attribution_conflict'
         when task_type = 'tabular_regression' then case when interval_w >= delta then 'D_external_regression_uncertainty' else 'D_external_regression_explanation_loss' end
         when task_type = 'image_like_classification' then case when delta >= gamma then 'D_image_explanation_reduction' else 'D_external_image_uncertainty' end
         when quality >= 0.35 then 'D_external_tabular_quality_limit'
         when delta >= gamma and delta >= 0.45 then 'D_external_tabular_reduction_loss'
         else 'D_external_tabular_uncertainty' end as diagnostic_id,
    case when rho < 0.35 then 'accept' when task_type = 'signal_quality' and quality >= 0.55 then 'defer_to_human'
         when task_type = 'image_like_classification' and quality >= 0.55 then 'audit' when conflict >= 0.55 then 'audit'
         else {_SOFT} end as action
    from route_3)"""

ROUTED = ctes(CASES, PAYLOADS, ROUTES)

# --- attribution conflicts --------------------------------------------------------------------

ATTRIBUTIONS = """
emb as (select vec_id, label, (label >= 5)::int as y, [x::double for x in embedding] as h from embeddings),
acases as (select vec_id as case_id, vec_id // 4 as object_id, y as y_true,
    greatest(0e0, least(1e0, 0.5e0 + (h[1] + h[18] + h[35] + h[52]))) as p, h from emb),
feats as (select case_id, unnest(range(32)) as feature from acases),
vals as (select f.case_id, f.feature, h[f.feature + 1] as a,
    case when f.case_id % 2 = 0 then h[f.feature + 1] + 0.5e0 * h[f.feature + 33] else h[f.feature + 33] end as b
    from feats f join acases c on f.case_id = c.case_id),
ranked as (select *, row_number() over (partition by case_id order by abs(a) desc, feature) as ra,
    row_number() over (partition by case_id order by abs(b) desc, feature) as rb from vals),
tops as (select case_id, count(*) filter (where ra <= 5 and rb <= 5) as common, count(*) filter (where ra <= 5 or rb <= 5) as either,
    (count(*) filter (where ra <= 5 and rb <= 5 and sign(a) * sign(b) < 0))::bigint as sign_disagreement,
    (sum(sign(a)) filter (where ra <= 5))::double / 5 + (sum(sign(b)) filter (where rb <= 5))::double / 5 as support
    from ranked group by case_id)"""


def conflicts(variant: str = "practice") -> str:
    gap = "1 - i_pre" if variant == "practice" else clip(
        "1 - topk_jaccard + 0.2e0 * sign_disagreement + 0.25e0 * conflict_rule::int"
    )
    th = (0.25, 0.45, 0.65, 0.82)
    return ATTRIBUTIONS + f""",
conf_1 as (select c.case_id, c.object_id, c.p, c.y_true, (c.p >= 0.5)::int as y_pred, common / either::double as topk_jaccard, sign_disagreement, support,
    case when p >= 0.70 then 'block' when p <= 0.30 then 'accept' else 'defer_to_human' end as rule_action,
    1 - 2 * abs(p - 0.5) as u_m from acases c join tops t on c.case_id = t.case_id),
conf_2 as (select *, topk_jaccard < 0.4 as conflict_rank, sign_disagreement > 0 as conflict_sign,
    (rule_action = 'block' and support < -0.25) or (rule_action = 'accept' and support > 0.25) as conflict_rule,
    {clip("topk_jaccard - 0.2e0 * sign_disagreement")} as i_pre from conf_1),
conf_3 as (select *, conflict_rank or conflict_sign or conflict_rule as chi_r,
    (conflict_sign and conflict_rule) or ((conflict_rank or conflict_sign or conflict_rule) and (p <= 0.30 or p >= 0.70)) as chi_r_crit from conf_2),
conf_4 as (select *, p as rho_f0, {clip("0.55e0 * p + 0.25e0 * u_m + 0.2e0 * chi_r::int")} as rho_nas from conf_3),
conf_5 as (select *, {clip(f"0.5e0 * rho_nas + 0.25e0 * ({gap}) + 0.25e0 * chi_r::int")} as rho_fml from conf_4),
conf as (select *, {ladder("rho_f0", th)} as action_f0, {ladder("rho_nas", th, "chi_r_crit")} as action_nas,
    {ladder("rho_fml", th, "chi_r_crit")} as action_fml, abs(rho_fml - rho_f0) as delta_m from conf_5)"""


CONFLICTS = ctes(conflicts())

# --- explanation pairs --------------------------------------------------------------------------

_M = {
    "low": lambda z: clip(f"1 - {z} * 1.4e0"),
    "medium": lambda z: clip(f"1 - abs({z} - 0.5) * 4e0"),
    "high": lambda z: clip(z),
}
PAIRS = f"""
pair_1 as (select *, least(1e0, extendedprice / 100000e0) as q from cases),
pair_2 as (select *, {_M['low']('p')} as a_low, {_M['medium']('p')} as a_medium, {_M['high']('p')} as a_high,
    {_M['low']('q')} as b_low, {_M['medium']('q')} as b_check, {_M['high']('q')} as b_high,
    {clip('q - 0.04')} as lo, {clip('q + 0.04')} as hi, {clip('q - 0.08')} as v1, {clip('q + 0.06')} as v2, {clip('1 - q - 0.04')} as f from pair_1),
pair_3 as (select *, {clip('(1 - abs(a_high - a_low)) * 0.8e0')} as ul, {clip('(1 - abs(b_high - b_low)) * 0.8e0')} as ur,
    case line % 3 when 0 then least(1e0, greatest(abs(p - q), 0.15e0, abs((1 - p) - f)) + 0.05e0)
        when 1 then greatest(abs(lo - p), abs(hi - p)) else greatest(abs(v1 - p), abs(v2 - p)) end as g_repr,
    case line % 3 when 0 then least(least(1e0, greatest(0.15e0, abs(q + f - 1) / 2) + 0.05e0), least(1e0, greatest(0.15e0, abs(f - (1 - q))) + 0.05e0))
        when 1 then (hi - lo) / 2 else greatest(v2 - (v1 + v2) / 2, (v1 + v2) / 2 - v1) end as delta_r from pair_2),
pair_4 as (select *,
    (a_low > 0.05)::int + (a_medium > 0.05)::int + (a_high > 0.05)::int as na, (b_low > 0.05)::int + (b_high > 0.05)::int + (b_check > 0.05)::int as nb,
    (a_low > 0.05 and b_low > 0.05)::int + (a_high > 0.05 and b_high > 0.05)::int as nab,
    (abs(a_low - b_low) + abs(a_medium - 0) + abs(a_high - b_high) + abs(0 - b_check)) / 4 as g_act,
    (1 + (segment = 'O')::int + (returnflag <> 'R')::int) / 6e0 as g_trace from pair_3),
pairs as (select *, case when na + nb - nab = 0 then 0e0 else 1 - nab / (na + nb - nab)::double end as g_rules,
    {clip("0.3e0 * g_repr + 0.25e0 * (case when na + nb - nab = 0 then 0e0 else 1 - nab / (na + nb - nab)::double end) + 0.15e0 * g_act + 0.2e0 * abs(ul - ur) + 0.1e0 * g_trace")} as gamma from pair_4)"""
PAIRED = ctes(CASES, PAIRS)
