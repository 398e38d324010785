"""Queries over ordered paths, and the streaming operators run to completion over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6, r9
from ..operators import chains as C
from ..operators import compose as X
from ..operators import observe as O
from ..operators import paths as P
from ..sources import views as V
from ..streaming import streams as ST
from . import sql as S
from .registry import query

_EDGES = """e as (select l_orderkey as path_id, l_linenumber as seq, l_partkey as part, l_suppkey as supp, 'n' || l_linenumber as source, 'n' || (l_linenumber + 1) as target,
    l_discount * 4 as gamma, l_tax as delta, l_tax >= 0.07 as failed, l_returnflag = 'R' and l_discount >= 0.09 as crit, l_discount * 4 > 0.3e0 as far from lineitem),
o as (select *, lag(target) over (partition by path_id order by seq, part, supp) as prev, row_number() over (partition by path_id order by seq, part, supp) as rn,
    count(*) over (partition by path_id) as n from e)"""

_CERTIFY = S.ctes(_EDGES) + """,
m as (select *, prev is not null and prev <> source as mism from o),
codes as (
    select path_id, rn, 0 as pin, 'D_k_trace' as code from m where failed union all
    select path_id, rn, failed::int, 'D_ij_critical' from m where crit union all
    select path_id, rn, failed::int + crit::int, 'gamma_exceeded' from m where far union all
    select path_id, rn, failed::int + crit::int + far::int, 'path_endpoint_mismatch' from m where mism),
firsts as (select path_id, code, min(rn * 10 + pin) as pos from codes group by 1, 2),
listed as (select path_id, string_agg(code, ';' order by pos) as diagnostics, bool_or(code = 'D_ij_critical') as crit from firsts group by 1),
tot as (select path_id, max(case when rn = 1 then source end) as source, max(case when rn = n then target end) as target, count(*)::bigint as n_edges,
    count(*) filter (where mism)::bigint as n_mismatch, bool_or(failed or far or mism) as rupture from m group by 1)
select t.path_id, source, target, n_edges, n_mismatch, rupture, not rupture as certified, rupture or coalesce(crit, false) as rupture_inhabited, coalesce(diagnostics, '') as diagnostics
from tot t left join listed l on t.path_id = l.path_id"""


@query("certify_paths", _CERTIFY)
def certify_paths(spark, sf):
    # Long paths are cut into blocks of 4 sequence numbers.
    out = P.certify_paths(V.edges(spark, sf), order=V.EDGE_ORDER, bucket=F.floor(F.col("seq") / 4))
    return out.withColumn("diagnostics", F.array_join("diagnostics", ";"))


@query(
    "path_certificates",
    S.ctes(_EDGES)
    + """select path_id, max(case when rn = 1 then source end) as source, max(case when rn = n then target end) as target, count(*)::bigint as length,
    round(least(1e0, sum(gamma)), 6) as gamma_total, round(least(1e0, sum(delta)), 6) as delta_total, least(1e0, round(sum(gamma), 9)) <= 0.6 as valid from o group by path_id""",
)
def path_certificates(spark, sf):
    # Sums of two-decimal inputs are rounded before the limit is tested, so that summation order does not matter.
    edges = V.edges(spark, sf)
    out = P.path_certificates(edges, order=V.EDGE_ORDER)
    return out.select(
        "path_id", "source", "target", "length", r6(F.col("gamma_total")).alias("gamma_total"), r6(F.col("delta_total")).alias("delta_total"),
        (F.round("gamma_total", 9) <= 0.6).alias("valid"),
    )


@query(
    "compose_chain",
    """with e as (select l_orderkey as case_id, l_discount * 4 as gamma, """ + S.LINE_P + """ * 0.5e0 as u, l_tax as d,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem),
s as (select case_id, min(case when gamma > 0.3e0 then rn end) as stop, count(*) as n from e group by 1),
k as (select e.*, s.n, s.stop from e join s on e.case_id = s.case_id where s.stop is null or rn < s.stop)
select case_id, max(n)::bigint as n_stages, count(*)::bigint as n_composed, max(stop) is not null as stopped,
    round(case when bool_or(u >= 1 or gamma >= 1) then 1e0 else 1 - exp(sum(ln(1 - u)) + sum(ln(1 - gamma))) end, 6) as uncertainty,
    round(least(1e0, sum(d)), 6) as reduction_loss, case when max(stop) is not null then 'D_ij' end as diagnostic from k group by case_id""",
)
def compose_chain(spark, sf):
    out = X.compose_chain(V.chain_stages(spark, sf), 0.3, order=V.EDGE_ORDER)
    return out.withColumn("uncertainty", r6(F.col("uncertainty"))).withColumn("reduction_loss", r6(F.col("reduction_loss")))


@query(
    "chain_activations",
    f"""with e as (select l_orderkey as case_id, {S.LINE_P} as p from lineitem)
select case_id, 'low' as rule, round(max({S.clip('1 - p * 1.4e0')}), 6) as activation from e group by 1 union all
select case_id, 'medium', round(max({S.clip('1 - abs(p - 0.5) * 4e0')}), 6) from e group by 1 union all
select case_id, 'high', round(max({S.clip('p')}), 6) from e group by 1""",
)
def chain_activations(spark, sf):
    out = X.chain_activations(V.chain_stages(spark, sf))
    return out.withColumn("activation", r6(F.col("activation")))


_FOLD = """ev as (select user_id, event_id, event_type as t, least(value / 300, 1e0) as u, case when value >= 200 then 'high' when value >= 60 then 'mid' else 'low' end as band,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
steps as (
    select user_id, rn, 1 as n, u as cu, u as pu, [t, band] as terms, [t] as names, map([t], [0.5e0 + 0.5e0 * u]) as acts, event_id as trace, null::varchar as reason, null::double as gamma from ev where rn = 1
    union all
    select user_id, rn, n + (why is null)::int, if(why is null, 1 - (1 - cu) * (1 - u) * (1 - g), cu), if(why is null, u, pu),
        if(why is null, terms || [x for x in [t, band] if not list_contains(terms, x)], terms), if(why is null and not list_contains(names, t), names || [t], names),
        if(why is null, map(map_keys(wide), [greatest(wide[k], if(k = t, a, 0e0)) for k in map_keys(wide)]), acts), if(why is null, event_id, trace), why, if(why is null, g, gamma)
    from (select *, case when not list_contains(terms, t) and not list_contains(terms, band) then 'no common terms' when g > {limit} then 'disagreement above gamma_max' end as why
        from (select s.user_id, e.rn, s.n, s.cu, s.pu, s.terms, s.names, s.acts, s.trace, s.gamma, e.t, e.u, e.band, e.event_id, 0.5e0 + 0.5e0 * e.u as a,
            if(list_contains(s.names, e.t), s.acts, map(s.names || [e.t], map_values(s.acts) || [0e0])) as wide,
            greatest(0e0, least(1e0, 0.3e0 * abs(s.pu - e.u) + 0.25e0 * (1 - list_contains(s.names, e.t)::int / (len(s.names) + 1e0 - list_contains(s.names, e.t)::int))
                + 0.15e0 * (abs(coalesce(s.acts[e.t], 0e0) - (0.5e0 + 0.5e0 * e.u)) + list_sum(map_values(s.acts)) - coalesce(s.acts[e.t], 0e0))
                    / (len(s.names) + 1 - list_contains(s.names, e.t)::int)
                + 0.2e0 * abs(s.cu - e.u) + 0.1e0 * (2 / 6e0))) as g
            from steps s join ev e on s.user_id = e.user_id and e.rn = s.rn + 1 where s.reason is null))),
ends as (select *, row_number() over (partition by user_id order by rn desc) as nth from steps)
select ends.user_id, total as n_stages, n::bigint as n_composed, reason, round(gamma, 9) as gamma, round(cu, 9) as uncertainty,
    array_to_string(list_sort(terms), ';') as terms, array_to_string(['r_' || x for x in names], ';') as rules,
    array_to_string([x || '=' || round(acts[x] * 1e6)::int for x in list_sort(map_keys(acts))], ';') as activations, trace::varchar as trace_id
from ends join (select user_id, count(*)::bigint as total from ev group by 1) c on ends.user_id = c.user_id where nth = 1"""
FOLD_LIMIT = 0.45


@query("compose_chain_fold", S.ctes(_FOLD.format(limit=FOLD_LIMIT)).replace("with ", "with recursive ", 1))
def compose_chain_fold(spark, sf):
    """The events of a user folded into one explanation: its rules, activations, terms and last trace."""
    e = V.event_explanations(spark, sf)
    value = F.col("u") * 300
    band = F.when(value >= 200, "high").when(value >= 60, "mid").otherwise("low")
    out = C.fold_chain(e.withColumn("terms", F.array("event_type", band)), "user_id", ("ts", "event_id"), gamma_max=FOLD_LIMIT)
    shown = F.transform(F.array_sort(F.map_keys("activations")), lambda k: F.concat(F.substr(k, F.lit(3)), F.lit("="), F.round(F.element_at("activations", k) * 1e6).cast("int").cast("string")))
    return out.select(
        "user_id", "n_stages", "n_composed", "reason", r9(F.col("gamma")).alias("gamma"), r9(F.col("uncertainty")).alias("uncertainty"),
        F.array_join(F.array_sort("terms"), ";").alias("terms"), F.array_join(F.transform("rules", lambda r: r["name"]), ";").alias("rules"),
        F.array_join(shown, ";").alias("activations"), F.col("trace.id").alias("trace_id"),
    )


_DRIFT = """ev as (select event_id, ts, user_id, event_type, least(value / 300, 1e0) as u,
    lag(event_type) over w as t0, lag(least(value / 300, 1e0)) over w as u0 from events window w as (partition by user_id order by ts, event_id)),
dr as (select *, greatest(0e0, least(1e0, 0.3e0 * abs(u0 - u) + 0.25e0 * (case when t0 = event_type then 0e0 else 1e0 end)
    + 0.15e0 * (case when t0 = event_type then abs((0.5e0 + 0.5e0 * u0) - (0.5e0 + 0.5e0 * u)) else ((0.5e0 + 0.5e0 * u0) + (0.5e0 + 0.5e0 * u)) / 2 end)
    + 0.2e0 * abs(u0 - u) + 0.1e0 * (2 / 6e0))) as gamma from ev where t0 is not null)"""
PARTS = ("representation", "rules", "activations", "uncertainty", "trace", "reduction_loss")


def _drift(spark, sf):
    e = V.event_explanations(spark, sf)
    # Users are cut into days, so an active user is many tasks.
    return P.drift_edges(e, "user_id", ("ts", "event_id"), F.to_date("ts"), PARTS, gamma_max=0.35)


@query("drift_edges", S.ctes(_DRIFT) + "select user_id, event_id, round(gamma, 9) as gamma, round(gamma, 9) > 0.35 as rupture from dr")
def drift_edges(spark, sf):
    return _drift(spark, sf).select("user_id", "event_id", r9(F.col("gamma")).alias("gamma"), "rupture")


@query(
    "drift_path",
    S.ctes(_DRIFT)
    + """select user_id, count(*)::bigint as n_edges, count(*) filter (where gamma > 0.35)::bigint as n_ruptures, round(max(gamma), 9) as max_gamma,
    count(*) filter (where gamma > 0.35) = 0 as is_continuous from dr group by user_id""",
)
def drift_path(spark, sf):
    out = P.drift_path(_drift(spark, sf), "user_id")
    return out.withColumn("max_gamma", r9(F.col("max_gamma")))


# --- streams run to completion ---------------------------------------------------------------------

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("u", F.least(F.col("value") / 300, F.lit(1.0)))


def _gated(events):
    return O.observe(events.withColumn("p", F.least(F.col("value") / 100, F.lit(1.0))), "p", chi_r_crit="crit")


def _with_flags(events):
    return events.withColumn("crit", (F.col("event_type") == "error") & (F.col("value") >= 60))


def run_to_end(df, name: str):
    """Run an aggregating stream over what is there in complete mode: every group comes out, closed or not.

    Each trigger replaces the table of the one before, so what stays is the state at the end of the input.
    """
    import uuid

    spark = df.sparkSession
    run = f"{name}-{uuid.uuid4().hex}"
    root = ST.checkpoint_root(spark)
    path = f"{root}/out-{run}"
    stream = df.writeStream.queryName(run).outputMode("complete").option("checkpointLocation", f"{root}/{run}").trigger(availableNow=True)
    stream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_to_table(df, name: str):
    """Run a stream over what is there into parquet under the checkpoint folder, and read it back."""
    import uuid

    spark = df.sparkSession
    root = ST.checkpoint_root(spark)
    run = f"{name}-{uuid.uuid4().hex}"
    path = f"{root}/out-{run}"
    q = ST.write_stream(df, run, "parquet", path)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


_EVENT_CASES = """cases as (select event_id, ts, user_id, event_type, least(value / 100, 1e0) as p, event_type = 'error' and value >= 60 as chi_r_crit, false as chi_r, true as trace_ok from events)"""


@query(
    "observe_stream",
    S.ctes(_EVENT_CASES, S.scored()) + "select event_id, action, round(rho, 6) as rho, round(confidence, 6) as corrected_confidence from scored",
)
def observe_stream(spark, sf):
    out = _gated(_with_flags(_stream(spark, sf))).select(
        "event_id", "action", r6(F.col("rho")).alias("rho"), r6(F.col("corrected_confidence")).alias("corrected_confidence")
    )
    return run_to_table(out, "observe")


_RATES = S.ctes(_EVENT_CASES, S.scored()) + """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*)::bigint as n, """ + ", ".join(
    f"round(avg((action = '{a}')::int), 6) as rate_{a}" for a in S.ACTIONS
) + ", round(avg(rho), 6) as mean_rho from scored group by 1"


def _rates(df):
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", *[r6(F.col(f"rate_{a}")).alias(f"rate_{a}") for a in S.ACTIONS],
        r6(F.col("mean_rho")).alias("mean_rho"),
    )


@query("action_rates", _RATES)
def action_rates(spark, sf):
    """Batch twin of the windowed stream."""
    rows = _gated(_with_flags(V.table(spark, sf, "events")))
    return _rates(ST.action_rates(rows, "ts"))


@query("action_rates_stream", _RATES)
def action_rates_stream(spark, sf):
    """All windows up to the end of the input, those still open too."""
    out = ST.action_rates(_gated(_with_flags(_stream(spark, sf))), "ts")
    return _rates(run_to_end(out, "rates"))


#: Groups of users per day: 100 groups hold some 2,000 events each at 60 times sf0.1.
DRIFT_GROUPS = 100


@query(
    "drift_stream",
    S.ctes(_DRIFT) + "select user_id, event_id, round(gamma, 9) as gamma, round(gamma, 9) > 0.35 as rupture from dr",
)
def drift_stream(spark, sf):
    # A day of some users is one group of the state; the ends of the days are joined afterwards.
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    out = ST.join_shards(run_to_table(ST.drift_stream(ST.closed(_stream(spark, sf)), gamma_max=0.35, shard=day, groups=DRIFT_GROUPS), "drift"), 0.35)
    return out.where(~F.col("first")).select("user_id", "event_id", r9(F.col("gamma")).alias("gamma"), "rupture")


_SESSIONS = """ev as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
se as (select *, sum((prev is null or ts >= prev + interval 2 hour)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from ev),
pos as (select *, row_number() over (partition by user_id, sid order by ts, event_id) as rn, count(*) over (partition by user_id, sid) as n from se)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, max(case when rn = 1 then event_type end) as source, max(case when rn = n then event_type end) as target,
    count(*)::bigint as length, round(least(1e0, sum(value / 1000)), 6) as gamma_total, least(1e0, sum(value / 1000)) <= 0.2 as valid from pos group by user_id, sid"""


def _session_edges(events):
    return events.select(
        "user_id", "ts", "event_id", F.col("event_type").alias("source"), F.col("event_type").alias("target"),
        (F.col("value") / 1000).alias("gamma"), F.lit(0.0).alias("delta"),
    )


def _session_out(df):
    return df.select(
        "user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "source", "target", "length",
        r6(F.col("gamma_total")).alias("gamma_total"), "valid",
    )


_SESSION_SQL = S.ctes(_SESSIONS.split("select user_id, strftime")[0].rstrip()) + "select user_id, strftime" + _SESSIONS.split("select user_id, strftime")[1]


@query("session_paths", _SESSION_SQL)
def session_paths(spark, sf):
    """Batch twin of the session stream."""
    return _session_out(ST.session_paths(_session_edges(V.table(spark, sf, "events")), "user_id", "ts", gamma_max=0.2, order=("event_id",)))


@query("session_paths_stream", _SESSION_SQL)
def session_paths_stream(spark, sf):
    """All sessions up to the end of the input, those still open too."""
    out = ST.session_paths(_session_edges(_stream(spark, sf)), "user_id", "ts", gamma_max=0.2, order=("event_id",))
    return _session_out(run_to_end(out, "sessions"))
