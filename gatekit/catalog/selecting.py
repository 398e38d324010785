"""Queries that choose from candidate tables made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as L
from ..operators.compose import pair_up
from ..sources import views as V
from . import sql as S
from .registry import query

TAGS = ("u_num", "u_ling", "u_int", "u_exp", "u_conf", "u_trace", "u_multi")
PROFILES = {
    "plain": ("u_num", "u_ling"), "interval": ("u_num", "u_int"), "expert": ("u_exp", "u_conf"), "traced": ("u_num", "u_trace", "u_ling"),
    "all": ("u_num", "u_ling", "u_int", "u_exp", "u_conf", "u_trace"), "multi": ("u_num", "u_multi"),
}
#: Tag k is covered where the line number has bit k, or the flag or the status says so.
_CANDIDATE = """c as (select l_orderkey::varchar || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as name, l_linenumber % 2 = 1 as t0, l_returnflag <> 'R' as t1, (l_linenumber // 2) % 2 = 1 as t2,
    l_linestatus = 'O' as t3, l_suppkey % 3 = 0 as t4, l_partkey % 2 = 0 as t5, l_quantity as cognitive, round(l_extendedprice / 100)::bigint as computational, round((l_tax * 3 + 0.1 - l_discount) * 100)::bigint as expected_loss from lineitem)"""


def _covers(tags) -> str:
    return " and ".join(f"t{TAGS.index(t)}" for t in tags if t != "u_multi") + (" and false" if "u_multi" in tags else "")


_FIT = "f as (" + " union all ".join(f"select '{name}' as profile, * from c where {_covers(tags)}" for name, tags in PROFILES.items()) + ")"
# The cheapest computation for each pair of the other costs is all that can be in front; the anti join runs on these.
_FRONT = """g as (select profile, cognitive, expected_loss, min(computational) as computational from f group by all),
s as (select * from g a where not exists (select 1 from g b where a.profile = b.profile and b.cognitive <= a.cognitive and b.computational <= a.computational
    and b.expected_loss <= a.expected_loss and (b.cognitive < a.cognitive or b.computational < a.computational or b.expected_loss < a.expected_loss))),
front as (select f.* from f join s using (profile, cognitive, computational, expected_loss))"""


def _candidates(spark, sf):
    """A candidate class per line item: what it covers and three costs."""
    t = V.table(spark, sf, "lineitem")
    has = {
        "u_num": F.col("l_linenumber") % 2 == 1, "u_ling": F.col("l_returnflag") != "R", "u_int": F.floor(F.col("l_linenumber") / 2) % 2 == 1,
        "u_exp": F.col("l_linestatus") == "O", "u_conf": F.col("l_suppkey") % 3 == 0, "u_trace": F.col("l_partkey") % 2 == 0,
    }
    return t.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("name"),
        F.array_compact(F.array(*[F.when(on, tag) for tag, on in has.items()])).alias("coverage"),
        F.col("l_quantity").alias("cognitive"), F.round(F.col("l_extendedprice") / 100).cast("long").alias("computational"),
        F.round((F.col("l_tax") * 3 + 0.1 - F.col("l_discount")) * 100).cast("long").alias("expected_loss"),
    )


@query("skyline_candidates", S.ctes(_CANDIDATE, _FIT, _FRONT) + "select profile, name, cognitive, computational, expected_loss from front")
def skyline_candidates(spark, sf):
    fit = L.covering_candidates(_candidates(spark, sf), PROFILES, TAGS)
    return L.skyline(fit.select("profile", "name", *L.COSTS), L.COSTS, ["profile"])


_LISTED = "p as (" + " union all ".join(f"select '{name}' as profile" for name in PROFILES) + ")"


@query(
    "select_candidates",
    S.ctes(_CANDIDATE, _FIT, _FRONT, _LISTED)
    + """select p.profile, (select count(*) from f where f.profile = p.profile)::bigint as n_admissible, (select count(*) from front where front.profile = p.profile)::bigint as n_front,
    (select arg_min(name, (expected_loss, cognitive, computational, name)) from front where front.profile = p.profile) as audit_choice,
    (select arg_min(name, (cognitive, expected_loss, computational, name)) from front where front.profile = p.profile) as user_choice,
    case when not exists (select 1 from f where f.profile = p.profile) then 'D_choice' end as diagnostic,
    case when not exists (select 1 from f where f.profile = p.profile) then case when p.profile = 'multi' then 'u_multi' else '' end end as missing from p""",
)
def select_candidates(spark, sf):
    return L.select_candidates(_candidates(spark, sf), PROFILES, TAGS).withColumn("missing", F.array_join("missing", ";"))


TYPES, BANDS = ("click", "error", "purchase", "signup", "view"), ("low", "mid", "high")
_ALIGN_TABLE = """e as (select event_id, event_type as t, 's' || floor(value / 6)::int as s, 'u' || user_id % 10 as w, case when value >= 200 then 'high' when value >= 60 then 'mid' else 'low' end as band,
    least(value / 300, 1e0) as u, user_id from events),
pt as (select p_partkey as pos, ['click', 'error', 'purchase', 'signup', 'view'][p_partkey % 5 + 1] as ct, ['low', 'mid', 'high'][p_size % 3 + 1] as cb, 's' || p_size as cs, 'u' || p_partkey % 10 as cw,
    p_partkey % 7 as kind, 0.5e0 + p_size / 97 as scale from part),
m as (select e.*, pt.*, case kind when 0 then 1 else 2 end as n_terms from e join pt on s = cs and w = cw and (kind = 0 or (t = ct and band = cb))
    union all select e.*, pt.*, 0 from e join pt on kind = 1 and pos <= 7),
k as (select *, case when t = ct then 0.5e0 + 0.5e0 * u end as la, case when kind % 2 = 0 then case when t = ct then u end else case when band = cb then 1 - u end end as ra from m where kind <> 1 or n_terms = 0),
g as (select event_id, pos, 1 - n_terms / 2 as tg, 1 - (case when la is not null and ra is not null then 1 else 0 end) / (case when t = ct then 1e0 else 2e0 end) as rg,
    case when la is not null and ra is not null then abs(la * scale - ra) else 0e0 end as mg, 0.05e0 * (user_id % 3) as loss from k),
h as (select event_id, pos, least(1e0, mg + 0.5e0 * tg + 0.3e0 * rg) as ga, least(1e0, loss + 0.25e0 * tg) as de from g),
b as (select *, row_number() over (partition by event_id order by round(ga + 0.2e0 * de, 6), pos) as rn, count(*) over (partition by event_id) as n from h)
select e.event_id as case_id, coalesce(n, 0)::bigint as n_admissible, 'a' || pos as alignment, round(ga, 6) as gamma, round(de, 6) as delta_t, round(ga + 0.2e0 * de, 6) as cost,
    case when pos is null then 'no_admissible_alignment_candidate' when round(ga + 0.2e0 * de, 6) > 0.5 then 'alignment_cost_exceeds_gamma_max' end as diagnostic
from e left join b on e.event_id = b.event_id and rn = 1"""


def _event_pairs(spark, sf):
    """Two explanations of each event: by its type and value, and by its user and band."""
    e = V.event_explanations(spark, sf).withColumn("case_id", F.col("event_id"))
    value = V.table(spark, sf, "events").select(F.col("event_id").alias("case_id"), "value")
    e = e.join(value, "case_id")
    band = F.when(F.col("value") >= 200, "high").when(F.col("value") >= 60, "mid").otherwise("low")
    rule = lambda n: F.struct(n.alias("name"), F.create_map(F.lit("risk"), n).alias("conditions"), F.lit("watch").alias("conclusion"))
    by_type, by_band = F.concat(F.lit("r_"), F.col("event_type")), F.concat(F.lit("r_"), band)
    left = e.withColumn("terms", F.array("event_type", F.concat(F.lit("s"), F.floor(F.col("value") / 6).cast("string"))))
    right = e.withColumns(
        {
            "terms": F.array(band, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))),
            "rules": F.array(rule(by_type), rule(by_band)),
            "activations": F.create_map(by_type, F.col("u"), by_band, 1.0 - F.col("u")),
            "reduction_loss": 0.05 * (F.col("user_id") % 3),
        }
    )
    return pair_up(left, right)


def _alignments(spark, sf):
    """A candidate per part: which term and rule of the left side stands for which of the right side."""
    t = V.table(spark, sf, "part")
    kind = F.col("p_partkey") % 7
    text = lambda c: c.cast("string")
    ct = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    cb = F.element_at(F.array(*[F.lit(x) for x in BANDS]), (F.col("p_size") % 3 + 1).cast("int"))
    cs, cw = F.concat(F.lit("s"), text(F.col("p_size"))), F.concat(F.lit("u"), text(F.col("p_partkey") % 10))
    rare = F.create_map(cs, cw)
    terms = F.when(kind == 1, F.create_map().cast("map<string,string>")).when(kind == 0, rare).otherwise(F.create_map(ct, cb, cs, cw))
    rules = F.create_map(F.concat(F.lit("r_"), ct), F.concat(F.lit("r_"), F.when(kind % 2 == 0, ct).otherwise(cb)))
    # Candidates without terms fit every pair; a few of them are enough.
    return t.where((kind != 1) | (F.col("p_partkey") <= 7)).select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("a"), text(F.col("p_partkey"))).alias("name"), terms.alias("term_map"), rules.alias("rule_map"),
        (0.5 + F.col("p_size") / 97).alias("activation_scale"),
    )


@query("align_from_table", S.ctes(_ALIGN_TABLE))
def align_from_table(spark, sf):
    return L.align_from_table(_event_pairs(spark, sf), _alignments(spark, sf), gamma_max=0.5)
