"""Uncertainty representations as tagged structs: selection, reduction, distance.

Every representation built for a scalar risk is constant in its argument, so
reduction and distance are closed forms over the struct's fields.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.plan import CANDIDATES, Candidate
from .numeric import array_mean, array_sum, clip01, let, string_array

SOURCE_STEP = 0.05
LEVEL_TYPE = (
    "struct<kind:string,value:double,lo:double,hi:double,values:array<double>,"
    "t:double,i:double,f:double,src_t:string,src_i:string,src_f:string>"
)
_LEVEL_FIELDS = {
    "kind": "string", "value": "double", "lo": "double", "hi": "double", "values": "array<double>",
    "t": "double", "i": "double", "f": "double", "src_t": "string", "src_i": "string", "src_f": "string",
}
_REP_FIELDS = {
    **_LEVEL_FIELDS,
    "levels": f"array<{LEVEL_TYPE}>", "weights": "array<double>", "links": "array<string>",
    "ann_source": "string", "ann_trace": "string",
}


def _tagged(fields: dict[str, str], **values) -> Column:
    cols = []
    for name, dtype in fields.items():
        col = values.get(name)
        col = F.lit(None) if col is None else col if isinstance(col, Column) else F.lit(col)
        cols.append(col.cast(dtype).alias(name))
    return F.struct(*cols)


def level(kind: str, **values) -> Column:
    """A level of a multi-level representation: F0, FI, FH or FNsrc."""
    return _tagged(_LEVEL_FIELDS, kind=kind, **values)


def scalar(value: Column) -> Column:
    return _tagged(_REP_FIELDS, kind="F0", value=clip01(value))


def interval(lo: Column, hi: Column) -> Column:
    lo, hi = clip01(lo), clip01(hi)
    return _tagged(_REP_FIELDS, kind="FI", lo=F.least(lo, hi), hi=F.greatest(lo, hi))


def hesitant(values: Column) -> Column:
    return _tagged(_REP_FIELDS, kind="FH", values=F.array_sort(F.transform(values, clip01)))


def neutrosophic(t: Column, i: Column, f: Column, src_t="", src_i="", src_f="") -> Column:
    return _tagged(
        _REP_FIELDS, kind="FNsrc", t=clip01(t), i=clip01(i), f=clip01(f), src_t=src_t, src_i=src_i, src_f=src_f
    )


def multilevel(levels: Sequence[Column], weights: Sequence[float] | None = None, links: Iterable[str] = ()) -> Column:
    if not levels:
        raise ValueError("a multi-level representation needs levels")
    weights = list(weights or [1.0] * len(levels))
    total = sum(weights)
    return _tagged(
        _REP_FIELDS,
        kind="FML",
        levels=F.array(*levels),
        weights=F.array(*[F.lit(w / total) for w in weights]),
        links=string_array(sorted(links)),
    )


def annotate_source(rep: Column, source: Column, trace_id: Column) -> Column:
    """Wrap a representation with the source and trace it came from."""
    return rep.withField("ann_source", source.cast("string")).withField("ann_trace", trace_id.cast("string"))


# --- reduction -----------------------------------------------------------

def _any_source(r: Column) -> Column:
    return (F.concat(r["src_t"], r["src_i"], r["src_f"]) != "").cast("double")


def _balanced_loss(r: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(r["i"], F.abs(r["t"] + r["f"] - 1.0) / 2.0) + SOURCE_STEP * _any_source(r))


def _support_loss(r: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(r["i"], F.abs(r["f"] - (1.0 - r["t"]))) + SOURCE_STEP * _any_source(r))


def _level_value(r: Column) -> Column:
    return (
        F.when(r["kind"] == "F0", r["value"])
        .when(r["kind"] == "FI", (r["lo"] + r["hi"]) / 2.0)
        .when(r["kind"] == "FH", array_mean(r["values"]))
        .when(r["kind"] == "FNsrc", clip01((r["t"] + 1.0 - r["f"]) / 2.0))
    )


def _level_loss(r: Column) -> Column:
    mean = array_mean(r["values"])
    return (
        F.when(r["kind"] == "F0", 0.0)
        .when(r["kind"] == "FI", (r["hi"] - r["lo"]) / 2.0)
        .when(r["kind"] == "FH", F.greatest(F.array_max(r["values"]) - mean, mean - F.array_min(r["values"])))
        .when(r["kind"] == "FNsrc", _balanced_loss(r))
    )


def reduced_value(rep: Column) -> Column:
    """Scalar the representation reduces to. The balanced form wins ties for FNsrc."""
    multi = array_sum(F.zip_with(rep["levels"], rep["weights"], lambda lv, w: w * _level_value(lv)))
    return (
        F.when(rep["kind"] == "FML", multi)
        .when((rep["kind"] == "FNsrc") & rep["ann_source"].isNull() & (_support_loss(rep) < _balanced_loss(rep)), rep["t"])
        .otherwise(_level_value(rep))
    )


def reduction_loss(rep: Column) -> Column:
    """Detail lost by reducing to a scalar, in [0,1]."""
    multi = array_sum(F.zip_with(rep["levels"], rep["weights"], lambda lv, w: w * _level_loss(lv)))
    multi = F.least(F.lit(1.0), multi + 0.02 * F.size(rep["links"]))
    bare = F.when(rep["kind"] == "FML", multi)
    plain = bare.when(rep["kind"] == "FNsrc", F.least(_balanced_loss(rep), _support_loss(rep))).otherwise(_level_loss(rep))
    annotated = F.least(F.lit(1.0), bare.otherwise(_level_loss(rep)) + SOURCE_STEP)
    return F.when(rep["ann_source"].isNull(), plain).otherwise(annotated)


def reduction_policy(rep: Column) -> Column:
    return (
        F.when(rep["ann_source"].isNotNull() | rep["kind"].isin("F0", "FML"), "canonical")
        .when(rep["kind"] == "FI", "mid")
        .when(rep["kind"] == "FH", "mean")
        .when(_support_loss(rep) < _balanced_loss(rep), "support_only")
        .otherwise("balanced")
    )


# --- distance ------------------------------------------------------------

def _hausdorff(a: Column, b: Column) -> Column:
    def directed(xs: Column, ys: Column) -> Column:
        return F.aggregate(
            xs,
            F.lit(0.0),
            lambda acc, x: F.greatest(acc, F.aggregate(ys, F.lit(2.0), lambda m, y: F.least(m, F.abs(x - y)))),
        )

    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 1.0).otherwise(F.greatest(directed(a, b), directed(b, a)))


def _components_gap(t1, i1, f1, t2, i2, f2, same_sources: Column) -> Column:
    gap = F.greatest(F.abs(t1 - t2), F.abs(i1 - i2), F.abs(f1 - f2))
    return F.least(F.lit(1.0), gap + F.when(same_sources, 0.0).otherwise(SOURCE_STEP))


def _level_distance(a: Column, b: Column) -> Column:
    """Distance of two single-level representations; 1 when their kinds cannot be compared.

    A scalar x is embedded in the other kind as [x,x], {x} or (x, 0, 1-x).
    """
    scalar_a, scalar_b = a["kind"] == "F0", b["kind"] == "F0"

    def pick(r, field, fallback):
        return F.when(r["kind"] == "F0", fallback).otherwise(r[field])

    both = lambda kind: (scalar_a | (a["kind"] == kind)) & (scalar_b | (b["kind"] == kind))
    fi = F.greatest(
        F.abs(pick(a, "lo", a["value"]) - pick(b, "lo", b["value"])),
        F.abs(pick(a, "hi", a["value"]) - pick(b, "hi", b["value"])),
    )
    fh = _hausdorff(pick(a, "values", F.array(a["value"])), pick(b, "values", F.array(b["value"])))
    srcs = [
        pick(a, s, F.lit("")) == pick(b, s, F.lit("")) for s in ("src_t", "src_i", "src_f")
    ]
    fn = _components_gap(
        pick(a, "t", a["value"]), pick(a, "i", F.lit(0.0)), pick(a, "f", 1.0 - a["value"]),
        pick(b, "t", b["value"]), pick(b, "i", F.lit(0.0)), pick(b, "f", 1.0 - b["value"]),
        srcs[0] & srcs[1] & srcs[2],
    )
    return (
        F.when(scalar_a & scalar_b, F.abs(a["value"] - b["value"]))
        .when(both("FI"), fi)
        .when(both("FH"), fh)
        .when(both("FNsrc"), fn)
        .otherwise(F.lit(1.0))
    )


def _as_level(rep: Column) -> Column:
    return F.struct(*[rep[name].alias(name) for name in _LEVEL_FIELDS])


def _multilevel_distance(a: Column, b: Column) -> Column:
    def levels(r):
        return F.when(r["kind"] == "FML", r["levels"]).otherwise(F.array(_as_level(r)))

    def links(r):
        return F.when(r["kind"] == "FML", F.array_sort(r["links"])).otherwise(F.array().cast("array<string>"))

    # The first operand's weights count, unless it is a scalar and the other is multi-level.
    own = F.when(a["kind"] == "FML", a["weights"]).when(b["kind"] == "FML", b["weights"])

    def gap(la: Column, lb: Column) -> Column:
        pairs = F.zip_with(
            F.zip_with(la, lb, lambda x, y: F.struct(x.alias("a"), y.alias("b"))),
            own,
            lambda q, w: F.when(q["a"].isNotNull() & q["b"].isNotNull(), w * _level_distance(q["a"], q["b"])).otherwise(0.0),
        )
        penalty = F.abs(F.size(la) - F.size(lb)) / F.greatest(F.size(la), F.size(lb))
        return array_sum(pairs) + 0.10 * penalty

    total = let(levels(a), lambda la: let(levels(b), lambda lb: gap(la, lb)))
    return F.least(F.lit(1.0), total + F.when(links(a) == links(b), 0.0).otherwise(0.05))


def _unwrapped_distance(a: Column, b: Column) -> Column:
    comparable = (a["kind"] == "FML") | ((a["kind"] == "F0") & (b["kind"] == "FML"))
    return (
        F.when(comparable, _multilevel_distance(a, b))
        .when(b["kind"] == "FML", F.lit(1.0))
        .otherwise(_level_distance(a, b))
    )


def representation_distance(a: Column, b: Column) -> Column:
    wrapped_a, wrapped_b = a["ann_source"].isNotNull(), b["ann_source"].isNotNull()
    # What wrapping adds to the distance of the bare representations.
    added = (
        F.when(
            wrapped_a & wrapped_b,
            F.when(a["ann_source"] == b["ann_source"], 0.0).otherwise(0.05)
            + F.when(a["ann_trace"] == b["ann_trace"], 0.0).otherwise(0.05),
        )
        .when(wrapped_a | wrapped_b, F.lit(0.10))
        .otherwise(F.lit(0.0))
    )
    clash = ~wrapped_a & wrapped_b & (a["kind"] != "F0")
    return F.when(clash, 1.0).otherwise(F.least(F.lit(1.0), _unwrapped_distance(a, b) + added))


# --- profiles and selection ----------------------------------------------

def uncertainty_profile(**flags: Column) -> Column:
    """Tags of a case: the two base tags plus one per true flag, sorted."""
    tags = [F.lit("u_num"), F.lit("u_ling")] + [F.when(flag, F.lit(tag)) for tag, flag in flags.items()]
    return F.array_sort(F.array_compact(F.array(*tags)))


def candidate_array(candidates: Sequence[Candidate] = CANDIDATES) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(c.name).alias("name"),
                string_array(c.coverage).alias("coverage"),
                F.lit(c.cognitive).alias("cognitive"),
                F.lit(c.computational).alias("computational"),
                F.lit(c.expected_loss).alias("expected_loss"),
            )
            for c in candidates
        ]
    )


def pareto_front(candidates: Column) -> Column:
    """Candidates of one row that no other candidate of the row beats on all three costs."""

    def beats(o: Column, c: Column) -> Column:
        no_worse = (
            (o["cognitive"] <= c["cognitive"])
            & (o["computational"] <= c["computational"])
            & (o["expected_loss"] <= c["expected_loss"])
        )
        better = (
            (o["cognitive"] < c["cognitive"])
            | (o["computational"] < c["computational"])
            | (o["expected_loss"] < c["expected_loss"])
        )
        return no_worse & better

    return F.filter(candidates, lambda c: ~F.exists(candidates, lambda o: beats(o, c)))


def covering(candidates: Column, profile: Column) -> Column:
    return F.filter(candidates, lambda c: F.size(F.array_except(profile, c["coverage"])) == 0)


_MODE_ORDER = {
    "audit": ("expected_loss", "cognitive", "computational"),
    "user": ("cognitive", "expected_loss", "computational"),
}


def best_candidate(candidates: Column, mode: str = "audit") -> Column:
    """Name of the cheapest candidate in the mode's cost order; null when there is none."""
    ranked = F.transform(
        candidates, lambda c: F.struct(*[c[name] for name in _MODE_ORDER[mode]], c["name"].alias("name"))
    )
    return F.array_min(ranked)["name"]


def select_class(profile: Column, mode: str = "audit", candidates: Sequence[Candidate] = CANDIDATES) -> Column:
    """Cheapest covering class on the Pareto front, or D_choice when none covers the profile.

    The candidate table is a literal, so this is a projection: no join, no shuffle.
    """
    admissible = let(profile, lambda tags: covering(candidate_array(candidates), tags))
    return F.coalesce(best_candidate(let(admissible, pareto_front), mode), F.lit("D_choice"))


def missing_tags(profile: Column, candidates: Sequence[Candidate] = CANDIDATES) -> Column:
    covered = sorted({tag for c in candidates for tag in c.coverage})
    return F.array_sort(F.array_except(profile, string_array(covered)))


def build_representation(z: Column, profile: Column, selected: Column) -> Column:
    """Representation of a scalar risk for a profile and a selected class."""

    def has(tag: str) -> Column:
        return F.array_contains(profile, tag)

    z = clip01(z)
    lo, hi = F.greatest(F.lit(0.0), z - 0.04), F.least(F.lit(1.0), z + 0.04)
    spread = F.array(F.greatest(F.lit(0.0), z - 0.08), F.least(F.lit(1.0), z + 0.06))
    doubt = F.when(has("u_conf"), 0.15).otherwise(0.05)
    against = F.greatest(F.lit(0.0), 1.0 - z - 0.04)
    is_ml = selected.startswith("FML")
    # Levels are chosen per row, so the array is compacted and weighted evenly.
    chosen = F.array_compact(
        F.array(
            F.when(has("u_int") | is_ml, level("FI", lo=lo, hi=hi)),
            F.when(has("u_exp") | is_ml, level("FH", values=spread)),
            F.when(
                has("u_conf") | has("u_trace") | is_ml,
                level("FNsrc", t=z, i=doubt, f=against, src_t="model", src_i="", src_f="observer"),
            ),
        )
    )
    levels = F.when(F.size(chosen) == 0, F.array(level("F0", value=z))).otherwise(chosen)

    def multi_of(picked: Column) -> Column:
        linked = F.array(F.lit("dataset_profile>risk:same_case"))
        return _tagged(
            _REP_FIELDS,
            kind="FML",
            levels=picked,
            weights=F.array_repeat(1.0 / F.size(picked), F.size(picked)),
            links=F.when(F.size(picked) > 1, linked).otherwise(F.array().cast("array<string>")),
        )

    multi = let(levels, multi_of)
    return (
        F.when(is_ml | has("u_multi"), multi)
        .when(
            (selected == "FNsrc") | has("u_conf") | has("u_trace"),
            neutrosophic(z, doubt, against, src_t="model", src_f="observer"),
        )
        .when((selected == "FH") | has("u_exp"), hesitant(spread))
        .when((selected == "FI") | has("u_int"), interval(lo, hi))
        .otherwise(scalar(z))
    )


# --- reduced forms ---------------------------------------------------------

def interval_gap_lite(lo1, hi1, lo2, hi2) -> Column:
    return (F.abs(lo1 - lo2) + F.abs(hi1 - hi2)) / 2.0


def component_gap_lite(t1, i1, f1, t2, i2, f2) -> Column:
    return (F.abs(t1 - t2) + F.abs(i1 - i2) + F.abs(f1 - f2)) / 3.0


def weighted_reduction_lite(values: Column, weights: Column) -> Column:
    """Weighted mean of level values and their spread."""
    total = array_sum(weights)
    total = F.when(total == 0, 1.0).otherwise(total)
    value = array_sum(F.zip_with(values, weights, lambda v, w: v * w)) / total
    return F.struct(value.alias("value"), (F.array_max(values) - F.array_min(values)).alias("spread"))


def select_class_lite(needs: Column, candidates: Sequence[Candidate]) -> Column:
    picked = best_candidate(covering(candidate_array(candidates), needs), "audit")
    return F.coalesce(picked, F.lit("DiagnosticState"))
