"""Choosing from candidate tables: coverage of a profile, cheapest candidates that no other one beats."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from ..session import materialised

#: Candidates are compared with the front in blocks of so many.
BLOCK = 256


def tag_mask(tags: Column, vocabulary: Sequence[str]) -> Column:
    """Tags as bits of a long, by their place in the vocabulary (at most 63 tags); other tags and null have no bit."""
    bits = [F.when(F.array_contains(tags, tag), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, tag in enumerate(vocabulary)]
    out = F.lit(0).cast("long")
    for bit in bits:
        out = out.bitwiseOR(F.coalesce(bit, F.lit(0).cast("long")))
    return out


def _front(costs: np.ndarray) -> np.ndarray:
    """Rows that no other row beats: at most as high everywhere and lower somewhere. Equal rows stay together.

    Sorted by their sum, then by the costs, a row can be beaten only by one before it.
    """
    order = np.lexsort((*costs.T[::-1], costs.sum(axis=1)))
    kept = np.zeros(0, dtype=np.int64)

    def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        no_worse = (by[None] <= rows[:, None]).all(axis=2)
        return (no_worse & (by[None] < rows[:, None]).any(axis=2)).any(axis=1)

    for start in range(0, len(order), BLOCK):
        block = order[start : start + BLOCK]
        for k in range(0, len(kept), 16 * BLOCK):
            block = block[~beaten(costs[block], costs[kept[k : k + 16 * BLOCK]])]
        block = block[~beaten(costs[block], costs[block])]
        kept = np.concatenate([kept, block])
    return kept


def _local_fronts(costs: Sequence[str], group: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The front of each group among the rows of a task; only fronts are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                mine = rows.take(pa.array(at))
                whole = pa.concat_tables([held[key], mine]) if key in held else mine
                matrix = np.column_stack([whole.column(c).to_numpy().astype(float) for c in costs])
                held[key] = whole.take(pa.array(_front(matrix))).combine_chunks()
        for table in held.values():
            yield from table.to_batches()

    return run


def skyline(candidates: DataFrame, costs: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Candidates of each group that no other candidate of the group beats; lower costs are better, equal ones all stay.

    Tasks keep the front of what they read, whatever its key; only these fronts are shuffled by group and merged, so a
    group with all rows is still worked on everywhere. The front of one group is held in a task. Rows with a
    null or NaN cost are left out; all columns stay.
    """
    known = candidates
    for c in costs:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    local = known.mapInArrow(_local_fronts(costs, group), known.schema)
    merged = local.repartition(*[F.col(g) for g in group]) if group else local.repartition(1)
    return merged.mapInArrow(_local_fronts(costs, group), known.schema)


_MODES = {"audit": ("expected_loss", "cognitive", "computational"), "user": ("cognitive", "expected_loss", "computational")}
COSTS = ("cognitive", "computational", "expected_loss")


def covering_candidates(candidates: DataFrame, profiles: Mapping[str, Sequence[str]], vocabulary: Sequence[str]) -> DataFrame:
    """Candidates once per profile whose tags their coverage holds, with the profile's name. A projection: profiles are literals."""
    for tags in profiles.values():
        if set(tags) - set(vocabulary):
            raise ValueError("every tag of a profile must be in the vocabulary")
    places = {tag: 1 << k for k, tag in enumerate(vocabulary)}
    wanted = F.array(*[F.struct(F.lit(name).alias("profile"), F.lit(sum(places[t] for t in set(tags))).cast("long").alias("mask")) for name, tags in profiles.items()])
    masked = candidates.withColumn("_mask", tag_mask(F.col("coverage"), vocabulary))
    return masked.select("*", F.explode(F.filter(wanted, lambda p: F.col("_mask").bitwiseAND(p["mask"]) == p["mask"])["profile"]).alias("profile")).drop("_mask")


def select_candidates(candidates: DataFrame, profiles: Mapping[str, Sequence[str]], vocabulary: Sequence[str]) -> DataFrame:
    """Per profile: n_admissible, n_front, the cheapest candidate for users and for audits, diagnostic and missing tags.

    candidates: name, coverage array<string> and the three costs. Equal costs are decided by name. A profile that no
    candidate covers has the diagnostic D_choice and the tags that none of them has.
    """
    spark = candidates.sparkSession
    fit = covering_candidates(candidates, profiles, vocabulary)
    front = skyline(fit.select("profile", "name", *COSTS), COSTS, ["profile"])
    best = [F.min_by("name", F.struct(*costs, "name")).alias(f"{mode}_choice") for mode, costs in _MODES.items()]
    chosen = front.groupBy("profile").agg(F.count(F.lit(1)).alias("n_front"), *best)
    counts = fit.groupBy("profile").agg(F.count(F.lit(1)).alias("n_admissible"))
    covered = candidates.agg(*[F.max(F.array_contains("coverage", tag)).alias(f"_has_{k}") for k, tag in enumerate(vocabulary)])
    has = {tag: F.coalesce(F.col(f"_all._has_{k}"), F.lit(False)) for k, tag in enumerate(vocabulary)}
    listed = spark.createDataFrame([(name, sorted(set(tags))) for name, tags in profiles.items()], "profile string, tags array<string>")
    with_all = listed.withColumn("_all", covered.select(F.struct("*").alias("s")).scalar())
    gone = [F.when(F.array_contains("tags", tag) & ~held, F.lit(tag)) for tag, held in has.items()]
    out = with_all.join(counts, "profile", "left").join(chosen, "profile", "left")
    return out.select(
        "profile", F.coalesce("n_admissible", F.lit(0)).alias("n_admissible"), F.coalesce("n_front", F.lit(0)).alias("n_front"), "audit_choice", "user_choice",
        F.when(F.col("n_admissible").isNull(), "D_choice").alias("diagnostic"),
        F.when(F.col("n_admissible").isNull(), F.array_sort(F.array_compact(F.array(*gone)))).alias("missing"),
    )


#: Kinds of candidates in one row of a term set's list.
KINDS_AT_ONCE = 1000


def _kinds(candidates: DataFrame) -> DataFrame:
    """Candidates of equal maps and scale as one row: the first pos with its name, and their number n.

    They cost the same everywhere, so only the first can win. Grouping by entries keeps the order of the maps.
    """
    filled = [F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))).alias(f"_{c}") for c in ("term_map", "rule_map")]
    rows = candidates.select("pos", "name", *filled, F.col("activation_scale").cast("double").alias("scale"))
    merged = rows.groupBy("_term_map", "_rule_map", "scale").agg(F.min(F.struct("pos", "name")).alias("_first"), F.count(F.lit(1)).alias("n"))
    maps = [F.map_from_entries(f"_{c}").alias(c) for c in ("term_map", "rule_map")]
    return merged.select("_first.pos", "_first.name", *maps, "scale", "n")


def align_from_table(pairs: DataFrame, candidates: DataFrame, lam: float = 0.2, gamma_max: float = 0.4) -> DataFrame:
    """Cheapest admissible alignment of each pair out of a table of candidates: pos, name, term_map, rule_map, activation_scale.

    A candidate is admissible where the left terms hold all keys of its term_map and the right terms all values. Candidates
    of equal maps and scale are one kind with a number. Every kind is entered under the rarest of its terms; the distinct
    term sets of the pairs look up their terms there, and what is found is verified on the whole maps. A pair meets the
    admissible kinds of its set as lists, and the cheapest is taken inside the row, so pairs times candidates are never
    rows. Candidates without terms are admissible everywhere. The lowest pos wins among equal costs. Null lists and maps
    are empty. pairs: l_* and r_* columns of two explanations and a case_id that is unique.
    """
    empty = F.array().cast("array<string>")
    held = {s: F.array_sort(F.array_distinct(F.coalesce(F.col(f"{s}_terms"), empty))) for s in ("l", "r")}
    named = pairs.withColumns({"_l": held["l"], "_r": held["r"]})
    sets = named.select("_l", "_r").distinct()
    marked = lambda c, side: F.transform(c, lambda t: F.concat(F.lit(f"{side}:"), t))
    tokens = materialised(sets.select("*", F.explode(F.concat(F.array(F.lit("")), marked(F.col("_l"), "l"), marked(F.col("_r"), "r"))).alias("token")))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    kinds = materialised(_kinds(candidates))
    needs = F.concat(F.array(F.lit("")), marked(F.map_keys("term_map"), "l"), marked(F.map_values("term_map"), "r"))
    # A term that no pair has makes a candidate inadmissible; the inner join with the frequencies may lose such a token, verification does not.
    entries = kinds.select("pos", F.explode(needs).alias("token")).join(frequency, "token").groupBy("pos").agg(F.min_by("token", F.struct("sets", "token")).alias("token"))
    entered = kinds.join(entries, "pos")
    fits = (F.size(F.array_except(F.map_keys("term_map"), "_l")) == 0) & (F.size(F.array_except(F.map_values("term_map"), "_r")) == 0)
    place = F.row_number().over(Window.partitionBy("_l", "_r").orderBy("pos"))
    admissible = tokens.join(entered, "token").where(fits).withColumn("_list", F.floor((place - 1) / KINDS_AT_ONCE))
    kind = F.struct("pos", "name", "term_map", "rule_map", "scale", "n")
    # Stored, so that the plan knows the size: pairs meet lists that are few without a shuffle.
    lists = materialised(admissible.groupBy("_l", "_r", "_list").agg(F.collect_list(kind).alias("_kinds")).drop("_list"))
    names = {s: F.transform(F.col(f"{s}_rules"), lambda x: x["name"]) for s in ("l", "r")}
    narrow = named.select(
        "case_id", "_l", "_r", "l_activations", "r_activations", F.abs(F.col("l_reduction_loss") - F.col("r_reduction_loss")).alias("_loss"),
        *[names[s].alias(f"_{s}_names") for s in ("l", "r")],
    )

    def parts(k: Column) -> Column:
        rules = F.map_entries(k["rule_map"])
        term_gap = 1.0 - F.size(k["term_map"]) / F.greatest(F.lit(1), F.size("_l"))
        hits = F.size(F.filter(rules, lambda e: F.array_contains("_l_names", e["key"]) & F.array_contains("_r_names", e["value"])))
        rule_gap = 1.0 - hits / F.greatest(F.lit(1), F.size(F.array_union("_l_names", F.map_keys(k["rule_map"]))))
        gaps = F.array_compact(F.transform(rules, lambda e: F.abs(F.element_at("l_activations", e["key"]) * k["scale"] - F.element_at("r_activations", e["value"]))))
        mean_gap = let(gaps, lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g)).otherwise(0.0))
        return F.struct(k["pos"].alias("pos"), k["name"].alias("name"), term_gap.alias("t"), rule_gap.alias("s"), mean_gap.alias("m"))

    def costs(x: Column) -> Column:
        gamma = F.least(F.lit(1.0), x["m"] + 0.5 * x["t"] + 0.3 * x["s"])
        delta = F.least(F.lit(1.0), F.col("_loss") + 0.25 * x["t"])
        return F.struct(x["pos"].alias("pos"), x["name"].alias("name"), gamma.alias("g"), delta.alias("d"))

    def option(x: Column) -> Column:
        cost = F.round(x["g"] + lam * x["d"], 6)
        return F.struct(cost.alias("cost"), x["pos"].alias("pos"), x["name"].alias("name"), F.round(x["g"], 6).alias("gamma"), F.round(x["d"], 6).alias("delta_t"))

    scored = narrow.join(lists, ["_l", "_r"], "left").select(
        "case_id",
        F.array_min(F.transform(F.transform(F.transform("_kinds", parts), costs), option)).alias("_option"),
        F.aggregate("_kinds", F.lit(0).cast("long"), lambda a, k: a + k["n"]).alias("_n"),
    )
    best = scored.groupBy("case_id").agg(F.min("_option").alias("_best"), F.sum("_n").alias("n_admissible"))
    return best.select(
        "case_id", F.coalesce("n_admissible", F.lit(0)).alias("n_admissible"), F.col("_best.name").alias("alignment"), F.col("_best.gamma").alias("gamma"),
        F.col("_best.delta_t").alias("delta_t"), F.col("_best.cost").alias("cost"),
        F.when(F.col("_best").isNull(), "no_admissible_alignment_candidate").when(F.col("_best.cost") > gamma_max, "alignment_cost_exceeds_gamma_max").alias("diagnostic"),
    )


# The functions travel with the tasks that use them, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
