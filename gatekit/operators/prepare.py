"""Profiling and preparation of tables before scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.numeric import config_array, hash_uniform
from ..session import materialised
from .quantiles import cut_points, exact_quantiles, unpivot
from .ranks import dense_ranks

# Column names taken as the target, in order of preference.
TARGET_NAMES = ("target", "label", "class", "y", "result", "diagnosis", "risk", "is_risk")
INTERVAL_ENDS = (("_min", "_max"), ("_lower", "_upper"), ("_lo", "_hi"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def guess_target(df: DataFrame) -> str | None:
    """A well-known name if there is one, else the last column when it has few distinct values."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in TARGET_NAMES:
        if name in by_lower:
            return by_lower[name]
    if not df.columns:
        return None
    last = df.columns[-1]
    # The distinct values are counted only up to the limit, so a column of unique values is not shuffled for nothing.
    few = max(20, int(0.05 * (n := df.count())))
    seen = df.select(F.col(f"`{last}`").alias("v")).where(F.col("v").isNotNull()).distinct().limit(few + 1).count()
    return last if n and seen <= few else None


def has_interval_pairs(columns: Sequence[str]) -> bool:
    names = {c.lower() for c in columns}
    return any(
        c.endswith(lo) and c[: -len(lo)] + hi in names for c in names for lo, hi in INTERVAL_ENDS
    )


def profile_table(df: DataFrame, requires_audit: bool = True) -> DataFrame:
    """One row describing the table and the uncertainty tags it calls for.

    The schema part is read on the driver; the data part is one aggregation.
    """
    numeric = numeric_columns(df)
    text = [c for c in df.columns if c not in numeric]
    lowered = [c.lower() for c in df.columns]
    flags = {
        "has_intervals": has_interval_pairs(df.columns),
        "has_multiple_experts": sum(c.startswith("expert_") for c in lowered) >= 2,
        "has_source_conflict": sum(c.startswith("source_") for c in lowered) >= 2,
        "requires_audit": requires_audit,
    }
    nulls = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns]
    agg = df.agg(F.count("*").alias("n_rows"), (sum(nulls[1:], nulls[0]) / len(nulls)).alias("missing_rate"))
    fixed = {
        "u_num": bool(numeric),
        "u_ling": bool(text),
        "u_int": flags["has_intervals"],
        "u_expert": flags["has_multiple_experts"],
        "u_conf": flags["has_source_conflict"],
    }
    tags = [F.lit(t) for t, on in fixed.items() if on]
    tags.append(F.when(F.lit(requires_audit) | (F.col("missing_rate") > 0), F.lit("u_trace")))
    return agg.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(text)).alias("n_categorical"),
        F.coalesce("missing_rate", F.lit(0.0)).alias("missing_rate"),
        *[F.lit(v).alias(k) for k, v in flags.items()],
        F.array_sort(F.array_compact(F.array(*tags))).alias("tags"),
    )


def profile_to_tags(tags: Column) -> Column:
    """Representation profile of a table profile: expert tag renamed, multi tag added."""
    renamed = F.array_union(
        F.array(F.lit("u_ling")), F.transform(tags, lambda t: F.when(t == "u_expert", "u_exp").otherwise(t))
    )
    complex_tags = F.array(*[F.lit(t) for t in ("u_int", "u_exp", "u_conf", "u_trace")])
    many = F.size(F.array_intersect(renamed, complex_tags)) >= 2
    return F.array_sort(F.when(many, F.array_union(renamed, F.array(F.lit("u_multi")))).otherwise(renamed))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(unpivot(df, columns), "value", {"median": 0.5}, keys=["column"], few_keys=True)


def _as_map(table: DataFrame, key: str, value: str) -> Column:
    """A small keyed table as a map, read by a scalar subquery instead of a join."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def impute(df: DataFrame) -> DataFrame:
    """Fill numeric nulls with the column median (0 if all null), text nulls with 'unknown'.

    The medians, one per column, reach the rows through a scalar subquery: no join.
    """
    numeric = numeric_columns(df)
    filled = df
    if numeric:
        by_column = _as_map(medians(df, numeric), "column", "median")
        filled = filled.withColumn("_medians", by_column)
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in numeric:
            median = F.coalesce(F.element_at("_medians", F.lit(field.name)), F.lit(0.0))
            cols.append(F.coalesce(c.cast("double"), median).alias(field.name))
        elif field.dataType.typeName() == "string":
            cols.append(F.coalesce(c, F.lit("unknown")).alias(field.name))
        else:
            cols.append(c)
    return filled.select(*cols)


#: A column of more levels than this is not spread over columns of its own; `one_hot_vector` has no such bound.
MOST_LEVELS = 1_000


def levels_of(df: DataFrame, column: str, most: int = MOST_LEVELS) -> list:
    """Sorted distinct values of a column that is about to become columns, which the driver has to name."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels: use one_hot_vector, or pass the levels that are wanted")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, columns: Sequence[str], dummy_na: bool = False, levels: dict[str, list] | None = None) -> DataFrame:
    """Replace text columns by 0/1 columns, one per level. Pass levels to avoid the discovery jobs.

    Found levels are at most MOST_LEVELS per column, else the call is refused; `one_hot_vector` serves any number.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    dummies = []
    for c in columns:
        for value in levels[c] if levels and c in levels else levels_of(df, c):
            dummies.append(F.coalesce((F.col(c) == value).cast("int"), F.lit(0)).alias(f"{c}_{value}"))
        if dummy_na:
            dummies.append(F.col(c).isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*kept, *dummies)


def one_hot_vector(df: DataFrame, column: str, out: str) -> DataFrame:
    """A sparse 0/1 vector with one place per level, for columns of many levels; null has no place."""
    indexed = f"_{column}_level"
    steps = Pipeline(
        stages=[
            StringIndexer(inputCol=column, outputCol=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCol=indexed, outputCol=out, dropLast=True),
        ]
    )
    return steps.fit(df).transform(df).drop(indexed)


def encode_label(df: DataFrame, column: str, out: str = "label_code") -> DataFrame:
    """Label position in the sorted distinct labels, from 0; null for null.

    Distinct labels are ranked by range partitions, one row each; rows meet their code in an equi-join.
    """
    codes = dense_ranks(df, column, "_code").select(F.col(column).alias("_label"), F.col("_code").cast("long").alias(out))
    return df.join(codes, F.col(column) == F.col("_label"), "left").drop("_label")


def binarize_at_median(df: DataFrame, column: str, out: str = "risk_target") -> DataFrame:
    median = exact_quantiles(df, column, {"median": 0.5}).select("median").scalar()
    return df.withColumn(out, (F.col(column) >= median).cast("int"))


def stratified_split(df: DataFrame, label: str, case_id: Sequence[str], seed: int = 42, test: float = 0.25, validation: float = 0.25, stratify: bool = True) -> DataFrame:
    """Repeatable train / validation / test split with exact shares per class.

    Each row gets a hash draw; per class the draw at the wanted ranks is found once and stored, and rows meet the cuts of
    their class in an equi-join. As the size of the stored cuts is known to the plan, Spark broadcasts them where classes
    are few, without a shuffle of the rows by class. stratify=False takes the shares of the whole table instead.
    """
    drawn = df.withColumn("_u", hash_uniform(seed, *[F.col(c) for c in case_id]))
    shares = (test, test + (1 - test) * validation)
    stratum = F.coalesce(F.col(label).cast("string"), F.lit("")) if stratify else F.lit("*")
    labelled = drawn.select(stratum.alias("stratum"), "_u")
    cuts = materialised(cut_points(labelled, "_u", shares, keys=["stratum"]))
    with_cut = drawn.withColumn("_stratum", stratum).join(cuts.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    return with_cut.withColumn(
        "split",
        F.when(F.col("_u") < F.col("cut_0"), "test")
        .when(F.col("_u") < F.col("cut_1"), "validation")
        .otherwise("train"),
    ).drop("_u", "_stratum", "cut_0", "cut_1")


def data_card(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.count("*").alias("n_total"),
        F.count_if(y == 1).alias("n_pos"),
        F.count_if(y == 0).alias("n_neg"),
        F.coalesce(F.count_if(y == 1) / F.count("*"), F.lit(0.0)).alias("positive_rate"),
    )


# Perturbations of a case and the flags each sets.
SCENARIOS = [
    {"scenario": "clean", "chi_r": False, "chi_r_crit": False, "chi_auto": True, "trace_valid": True},
    {"scenario": "rule_conflict", "chi_r": True, "chi_r_crit": False, "chi_auto": True, "trace_valid": True},
    {"scenario": "trace_gap", "chi_r": False, "chi_r_crit": False, "chi_auto": True, "trace_valid": False},
    {"scenario": "context_forbidden", "chi_r": False, "chi_r_crit": False, "chi_auto": False, "trace_valid": True},
    {"scenario": "source_conflict", "chi_r": True, "chi_r_crit": False, "chi_auto": False, "trace_valid": True},
    {"scenario": "high_reduction_loss", "chi_r": False, "chi_r_crit": False, "chi_auto": True, "trace_valid": True},
    {"scenario": "critical_rupture", "chi_r": True, "chi_r_crit": True, "chi_auto": False, "trace_valid": True},
]


def allowed_actions(scenario: Column, p: Column) -> Column:
    """Sorted actions that are acceptable in a scenario."""

    def actions(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in sorted(names)])

    return (
        F.when(scenario == "critical_rupture", actions("block"))
        .when(
            scenario.isin("rule_conflict", "trace_gap", "context_forbidden", "source_conflict"),
            actions("request_more_data", "defer_to_human"),
        )
        .when(scenario == "high_reduction_loss", actions("lower_confidence", "request_more_data", "defer_to_human"))
        .when(p < 0.25, actions("accept", "lower_confidence"))
        .otherwise(actions("lower_confidence", "defer_to_human"))
    )


def expand_scenarios(df: DataFrame, p: str = "p", loss: str = "reduction_loss") -> DataFrame:
    """Each case under seven perturbations. The scenario table is a literal array: explode, no join."""
    kept = [c for c in df.columns if c not in ("scenario", "chi_r", "chi_r_crit", "chi_auto", "trace_valid")]
    out = df.select(*kept, F.inline(config_array(SCENARIOS)))
    high = F.col("scenario") == "high_reduction_loss"
    allowed = allowed_actions(F.col("scenario"), F.col(p))
    return (
        out.withColumn(loss, F.when(high, F.greatest(F.lit(0.35), F.col(loss))).otherwise(F.col(loss)))
        .withColumn("expected_actions", allowed)
        .withColumn("expected_action", F.get("expected_actions", F.lit(0)))
    )


def rupture_flags(df: DataFrame) -> DataFrame:
    """chi_r and chi_r_crit from whatever rupture, expert and source columns the table has."""
    names = set(df.columns)
    any_r, crit = F.lit(False), F.lit(False)
    for c in ("chi_R", "rupture"):
        if c in names:
            any_r = any_r | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    for c in ("chi_R_crit", "critical_rupture", "is_critical"):
        if c in names:
            crit = crit | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    if {"expert_a", "expert_b"} <= names:
        any_r = any_r | ~F.col("expert_a").cast("string").eqNullSafe(F.col("expert_b").cast("string"))
    if {"source_model", "source_expert"} <= names:
        conflict = ~F.col("source_model").cast("string").eqNullSafe(F.col("source_expert").cast("string"))
        any_r, crit = any_r | conflict, crit | conflict
    return df.select(*[c for c in df.columns if c not in ("chi_r", "chi_r_crit")], (any_r | crit).alias("chi_r"), crit.alias("chi_r_crit"))


# --- linguistic terms ------------------------------------------------------------

QUARTILES = {"q_min": 0.0, "q25": 0.25, "q_median": 0.5, "q75": 0.75, "q_max": 1.0}


def fit_terms(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Five quantiles per column that define its low, medium and high terms.

    Constant columns are widened in steps of 0.25 and empty ones get 0..1. With
    approximate=True a bounded sketch replaces the exact order statistics.
    """
    long = unpivot(df, columns).where(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))
    if approximate:
        sketch = long.groupBy("column").agg(F.percentile_approx("value", list(QUARTILES.values()), 10000).alias("q"))
        found = sketch.select("column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(QUARTILES)])
    else:
        found = exact_quantiles(long, "value", QUARTILES, keys=["column"], few_keys=True)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    table = names.join(found, "column", "left")
    cols = ["column"]
    for i, name in enumerate(QUARTILES):
        cols.append(
            F.when(F.col("q_min").isNull(), F.lit(0.25 * i))
            .when(F.col("q_min") == F.col("q_max"), F.col("q_min") + 0.25 * i)
            .otherwise(F.col(name))
            .alias(name)
        )
    return table.select(*cols)


def apply_terms(df: DataFrame, terms: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add <column>_low, _medium and _high memberships; terms come by scalar subquery."""
    from ..functions.fuzzy import left_shoulder, right_shoulder, triangle

    by_column = terms.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct(*QUARTILES))))
    ).scalar()
    out = df.withColumn("_terms", by_column)
    cols = []
    for c in columns:
        x, q = F.col(c).cast("double"), F.element_at("_terms", F.lit(c))
        cols += [
            left_shoulder(x, q["q_min"], q["q_median"]).alias(f"{c}_low"),
            triangle(x, q["q25"], q["q_median"], q["q75"]).alias(f"{c}_medium"),
            right_shoulder(x, q["q_median"], q["q_max"]).alias(f"{c}_high"),
        ]
    return out.select(*df.columns, *cols)


def categorical_levels(df: DataFrame, columns: Sequence[str], keep: int | None = None) -> DataFrame:
    """The vocabulary of text columns, one row per column and distinct value; with keep, the first so many in sorted order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    if keep is None:
        return distinct
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    return ranked.where(F.col("_r") <= keep).drop("_r")
