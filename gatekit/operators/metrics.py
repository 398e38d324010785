"""Aggregates over gated cases. Every one is a partial aggregation with a small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.plan import AUTO_ACTIONS, GatePlan
from ..session import materialised
from .quantiles import exact_quantiles, roc_auc


def share(condition: Column) -> Column:
    """Share of rows; 0 on empty input."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def is_auto(action: Column) -> Column:
    return action.isin(*AUTO_ACTIONS)


def gate_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", y_hat: str = "y_pred", diagnostics: Column | None = None) -> DataFrame:
    """Accuracy, accepted accuracy (null when nothing is accepted), coverage and action rates."""
    a, right = F.col("action"), F.col(y) == F.col(y_hat)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(right).alias("accuracy"),
        F.avg(F.when(a == "accept", right.cast("double"))).alias("accepted_accuracy"),
        share(a == "accept").alias("coverage"),
        share(a == "defer_to_human").alias("defer_rate"),
        share(a == "block").alias("block_rate"),
        share(a == "request_more_data").alias("request_rate"),
        share(diagnostics if diagnostics is not None else F.lit(False)).alias("diagnostic_rate"),
        F.avg("interpretability").alias("mean_interpretability"),
    )


def cost_metrics(df: DataFrame, costs: Sequence[Sequence[float]], by: Sequence[str] = (), y: str = "y_true", y_hat: str = "y_pred", request: float = 0.06, block: float = 0.08, defer: float = 0.10) -> DataFrame:
    """Mean cost before and after the gate. The cost matrix is a literal array of rows."""
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in costs])
    raw = F.get(F.get(matrix, F.col(y).cast("int")), F.col(y_hat).cast("int"))
    a = F.col("action")
    after = F.when(is_auto(a), raw).when(a == "request_more_data", request).when(a == "block", block).otherwise(defer)
    before_mean, after_mean = F.coalesce(F.avg(raw), F.lit(0.0)), F.coalesce(F.avg(after), F.lit(0.0))
    return df.groupBy(*by).agg(
        before_mean.alias("cost_before"), after_mean.alias("cost_after"), (before_mean - after_mean).alias("reduction")
    )


def expected_costs(proba: Column, costs: Mapping[str, Sequence[float]]) -> Column:
    """Expected cost of each action as an array of structs (cost, pos, action); no join."""
    total = F.aggregate(proba, F.lit(0.0), lambda acc, v: acc + v)
    options = []
    for pos, (name, row) in enumerate(costs.items()):
        expected = F.lit(0.0)
        for k, c in enumerate(row):
            expected = expected + F.get(proba, F.lit(k)) / total * F.lit(float(c))
        options.append(F.struct(expected.alias("cost"), F.lit(pos).alias("pos"), F.lit(name).alias("action")))
    return F.array(*options)


def expected_cost_action(df: DataFrame, proba: str, costs: Mapping[str, Sequence[float]]) -> DataFrame:
    """Cheapest action by expected cost; the first listed wins ties."""
    options = expected_costs(F.col(proba), costs)
    priced = df.withColumn("_costs", options).withColumn("_best", F.array_min("_costs"))
    per_action = [F.get("_costs", F.lit(i))["cost"].alias(f"cost_{name}") for i, name in enumerate(costs)]
    return priced.select(*df.columns, *per_action, F.col("_best")["action"].alias("best_action"))


def recall_or_one(hit: Column, critical: Column) -> Column:
    total = F.count_if(critical)
    return F.when(total == 0, 1.0).otherwise(F.count_if(critical & hit) / total)


def policy_metrics(df: DataFrame, by: Sequence[str] = ("policy",), expected: Mapping[str, str] | None = None) -> DataFrame:
    """Agreement with labels, missed critical cases, false automatic accepts and blocks per policy.

    `expected` maps output names to label columns.
    """
    expected = expected or {"agreement_proxy": "proxy_action", "agreement_reference": "reference_action"}
    a, crit = F.col("action"), F.col("chi_r_crit")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[share(a == F.col(label)).alias(name) for name, label in expected.items()],
        F.count_if(crit & (a != "block")).alias("missed_critical"),
        recall_or_one(a == "block", crit).alias("critical_recall"),
        share(is_auto(a) & ~F.col("chi_auto")).alias("false_auto_accept_rate"),
        share((a == "block") & ~crit).alias("false_block_rate"),
        share(is_auto(a)).alias("auto_coverage"),
    )


def set_agreement(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    a, allowed = F.col("action"), F.array_contains("expected_actions", F.col("action"))
    return df.groupBy(*by).agg(
        share(a == F.col("expected_action")).alias("agreement_strict"),
        share(allowed).alias("agreement_set"),
        share(is_auto(a) & ~allowed).alias("false_auto_accept_rate"),
        F.count_if(F.col("chi_r_crit") & (a != "block")).alias("missed_critical"),
    )


def conflict_counts() -> dict[str, Column]:
    """The five counters behind the objective, over action and the conflict-case columns."""
    a, crit, chi = F.col("action"), F.col("chi_r_crit"), F.col("chi_r")
    wrong, low = F.col("y_true") != F.col("y_pred"), F.col("p") < 0.35
    return {
        "missed_critical": crit & (a != "block"),
        "false_auto_accept": (a == "accept") & (wrong | chi),
        "unsafe_accept": (a == "accept") & chi,
        "false_block": (a == "block") & ~wrong & ~chi & low,
        "excessive_defer": (a == "defer_to_human") & ~chi & low,
    }


def objective(c: Mapping[str, Column]) -> Column:
    return (
        5.0 * c["missed_critical"]
        + 3.0 * c["false_auto_accept"]
        + 2.0 * c["unsafe_accept"]
        + c["false_block"]
        + 0.5 * c["excessive_defer"]
    )


def objective_metrics(df: DataFrame, by: Sequence[str] = ("method",), base: str = "action_f0") -> DataFrame:
    counts = conflict_counts()
    crit, a = F.col("chi_r_crit"), F.col("action")
    out = df.groupBy(*by).agg(
        (F.count_if(crit & (a == "block")) / F.greatest(F.lit(1), F.count_if(crit))).alias("recall_critical"),
        *[F.count_if(c).alias(name) for name, c in counts.items()],
        share(a != F.col(base)).alias("action_diff"),
    )
    return out.withColumn("objective", objective({n: F.col(n) for n in counts}))


def level_summary(df: DataFrame, entity: str = "object_id") -> DataFrame:
    """Counts and shares over conflict cases, at the probability level and the conflict-aware level.

    Objects are counted from a first aggregation per object, so no task sees all of them.
    """
    f0, nas, chi, crit = F.col("action_f0"), F.col("action_nas"), F.col("chi_r"), F.col("chi_r_crit")
    wrong, low = F.col("y_true") != F.col("y_pred"), F.col("p") < 0.35
    flags = {
        "n_conflicts": chi,
        "n_critical": crit,
        "n_action_diff": f0 != nas,
        "n_accept_to_block": (f0 == "accept") & (nas == "block"),
        "n_accept_to_defer": (f0 == "accept") & (nas == "defer_to_human"),
        "n_critical_blocked": crit & (nas == "block"),
        "false_auto_f0": (f0 == "accept") & (wrong | chi),
        "false_auto_nas": (nas == "accept") & (wrong | chi),
        "false_block_f0": (f0 == "block") & ~wrong & ~chi & low,
        "false_block_nas": (nas == "block") & ~wrong & ~chi & low,
    }
    per_object = df.groupBy(entity).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    totals = per_object.agg(
        F.sum("n").alias("n_cases"), F.count("*").alias("n_objects"), *[F.sum(k).alias(k) for k in flags]
    )
    shared = ("n_conflicts", "n_critical", "n_action_diff", "n_accept_to_block", "n_accept_to_defer")
    return totals.select(
        "n_cases", "n_objects",
        *[k for k in flags if k != "n_critical_blocked"],
        *[(F.col(k) / F.col("n_cases")).alias(k.replace("n_", "share_", 1)) for k in shared],
        (F.col("n_critical_blocked") / F.greatest(F.lit(1), F.col("n_critical"))).alias("recall_critical_nas"),
    )


def distribution(df: DataFrame, columns: Sequence[str], rollup: bool = False) -> DataFrame:
    """Count and percentage to two places per value.

    The total comes from the counts, whose shuffle the plan reads twice, so rows are scanned once. Each level of a
    rollup counts all rows.
    """
    grouped = df.rollup(*columns) if rollup else df.groupBy(*columns)
    counts = grouped.agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count") / (len(columns) + 1 if rollup else 1)).scalar()
    return counts.withColumn("percentage", F.round(F.col("count") / total * 100.0, 2))


def class_coverage(df: DataFrame, cls: str = "representation_class", task: str = "task_type", case: str = "case_id", order: Sequence[str] = ("case_id",), examples: int = 3) -> DataFrame:
    """Count, task types and the first examples per class.

    Counts and examples read the few columns they need from a stored table, so rows are computed once. The
    examples come from a rank filter that Spark applies per input task before the shuffle.
    """
    df = materialised(df.where(F.col(cls).isNotNull()).select(*dict.fromkeys((cls, task, case, *order))))
    cells = df.groupBy(cls, task).agg(F.count("*").alias("_n"))
    counts = cells.groupBy(cls).agg(
        F.sum("_n").alias("count"), F.array_join(F.array_sort(F.collect_list(task)), ";").alias("task_types")
    )
    w = Window.partitionBy(cls).orderBy(*order)
    first = (
        df.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= examples)
        .groupBy(cls)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", case))), lambda s: s[case]), ";").alias("examples"))
    )
    return counts.join(first, cls)


def component_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("dominant_component").agg(
        F.count("*").alias("count"), F.round(F.avg("rho"), 6).alias("mean_rho"), F.round(F.max("rho"), 6).alias("max_rho")
    )


RISK_COMPONENTS = ("uncertainty", "reduction", "quality", "conflict", "interval")
_DOMINANT_ALIAS = {"gamma": "uncertainty", "delta": "reduction"}


def contribution_summary(df: DataFrame, plan: GatePlan = GatePlan()) -> DataFrame:
    """Mean, spread, dominance and excess over the warning limit per risk component.

    Wants columns uncertainty, reduction, quality, conflict, interval, gamma, delta, dominant_component.
    """
    values = {n: F.col(n) for n in RISK_COMPONENTS}
    values["uncertainty"] = F.when(F.col("uncertainty") == 0, F.col("gamma")).otherwise(F.col("uncertainty"))
    values["reduction"] = F.when(F.col("reduction") == 0, F.col("delta")).otherwise(F.col("reduction"))
    dominant = F.col("dominant_component")
    for old, new in _DOMINANT_ALIAS.items():
        dominant = F.when(F.col("dominant_component") == old, new).otherwise(dominant)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("component"), v.alias("value"), (dominant == n).alias("dominates")) for n, v in values.items()]
    )
    warning = F.when(F.col("component") == "reduction", plan.delta_warning).otherwise(plan.gamma_warning)
    n_dominant = F.count_if("dominates")
    return (
        df.select(F.inline(pairs))
        .groupBy("component")
        .agg(
            F.round(F.avg("value"), 6).alias("mean_value"),
            F.round(F.stddev_pop("value"), 6).alias("std_value"),
            n_dominant.alias("dominance_count"),
            F.round(n_dominant / F.count("*"), 6).alias("dominance_rate"),
            F.round(F.avg(F.greatest(F.lit(0.0), F.col("value") - warning)), 6).alias("mean_excess"),
            F.round(F.max("value"), 6).alias("max_value"),
        )
    )


def model_summary(df: DataFrame, model: str = "model_name") -> DataFrame:
    """Counts, means, and the most common action and component per model, ties by name.

    All of it comes from one count per model, action and component, so rows are scanned once. Rows without a model are left out.
    """
    means = ("gamma", "delta", "rho")
    cells = df.where(F.col(model).isNotNull()).groupBy(model, "action", "dominant_component").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in means], *[F.count(c).alias(f"_n_{c}") for c in means]
    )

    def mode(column: str) -> Column:
        return F.min_by(column, F.struct(-F.col(f"_with_{column}"), F.col(column)))

    per = {c: F.sum("_n").over(Window.partitionBy(model, c)) for c in ("action", "dominant_component")}
    return cells.select("*", *[n.alias(f"_with_{c}") for c, n in per.items()]).groupBy(model).agg(
        F.sum("_n").alias("n"),
        *[F.round(F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")), 6).alias(f"mean_{c}") for c in means],
        F.coalesce(F.sum(F.when(F.col("action") == "audit", F.col("_n"))), F.lit(0)).alias("audit_count"),
        mode("action").alias("dominant_action"),
        mode("dominant_component").alias("dominant_risk_component"),
    )


def class_atlas(df: DataFrame, task: str = "task_type", perturbation: str = "perturbation", cls: str = "representation_class") -> DataFrame:
    counts = df.groupBy(task, perturbation, cls).agg(F.count("*").alias("_n"))
    return counts.groupBy(task, perturbation).agg(
        F.min_by(cls, F.struct(-F.col("_n"), F.col(cls))).alias("common_class"), F.sum("_n").alias("n")
    )


SERIES_QUANTILES = {"median": 0.50, "p25": 0.25, "p75": 0.75, "p05": 0.05, "p95": 0.95}


def series_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and five exact quantiles of a column, in two scans. Nulls and NaN are left out."""
    return exact_quantiles(df, column, SERIES_QUANTILES, moments=True).select("mean", "std", *SERIES_QUANTILES)


def quantile_digest(df: DataFrame, column: str) -> DataFrame:
    return series_stats(df, column).select("mean", "median", F.col("p05").alias("q05"), F.col("p95").alias("q95"))


def classification_metrics(df: DataFrame, y: str = "y_true", y_hat: str = "y_pred", score: str | None = "p") -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC of a binary classifier in one row."""
    t, h = F.col(y) == 1, F.col(y_hat) == 1
    tp, fp, fn = F.count_if(t & h), F.count_if(~t & h), F.count_if(t & ~h)

    def safe(num: Column, den: Column) -> Column:
        return F.when(den == 0, 0.0).otherwise(num / den)

    out = df.agg(
        F.count("*").alias("n"),
        share(t == h).alias("accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return out.withColumn("roc_auc", roc_auc(df, score, y).scalar()) if score else out


def macro_metrics(df: DataFrame, y: str = "y_true", y_hat: str = "y_pred") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over all classes, from the confusion counts."""
    cells = df.groupBy(F.col(y).alias("t"), F.col(y_hat).alias("h")).agg(F.count("*").alias("n"))
    per_class = (
        cells.select("n", (F.col("t") == F.col("h")).alias("hit"), F.inline(F.array(
            F.struct(F.col("t").alias("cls"), F.lit("t").alias("role")),
            F.struct(F.col("h").alias("cls"), F.lit("h").alias("role")),
        )))
        .groupBy("cls")
        .agg(
            F.sum(F.when(F.col("hit") & (F.col("role") == "t"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("role") == "t", F.col("n")).otherwise(0)).alias("actual"),
            F.sum(F.when(F.col("role") == "h", F.col("n")).otherwise(0)).alias("predicted"),
        )
    )

    def safe(num: Column, den: Column) -> Column:
        return F.when(den == 0, 0.0).otherwise(num / den)

    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    return per_class.agg(
        F.sum("actual").alias("n"),
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(safe(tp, predicted)).alias("precision"),
        F.avg(safe(tp, actual)).alias("recall"),
        F.avg(safe(2 * tp, actual + predicted)).alias("f1"),
    )


def boundary_distance(df: DataFrame, rho: str = "rho") -> DataFrame:
    """Distance of each case to the accept and audit limits and which is nearer."""
    above, below = F.greatest(F.col(rho) - 0.35, F.lit(0.0)), F.greatest(0.60 - F.col(rho), F.lit(0.0))
    return df.select(
        "*",
        above.alias("to_accept"),
        below.alias("to_audit"),
        F.when(F.abs(F.col(rho) - 0.35) <= F.abs(F.col(rho) - 0.60), "accept").otherwise("audit").alias("nearest"),
    )


def wilson_interval(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson score interval as a struct (low, high); (0,0) without rows."""
    share_, zz = successes / n, z * z
    denom = 1 + zz / n
    center = (share_ + zz / (2 * n)) / denom
    half = z * F.sqrt((share_ * (1 - share_) + zz / (4 * n)) / n) / denom
    low = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - half))
    high = F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), center + half))
    return F.struct(low.alias("low"), high.alias("high"))
