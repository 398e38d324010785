"""Checks on payloads and cases; bad rows go to a second DataFrame, never away."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let

# Required fields of each payload type.
REQUIRED = {
    "classification": (
        "scenario_id", "source_type", "model_name", "dataset_name", "predicted_class",
        "class_probability", "feature_values", "feature_importance", "quality_metrics",
    ),
    "regression": (
        "scenario_id", "source_type", "model_name", "dataset_name", "prediction",
        "feature_values", "feature_importance", "quality_metrics",
    ),
    "signal": ("scenario_id", "source_type", "model_name", "signal_quality", "quality_metrics", "feature_values"),
    "image": (
        "scenario_id", "source_type", "model_name", "dataset_name",
        "feature_values", "feature_importance", "quality_metrics",
    ),
    "route": ("scenario_id", "nodes", "computed_result", "final_action"),
    "proof_trace": ("package_type", "scenario_id", "route", "computed_result", "final_action"),
    "operator_trace": ("scenario_id", "nodes", "edges", "computed_result"),
}
OBJECT_FIELDS = ("feature_values", "feature_importance", "quality_metrics")


class Checked(NamedTuple):
    valid: DataFrame
    quarantine: DataFrame


class Rule(NamedTuple):
    """A field of a payload type, what its JSON must be (any, number, unit, object, array), and the code of a breach."""

    field: str
    kind: str
    code: str


def rules_of(schema: str) -> list[Rule]:
    """The declared rules of a payload type: one per required field, then one per typed field."""
    typed = {name: "object" for name in OBJECT_FIELDS}
    if schema == "classification":
        typed["class_probability"] = "unit"
    if schema in ("route", "operator_trace"):
        typed["nodes"] = "array"
    wanted = [Rule(name, "any", f"{name}:missing") for name in REQUIRED[schema]]
    return wanted + [Rule(name, kind, f"{name}:not_{kind}") for name, kind in sorted(typed.items())]


def _breach(raw: Column, there: Column, rule: Rule) -> Column:
    """The code of the rule where the raw JSON text of its field breaks it, else null."""
    number = raw.try_cast("double")
    holds = {
        "any": there,
        "number": number.isNotNull(),
        "unit": number.between(0.0, 1.0),
        "object": F.startswith(F.ltrim(raw), F.lit("{")),
        "array": F.startswith(F.ltrim(raw), F.lit("[")),
    }[rule.kind]
    asked = F.lit(True) if rule.kind == "any" else there
    return F.when(asked & ~F.coalesce(holds, F.lit(False)), F.lit(rule.code))


def _errors_of(top: Column, schema: str) -> Column:
    """Codes of the broken rules of a payload that is parsed to a map of its top-level fields."""
    codes = [_breach(F.element_at(top, r.field), F.map_contains_key(top, r.field), r) for r in rules_of(schema)]
    return F.when(top.isNull(), F.array(F.lit("root:not_object"))).otherwise(F.array_compact(F.array(*codes)))


def payload_errors(payload: Column, schema: str) -> Column:
    """Array of error codes for a JSON payload, empty when it is valid. Parses the payload once."""
    if schema not in REQUIRED:
        raise ValueError(f"unknown schema: {schema}")
    return let(F.from_json(payload, "map<string,string>"), lambda top: _errors_of(top, schema))


def validate_payloads(df: DataFrame, payload: str = "payload", schema: str = "classification") -> DataFrame:
    """Add an errors column. Narrow: parses each payload once."""
    return df.withColumn("errors", payload_errors(F.col(payload), schema))


def split_valid(checked: DataFrame) -> Checked:
    return Checked(
        checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
    )


# Numbers are read as text and cast, so that quoted numbers count as numbers.
PLAIN_FIELDS = {
    "scenario_id": "string", "source_type": "string", "model_name": "string", "dataset_name": "string",
    "predicted_class": "int", "class_probability": "double",
}
MAP_FIELDS = {
    "feature_values": "map<string,double>", "feature_importance": "map<string,double>",
    "quality_metrics": "map<string,double>", "context_values": "map<string,string>",
}
PAYLOAD_SCHEMA = ", ".join(
    [*[f"{n} string" for n in (*PLAIN_FIELDS, "top_k_importance")], *[f"{n} {t}" for n, t in MAP_FIELDS.items()]]
)


def parse_payloads(df: DataFrame, payload: str = "payload", schema: str = "classification") -> DataFrame:
    """Errors and typed fields of each payload; quality and context numbers default to 0.

    A payload whose required fields all parse to their types is valid, and what `_told` can tell from the
    parsed row is told from it, so only the others are parsed again for the detailed check. The parsed row
    is inlined out of a one-element array, so its fields are plain columns: a later filter on the errors
    stays above the parse and does not repeat it, and the typed fields are compiled.
    """
    fields = (*PLAIN_FIELDS, "top_k_importance", *MAP_FIELDS)
    parsed = F.inline(F.array(F.from_json(F.col(payload), PAYLOAD_SCHEMA))).alias(*[f"_doc_{n}" for n in fields])
    doc = {n: F.col(f"_doc_{n}") for n in fields}
    return df.select("*", parsed).select(*df.columns, *_typed(doc, schema, F.col(payload)))


def _told(doc: Mapping[str, Column], schema: str, payload: Column) -> tuple[Column, Column]:
    """Whether the parsed fields alone tell all broken rules of a payload, and the codes they tell.

    A field without a value is missing for sure where its name is nowhere in the text and nothing is escaped. One whose
    name is there may be null or of another type, which the detailed check finds out.
    """
    asked = tuple(dict.fromkeys((*REQUIRED[schema], *OBJECT_FIELDS)))
    if any(n not in doc for n in asked):
        return F.lit(False), F.array().cast("array<string>")
    told = F.startswith(payload, F.lit("{")) & ~F.contains(payload, F.lit("\\")) & F.coalesce(*[doc[n] for n in PLAIN_FIELDS]).isNotNull()
    for name in asked:
        told = told & (doc[name].isNotNull() | ~F.contains(payload, F.lit(name)))
    codes = [F.when(doc[n].isNull(), F.lit(f"{n}:missing")) for n in REQUIRED[schema]]
    if schema == "classification":
        p = doc["class_probability"]
        codes.append(F.when(p.isNotNull() & ~F.coalesce(p.try_cast("double").between(0.0, 1.0), F.lit(False)), F.lit("class_probability:not_unit")))
    return told, F.array_compact(F.array(*codes))


def _typed(doc: Mapping[str, Column], schema: str, payload: Column) -> list[Column]:
    p = doc["class_probability"].try_cast("double")
    known = (*PLAIN_FIELDS, *MAP_FIELDS)
    clean = F.lit(all(n in known for n in REQUIRED[schema]))
    for name in REQUIRED[schema]:
        if name in known:
            clean = clean & doc[name].isNotNull()
    if schema == "classification":
        clean = clean & F.coalesce(p.between(0.0, 1.0), F.lit(False))
    for name in OBJECT_FIELDS:
        clean = clean & doc[name].isNotNull()

    def quality(name: str) -> Column:
        return F.coalesce(F.element_at(doc["quality_metrics"], name), F.lit(0.0)).alias(name)

    def context(name: str, alias: str) -> Column:
        raw = F.element_at(doc["context_values"], name).try_cast("double")
        return F.coalesce(F.round(raw, 6), F.lit(0.0)).alias(alias)

    def text(name: str, default: str | None) -> Column:
        raw = F.element_at(doc["context_values"], name)
        return (F.coalesce(raw, F.lit(default)) if default else raw).alias(name)

    told, codes = _told(doc, schema, payload)
    importance = doc["feature_importance"]
    return [
        F.when(clean, F.array().cast("array<string>")).when(told, codes).otherwise(payload_errors(payload, schema)).alias("errors"),
        *[doc[n].try_cast(t).alias(n) for n, t in PLAIN_FIELDS.items()],
        doc["feature_values"].alias("feature_values"),
        importance.alias("feature_importance"),
        F.coalesce(doc["top_k_importance"].try_cast("int"), F.size(importance)).alias("top_k_importance"),
        quality("missing_rate"),
        quality("feature_range_violation"),
        text("task_type", "tabular_classification"),
        text("perturbation", "external_payload"),
        text("representation_class", None),
        context("conflict_component", "conflict_component"),
        context("prediction_interval_width", "interval_width"),
        context("noise_ratio", "signal_noise"),
        context("occlusion_rate", "image_noise"),
    ]


def flatten_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One typed row per payload, without the error column."""
    return parse_payloads(df, payload).drop("errors")


def case_errors(df: DataFrame, unit_columns: tuple[str, ...] = (), activations: str | None = None) -> Column:
    """Error codes of a case row: values outside [0,1], missing, NaN or infinite numbers."""
    checks = []
    for name in unit_columns:
        c = F.col(name)
        checks.append(
            F.when(c.isNull(), F.lit(f"{name} is missing")).when(
                ~c.between(0.0, 1.0) | F.isnan(c), F.lit(f"{name} must be in [0,1]")
            )
        )
    if activations:
        bad = F.exists(F.map_values(activations), lambda v: v.isNull() | ~v.between(0.0, 1.0))
        checks.append(F.when(bad, F.lit(f"{activations} must be in [0,1]")))
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float") and field.name not in unit_columns:
            c = F.col(f"`{field.name}`")
            infinite = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            checks.append(F.when(infinite, F.lit(f"{field.name} must be finite")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_cases(df: DataFrame, unit_columns: tuple[str, ...] = (), activations: str | None = None) -> DataFrame:
    return df.withColumn("errors", case_errors(df, unit_columns, activations))
