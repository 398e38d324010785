"""Folding ordered explanations of a case into one: each is composed with what came out of those before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.disagreement import trace_gap
from ..functions.representation import representation_distance
from ..plans.plan import BETA

_FOLDED = "n_stages long, n_composed long, gamma double, stop_gamma double, diagnostic string, reason string, terms array<string>, activations map<string,double>, uncertainty double, reduction_loss double"
#: Folded cases leave a task in batches of so many.
OUT_ROWS = 1_000


def _folder(beta: Mapping[str, float], gamma_max: float | None, allow_missing_terms: bool, threshold: float, taken: Sequence[str], out: list[str]) -> Callable:
    """Stages in order, whole cases in a task, to one row per case. The state of a case is carried over batches.

    A stage costs as much as its own rules and activations, however long the chain is. Everything is defined inside, so
    Spark ships it by value.
    """

    def clip(x: float) -> float:
        return min(1.0, max(0.0, x))

    class Composed:
        def __init__(self, columns: dict, i: int, batch: pa.RecordBatch) -> None:
            self.n_stages, self.n_composed, self.gamma, self.stop_gamma, self.reason = 0, 0, None, None, None
            self.terms, self.rules, self.names = {}, [], set()
            self.activations, self.held, self.active = {}, 0.0, set()
            self.uncertainty, self.loss = 0.0, 0.0
            self.key = batch.slice(i, 1)
            self.take(columns, i, batch)

        def step(self, columns: dict, i: int, batch: pa.RecordBatch) -> None:
            """Compose with the next stage, or stop for good."""
            self.n_stages += 1
            if self.reason:
                return
            terms, values = columns["terms"][i] or [], dict(columns["activations"][i] or [])
            if not allow_missing_terms and not any(t in self.terms for t in terms):
                self.reason = "no common terms"
                return
            firing = {n for n in columns["names"][i] or [] if values.get(n, 0.0) > threshold}
            both = len(firing & self.active)
            either = len(firing) + len(self.active) - both
            known = [k for k in values if k in self.activations]
            gaps = sum(abs(self.activations.get(k, 0.0) - v) for k, v in values.items()) + self.held - sum(self.activations[k] for k in known)
            keys = len(self.activations) + len(values) - len(known)
            u, loss = columns["uncertainty"][i] or 0.0, columns["reduction_loss"][i] or 0.0
            parts = {
                "rules": 1.0 - both / either if either else 0.0,
                "activations": gaps / max(1, keys),
                "uncertainty": abs(self.uncertainty - u),
                "reduction": min(1.0, self.loss + loss),
            }
            gamma = clip((columns["near"][i] or 0.0) + sum(beta.get(k, 0.0) * v for k, v in parts.items()))
            if gamma_max is not None and gamma > gamma_max:
                self.reason, self.stop_gamma = "disagreement above gamma_max", gamma
                return
            self.gamma = gamma
            self.take(columns, i, batch)

        def take(self, columns: dict, i: int, batch: pa.RecordBatch) -> None:
            u, loss = columns["uncertainty"][i] or 0.0, columns["reduction_loss"][i] or 0.0
            if self.gamma is None:
                self.n_stages, self.uncertainty, self.loss = 1, u, loss
            else:
                self.uncertainty = 1.0 - (1.0 - clip(self.uncertainty)) * (1.0 - clip(u)) * (1.0 - clip(self.gamma))
                self.loss = min(1.0, self.loss + loss)
            self.n_composed += 1
            self.terms.update(dict.fromkeys(columns["terms"][i] or []))
            names = columns["names"][i] or []
            if any(n not in self.names for n in names):
                first = self.n_composed == 1
                self.rules += [r for r in batch.column("rules")[i].as_py() if first or r["name"] not in self.names]
                self.names.update(names)
            for k, v in dict(columns["activations"][i] or []).items():
                before = self.activations.get(k, 0.0)
                if k not in self.activations or v > before:
                    self.activations[k] = v if self.gamma is None else max(before, v)
                    self.held += self.activations[k] - before
            touched = [*names, *(k for k, _ in columns["activations"][i] or [])]
            self.active.update(n for n in touched if n in self.names and self.activations.get(n, 0.0) > threshold)
            self.last = batch.slice(i, 1)

        def row(self) -> dict:
            return {
                "n_stages": self.n_stages, "n_composed": self.n_composed, "gamma": self.gamma, "stop_gamma": self.stop_gamma,
                "diagnostic": "D_ij" if self.reason else None, "reason": self.reason, "terms": list(self.terms), "rules": self.rules,
                "activations": list(self.activations.items()), "uncertainty": self.uncertainty, "reduction_loss": self.loss,
            }

    def table(done: list[Composed], types: dict[str, pa.DataType]) -> pa.RecordBatch:
        rows, columns = [c.row() for c in done], []
        for name in out:
            if name in rows[0]:
                kind = types.get(name) or {"n_stages": pa.int64(), "n_composed": pa.int64(), "diagnostic": pa.string(), "reason": pa.string(), "terms": pa.list_(pa.string())}.get(name)
                columns.append(pa.array([r[name] for r in rows], kind or pa.float64()))
            else:
                columns.append(pa.concat_arrays([(c.key if name == "case" else c.last).column(name) for c in done]))
        return pa.RecordBatch.from_arrays(columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, case, done, types = None, None, [], {}
        for batch in batches:
            types = types or {n: batch.schema.field(n).type for n in ("rules", "activations")}
            columns = {n: batch.column(n).to_pylist() for n in taken}
            for i, key in enumerate(columns["case"]):
                if here is None or key != case:
                    if here is not None:
                        done.append(here)
                        if len(done) >= OUT_ROWS:
                            yield table(done, types)
                            done = []
                    here, case = Composed(columns, i, batch), key
                else:
                    here.step(columns, i, batch)
        if here is not None:
            yield table([*done, here], types)

    return run


def fold_chain(stages: DataFrame, case: str = "case_id", order: Sequence[str] = ("seq",), beta: Mapping[str, float] = BETA, gamma_max: float | None = None, allow_missing_terms: bool = False, threshold: float = 0.05) -> DataFrame:
    """Compose the stages of each case in order, each with the result of those before; stop where that can't be done.

    Stages are explanations (terms, representation, rules, activations, uncertainty, trace, reduction_loss). The composed
    explanation has the terms and rules of all (the first rule of a name), the largest activations, the last
    representation and trace, and its own disagreement with the next stage decides whether the chain goes on: it stops
    with D_ij where no term is shared or the disagreement is above gamma_max. One row per case: case, n_stages,
    n_composed, gamma (of the last composition), stop_gamma, diagnostic, reason and the composed explanation.

    Cases are dealt by hash, sorted and streamed with the state of one case in memory, so a chain of any length is never
    collected; what depends on two neighbours only is computed in Spark before. Null lists and maps are empty, null
    numbers 0; rows without a case are one case. Order must be unique within a case.
    """
    neighbours = Window.partitionBy(case).orderBy(*order)
    dealt = stages.repartition(F.col(case)).select(
        F.col(case).alias("case"), *order, "terms", "representation", "rules", "activations", "uncertainty", "trace", "reduction_loss",
        F.lag("representation").over(neighbours).alias("_representation"), F.lag("trace").over(neighbours).alias("_trace"),
    )
    near = beta.get("repr", 0.0) * F.coalesce(representation_distance(F.col("_representation"), F.col("representation")), F.lit(0.0))
    if beta.get("trace", 0.0):
        near = near + beta["trace"] * trace_gap(F.col("_trace"), F.col("trace"))
    taken = ["case", "terms", "names", "activations", "uncertainty", "reduction_loss", "near"]
    streamed = dealt.sortWithinPartitions("case", *order).select(
        "case", "terms", "rules", F.transform("rules", lambda r: r["name"]).alias("names"), "activations",
        F.col("uncertainty").cast("double").alias("uncertainty"), F.col("reduction_loss").cast("double").alias("reduction_loss"),
        F.when(F.col("_trace").isNotNull(), near).otherwise(0.0).alias("near"), "representation", "trace",
    )
    kinds = {f.name: f.dataType for f in streamed.schema.fields}
    own = StructType.fromDDL(_FOLDED).fields
    fields = [StructField("case", kinds["case"]), *own[:7], *[StructField(n, kinds[n]) for n in ("representation", "rules")], *own[7:9], StructField("trace", kinds["trace"]), own[9]]
    folded = streamed.mapInArrow(_folder(dict(beta), gamma_max, allow_missing_terms, threshold, taken, [f.name for f in fields]), StructType(fields))
    return folded.withColumnRenamed("case", case)
