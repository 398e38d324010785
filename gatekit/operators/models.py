"""A risk model fitted with Spark ML and scored through the gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import GatePolicy
from ..session import materialised
from .observe import observe


#: Training rows of a forest in one task. A row is kept with a draw per tree, some 670 bytes for 120 trees.
FOREST_ROWS = 200_000
#: From so many training rows on a forest is learned from kinds of rows; fewer rows are learned from one by one as fast.
KIND_ROWS = 1_000_000
#: Rows that a kind must stand for on average. A kind is read once per tree, so with fewer the rows are learned from one by one.
ROWS_PER_KIND = 10
#: Kinds in one task of the fit of a tree.
KINDS_PER_TASK = 250_000
#: Steps of a feature that a tree tells apart, and values at even ranks from which they are taken: as many as Spark ML has by default.
STEPS = 32
RANKS = 10_000


def fit_risk_model(train: DataFrame, features: Sequence[str], label: str, kind: str = "random_forest", seed: int = 42, trees: int = 120, depth: int = 6):
    """Fit a random forest or a logistic regression; training is distributed by Spark ML.

    Nulls and NaN are filled with the medians of the training part, so every row is learned from and scored. A forest's rows
    are dealt over tasks by their number, for each costs a walk through all trees per level. Many rows are learned from by
    kind (`_forest_of_kinds`), so that this cost does not grow with the rows.
    """
    if kind == "random_forest":
        model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    elif kind == "logistic_regression":
        model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=2000)
    else:
        raise ValueError(f"unknown model {kind!r}")
    filled = [f"_{c}_filled" for c in features]
    rows = _as_doubles(train, features).withColumn(label, F.col(label).cast("double"))
    prepare = Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="error"),
        ]
    ).fit(rows)
    ready = prepare.transform(rows).select("features", label)
    if kind == "random_forest":
        n = rows.count()
        if n >= KIND_ROWS:
            in_steps = _in_steps(prepare.stages[0], rows)
            stepped, names = in_steps.transform(rows), in_steps.stages[-1].getInputCols()
            if stepped.agg(F.approx_count_distinct(F.xxhash64(*names, label))).first()[0] * ROWS_PER_KIND <= n:
                return in_steps, _forest_of_kinds(stepped.select(*names, label), names, label, seed, trees, depth)
        ready = ready.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FOREST_ROWS)))
    return prepare, model.fit(ready)


def _limits(values: Sequence[float]) -> list[float]:
    """Where the steps of a feature begin, by Spark ML's rule: each value is a step if they are few, else steps have about as many rows.

    values: those at even ranks. A limit lies halfway between two neighbours, the lower of which it leaves below.
    """
    found, counts = np.unique(values, return_counts=True)
    ends = range(len(found) - 1)
    if len(found) > STEPS:
        below, stride = np.cumsum(counts), len(values) / STEPS
        ends, target = [], stride
        for i in range(len(found) - 1):
            if abs(below[i] - target) < abs(below[i + 1] - target):
                ends.append(i)
                target += stride
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = found[list(ends)], found[[i + 1 for i in ends]]
        middle = low + (high - low) / 2
    limits = np.nextafter(np.where((low <= middle) & (middle < high), middle, low), np.inf)
    return limits[limits < np.inf].tolist() or [0.0]


def _in_steps(imputer, rows: DataFrame) -> PipelineModel:
    """Features filled and replaced by the numbers of their steps, which are all that trees tell apart."""
    filled = imputer.getOutputCols()
    names = [f"{c}_step" for c in filled]
    # One text literal, for a literal per rank takes the driver seconds.
    ranks = F.split(F.lit(" ".join(str(i / (RANKS - 1)) for i in range(RANKS))), " ").cast("array<double>")
    at = imputer.transform(rows).agg(*[F.percentile_approx(c, ranks, F.lit(2 * RANKS)).alias(c) for c in filled]).first()
    splits = [[-float("inf"), *_limits(at[c]), float("inf")] for c in filled]
    return PipelineModel(
        [
            imputer,
            Bucketizer(splitsArray=splits, inputCols=filled, outputCols=names, handleInvalid="error"),
            VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error"),
        ]
    )


def _drawn(frames: Iterator[pd.DataFrame], seed: int, trees: int) -> Iterator[pd.DataFrame]:
    """How often each tree draws each kind, the same for the same kind and seed wherever it is drawn."""
    for frame in frames:
        keys, sizes = frame.pop("_key"), frame.pop("_n")
        draws = [np.random.default_rng((seed & (2**64 - 1), k & (2**64 - 1))).poisson(n, trees) for k, n in zip(keys.tolist(), sizes.tolist())]
        counts = pd.DataFrame(np.array(draws, dtype="int64").reshape(-1, trees), index=frame.index, columns=[f"_w{t}" for t in range(trees)])
        yield pd.concat([frame, counts], axis=1)


def _forest_of_kinds(rows: DataFrame, names: Sequence[str], label: str, seed: int, trees: int, depth: int) -> RandomForestClassificationModel:
    """A random forest over rows (names, label) whose features are numbers of steps.

    Rows with equal steps and label are one kind. In a bootstrap each row has a Poisson(1) draw per tree, and what the draws of a
    kind add up to is one Poisson draw of its number, so trees learn from kinds with these weights. Each tree is a fit of its own,
    for the weights are its own; several are fitted at a time.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    kinds = rows.groupBy(*names, label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.xxhash64(*names, label))
    schema = ", ".join([*[f"`{c}` double" for c in (*names, label)], *[f"_w{t} long" for t in range(trees)]])
    drawn = materialised(kinds.mapInPandas(partial(_drawn, seed=seed, trees=trees), schema))
    size, top = drawn.agg(F.count(F.lit(1)), F.max(label)).first()
    tasks, classes = -(-size // KINDS_PER_TASK), int(top or 0) + 1
    labelled = drawn.withColumn(label, F.col(label).alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": classes}}))

    def fit(tree: int) -> RandomForestClassificationModel:
        mine = labelled.select(*names, label, F.col(f"_w{tree}").alias("_w")).where("_w > 0").coalesce(tasks)
        one = RandomForestClassifier(
            labelCol=label, featuresCol="features", weightCol="_w", numTrees=1, maxDepth=depth, seed=seed + tree, bootstrap=False,
            featureSubsetStrategy="sqrt" if trees > 1 else "all",
            # Spark ML looks for steps in the square of so many rows: in all kinds, so that no step is missed.
            maxBins=max(STEPS, int(size**0.5) + 1),
        )
        return one.fit(VectorAssembler(inputCols=names, outputCol="features").transform(mine).select("features", label, "_w"))

    with ThreadPool(min(trees, 1 + 2 * sc.defaultParallelism // tasks)) as pool:
        fits = pool.map(inheritable_thread_target(spark)(fit), range(trees), 1)
    ml = sc._jvm.org.apache.spark.ml.classification
    grown = sc._gateway.new_array(ml.DecisionTreeClassificationModel, trees)
    for i, one in enumerate(fits):
        grown[i] = one._java_obj.trees()[0]
    forest = RandomForestClassificationModel(ml.RandomForestClassificationModel(fits[0].uid, grown, len(names), classes))
    forest._set(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)._transfer_params_to_java()
    return forest


def _as_doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def score_risk_model(fitted, df: DataFrame, positive: int = 1) -> DataFrame:
    """Add proba, p and y_pred columns."""
    prepare, model = fitted
    features = prepare.stages[0].getInputCols()
    scored = model.transform(prepare.transform(_as_doubles(df, features))).withColumn("proba", vector_to_array("probability"))
    return (
        scored.withColumn("p", F.get("proba", F.lit(positive)))
        .withColumn("y_pred", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability", "prediction", *[c for stage in prepare.stages[:-1] for c in stage.getOutputCols()])
    )


def fit_and_observe(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "random_forest", profile: Sequence[str] | None = None, **model_args) -> DataFrame:
    """Train on one part and gate the other."""
    fitted = fit_risk_model(train, features, label, kind, **model_args)
    return gate_of(score_risk_model(fitted, test), profile)


def gate_of(scored: DataFrame, profile: Sequence[str] | None = None) -> DataFrame:
    """The gate of a risk model over its probabilities (p, proba)."""
    policy = GatePolicy(theta_mid=0.34, theta_high=0.62)
    return observe(scored, "p", proba="proba", profile=profile, policy=policy)
