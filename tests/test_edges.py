"""Nulls, infinities, many levels, repeated and missing rows in the operators."""

import math

import pytest
from gatekit.functions import numeric as N
from gatekit.operators import models as MD
from gatekit.operators import paths as P
from gatekit.operators import prepare as PR
from gatekit.catalog.comparisons import one_type_of_events
from gatekit.operators.quantiles import exact_quantiles
from gatekit.operators.ranks import dense_ranks, positions
from gatekit.sources.tables import read_table, spread, write_table
from pyspark.sql import functions as F


def test_json_lines_are_all_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n{"a": 3}\n')
    assert sorted((r.a, r.b) for r in read_table(spark, str(tmp_path / "a.json"), schema="a int, b string").collect()) == [(1, "x"), (2, None), (3, None)]
    (tmp_path / "bad.json").write_text('{"a": 1}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path / "bad.json"), schema="a int").collect()
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert read_table(spark, str(tmp_path / "array.json"), schema="a int", multiLine=True).count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x, y", None), (2, None, 0.5)], "a int, b string, c double")
    write_table(rows.coalesce(1), str(tmp_path / "t.csv"), "csv")
    back = read_table(spark, str(tmp_path / "t.csv"), schema="a int, b string, c double", header=False)
    assert sorted(map(tuple, back.collect())) == [(1, "x, y", None), (2, None, 0.5)]


def test_quantiles_with_infinities(spark):
    values = [1.0, 2.0, 3.0, math.inf, -math.inf, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    q = exact_quantiles(df, "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (q.low, q.mid, q.top, q.n_values) == (-math.inf, 2.0, math.inf, 5)


def test_quantiles_of_large_close_values(spark):
    df = spark.range(1001).select((1_700_000_000 + F.col("id")).cast("double").alias("v"))
    assert exact_quantiles(df, "v", {"mid": 0.5}).first().mid == 1_700_000_500


def test_many_levels(spark):
    df = spark.range(10_000).select(F.format_string("l%05d", F.col("id")).alias("level")).union(spark.createDataFrame([(None,)], "level string"))
    codes = PR.encode_label(df, "level").collect()
    assert all(r.label_code == int(r.level[1:]) for r in codes if r.level) and sum(r.label_code is None for r in codes) == 1 and len(codes) == 10_001
    assert PR.categorical_levels(df, ["level"]).count() == 10_000
    assert PR.categorical_levels(df, ["level"], keep=3).count() == 3
    coded = PR.one_hot_vector(df, "level", "v").orderBy("level")
    assert coded.count() == 10_001 and coded.where("level = 'l00007'").first().v.indices.tolist() == [7] and not coded.where("level IS NULL").first().v.indices.tolist()
    few = df.limit(5)
    assert PR.one_hot(few, ["level"], levels={"level": []}).columns == []


def test_a_million_labels_are_ranked_without_one_task(spark):
    df = spark.range(1_000_000).select(F.format_string("l%07d", F.pmod(F.col("id") * 7919, F.lit(1_000_000))).alias("level"))
    ranks = dense_ranks(df, "level", "code")
    wrong = ranks.where(F.col("code") != F.substring("level", 2, 7).cast("long"))
    assert ranks.count() == 1_000_000 and wrong.isEmpty()
    # The only window without a partition runs over the sizes of the range partitions.
    assert ranks.rdd.getNumPartitions() > 1


def test_positions_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), (None,)], "x string")
    assert [(r.x, r.position) for r in positions(df, ["x"]).orderBy("position").collect()] == [(None, 0), (None, 1), ("a", 2), ("b", 3), ("b", 4)]
    assert dense_ranks(df.limit(0), "x").isEmpty()


def test_too_many_levels_are_refused(spark):
    df = spark.range(1_500).select(F.col("id").cast("string").alias("level"))
    with pytest.raises(ValueError, match="one_hot_vector"):
        PR.one_hot(df, ["level"])


def test_split_with_many_classes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 30).alias("y"))
    parts = {(r.y, r.split): r.n for r in PR.stratified_split(df, "y", ["id"]).groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert all(parts[y, "test"] == 25 and parts[y, "validation"] == 19 for y in range(30))
    whole = PR.stratified_split(df, "y", ["id"], stratify=False).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in whole}["test"] == 750


def test_models_score_every_row(spark):
    rows = [(float(i % 7), None if i % 5 == 0 else float(i % 3), int(i % 7 > 3)) for i in range(200)] + [(float("nan"), None, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    for kind in ("logistic_regression", "random_forest"):
        fitted = MD.fit_risk_model(df, ["a", "b"], "y", kind, trees=5, depth=3)
        scored = MD.score_risk_model(fitted, df)
        assert scored.count() == 201 and scored.where("p IS NULL").count() == 0
        assert set(scored.columns) == {"a", "b", "y", "proba", "p", "y_pred"}


def test_previous_row_with_null_keys(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 5, "d"), (2, None, "e")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    got = P.with_previous(df, ["k"], ["t"], F.col("v"), F.floor(F.col("t") / 2)).collect()
    assert sorted((r.v, r.prev) for r in got) == [("a", None), ("b", "a"), ("c", None), ("d", "c"), ("e", None)]


def test_poisson_totals(spark):
    """The mean and variance of totals follow the number of units, on both sides of the switch to the expansion."""
    for mean in (1, 7, 40, 41, 1000):
        df = spark.range(4000).select(N.hash_uniform(3, F.col("id")).alias("u"), F.lit(mean).cast("long").alias("m"))
        n = df.select(N.poisson_total(F.col("u"), F.col("m"), N.poisson_steps(F.col("m"))).alias("n"))
        got = n.agg(F.avg("n").alias("a"), F.variance("n").alias("v"), F.min("n").alias("low")).first()
        assert abs(got.a - mean) < 5 * math.sqrt(mean / 4000) and abs(got.v / mean - 1) < 0.15 and got.low >= 0
    draws = spark.range(2000).select((F.col("id") / 2000).alias("u")).select(N.poisson1(F.col("u")).alias("a"), N.poisson_total(F.col("u"), F.lit(1), N.poisson_steps(F.lit(1))).alias("b"))
    assert draws.where("a <> b").count() == 0


def test_spread_leaves_split_tables_alone(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(16)
    assert spread(few, "id").rdd.getNumPartitions() == 8 and spread(many, "id").rdd.getNumPartitions() == 16
    assert spread(few, "id").count() == 100


def test_a_partitioned_table_is_pruned(spark):
    back = one_type_of_events(spark, "/root/testdata/sf0.001")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "PushedFilters: []" in plan
    folders = {r.file.split("/")[-3] for r in back.select(F.input_file_name().alias("file")).distinct().collect()}
    assert folders == {"event_type=error"}
