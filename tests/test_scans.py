"""Long jobs read their input once, or as often as said here, and what they hand on does not grow with copies."""

import datetime as dt
import json
import tracemalloc
from functools import partial

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatekit.catalog import SPARK
from gatekit.catalog import paths_streams as PS
from gatekit.catalog import rules_stats as RS
from gatekit.functions.numeric import r6_scaled
from gatekit.operators import contracts as C
from gatekit.operators import fit as FT
from gatekit.operators import metrics as M
from gatekit.operators import models as MD
from gatekit.operators import prepare as PR
from gatekit.operators import selection as L
from gatekit.operators import sweeps as W
from gatekit.streaming import streams as ST
from test_streams import drift_over_files


def counted(df):
    """df and a counter of the rows that were computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(frame.num_rows)
            yield frame

    return df.mapInArrow(run, df.schema), seen


@pytest.fixture(scope="module")
def gaps(spark):
    values = np.random.default_rng(1).random((300, len(FT.FEATURES)))
    rows = [(str(k), *map(float, v), float(v[0] * 0.7 + v[1] * 0.3)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, ["case_id", *FT.FEATURES, "expert_score"]).localCheckpoint()


def test_cross_validation_computes_the_pairs_once(gaps):
    pairs, seen = counted(gaps)
    assert len(FT.cv_beta(pairs, "case_id").collect()) == 5
    assert seen.value == 300


def test_fit_and_its_check_share_one_scan(gaps):
    pairs, seen = counted(gaps)
    sums = FT.moment_sums(pairs)
    assert all(r.optimal for r in FT.beta_optimality(pairs, FT.fit_beta(pairs, sums=sums), sums=sums).collect())
    assert seen.value == 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_split_does_not_shuffle_rows_by_class(spark):
    rows = spark.range(0, 4000, 1, 4).select("id", (F.col("id") % 2).alias("y"))
    split = PR.stratified_split(rows, "y", ["id"])
    assert "Exchange hashpartitioning" not in plan(split) and "SortMergeJoin" not in plan(split)
    assert {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()} == {
        (y, part): n for y in (0, 1) for part, n in (("test", 500), ("validation", 375), ("train", 1125))
    }


def test_models_read_a_stored_split(spark):
    assert "Join" not in plan(RS._split(spark, "/root/testdata/sf0.001"))


def test_forest_rows_are_dealt_by_their_number(spark, monkeypatch):
    seen = {}

    class Forest:
        def __init__(self, **options):
            pass

        def fit(self, df):
            seen["pieces"] = df.rdd.getNumPartitions()

    monkeypatch.setattr(MD, "RandomForestClassifier", Forest)
    monkeypatch.setattr(MD, "FOREST_ROWS", 50)
    MD.fit_risk_model(spark.range(0, 1000, 1, 1).select(F.col("id").alias("x"), (F.col("id") % 2).alias("y")), ["x"], "y")
    assert seen["pieces"] == 20


def by_kind(monkeypatch, rows=100):
    """Forests learn from kinds from so many rows on; returns the numbers of rows that fits get, and their weights."""
    seen = []

    class Forest(MD.RandomForestClassifier):
        def fit(self, df):
            seen.append(df.agg(F.count("*"), F.sum(self.getWeightCol())).first() if self.isSet("weightCol") else (df.count(), None))
            return super().fit(df)

    monkeypatch.setattr(MD, "RandomForestClassifier", Forest)
    monkeypatch.setattr(MD, "KIND_ROWS", rows)
    return seen


def test_a_forest_learns_from_kinds_of_rows(spark, monkeypatch):
    """Equal rows are learned from together, and trees draw as many rows as there are, give or take a few."""
    rows = spark.range(6000).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 5).cast("int").alias("b"), (F.col("id") % 6 > 3).cast("int").alias("y"))
    seen = by_kind(monkeypatch)
    fitted = MD.fit_risk_model(rows, ["a", "b"], "y", trees=12, depth=3)
    assert len(seen) == 12 and all(n <= 30 and abs(w - 6000) < 400 for n, w in seen) and len({w for _, w in seen}) > 1
    assert fitted[1].getNumTrees == len(fitted[1].trees) == 12 and fitted[1].getMaxDepth() == 3
    scored = MD.score_risk_model(fitted, rows)
    assert set(scored.columns) == {"a", "b", "y", "proba", "p", "y_pred"} and scored.where("p IS NULL").count() == 0
    again = MD.score_risk_model(MD.fit_risk_model(rows.repartition(3), ["a", "b"], "y", trees=12, depth=3), rows)
    assert scored.select("a", "b", "p").distinct().exceptAll(again.select("a", "b", "p").distinct()).count() == 0


def test_kinds_give_the_forest_of_their_rows(spark, monkeypatch):
    """Probabilities of forests by row and by kind differ no more than those of two forests by row."""
    draw = np.random.default_rng(7)
    x = draw.integers(0, 9, (4000, 2)).astype(float)
    y = (draw.random(4000) < 0.1 + 0.07 * x[:, 0] + 0.02 * x[:, 1]).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).localCheckpoint()
    cells = rows.select("a", "b").distinct()

    def p(**args):
        found = MD.score_risk_model(MD.fit_risk_model(rows, ["a", "b"], "y", trees=40, depth=4, **args), cells).collect()
        return np.array([r.p for r in sorted(found, key=lambda r: (r.a, r.b))])

    one, other = p(), p(seed=1)
    by_kind(monkeypatch)
    kinds = p()
    assert np.abs(kinds - one).mean() < 2 * np.abs(other - one).mean() + 0.005 and np.corrcoef(kinds, one)[0, 1] > 0.95


def test_rows_that_hardly_repeat_are_learned_from_one_by_one(spark, monkeypatch):
    rows = spark.range(500).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).alias("y"))
    seen = by_kind(monkeypatch)
    MD.fit_risk_model(rows, ["a", "b"], "y", trees=3, depth=2)
    assert seen == [(500, None)]


def test_kinds_of_odd_rows(spark, monkeypatch):
    """Nulls and NaN count as the median, infinities and constants have their step, a third class has its place."""
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, 1.0]
    rows = spark.createDataFrame([(values[i % 8], 5, 2 if i % 8 == 2 else int(i % 8 == 3)) for i in range(800)], "a double, b int, y int")
    seen = by_kind(monkeypatch)
    scored = MD.score_risk_model(MD.fit_risk_model(rows, ["a", "b"], "y", trees=9, depth=3), rows)
    assert len(seen) == 9 and scored.where("size(proba) <> 3 OR p IS NULL").count() == 0
    assert {(r.a, r.y_pred) for r in scored.select("a", "y_pred").where("abs(a) = double('inf')").distinct().collect()} == {(float("inf"), 2), (float("-inf"), 1)}
    with pytest.raises(Exception, match="Labels MUST NOT be Null"):
        MD.fit_risk_model(rows.withColumn("y", F.when(F.col("y") < 2, F.col("y"))), ["a", "b"], "y", trees=2, depth=2)


def test_steps_are_found_by_their_rows():
    assert MD._limits([1.0, 1.0, 2.0, 4.0]) == [np.nextafter(1.5, np.inf), np.nextafter(3.0, np.inf)]
    even = MD._limits([float(i) for i in range(320)])
    assert len(even) == 31 and np.allclose(np.diff(even), 10, atol=1)
    mostly_zero = MD._limits([0.0] * 960 + [float(i) for i in range(1, 41)])
    assert 0 < mostly_zero[0] < 1 and 20 < len(mostly_zero) < 32
    inf = float("inf")
    assert MD._limits([7.0, 7.0]) == [0.0] and MD._limits([-inf, 0.0, inf]) == [np.nextafter(-inf, inf), np.nextafter(0.0, inf)]


def test_the_search_for_the_best_config_reads_each_part_once(spark):
    x = F.col("id") / 200.0
    rows = spark.range(200).select(
        x.alias("p"), (1 - x).alias("u"), x.alias("interpretability"), (x / 2).alias("reduction_loss"), (x > 0.7).alias("chi_r"), (x > 0.9).alias("chi_r_crit"),
        (x < 0.5).alias("chi_auto"), F.lit(True).alias("trace_valid"), F.lit(1).alias("y_true"), (x > 0.5).cast("int").alias("y_pred"),
    ).localCheckpoint()
    (validation, first), (test, second) = counted(rows), counted(rows)
    out = W.calibrate_before_after(validation, test).collect()
    assert sorted(r.part for r in out) == ["test", "validation"] and (first.value, second.value) == (200, 200)


def test_users_of_one_group_keep_their_own_order(spark, tmp_path, monkeypatch):
    at = lambda minute, event, user, value: (event, dt.datetime(2024, 1, 1, 0, minute), user, "click", value, "")
    parts = [[at(0, 1, 1, 30.0), at(5, 2, 2, 60.0), at(30, 3, 1, 90.0)], [at(20, 4, 2, 10.0), at(25, 5, 1, 0.0), at(50, 6, None, 50.0)], [at(59, 7, 2, 20.0)]]
    frames = [spark.createDataFrame(p, PS.EVENT_SCHEMA) for p in parts]
    plain = drift_over_files(spark, tmp_path / "plain", frames, "15 minutes").collect()
    monkeypatch.setattr(ST, "drift_stream", partial(ST.drift_stream, groups=1))
    grouped = drift_over_files(spark, tmp_path / "grouped", frames, "15 minutes").collect()
    assert sorted(map(str, plain)) == sorted(map(str, grouped))
    assert sorted(r.event_id for r in grouped) == [3, 4, 5, 7]


def test_equal_candidates_are_one_kind(spark):
    rows = [(k, f"a{k}", {"x": "y"}, {}, 0.5 + k % 2) for k in range(40)]
    kinds = L._kinds(spark.createDataFrame(rows, "pos long, name string, term_map map<string,string>, rule_map map<string,string>, activation_scale double"))
    assert sorted((r.pos, r.name, r.n) for r in kinds.collect()) == [(0, "a0", 20), (1, "a1", 20)]


def test_pairs_and_candidates_never_become_rows(spark, monkeypatch):
    """Sorts and aggregations by pair see a row per pair and list, and lists may be cut anywhere."""
    aligned = SPARK["align_from_table"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in plan(aligned)
    want = sorted(map(str, aligned.collect()))
    monkeypatch.setattr(L, "KINDS_AT_ONCE", 2)
    assert sorted(map(str, SPARK["align_from_table"](spark, "/root/testdata/sf0.001").collect())) == want


def test_shares_between_two_numbers_are_rounded_as_in_sql(spark):
    got = spark.range(2000).select(r6_scaled(F.col("id") / 2e6).alias("x")).collect()
    assert [r.x for r in got] == [x for (x,) in duckdb.sql("select round(i / 2e6::double, 6) from range(2000) t(i) order by i").fetchall()]


def test_equal_cases_are_scored_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(W, "_dealt", lambda rows: seen.setdefault("rows", rows))
    case = {"p": 0.5, "u": 0.2, "interpretability": 0.7, "reduction_loss": 0.1, "chi_r": False, "expected_action": "accept"}
    rows = spark.range(500).select(*[F.lit(v).alias(k) for k, v in case.items()])
    out = W.calibrate_simplex(rows, W.simplex_grid(spark).limit(3)).collect()
    assert len(out) == 3 and seen["rows"].count() == 1


def test_errors_are_told_from_the_parsed_fields(spark):
    whole = {
        "scenario_id": "s", "source_type": "t", "model_name": "m", "dataset_name": "d", "predicted_class": 1, "class_probability": 0.5,
        "feature_values": {"a": 1.0}, "feature_importance": {"a": 0.4}, "quality_metrics": {"missing_rate": 0.1},
    }
    without = {k: v for k, v in whole.items() if k != "model_name"}
    told = [whole | {"class_probability": 2}, without, without | {"class_probability": "x"}, {k: v for k, v in whole.items() if k != "feature_values"}]
    rest = [whole | {"feature_values": "n/a"}, whole | {"model_name": None}, without | {"context_values": {"model_name": "x"}}]
    texts = [json.dumps(p) for p in (*told, *rest)]
    odd = [None, "", "{}", "abc", f"[{texts[1]}]", texts[1][:-1], texts[0].replace("model_name", "m\\u006fdel_name")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)], "id int, payload string")
    parsed = C.parse_payloads(rows)
    assert "transform(array(from_json(StructField" not in plan(parsed)
    for r in parsed.withColumn("wanted", C.payload_errors(F.col("payload"), "classification")).collect():
        assert r.errors == r.wanted, r.payload
    doc = {n: F.from_json("payload", C.PAYLOAD_SCHEMA)[n] for n in (*C.PLAIN_FIELDS, "top_k_importance", *C.MAP_FIELDS)}
    told_rows = rows.where(C._told(doc, "classification", F.col("payload"))[0])
    assert sorted(r.id for r in told_rows.collect()) == list(range(len(told)))


@pytest.fixture
def routed(spark):
    rows = [(f"c{i:03}", "m1" if i % 3 else "m2", f"a{i % 4}", f"d{i % 5}", f"k{i % 2}", f"t{i % 3}", i / 100, i / 200, i / 300) for i in range(60)]
    names = "case_id model_name action dominant_component representation_class task_type gamma delta rho".split()
    return counted(spark.createDataFrame([*rows, ("none", None, "a0", "d0", None, "t0", 0.5, 0.5, 0.5)], names))


def test_model_summary_reads_rows_once(routed):
    df, seen = routed
    got = {r["model_name"]: (r["n"], r["dominant_action"], r["dominant_risk_component"], r["mean_gamma"], r["audit_count"]) for r in M.model_summary(df).collect()}
    assert got == {"m1": (40, "a0", "d0", 0.3, 0), "m2": (20, "a0", "d0", 0.285, 0)}
    assert seen.value == 61


def test_class_coverage_reads_rows_once(routed):
    df, seen = routed
    got = {r["representation_class"]: tuple(r)[1:] for r in M.class_coverage(df).collect()}
    assert got == {"k0": (30, "t0;t1;t2", "c000;c002;c004"), "k1": (30, "t0;t1;t2", "c001;c003;c005")}
    assert seen.value == 61


def test_tamper_check_makes_routes_once(spark):
    df = SPARK["tamper_check"](spark, "/root/testdata/sf0.001")
    assert "from_json" not in plan(df)


def test_distribution_reads_rows_once(routed):
    df, seen = routed
    assert {(r["action"], r["count"], r["percentage"]) for r in M.distribution(df, ["action"]).collect()} == {
        ("a0", 16, 26.23), ("a1", 15, 24.59), ("a2", 15, 24.59), ("a3", 15, 24.59)
    }
    assert seen.value == 61


def test_a_rollup_counts_its_shares_of_all_rows(routed):
    got = {(r["model_name"], r["action"]): (r["count"], r["percentage"]) for r in M.distribution(routed[0], ["model_name", "action"], rollup=True).collect()}
    assert got["m1", None] == (40, 65.57) and got["m2", "a0"] == (5, 8.2)


def test_both_explanations_of_a_case_come_from_one_row(spark):
    # One line item is there twice; joined by case it would make four pairs.
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("edge_report", "align_candidates", "compose_pair", "semantic_disagreement"):
        df = SPARK[name](spark, "/root/testdata/sf0.001")
        assert "Join" not in plan(df) and df.count() == lines
    assert "Join" not in plan(SPARK["disagreement_with_reduction"](spark, "/root/testdata/sf0.001"))


def test_distances_of_representations_need_no_join(spark):
    assert "Join" not in plan(SPARK["representation_distance"](spark, "/root/testdata/sf0.001"))


def test_scoring_candidates_needs_little_memory():
    draw = np.random.default_rng(3)
    rows = pd.DataFrame({c: draw.random(2000) for c in W.CONFLICT_COLUMNS[:5]} | {c: draw.random(2000) < 0.3 for c in W.CONFLICT_COLUMNS[5:]})
    count = W._objective_counter(draw.random((5701, 5)), np.sort(draw.random((5701, 4))))
    tracemalloc.start()
    out = pd.concat(count(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out["n"] == 2000).all() and peak < 60e6
