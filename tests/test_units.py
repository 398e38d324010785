"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from gatekit.functions import disagreement as D
from gatekit.functions import gates as G
from gatekit.functions import representation as R
from gatekit.functions import uncertainty as U
from gatekit.operators import attributions as A
from gatekit.operators import contracts as C
from gatekit.operators import decisions as DC
from gatekit.operators import metrics as M
from gatekit.operators import prepare as P
from gatekit.operators import rules as RU
from gatekit.operators import stats as ST
from gatekit.plans.plan import RISK_TERMS, risk_shares


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lits(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_reduction_losses(spark):
    assert value(spark, R.reduction_loss(R.interval(F.lit(0.4), F.lit(0.8)))) == pytest.approx(0.2)
    assert value(spark, R.reduction_loss(R.hesitant(lits(0.2, 0.8)))) == pytest.approx(0.3)
    loss = value(spark, R.reduction_loss(R.neutrosophic(F.lit(0.78), F.lit(0.20), F.lit(0.64))))
    assert 0.20 <= loss <= 0.22


def test_accepted_accuracy_and_coverage(spark):
    rows = spark.createDataFrame(
        [("accept", 1, 1), ("defer_to_human", 0, 1), ("block", 1, 0)], "action string, y_true int, y_pred int"
    ).withColumn("interpretability", F.lit(0.5))
    m = M.gate_metrics(rows).first()
    assert m["accepted_accuracy"] == 1.0
    assert m["coverage"] == pytest.approx(1 / 3)
    none = M.gate_metrics(rows.where("action <> 'accept'")).first()
    assert none["accepted_accuracy"] is None


def test_costs(spark):
    rows = spark.createDataFrame([("accept", 1, 0), ("defer_to_human", 1, 1)], "action string, y_true int, y_pred int")
    m = M.cost_metrics(rows, [[0, 1], [5, 0]]).first()
    assert (m["cost_before"], m["cost_after"]) == (2.5, 2.55)


def test_magnitude_and_lofo(spark):
    rows = spark.createDataFrame([([1.0, 0.5], 1), ([0.0, 0.5], 0)], "h array<double>, y int")
    mags = {r["rule"]: r["magnitude"] for r in RU.rule_importance_magnitude(rows, [2.0, 1.0]).collect()}
    assert mags == {0: 1.0, 1: 0.5}
    lofo = {r["rule"]: r for r in RU.rule_importance_lofo(rows, [2.0, 0.0], bias=-1.0).collect()}
    assert lofo[0]["baseline_f1"] == 1.0 and lofo[0]["f1_without"] == 0.0
    assert lofo[1]["delta_f1"] == 0.0


def test_diagnostic_blocks(spark):
    action = G.gate_simple(F.lit(0.1), F.lit(0.1), F.lit(0.1), F.lit(True))
    assert value(spark, action) == "block"
    assert value(spark, G.corrected_confidence(F.lit(0.1), F.lit(0.1), F.lit(0.9), F.lit(0.0), F.lit(True))) == 0.0


def test_uncertainty(spark):
    assert value(spark, U.entropy_uncertainty(lits(0.5, 0.5))) == pytest.approx(1.0)
    assert value(spark, U.margin_uncertainty(lits(0.9, 0.1))) == pytest.approx(0.2)
    assert value(spark, U.entropy_uncertainty(lits(1.0))) == 0.0
    p = F.lit(0.3)
    general = U.blended_uncertainty(U.entropy_uncertainty(lits(0.7, 0.3)), U.margin_uncertainty(lits(0.7, 0.3)))
    assert value(spark, U.binary_uncertainty(p)) == pytest.approx(value(spark, general))


def test_selection(spark):
    def pick(*tags, mode="audit"):
        return value(spark, R.select_class(F.array(*[F.lit(t) for t in tags]), mode))

    # The costliest class loses least, so an audit takes it; a user gets the simplest.
    assert pick("u_num", "u_ling") == "FML-audit"
    assert pick("u_num", "u_ling", mode="user") == "F0"
    assert pick("u_num", "u_exp", mode="user") == "FH"
    assert pick("u_num", "u_unknown") == "D_choice"


def test_multilevel_distance(spark):
    a = R.multilevel([R.level("F0", value=0.2), R.level("FI", lo=0.1, hi=0.3)], links=["a"])
    b = R.multilevel([R.level("F0", value=0.6)])
    # 0.5 * 0.4 for the shared level, half the levels missing, links differ.
    assert value(spark, R.representation_distance(a, b)) == pytest.approx(0.5 * 0.4 + 0.10 * 0.5 + 0.05)
    assert value(spark, R.representation_distance(R.interval(F.lit(0.1), F.lit(0.2)), R.hesitant(lits(0.1)))) == 1.0
    s = R.annotate_source(R.scalar(F.lit(0.2)), F.lit("m"), F.lit("t"))
    assert value(spark, R.representation_distance(s, R.scalar(F.lit(0.2)))) == pytest.approx(0.10)


def test_contradiction_and_overlap(spark):
    rule = lambda n, t, c: F.struct(F.lit(n).alias("name"), F.create_map(F.lit("risk"), F.lit(t)).alias("conditions"), F.lit(c).alias("conclusion"))
    rules = F.array(rule("a", "low", "accept"), rule("b", "low", "block"), rule("c", "high", "block"))
    comp = D.interpretability_components(rules, F.create_map(F.lit("a"), F.lit(0.5)), F.array(F.lit("x"), F.lit("y")))
    assert value(spark, comp["K"]) == 0.5
    assert value(spark, comp["O"]) == pytest.approx(1 - 4 / 6)
    assert value(spark, comp["C"]) == 0.5
    assert value(spark, comp["H"]) == 0.0


def test_payload_errors(spark):
    docs = ['{"scenario_id": 1}', "[1]", "not json", '{"class_probability": "x", "feature_values": 3}']
    rows = spark.createDataFrame([(d,) for d in docs], "payload string")
    errors = [r["errors"] for r in C.validate_payloads(rows).collect()]
    assert "model_name:missing" in errors[0] and "scenario_id:missing" not in errors[0]
    assert errors[1] == ["root:not_object"]
    assert "class_probability:not_unit" in errors[3] and "feature_values:not_object" in errors[3]


def test_parse_agrees_with_the_detailed_check(spark):
    good = (
        '{"scenario_id":"s","source_type":"t","model_name":"m","dataset_name":"d","predicted_class":1,"class_probability":%s,'
        '"feature_values":{"a":1},"feature_importance":%s,"quality_metrics":{"missing_rate":0.2}}'
    )
    docs = [good % (p, f) for p in ("0.7", '"0.7"', "1.7", "null", '"x"') for f in ('{"a":0.5}', '{"a":"x"}', "3")] + ["[]", "{"]
    rows = spark.createDataFrame([(d,) for d in docs], "payload string")
    parsed = C.parse_payloads(rows).select("payload", "errors", "missing_rate", "class_probability")
    checked = {r["payload"]: r["errors"] for r in C.validate_payloads(rows).collect()}
    got = {r["payload"]: r for r in parsed.collect()}
    assert {k: r["errors"] for k, r in got.items()} == checked
    assert checked[docs[0]] == [] and checked[docs[3]] == []
    assert got[docs[3]]["class_probability"] == 0.7 and got[docs[0]]["missing_rate"] == 0.2


def test_case_checks(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (1.5, 1.0), (0.5, float("nan")), (None, 2.0)], "p double, x double")
    out = C.split_valid(C.validate_cases(rows, ("p",)))
    assert out.valid.count() == 1 and out.quarantine.count() == 3


def test_imputation_of_an_empty_column(spark):
    rows = spark.createDataFrame([(None, 1.0, None), (None, 3.0, "x")], "a double, b double, c string")
    out = P.impute(rows).collect()
    assert [r["a"] for r in out] == [0.0, 0.0] and {r["c"] for r in out} == {"unknown", "x"}


def test_profile_and_target(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 1)], "v_lo double, v_hi double, expert_a string, Label int")
    assert P.guess_target(df) == "Label"
    row = P.profile_table(df, requires_audit=False).first()
    assert row["has_intervals"] and not row["has_multiple_experts"]
    assert row["tags"] == ["u_int", "u_ling", "u_num"]


def test_wilson_and_mcnemar_tail(spark):
    ci = value(spark, M.wilson_interval(F.lit(0), F.lit(10)))
    assert ci["low"] == 0.0 and 0.2 < ci["high"] < 0.3
    from math import comb

    for low, n in ((0, 0), (0, 5), (3, 10), (40, 100), (450, 1000)):
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n)
        got = value(spark, ST.binomial_two_sided(F.lit(low).cast("long"), F.lit(n).cast("long")))
        assert got == pytest.approx(want, rel=1e-9)


def test_topk_breaks_ties_by_position(spark):
    top = value(spark, A.topk_array(lits(0.5, -0.5, 0.1, 0.9), 3))
    assert [(t["feature"], t["sign"]) for t in top] == [(3, 1.0), (0, 1.0), (1, -1.0)]


def test_risk_shares():
    assert risk_shares({"diagnostic": -1.0})["diagnostic"] == 0.0
    assert sum(risk_shares({"uncertainty": 3.0}).values()) == pytest.approx(1.0)
    assert risk_shares(dict.fromkeys(RISK_TERMS, 0.0)) == risk_shares()


def test_tamper_check(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, action string")
    stored = DC.decision_fingerprint(spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, action string"), ["id", "action"])
    got = {r["id"]: r["status"] for r in DC.tamper_check(now, stored, "id", ["id", "action"]).collect()}
    assert got == {1: "ok", 2: "tampered", 3: "unknown", 4: "missing"}
