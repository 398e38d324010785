"""Chains of explanations folded into one, against a plain fold that keeps whole sets."""

import random

import pytest
from pyspark.sql import functions as F

from gatekit.functions import representation as R
from gatekit.operators.chains import fold_chain
from gatekit.plans.plan import BETA

STAGE = "case_id long, seq long, terms array<string>, names array<string>, activations map<string,double>, uncertainty double, trace_id string, reduction_loss double"


def plain_gamma(left, right):
    active = lambda x: {n for n in x["names"] if x["activations"].get(n, 0) > 0.05}
    a, b = active(left), active(right)
    keys = set(left["activations"]) | set(right["activations"])
    gaps = [abs(left["activations"].get(k, 0) - right["activations"].get(k, 0)) for k in keys]
    # The representation is the scalar of the uncertainty of the stage itself; of six trace fields only the id differs.
    parts = {
        "repr": abs(left["own"] - right["own"]), "rules": 1 - len(a & b) / len(a | b) if a | b else 0.0, "activations": sum(gaps) / len(gaps) if gaps else 0.0,
        "uncertainty": abs(left["uncertainty"] - right["uncertainty"]), "trace": (left["trace_id"] != right["trace_id"]) / 6,
        "reduction": min(1.0, left["reduction_loss"] + right["reduction_loss"]),
    }
    return min(1.0, sum(BETA.get(k, 0.0) * v for k, v in parts.items()))


def plain_fold(stages, gamma_max):
    state, n, reason = None, 0, None
    for s in stages:
        if state is None:
            state = dict(s)
        else:
            gamma = plain_gamma(state, s)
            if not set(state["terms"]) & set(s["terms"]):
                reason = "no common terms"
            elif gamma_max is not None and gamma > gamma_max:
                reason = "disagreement above gamma_max"
            if reason:
                break
            keys = {**state["activations"], **s["activations"]}
            state = {
                "terms": [*state["terms"], *[t for t in s["terms"] if t not in state["terms"]]],
                "names": [*state["names"], *[x for x in s["names"] if x not in state["names"]]],
                "activations": {k: max(state["activations"].get(k, 0.0), s["activations"].get(k, 0.0)) for k in keys},
                "uncertainty": 1 - (1 - state["uncertainty"]) * (1 - s["uncertainty"]) * (1 - gamma),
                "own": s["own"], "trace_id": s["trace_id"], "reduction_loss": min(1.0, state["reduction_loss"] + s["reduction_loss"]),
            }
        n += 1
    return state, n, reason


def stages_of(rng, n, case, rules=30):
    out = []
    for k in range(n):
        names = [f"r{rng.randrange(rules)}" for _ in range(rng.randrange(0, 4))]
        names += names[:1] if rng.random() < 0.1 else []
        acts = {x: rng.choice([0.0, 0.05, 0.4, rng.random()]) for x in names if rng.random() < 0.9}
        terms = ["base"] * (rng.random() < 0.97) + [f"t{rng.randrange(9)}"]
        u = rng.random() * 0.02
        out.append({"case_id": case, "seq": k, "terms": terms, "names": names, "activations": acts, "uncertainty": u, "own": u, "trace_id": f"e{k % 5}", "reduction_loss": rng.choice([0.0, 0.001])})
    return out


def frame(spark, rows):
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in STAGE.replace("map<string,double>", "map").split(", ")) for r in rows], STAGE)
    rule = lambda n: F.struct(n.alias("name"), F.create_map(F.lit("risk"), n).alias("conditions"), F.lit("watch").alias("conclusion"))
    text = F.lit("")
    trace = F.struct(F.col("trace_id").alias("id"), text.alias("version"), text.alias("timestamp"), F.create_map(F.lit("k"), text).alias("params"), text.alias("source"), text.alias("checksum"))
    return df.select("*", F.transform("names", rule).alias("rules"), R.scalar(F.col("uncertainty")).alias("representation"), trace.alias("trace")).drop("names", "trace_id").repartition(7)


@pytest.mark.parametrize("gamma_max", [None, 0.3])
def test_fold_matches_a_plain_fold(spark, gamma_max):
    rng = random.Random(4)
    cases = {c: stages_of(rng, rng.choice([1, 2, 5, 40]), c) for c in range(60)} | {None: stages_of(rng, 4, None)}
    got = {r.case_id: r for r in fold_chain(frame(spark, sum(cases.values(), [])), gamma_max=gamma_max).collect()}
    assert set(got) == set(cases)
    for c, stages in cases.items():
        state, n, reason = plain_fold(stages, gamma_max)
        r = got[c]
        assert (r.n_stages, r.n_composed, r.reason, r.diagnostic) == (len(stages), n, reason, "D_ij" if reason else None)
        assert r.terms == list(dict.fromkeys(state["terms"])) and [x.name for x in r.rules] == state["names"]
        assert r.activations == pytest.approx(state["activations"]) and r.trace.id == state["trace_id"]
        assert r.uncertainty == pytest.approx(state["uncertainty"], abs=1e-9) and r.reduction_loss == pytest.approx(state["reduction_loss"])


def test_a_case_of_ten_thousand_stages(spark):
    stages = [s | {"terms": ["base", *s["terms"]], "uncertainty": s["own"] / 1e4} for s in stages_of(random.Random(8), 10_000, 1, rules=400)]
    stages = [s | {"own": s["uncertainty"]} for s in stages]
    r = fold_chain(frame(spark, stages)).first()
    state, n, _ = plain_fold(stages, None)
    assert (r.n_stages, r.n_composed) == (10_000, n) == (10_000, 10_000)
    assert sorted(x.name for x in r.rules) == sorted(state["names"]) and r.activations == pytest.approx(state["activations"])
    assert r.uncertainty == pytest.approx(state["uncertainty"], abs=1e-6)


def test_empty_and_null_stages(spark):
    some = frame(spark, stages_of(random.Random(1), 3, 1))
    assert fold_chain(some.limit(0)).isEmpty()
    bare = some.withColumns({"terms": F.lit(None).cast("array<string>"), "activations": F.lit(None).cast("map<string,double>"), "uncertainty": F.lit(None).cast("double")})
    r = fold_chain(bare, allow_missing_terms=True).first()
    assert (r.n_composed, r.terms, r.activations) == (3, [], {})
    assert fold_chain(bare).first().reason == "no common terms"
