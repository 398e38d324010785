"""Skylines and alignments over candidate tables against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatekit.catalog import SPARK
from gatekit.operators import selection as L
from gatekit.operators.compose import align_candidates

SF = "/root/testdata/sf0.001"


def plain_front(points):
    beats = lambda a, b: all(x <= y for x, y in zip(a, b)) and any(x < y for x, y in zip(a, b))
    return [p for p in points if not any(beats(q[1:], p[1:]) for q in points)]


@pytest.mark.parametrize("kind", ["random", "ties", "front"])
def test_skyline(spark, kind):
    rng = random.Random(kind)
    draw = {"random": lambda i: (rng.random(), rng.random(), rng.random()), "ties": lambda i: tuple(float(rng.randrange(4)) for _ in range(3)), "front": lambda i: (float(i), float(-i), rng.random())}[kind]
    points = [(i, *draw(i)) for i in range(600)]
    df = spark.createDataFrame([("a" if p[0] % 3 else None, *p) for p in points], "g string, id long, x double, y double, z double").repartition(5)
    got = L.skyline(df, ["x", "y", "z"], ["g"]).collect()
    for g in ("a", None):
        want = plain_front([p for p in points if (p[0] % 3 > 0) == (g == "a")])
        assert sorted(r.id for r in got if r.g == g) == sorted(p[0] for p in want)
    assert sorted(r.id for r in L.skyline(df, ["x", "y", "z"]).collect()) == sorted(p[0] for p in plain_front(points))


def test_skyline_of_a_hundred_thousand(spark):
    df = spark.range(100_000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1_000_003)) / 1e6).alias(c) for s, c in enumerate("xyz")])
    pdf = df.toPandas()
    got = {r.id for r in L.skyline(df, ["x", "y", "z"]).collect()}
    costs = pdf[["x", "y", "z"]].to_numpy()
    front = costs[sorted(got)]
    for i in range(0, len(costs), 5_000):
        block = costs[i : i + 5_000]
        beaten = ((front[None] <= block[:, None]).all(2) & (front[None] < block[:, None]).any(2)).any(1)
        assert {i + int(k) for k in np.flatnonzero(~beaten)} == {x for x in got if i <= x < i + 5_000}


def test_skyline_of_null_costs_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "id long, x double")
    assert sorted(r.id for r in L.skyline(df, ["x"]).collect()) == [3, 4]
    assert L.skyline(df.limit(0), ["x"]).isEmpty()


def test_profiles(spark):
    rows = [("c1", ["a", "b"], 1.0, 5.0, 0.3), ("c2", ["a", "b", "c"], 2.0, 1.0, 0.1), ("c3", ["a"], 0.5, 9.0, 0.9), ("c4", ["a"], 0.5, 9.0, 0.9), ("c5", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "name string, coverage array<string>, cognitive double, computational double, expected_loss double")
    got = {r.profile: r for r in L.select_candidates(df, {"ab": ["a", "b"], "a": ["a"], "none": [], "d": ["d", "a"]}, "abcd").collect()}
    assert (got["ab"].n_admissible, got["ab"].audit_choice, got["ab"].user_choice) == (2, "c2", "c1")
    assert (got["a"].n_admissible, got["a"].n_front, got["a"].user_choice) == (4, 4, "c3")
    assert got["none"].audit_choice == "c5" and (got["d"].diagnostic, got["d"].missing) == ("D_choice", ["d"])
    with pytest.raises(ValueError, match="vocabulary"):
        L.covering_candidates(df, {"x": ["q"]}, "abcd")


def test_alignments_from_a_table_match_the_literal_list(spark):
    """The same candidates as literals in the plan and as a table give the same choice."""
    rng = random.Random(2)
    terms, rules = [f"t{k}" for k in range(6)], [f"r{k}" for k in range(4)]
    cands = [{"name": f"c{i}", "term_map": {t: rng.choice(terms) for t in rng.sample(terms, rng.randrange(0, 3))}, "rule_map": {r: rng.choice(rules) for r in rng.sample(rules, rng.randrange(0, 3))}, "activation_scale": rng.choice([0.5, 1.0])} for i in range(40)]
    cands.append({"name": "never", "term_map": {"unknown": "t0"}, "rule_map": {}, "activation_scale": 1.0})
    table = spark.createDataFrame([(i, c["name"], c["term_map"], c["rule_map"], c["activation_scale"]) for i, c in enumerate(cands)], "pos long, name string, term_map map<string,string>, rule_map map<string,string>, activation_scale double")
    side = "array<string>, {0}_rules array<struct<name:string>>, {0}_activations map<string,double>, {0}_reduction_loss double"
    one = lambda: (rng.sample(terms, rng.randrange(0, 5)), [(r,) for r in rng.sample(rules, 2)], {r: rng.random() for r in rng.sample(rules, 2)}, rng.random() / 4)
    rows = [(i, *one(), *one()) for i in range(200)]
    pairs = spark.createDataFrame(rows, "case_id long, l_terms " + side.format("l") + ", r_terms " + side.format("r"))
    pairs = pairs.withColumns({f"{s}_{c}": F.lit(0) for s in "lr" for c in ("representation", "uncertainty", "trace")})
    got = {r.case_id: r for r in L.align_from_table(pairs, table).collect()}
    for w in align_candidates(pairs, cands).collect():
        g = got[w.case_id]
        assert (g.alignment, g.cost, g.gamma, g.delta_t, g.diagnostic) == (w.alignment, w.cost, w.gamma, w.delta_t, w.diagnostic)
    alone = table.where("name = 'never'")
    assert {r.diagnostic for r in L.align_from_table(pairs, alone).collect()} == {"no_admissible_alignment_candidate"}
    assert L.align_from_table(pairs.limit(0), table).isEmpty()


def test_the_plan_does_not_grow_with_the_candidates(spark):
    plan = SPARK["align_from_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
