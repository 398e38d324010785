"""Properties over random rows, and distributed algorithms against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatekit.functions import disagreement as D
from gatekit.functions import gates as G
from gatekit.functions import numeric as N
from gatekit.functions import representation as R
from gatekit.operators import fit as FT
from gatekit.operators import paths as P
from gatekit.operators import prepare as PR
from gatekit.operators import quantiles as Q
from gatekit.operators import rules as RU
from gatekit.operators import sweeps as W
from gatekit.plans.plan import ACTIONS, RISK_TERMS, risk_shares


def uniform_rows(spark, n, *names, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([tuple(map(float, r)) for r in rng.random((n, len(names)))], ", ".join(f"{c} double" for c in names))


def test_distance_is_a_pseudometric_on_each_kind(spark):
    rows = uniform_rows(spark, 300, *[f"x{i}" for i in range(9)])

    def make(kind, i):
        a, b, c = (F.col(f"x{3 * i + k}") for k in range(3))
        return {"F0": R.scalar(a), "FI": R.interval(a, b), "FH": R.hesitant(F.array(a, b, c)), "FNsrc": R.neutrosophic(a, b, c)}[kind]

    for kind in ("F0", "FI", "FH", "FNsrc"):
        reps = rows.select(*[make(kind, i).alias(f"r{i}") for i in range(3)])
        r = [F.col(f"r{i}") for i in range(3)]
        d = R.representation_distance
        got = reps.select(d(r[0], r[0]).alias("same"), d(r[0], r[1]).alias("ab"), d(r[1], r[0]).alias("ba"), d(r[1], r[2]).alias("bc"), d(r[0], r[2]).alias("ac")).toPandas()
        assert (got["same"] == 0).all()
        assert np.allclose(got["ab"], got["ba"])
        assert (got["ac"] <= got["ab"] + got["bc"] + 1e-12).all()
        assert got["ab"].between(0, 1).all()


def test_gate_is_total(spark):
    rows = uniform_rows(spark, 2000, "rho", "u", "i", "d", "f1", "f2", "f3", "f4")
    flag = lambda c: F.col(c) < 0.5
    action = G.gate_full(F.col("rho"), F.col("u"), F.col("i"), F.col("d"), flag("f1"), F.col("f2") < 0.1, flag("f3"), flag("f4"))
    counts = {r["a"]: r["n"] for r in rows.groupBy(action.alias("a")).agg(F.count("*").alias("n")).collect()}
    assert set(counts) <= set(ACTIONS) and sum(counts.values()) == 2000


def test_prob_or_bounds(spark):
    rows = uniform_rows(spark, 500, "a", "b")
    got = rows.select("a", "b", D.prob_or(F.col("a"), F.col("b")).alias("v")).toPandas()
    assert (got["v"] >= got[["a", "b"]].max(axis=1) - 1e-12).all() and (got["v"] <= 1).all()


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=3000), np.array([0.0] * 1000 + [1.0, -2.0, 5e9, 1e-9]), np.array([3.0]),
])
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").unionAll(
        spark.createDataFrame([(None,), (float("nan"),)], "x double")
    )
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    row = Q.exact_quantiles(df, "x", probs).first()
    for name, q in probs.items():
        assert row[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantiles_per_key_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.random(2000)] + [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.random(700))]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["m"] for r in Q.exact_quantiles(df, "x", {"m": 0.5}, ["k"]).collect()}
    pdf = df.toPandas().groupby("k")["x"].median()
    assert got == pytest.approx(pdf.to_dict())


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(5)
    score, y = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)], "s double, y int")
    pos, neg = score[y == 1], score[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert Q.roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx(want)


def test_previous_row_across_buckets(spark):
    """A key with most rows, cut into buckets, gives the same as one window over the key."""
    rng = np.random.default_rng(7)
    rows = [(0 if rng.random() < 0.7 else int(rng.integers(1, 9)), int(i), int(rng.integers(0, 1000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    got = P.with_previous(df, ["k"], ["seq"], F.col("v"), F.floor(F.col("seq") / 37), "prev").toPandas()
    pdf = df.toPandas().sort_values(["k", "seq"])
    pdf["want"] = pdf.groupby("k")["v"].shift(1)
    both = got.merge(pdf[["k", "seq", "want"]], on=["k", "seq"])
    assert len(both) == 1500
    assert both["prev"].fillna(-1).tolist() == both["want"].fillna(-1).tolist()


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = PR.stratified_split(df, "y", ["id"]).toPandas()
    b = PR.stratified_split(df.repartition(5), "y", ["id"]).toPandas()
    assert a.sort_values("id")["split"].tolist() == b.sort_values("id")["split"].tolist()
    assert a.groupby(["y", "split"]).size().to_dict() == {
        (0, "test"): 225, (0, "validation"): 169, (0, "train"): 506, (1, "test"): 25, (1, "validation"): 19, (1, "train"): 56,
    }


def test_signature_sweep_equals_direct_evaluation(spark):
    """The 972-config calibration from signatures agrees with scoring one config row by row."""
    rows = uniform_rows(spark, 400, "p", "u", "interpretability", "reduction_loss", "a", "b", "c", seed=9)
    cases = rows.select(
        "p", "u", (0.55 + 0.3 * F.col("interpretability")).alias("interpretability"), (0.3 * F.col("reduction_loss")).alias("reduction_loss"),
        (F.col("a") < 0.2).alias("chi_r"), (F.col("a") < 0.05).alias("chi_r_crit"), (F.col("b") < 0.7).alias("chi_auto"),
        (F.col("b") < 0.9).alias("trace_valid"), (F.col("c") < 0.5).cast("int").alias("y_true"), F.lit(1).alias("y_pred"),
    )
    swept = {r["config_id"]: r for r in W.calibrate_gate(cases).collect()}
    assert len(swept) == 972
    w, t, g, i, d, m = 2, 1, 0, 2, 1, 0
    cid = ((((w * 3 + t) * 3 + g) * 3 + i) * 3 + d) * 3 + m
    weights = risk_shares(W.WEIGHT_GRID[w])
    gap = F.abs(F.col("p") - F.col("interpretability"))
    rup = F.col("chi_r") | (gap > W.GAMMA_GRID[g])
    crit = F.col("chi_r_crit") | (gap > W.GAMMA_GRID[g] + 0.10)
    rho = G.config_risk(F.col("p"), F.col("u"), F.col("interpretability"), F.col("reduction_loss"), rup, {k: F.lit(weights[k]) for k in RISK_TERMS})
    auto = F.col("chi_auto") & ~crit & F.col("trace_valid")
    action = G.full_ladder(
        rho, F.col("u"), F.col("interpretability"), F.col("reduction_loss"), rup, crit, auto, F.col("trace_valid"),
        thetas=W.LADDER_GRID[t], i_min=W.I_MIN_GRID[i], delta_max=W.DELTA_MAX_GRID[d], u_max=W.U_MAX_GRID[m],
    )
    direct = cases.select(action.alias("x"), crit.alias("c")).agg(
        F.avg((F.col("x").isin("accept", "lower_confidence")).cast("double")).alias("auto"),
        F.avg(((F.col("x") == "block") & ~F.col("c")).cast("double")).alias("fb"),
    ).first()
    assert swept[cid]["auto_coverage"] == pytest.approx(direct["auto"])
    assert swept[cid]["false_block_rate"] == pytest.approx(direct["fb"])


def test_fit_recovers_weights_and_stays_on_the_simplex(spark):
    rng = np.random.default_rng(11)
    x = rng.random((400, 6))
    true = np.array([0.4, 0.1, 0.2, 0.2, 0.1, 0.0])
    y = x @ true
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, " + ", ".join(f"{f} double" for f in FT.FEATURES) + ", expert_score double")
    got = {r["feature"]: r["weight"] for r in FT.fit_beta(df, l2=0.0).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert np.allclose([got[f] for f in FT.FEATURES], true, atol=0.02)
    cv = FT.cv_beta(df, "id").toPandas()
    assert (cv["mse_calibrated"] < cv["mse_base"]).all() and (cv["spearman"] > 0.95).all()


def test_bootstrap_ranks_ties_by_the_activation_of_the_replicate(spark):
    """Rules that never flip a case are tied; each replicate orders them by its own mean activation."""
    rng = np.random.default_rng(6)
    h = rng.uniform(0.1, 1.0, (40, 5))
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(h)], "id long, h array<double>, y int").repartition(3)
    got = {r.rule: r for r in RU.rule_importance_bootstrap(df, [1.0] * 5, "id", replicates=30, top_k=2).collect()}
    steps = np.array(N.poisson1_steps())
    ranks = np.zeros((30, 5))
    for rep in range(30):
        u = [int(hashlib.md5(f"42|{rep}|{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(40)]
        w = np.searchsorted(steps, u, side="right")
        ranks[rep, np.lexsort((np.arange(5), -np.round(w @ h / w.sum(), 12)))] = np.arange(1, 6)
    for rule in range(5):
        assert got[rule].mean_rank == pytest.approx(ranks[:, rule].mean()) and got[rule].top_frequency == pytest.approx((ranks[:, rule] <= 2).mean())
        assert got[rule].mean_delta_f1 == 0.0
