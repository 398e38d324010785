"""A stream over a table gives what the batch twin gives."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gatekit.catalog import SPARK
from gatekit.catalog import paths_streams as PS
from gatekit.operators import paths as P
from gatekit.operators import registry as RG
from gatekit.sources import views as V
from gatekit.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_observe_stream(spark):
    batch = PS._gated(PS._with_flags(V.table(spark, SF, "events"))).select("event_id", "action")
    assert rows(SPARK["observe_stream"](spark, SF).select("event_id", "action")) == rows(batch)


def test_a_registered_gate_runs_in_batch_and_stream(spark, tmp_path):
    gate = lambda c: F.when(c["crit"], "block").when(c["rho"] > 0.4, "defer_to_human").otherwise("accept")
    RG.register_gate("own", gate, {"crit": "boolean", "rho": "number"}, replace=True)
    try:
        events = PS._with_flags(V.table(spark, SF, "events")).withColumn("p", F.least(F.col("value") / 100, F.lit(1.0)))
        batch = ST.observe_stream(events, chi_r_crit="crit", registered=["own"])
        live = PS._with_flags(PS._stream(spark, SF)).withColumn("p", F.least(F.col("value") / 100, F.lit(1.0)))
        out = PS.run_to_table(ST.observe_stream(live, chi_r_crit="crit", registered=["own"]), "own-gate")
        assert rows(out.select("event_id", "action_own")) == rows(batch.select("event_id", "action_own"))
        assert RG.unknown_actions(batch, "action_own").isEmpty() and len(set(r.action_own for r in batch.collect())) == 3
        assert "Exchange" not in batch._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError, match="no column crit"):
            ST.observe_stream(events.drop("crit"), registered=["own"])
        with pytest.raises(ValueError, match="not boolean"):
            ST.observe_stream(events.withColumn("crit", F.lit(1)), registered=["own"])
        with pytest.raises(ValueError, match="is registered"):
            RG.register_gate("own", gate, {})
    finally:
        RG.unregister_gate("own")
    with pytest.raises(ValueError, match="no gate own"):
        ST.observe_stream(events, registered=["own"])
    RG.register_gate("odd", lambda c: c["rho"], {"rho": "number"}, replace=True)
    with pytest.raises(ValueError, match="must be a string"):
        ST.observe_stream(events, registered=["odd"])
    RG.unregister_gate("odd")


def test_drift_stream(spark):
    assert rows(SPARK["drift_stream"](spark, SF)) == rows(SPARK["drift_edges"](spark, SF))


def test_all_windows_and_sessions_come_out(spark):
    for name in ("action_rates", "session_paths"):
        assert rows(SPARK[f"{name}_stream"](spark, SF)) == rows(SPARK[name](spark, SF))


def drift_over_files(spark, folder, parts, lateness):
    """Each part is a file and a trigger of its own; the last one moves the watermark past all events."""
    schema = PS.EVENT_SCHEMA
    for i, part in enumerate([*parts, spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias("ts"))]):
        full = spark.createDataFrame([], schema).unionByName(part, allowMissingColumns=True)
        full.coalesce(1).write.mode("append").parquet(str(folder))
        for file in folder.glob("*.parquet"):
            if not file.name.startswith("done"):
                os.utime(file.rename(folder / f"done-{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = ST.drift_stream(raw.withColumn("u", F.least(F.col("value") / 300, F.lit(1.0))), gamma_max=0.35, lateness=lateness)
    return PS.run_to_table(stream, "drift-late").where(~F.col("first"))


def test_late_rows_are_paired_in_event_order(spark, tmp_path):
    """Over three triggers, events that come after later ones give the same drift and paths as one pass in order."""
    events = V.table(spark, SF, "events").cache()
    place = F.pmod(F.xxhash64("event_id"), F.lit(3))
    out = drift_over_files(spark, tmp_path / "in", [events.where(place == k) for k in range(3)], "4000 days").cache()
    want = SPARK["drift_edges"](spark, SF)
    assert out.count() == want.count() > 500
    assert rows(out.select("event_id", "rupture", F.round("gamma", 9))) == rows(want.select("event_id", "rupture", F.round("gamma", 9)))
    paths = P.drift_path(out.select("user_id", "gamma", "rupture"), "user_id").withColumn("max_gamma", F.round("max_gamma", 9))
    assert rows(paths) == rows(SPARK["drift_path"](spark, SF))


def test_rows_later_than_the_lateness_are_dropped(spark, tmp_path):
    at = lambda minute, event, value: (event, dt.datetime(2024, 1, 1, 0, minute), 1, "click", value, "")
    parts = [[at(0, 1, 30.0), at(30, 2, 60.0)], [at(20, 3, 90.0), at(40, 4, 10.0)], [at(1, 5, 50.0)], [at(59, 6, 20.0)]]
    frames = [spark.createDataFrame(p, PS.EVENT_SCHEMA) for p in parts]
    got = drift_over_files(spark, tmp_path / "in", frames, "15 minutes").orderBy("ts").select("event_id").collect()
    assert [r.event_id for r in got] == [3, 2, 4, 6]


def test_checkpoint_folder_comes_from_the_session(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/checkpoints" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert ST.checkpoint_root(Session()) == "/shared/checkpoints"


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        ST.checkpoint_root(Session())
