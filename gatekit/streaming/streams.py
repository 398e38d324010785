"""The gate on Structured Streaming sources.

Each function takes and returns a streaming DataFrame (batch works too where state is built in).
Sinks, triggers and checkpoint locations belong to the caller, see `write_stream`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.observe import observe
from ..plans.plan import ACTIONS
from ..session import checkpoint_root


def write_stream(df: DataFrame, name: str, sink: str, path: str | None = None, mode: str = "append", once: bool = True):
    """Start a query with its checkpoint under the shared folder. File sinks restart exactly once."""
    writer = (
        df.writeStream.queryName(name)
        .outputMode(mode)
        .format(sink)
        .option("checkpointLocation", f"{checkpoint_root(df.sparkSession)}/{name}")
    )
    if path:
        writer = writer.option("path", path)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def observe_stream(cases: DataFrame, **options) -> DataFrame:
    """Score and gate a stream. Stateless, so late rows are scored like any other."""
    return observe(cases, **options)


def action_rates(scored: DataFrame, ts: str, window: str = "1 day", slide: str | None = None, lateness: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Action rates per tumbling or sliding window. On a stream, rows later than the watermark are dropped.

    Counters are combined before the shuffle, and state holds one row per window and group.
    """
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    source = scored.withWatermark(ts, lateness) if scored.isStreaming else scored
    counts = source.groupBy(frame.alias("frame"), *by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        F.avg("rho").alias("mean_rho"),
    )
    return counts.select(
        F.col("frame.start").alias("window_start"),
        F.col("frame.end").alias("window_end"),
        *by,
        "n",
        *[(F.col(f"n_{a}") / F.col("n")).alias(f"rate_{a}") for a in ACTIONS],
        "mean_rho",
    )


# --- drift with state ---------------------------------------------------------------------------

DRIFT_OUTPUT = "user_id long, shard int, event_id long, ts timestamp, gamma double, rupture boolean, first boolean, event_type string, u double"
DRIFT_ROW = "who string, ts timestamp, event_id long, event_type string, u double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drift_processor(gamma_max: float, idle_ms: int):
    """State of one group of users (as text) and shard: the rows that wait for the watermark, and the last row of each user that was paired.

    Everything it needs is defined inside, so Spark ships it by value and executors need pandas only.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    columns = ["who", "ts", "event_id", "event_type", "u"]

    def event_gamma(u0, type0, u1, type1):
        # The risk gap counts in the representation and the uncertainty part, the activation gap depends
        # on whether both fire the same rule, and the trace differs in id and time (2 of 6 fields).
        same = (type0 == type1) * 1.0
        a0, a1 = 0.5 + 0.5 * u0, 0.5 + 0.5 * u1
        activation = same * abs(a0 - a1) + (1.0 - same) * (a0 + a1) / 2.0
        return (0.30 + 0.20) * abs(u0 - u1) + 0.25 * (1.0 - same) + 0.15 * activation + 0.10 * 2.0 / 6.0

    def millis(ts) -> int:
        return int(pd.Timestamp(ts).value // 1_000_000)

    class Drift(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", DRIFT_ROW)
            self.last = handle.getListState("last", DRIFT_ROW)
            self.alarm = handle.getValueState("alarm", "at long")

        def wake(self, at: int) -> None:
            """One timer a group: the earliest time at which something can be done."""
            before = self.alarm.get()[0] if self.alarm.exists() else None
            if before is None or at < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.alarm.update((at,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for frame in rows:
                if len(frame):
                    known = lambda value, kind: None if pd.isna(value) else kind(value)
                    fields = zip(*[frame[c] for c in columns], strict=True)
                    self.waiting.appendList([(w, t.to_pydatetime(), known(e, int), known(k, str), known(u, float)) for w, t, e, k, u in fields])
                    self.wake(millis(frame["ts"].min()) + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.alarm.clear()
            now = timerValues.getCurrentWatermarkInMs()
            ready, later = [], []
            for row in self.waiting.get():
                (ready if millis(row[1]) < now else later).append(tuple(row))
            ready.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.wake(min(millis(r[1]) for r in later) + 1)
            last = {row[0]: tuple(row) for row in self.last.get()}
            if ready:
                # A user's first row follows the user's last one of before, or nothing.
                nobody = (None, None, None, None, float("nan"))
                previous = [ready[k - 1] if k and ready[k - 1][0] == r[0] else last.get(r[0], nobody) for k, r in enumerate(ready)]
                before, here = pd.DataFrame(previous, columns=columns), pd.DataFrame(ready, columns=columns)
                paired = pd.Series([p is not nobody for p in previous], index=here.index)
                gamma = event_gamma(before["u"].astype(float), before["event_type"], here["u"].astype(float), here["event_type"]).where(paired)
                last |= {r[0]: r for r in ready}
                yield pd.DataFrame(
                    {
                        "user_id": pd.array([int(w) if w else None for w in here["who"]], dtype="Int64"), "shard": key[1], "event_id": here["event_id"].astype("Int64"), "ts": here["ts"],
                        "gamma": gamma, "rupture": (gamma > gamma_max) & paired, "first": ~paired,
                        "event_type": here["event_type"], "u": here["u"].astype(float),
                    }
                )
            # A last row goes after idle_ms, unless rows of the user wait for it.
            awaited = {r[0] for r in later}
            kept = {w: r for w, r in last.items() if w in awaited or now < millis(r[1]) + idle_ms}
            if kept:
                self.last.put(list(kept.values()))
            else:
                self.last.clear()
            done = [millis(r[1]) + idle_ms for w, r in kept.items() if w not in awaited]
            if done:
                self.wake(min(done))

        def close(self) -> None:
            pass

    return Drift()


def drift_stream(events: DataFrame, gamma_max: float = 0.25, lateness: str = "1 hour", idle_ms: int = 7 * 86_400_000, shard: Column | None = None, groups: int | None = None) -> DataFrame:
    """Disagreement of each event with the user's one before, in event order across triggers.

    Rows wait in the state until the watermark has passed them; then they are ordered, paired and emitted, so that a row
    that comes late, but within the lateness, still stands where it belongs. Later rows are dropped, and rows without a time. `shard` splits a
    hot user, for example by day; each shard then starts afresh and its first row is marked, and `join_shards` pairs it over the table
    written. Besides the waiting rows, state is one row per user and shard, which goes after idle_ms.

    A call of the state costs the same for one row as for many. With `groups`, users are dealt over so many groups per shard
    and a group is handled at once, which suits many users with few rows each; without it every user is a group.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # lists and timers need it
    keyed = events.where(F.col("ts").isNotNull()).withWatermark("ts", lateness).withColumn("shard", F.coalesce((F.lit(0) if shard is None else shard).cast("int"), F.lit(-1)))
    # Keys of a state are never null: the user as text, empty for null.
    who = F.coalesce(F.col("user_id").cast("long").cast("string"), F.lit("")).alias("who")
    held = F.col("who") if groups is None else F.pmod(F.xxhash64("who"), F.lit(groups)).cast("string")
    return keyed.select(who, "shard", "event_id", "ts", "event_type", "u").withColumn("held", held).groupBy("held", "shard").transformWithStateInPandas(
        statefulProcessor=_drift_processor(gamma_max, idle_ms), outputStructType=DRIFT_OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def closed(events: DataFrame, ts: str = "ts", end: str = "2200-01-01") -> DataFrame:
    """events followed by one row that has only a time after all others: it moves the watermark past them, so they all come out.

    For streams that run over a finite input in one trigger. The row itself waits for ever.
    """
    spark = events.sparkSession
    path = f"{checkpoint_root(spark)}/end-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(end).cast("timestamp").alias(ts)).write.parquet(path)
    return events.unionByName(spark.readStream.schema(f"{ts} timestamp").parquet(path), allowMissingColumns=True)


def join_shards(edges: DataFrame, gamma_max: float = 0.25) -> DataFrame:
    """The table a sharded drift stream has written, with the first row of a shard paired with the end of the user's shard before.

    Shards must rise with time. Only shard ends, one row each, are put in order; the very first row of a user stays
    without a gamma.
    """
    end = F.max_by(F.struct("event_type", "u"), F.struct("ts", "event_id"))
    ends = edges.groupBy("user_id", "shard").agg(end.alias("end"))
    order = Window.partitionBy("user_id").orderBy("shard")
    carried = ends.select(F.col("user_id").alias("_user"), F.col("shard").alias("_shard"), F.lag("end").over(order).alias("_before"))
    joined = edges.join(carried, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("shard") == F.col("_shard")))
    u0, u1 = F.col("_before.u"), F.col("u")
    same = F.col("_before.event_type").eqNullSafe(F.col("event_type"))
    a0, a1 = 0.5 + 0.5 * u0, 0.5 + 0.5 * u1
    activation = F.when(same, F.abs(a0 - a1)).otherwise((a0 + a1) / 2.0)
    gamma = (0.30 + 0.20) * F.abs(u0 - u1) + F.when(same, 0.0).otherwise(0.25) + 0.15 * activation + 0.10 * 2.0 / 6.0
    opened = F.col("first") & F.col("_before").isNotNull()
    return joined.select(
        "user_id", "shard", "event_id", "ts",
        F.when(opened, gamma).otherwise(F.col("gamma")).alias("gamma"),
        F.when(opened, gamma > gamma_max).otherwise(F.col("rupture")).alias("rupture"),
        (F.col("first") & ~opened).alias("first"), "event_type", "u",
    )


def session_paths(edges: DataFrame, key: str, ts: str, gap: str = "2 hours", lateness: str = "1 hour", gamma_max: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """A path certificate per session of edges; on a stream it is emitted when the session closes."""
    source = edges.withWatermark(ts, lateness) if edges.isStreaming else edges
    position = F.struct(ts, *order)
    totals = source.groupBy(F.session_window(ts, gap).alias("session"), key).agg(
        F.min_by("source", position).alias("source"),
        F.max_by("target", position).alias("target"),
        F.count("*").alias("length"),
        F.least(F.lit(1.0), F.sum("gamma")).alias("gamma_total"),
        F.least(F.lit(1.0), F.sum("delta")).alias("delta_total"),
    )
    return totals.select(
        key,
        F.col("session.start").alias("session_start"),
        F.col("session.end").alias("session_end"),
        "source", "target", "length", "gamma_total", "delta_total",
        (F.col("gamma_total") <= gamma_max).alias("valid"),
    )
