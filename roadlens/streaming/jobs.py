"""Structured Streaming jobs (STR-01..07).

Sources are file streams over the driver tables (one new file = one micro-batch);
every stateful query carries a watermark so state is bounded; sinks write with a
checkpoint under the shared folder named by ``spark.checkpoint.dir`` so a
restarted query resumes exactly once.  ``run_available`` drives a query with
``trigger(availableNow=True)`` (replay of what is there, then stop) into Parquet and
reads it back, which is how the batch-equivalence checks run; nothing passes the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions.common import np_round
from roadlens.operators import clean, score
from roadlens.sources.tables import incidents_from, read_table
from roadlens.session import ensure_checkpoint_dir


# ------------------------------------------------------------------ sources / runner

def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """``events`` as a file stream with the batch schema (no inference)."""
    schema = read_table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.option("pathGlobFilter", "events*.parquet").parquet(sf_dir.rstrip("/"))


def incident_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from(event_stream(spark, sf_dir))


def run_available(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over all available input into Parquet in the shared folder; return what it wrote.

    Without ``keys``: append mode and the file sink (exactly once).  With ``keys``: update mode, so
    that the watermark evicts state; each micro-batch is written under its epoch (a replayed epoch
    rewrites its own files), and the newest row of each key is the result.  A stream that never had
    an input file has written nothing: the result is an empty table."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:8]}"
    out = f"{base}/out"
    w = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if keys is None:
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        q = w.foreachBatch(lambda b, epoch: b.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")) \
            .outputMode("update").start()
    q.awaitTermination()
    schema = df.schema if keys is None else T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    try:
        got = spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)
    if keys is None:
        return got
    values = [c for c in df.columns if c not in keys]
    last = got.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in df.columns])


def write_parquet_stream(df: DataFrame, path: str, checkpoint: str):
    """Production sink: append parquet with a durable checkpoint (exactly-once file sink)."""
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").start())


# Alert -> id, category, its calm level, time frame when raised, time frame when calm.
ALERTS = {
    "congestion": ("EWS-CONG-01", "Emerging Congestion", "MEDIUM", "Immediate (Next 15 mins)", "In 30 mins"),
    "accident": ("EWS-ACC-01", "Accident Risk", "MEDIUM", "In 30 mins", "In 1 hour"),
    "flood": ("EWS-FLOOD-01", "Flood Risk", "LOW", "Immediate", "In 2 hours"),
    "event": ("EWS-EVENT-01", "Event Risk", "MEDIUM", "In 1 hour", "In 2 hours"),
    "infrastructure": ("EWS-INFRA-01", "Infrastructure Risk", "MEDIUM", "In 2 hours", "In 2 hours"),
}


# ------------------------------------------------------------------ jobs

def intake(reports: DataFrame) -> DataFrame:
    """STR-01: validate, enrich (nearest station, triage of the mapped cause), append.

    Pure projection: no state, runs inside whole-stage codegen per micro-batch."""
    v = clean.validate_rows(reports.select("id", "ts", "start_datetime", "latitude", "longitude", "event_cause",
                                           "description", "status"))
    name, km = score.nearest_station()
    return v.select("id", "ts", "event_cause", "is_valid", "errors", name.alias("nearest_station"),
                    km.alias("station_km"), *score.triage("event_cause"))


def dedupe(reports: DataFrame, key: str = "id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """STR-02: duplicate suppression with bounded state (dedup within the watermark)."""
    return reports.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def latest_status(reports: DataFrame, key: str = "id", ts: str = "ts", watermark: str = "1 day",
                  span: str = "1 day") -> DataFrame:
    """STR-03: latest status per incident and ``span`` (max over a (ts, status) struct), update mode.

    Grouped by the id alone the watermark would have nothing to evict by.  With the span in the key
    the state holds the incidents of the spans that are still open, no others; the written rows of
    an incident (one for each span with an update) are compacted by ``compact_status``."""
    return (reports.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)
            .groupBy(F.window(ts, span).alias("w"), key)
            .agg(F.max(F.struct(ts, "status")).alias("s"))
            .select(F.col("w.start").alias("span"), key, F.col("s.status").alias("status"), F.col(f"s.{ts}").alias("status_ts")))


def compact_status(spans: DataFrame, key: str = "id") -> DataFrame:
    """STR-03: the newest of an incident's span rows (a batch aggregate, combined map-side)."""
    newest = spans.groupBy(key).agg(F.max(F.struct("status_ts", "status")).alias("s"))
    return newest.select(key, F.col("s.status").alias("status"), F.col("s.status_ts").alias("status_ts"))


def rolling_counts(reports: DataFrame, window: str = "3 hours", slide: str = "1 hour", by: str = "corridor",
                   ts: str = "ts", watermark: str = "3 hours") -> DataFrame:
    """STR-04: sliding-window counts per key with a watermark: windows are finalised (and
    their state evicted) once the watermark passes them; rows within the watermark always
    count, rows older than it may be dropped (Spark's guarantee)."""
    return (reports.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)
            .groupBy(F.window(ts, window, slide).alias("w"), F.coalesce(F.col(by), F.lit("unknown")).alias(by))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n"))


def live_counts(reports: DataFrame, by: str = "corridor", ts: str = "ts", key: str = "id",
                hours: tuple[int, ...] = (3, 6), watermark: str = "1 hour") -> DataFrame:
    """STR-04, live: for each report the number of reports of its ``by`` value in ``[ts - h, ts)``, append mode.

    A report is emitted once the watermark has passed its millisecond: then all that can still
    arrive is later, so its counts are those of a batch job, out-of-order rows included (rows behind
    the watermark are dropped, Spark's rule).  State is keyed by (value, block of the longest
    window): a report counts in its own block and is history in the next, so a key holds the times
    of two blocks at most, a busy value is spread over its blocks, and a key's timer removes it when
    the watermark passes its block.  Rows without a time are left out; equal times do not count each other."""
    span = max(hours) * 3_600_000_000
    kind = reports.schema[key].dataType.simpleString()
    us = F.unix_micros(F.col(ts))
    x = (reports.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)
         .select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.coalesce(F.col(by), F.lit("unknown")).alias("value"), us.alias("us"),
                 F.floor(us / F.lit(span)).cast("long").alias("at")))
    x = x.select("key", "ts", "value", "us", F.explode(F.array(F.struct(F.col("at").alias("block"), F.lit(True).alias("own")),
                                                               F.struct((F.col("at") + 1).alias("block"), F.lit(False).alias("own")))).alias("b"))
    x = x.select("key", "ts", "value", "us", "b.block", "b.own")
    names = [f"n_{h}h" for h in hours]

    def count(group, batches, state):
        value, block = group
        seen, keys, at = (np.array(c, kind) for c, kind in zip(state.get if state.exists else ((), (), ()), (np.int64, object, np.int64)))
        if not state.hasTimedOut:
            parts = list(batches)
            own = [p[p["own"]] for p in parts]
            seen = np.sort(np.concatenate([seen, *(p["us"].to_numpy(np.int64) for p in parts)]))
            keys = np.concatenate([keys, *(p["key"].to_numpy(object) for p in own)])
            at = np.concatenate([at, *(p["us"].to_numpy(np.int64) for p in own)])
        now = state.getCurrentWatermarkMs()
        ready = at // 1000 < now
        if ready.any():
            t = at[ready]
            upto = np.searchsorted(seen, t)
            yield pd.DataFrame({"key": keys[ready], "ts": pd.to_datetime(t, unit="us"), "value": value,
                                **{n: upto - np.searchsorted(seen, t - h * 3_600_000_000) for n, h in zip(names, hours)}})
            keys, at = keys[~ready], at[~ready]
        end = (block + 1) * span // 1000
        if not len(at) and now >= end:
            state.remove()
            return
        first = at.min() if len(at) else now * 1000
        state.update((seen[seen >= min(first, now * 1000) - span].tolist(), keys.tolist(), at.tolist()))
        state.setTimeoutTimestamp(int(max(now + 1, first // 1000 if len(at) else end)))

    out = x.groupBy("value", "block").applyInPandasWithState(
        count, "key string, ts timestamp, value string, " + ", ".join(f"{n} long" for n in names),
        "seen array<bigint>, keys array<string>, at array<bigint>", "append", "EventTimeTimeout")
    return out.select(F.col("key").cast(kind).alias(key), F.col("ts").alias(ts), F.col("value").alias(by), *names)


def early_warning(reports: DataFrame, cams: DataFrame, weather: DataFrame, window: str = "1 hour") -> DataFrame:
    """STR-05: per window the inputs of the warning rules - congested cameras, rain, visibility,
    flood risk, active keyword reports - and the level of the five alerts.

    Congestion: CRITICAL over a 350 m queue, HIGH with any congested camera, else MEDIUM.  Accident:
    CRITICAL over 10 mm of rain, HIGH over 2 mm, under 6 km of sight or with an active accident, else
    MEDIUM.  Flood: CRITICAL over 10 mm or with active water logging, HIGH over 5 mm or a raised flood
    risk, else LOW.  Event: HIGH from 16 to 23 h, else MEDIUM.  Infrastructure: HIGH with active works."""
    r = _active(reports).groupBy(F.window("ts", window).start.alias("w")).agg(*[F.count_if(c).alias(n) for n, c in _mentions().items()])
    c = cams.filter(F.col("ts").isNotNull()).groupBy(F.window("ts", window).start.alias("w")).agg(
        F.count_if(_congested()).alias("n_congested_cams"),
        F.max(F.when(_congested(), F.col("queue_length_m"))).alias("queue_m"))
    w = weather.groupBy(F.window("hr", window).start.alias("w")).agg(
        F.max("rain_mm").alias("rain_mm"), F.min("visibility_km").alias("visibility_km"),
        F.max(F.col("flood_risk").isin("MEDIUM", "HIGH")).alias("flood"))
    return warning_levels(r.join(c, "w", "full_outer").join(w, "w", "full_outer"))


def early_warning_stream(reports: DataFrame, cams: DataFrame, readings: DataFrame, window: str = "1 hour",
                         watermark: str = "1 hour") -> DataFrame:
    """STR-05 over three live feeds: the same windows and levels as ``early_warning``, update mode.

    The feeds are brought to one row form and united, so that one watermarked aggregate (combined
    map-side) does what an outer join of three windowed streams would: a window with rows of any
    feed is there, and its state goes when the watermark of the slowest feed passes it.
    ``readings`` are single rain readings (ts, rain_mm); the mean of a window gives its sight and flood risk."""
    feeds = {"r": (_active(reports).select("ts", *[c.alias(n) for n, c in _mentions().items()])),
             "c": cams.filter(F.col("ts").isNotNull()).select("ts", _congested().alias("congested"),
                                                              F.when(_congested(), F.col("queue_length_m")).alias("queue_m")),
             "w": readings.filter(F.col("ts").isNotNull()).select("ts", "rain_mm")}
    r, c, w = (f.withWatermark("ts", watermark) for f in feeds.values())
    every = r.unionByName(c, allowMissingColumns=True).unionByName(w, allowMissingColumns=True)
    j = every.groupBy(F.window("ts", window).alias("span")).agg(
        *[F.count_if(F.col(n)).alias(n) for n in _mentions()], F.count_if(F.col("congested")).alias("n_congested_cams"),
        F.max("queue_m").alias("queue_m"), F.avg("rain_mm").alias("rain_mm"))
    rain = F.col("rain_mm")
    return warning_levels(j.withColumns({"w": F.col("span.start"), "visibility_km": sight(rain), "flood": rain > 5}))


def sight(rain: Column) -> Column:
    """Visibility in km in rain of so many mm (null: null)."""
    return F.lit(10.0) - F.when(rain > 16, 16.0).otherwise(rain) / 2


def _active(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("status").isin("PENDING", "DISPATCHED", "ON_SCENE") & F.col("ts").isNotNull())


def _mentions() -> dict[str, Column]:
    lc, ld = F.lower(F.coalesce("event_cause", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    return {"n_water": F.contains(lc, F.lit("water")) | F.contains(lc, F.lit("flood")) | F.contains(ld, F.lit("water")),
            "n_accident": F.contains(lc, F.lit("accident")) | F.contains(lc, F.lit("crash")) | F.contains(ld, F.lit("accident")),
            "n_work": F.contains(lc, F.lit("construction")) | F.contains(ld, F.lit("repair")) | F.contains(ld, F.lit("work"))}


def _congested() -> Column:
    return F.col("density").isin("JAMMED", "HEAVY") | (F.col("queue_length_m") > 200)


def warning_levels(inputs: DataFrame) -> DataFrame:
    """The levels of the five alerts from a window's inputs (nulls: nothing reported)."""
    j = inputs.fillna({"n_water": 0, "n_accident": 0, "n_work": 0, "n_congested_cams": 0, "queue_m": 0.0, "rain_mm": 0.0,
                       "visibility_km": 10.0, "flood": False})
    rain, cam, hour = F.col("rain_mm"), F.col("n_congested_cams") > 0, F.hour("w")
    return j.select(
        F.col("w").alias("window_start"), "n_water", "n_accident", "n_work", "n_congested_cams",
        np_round(rain, 6).alias("rain_mm"),
        F.when(cam & (F.col("queue_m") > 350), "CRITICAL").when(cam, "HIGH").otherwise("MEDIUM").alias("congestion_level"),
        F.when((rain > 2) | (F.col("visibility_km") < 6) | (F.col("n_accident") > 0),
               F.when(rain > 10, "CRITICAL").otherwise("HIGH")).otherwise("MEDIUM").alias("accident_level"),
        F.when((rain > 5) | F.col("flood") | (F.col("n_water") > 0),
               F.when((rain > 10) | (F.col("n_water") > 0), "CRITICAL").otherwise("HIGH")).otherwise("LOW").alias("flood_level"),
        F.when((hour >= 16) & (hour <= 23), "HIGH").otherwise("MEDIUM").alias("event_level"),
        F.when(F.col("n_work") > 0, "HIGH").otherwise("MEDIUM").alias("infrastructure_level"))


def alert_rows(warn: DataFrame) -> DataFrame:
    """STR-05: one row per window and alert: id, category, level, time frame, the reports and the measure behind it."""
    none, quiet = F.lit(None).cast("double"), F.lit(0).cast("long")
    reports = {"accident": F.col("n_accident"), "flood": F.col("n_water"), "infrastructure": F.col("n_work"), "congestion": F.col("n_congested_cams")}
    rows = [F.struct(F.lit(id).alias("alert_id"), F.lit(category).alias("category"), F.col(f"{name}_level").alias("risk_level"),
                     F.when(F.col(f"{name}_level") == calm, later).otherwise(soon).alias("timeframe"),
                     reports.get(name, quiet).cast("long").alias("n_sources"),
                     (F.col("rain_mm") if name in ("accident", "flood") else none).alias("rain_mm"))
            for name, (id, category, calm, soon, later) in ALERTS.items()]
    return warn.select("window_start", F.explode(F.array(*rows)).alias("a")).select("window_start", "a.*")


def horizon_risk(warn: DataFrame) -> DataFrame:
    """STR-06: risk index, status, trend and alert colour 30 minutes, 1 hour and 2 hours ahead."""
    rain, cam = F.col("rain_mm"), (F.col("n_congested_cams") > 0).cast("double")

    def index(base: float, congestion: float, factor: float, cap: float, most: float):
        return F.least(F.lit(base) + cam * congestion + F.least(rain * factor, F.lit(cap)), F.lit(most))

    def status(c):
        return F.when(c > 70, "critical").when(c > 50, "high").when(c > 30, "medium").otherwise("low")

    def colour(c):
        return F.when(c > 70, "RED").when(c > 50, "ORANGE").when(c > 30, "YELLOW").otherwise("GREEN")

    x = warn.select("window_start", index(30.0, 30.0, 2.0, 30.0, 98.0).alias("t30"),
                    index(25.0, 20.0, 1.5, 25.0, 90.0).alias("t1"), index(15.0, 0.0, 1.0, 20.0, 80.0).alias("t2"))
    t30, t1, t2 = F.col("t30"), F.col("t1"), F.col("t2")
    trends = {"t30": F.when(t30 > t1, "UPWARD").otherwise("STABLE"),
              "t1": F.when(F.abs(t1 - t2) < 5, "STABLE").when(t1 > t2, "UPWARD").otherwise("DOWNWARD"),
              "t2": F.when(t2 < t1, "DOWNWARD").otherwise("STABLE")}
    return x.select("window_start", *[c for n, name in (("t30", "30m"), ("t1", "1h"), ("t2", "2h")) for c in (
        np_round(n, 1).alias(f"risk_{name}"), status(F.col(n)).alias(f"status_{name}"), trends[n].alias(f"trend_{name}"),
        colour(F.col(n)).alias(f"alert_{name}"))])


def telemetry(scored: DataFrame, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """STR-07: tumbling-window mean latency and confidence per model.

    Grouped by the window itself: its start alone would not carry the watermark, and no state would go."""
    return (scored.filter(F.col(ts).isNotNull()).withWatermark(ts, window)
            .groupBy(F.window(ts, window).alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"),
                 F.avg("confidence").alias("avg_confidence"))
            .select(F.col("w.start").alias("window_start"), "model", "n", "avg_latency_ms", "avg_confidence"))


# ------------------------------------------------------------------ keyed merge sink (STR-03 / SNK-05)

def _versions(spark: SparkSession, base: str) -> list[int]:
    """Committed snapshot versions (``v=<epoch>`` folders holding ``_SUCCESS``) under ``base``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(path)
                  if st.isDirectory() and st.getPath().getName().startswith("v=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))


def latest_snapshot(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """Newest committed snapshot (optionally the newest older than epoch ``before``)."""
    vs = [v for v in _versions(spark, base) if before is None or v < before]
    return spark.read.parquet(f"{base}/v={vs[-1]:012d}") if vs else None


def merge_status_batch(batch: DataFrame, epoch_id: int, base: str, key: str = "id", ts: str = "ts") -> None:
    """``foreachBatch`` body: merge the latest (ts, status) per key of this micro-batch into
    the previous snapshot and write it as version ``epoch_id``.  Re-running an epoch after
    a failure rewrites the same version from the same inputs (idempotent)."""
    spark = batch.sparkSession
    latest = (batch.groupBy(key).agg(F.max(F.struct(ts, "status")).alias("s"))
              .select(key, F.col("s").getField(ts).alias(ts), F.col("s.status").alias("status")))
    prev = latest_snapshot(spark, base, before=epoch_id)
    if prev is not None:
        both = prev.unionByName(latest)
        latest = (both.groupBy(key).agg(F.max(F.struct(ts, "status")).alias("s"))
                  .select(key, F.col("s").getField(ts).alias(ts), F.col("s.status").alias("status")))
    latest.write.mode("overwrite").parquet(f"{base}/v={epoch_id:012d}")


def run_status_merge(stream: DataFrame, base: str, checkpoint: str, key: str = "id", ts: str = "ts"):
    """Drive ``merge_status_batch`` over all available input (``availableNow``)."""
    q = (stream.writeStream.foreachBatch(lambda b, e: merge_status_batch(b, e, base, key, ts))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_snapshot(stream.sparkSession, base)


# ------------------------------------------------------------------ last rows per key (STR-07)

def merge_recent_batch(batch: DataFrame, epoch_id: int, base: str, by: str = "model", ts: str = "ts", key: str = "id",
                       keep: int = 100) -> None:
    """``foreachBatch`` body: the ``keep`` newest rows of each ``by`` value (ties by ``key``) of this micro-batch
    and the previous snapshot, written as version ``epoch_id`` (a replayed epoch rewrites its own).

    The snapshot holds at most ``keep`` rows of a value; within a batch Spark keeps at most ``keep`` rows
    of a value per task before the shuffle, so a busy value is no hot key."""
    rows = batch.filter(F.col(ts).isNotNull())
    prev = latest_snapshot(batch.sparkSession, base, before=epoch_id)
    if prev is not None:
        rows = prev.unionByName(rows)
    newest = Window.partitionBy(by).orderBy(F.desc(ts), F.desc(key))
    (rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep).drop("rank")
     .write.mode("overwrite").parquet(f"{base}/v={epoch_id:012d}"))


def run_recent(scored: DataFrame, by: str = "model", ts: str = "ts", key: str = "id", keep: int = 100) -> DataFrame:
    """STR-07, last rows: drive ``merge_recent_batch`` over all available input; the newest snapshot (empty without input)."""
    spark = scored.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-recent-{uuid.uuid4().hex[:8]}"
    q = (scored.writeStream.foreachBatch(lambda b, e: merge_recent_batch(b, e, f"{place}/rows", by, ts, key, keep))
         .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    last = latest_snapshot(spark, f"{place}/rows")
    return last if last is not None else spark.createDataFrame([], scored.schema)


def recent_means(recent: DataFrame, by: str = "model") -> DataFrame:
    """STR-07: mean latency and confidence of the rows kept."""
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"),
                                  F.avg("confidence").alias("avg_confidence"))
