"""Streaming semantics: replay equals batch (covered by the str_* oracles); watermarks
bound state (windows close and are emitted once the watermark passes them)."""

from __future__ import annotations

import datetime as dt
import tempfile
import time


import random

import pytest
from pyspark.sql import functions as F

from roadlens.streaming import jobs


def files(spark, place, parts, schema):
    """A file stream that reads the parts one micro-batch each, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/b{k}")
        time.sleep(1.1)          # file times order the batches
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(place)))


def test_windows_emit_only_after_watermark(spark):
    """Append mode: a window is emitted once the watermark (max event time - 3 h) passes its
    end; the still-open 22:00 window is held in state, not emitted.  (Spark guarantees rows
    within the watermark are counted; rows older than it may be dropped.)"""
    src = tempfile.mkdtemp(prefix="roadlens-stream-src-")
    schema = "id long, ts timestamp, corridor string, status string"
    base = dt.datetime(2024, 1, 2, 12, 0)
    first = [(1, base, "A", "PENDING"), (2, base + dt.timedelta(minutes=20), "A", "PENDING"),
             (3, base + dt.timedelta(hours=10), "A", "PENDING")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{src}/b1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    counts = jobs.rolling_counts(stream, window="1 hour", slide="1 hour", watermark="3 hours")
    out = jobs.run_available(counts, "wm")
    got = {(r["window_start"], r["n"]) for r in out.collect()}
    assert (base, 2) in got
    assert all(ws < base + dt.timedelta(hours=10) for ws, _ in got)


def test_dedupe_keeps_one_row_per_id(spark):
    src = tempfile.mkdtemp(prefix="roadlens-stream-dup-")
    schema = "id long, ts timestamp, status string"
    t = dt.datetime(2024, 1, 2, 12, 0)
    rows = [(1, t, "PENDING"), (1, t, "PENDING"), (2, t + dt.timedelta(minutes=5), "DISPATCHED")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b1")
    stream = spark.readStream.schema(schema).parquet(f"{src}/b1")
    out = jobs.run_available(jobs.dedupe(stream).select("id"), "dedupe_t")
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def test_foreach_batch_status_merge_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="roadlens-stream-merge-")
    out = tempfile.mkdtemp(prefix="roadlens-stream-snap-")
    schema = "id long, ts timestamp, status string"
    t = dt.datetime(2024, 1, 2, 12, 0)
    b1 = [(1, t, "PENDING"), (2, t, "PENDING"), (3, t, "DISPATCHED")]
    b2 = [(1, t + dt.timedelta(minutes=5), "DISPATCHED"), (2, t - dt.timedelta(minutes=5), "RESOLVED"),
          (4, t, "PENDING")]
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(f"{src}/b1")
    time.sleep(1.5)
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(f"{src}/b2")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    snap = jobs.run_status_merge(stream, f"{out}/status", f"{out}/ckpt")
    got = {r["id"]: r["status"] for r in snap.collect()}
    # id 2's second row is older than its first, so the earlier PENDING stays latest
    assert got == {1: "DISPATCHED", 2: "PENDING", 3: "DISPATCHED", 4: "PENDING"}


def test_stream_without_input_is_empty(spark, tmp_path):
    """A folder without files: the append sink and the keyed sink both give an empty table."""
    (tmp_path / "in").mkdir()
    schema = "id string, ts timestamp, status string"
    for keys in (None, ["id"]):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        df = stream if keys is None else jobs.latest_status(stream)
        got = jobs.run_available(df, "empty", keys)
        assert got.columns == df.columns and got.count() == 0


T0 = dt.datetime(2024, 1, 2, 12, 0)


def state_rows(df, tmp_path, mode="update"):
    """Rows of state after a run over all available input."""
    q = (df.writeStream.format("noop").outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


def test_status_state_is_evicted(spark, tmp_path):
    """The state keeps the incidents of open spans only; the compacted rows keep all incidents."""
    old = [(k, T0 + dt.timedelta(minutes=k), "PENDING") for k in range(50)]
    new = [(100 + k, T0 + dt.timedelta(days=9, minutes=k), "PENDING") for k in range(3)]
    moved = [(7, T0 + dt.timedelta(days=9), "RESOLVED"), (None, T0 + dt.timedelta(days=9), "PENDING"), (8, None, "RESOLVED")]
    stream = files(spark, tmp_path / "in", [old, new + moved], "id long, ts timestamp, status string")
    assert state_rows(jobs.latest_status(stream), tmp_path) == 5
    got = jobs.compact_status(jobs.run_available(jobs.latest_status(stream), "evict", ["span", "id"]))
    rows = {r.id: r.status for r in got.collect()}
    assert len(rows) == 54 and rows[7] == "RESOLVED" and rows[8] == "PENDING" and rows[None] == "PENDING"


@pytest.mark.parametrize("seed", range(2))
def test_live_counts_equal_a_batch(spark, tmp_path, seed):
    """Out-of-order rows within the watermark, ties, a value of a third of all rows, several batches."""
    r = random.Random(seed)
    rows = [(k, T0 + dt.timedelta(minutes=r.choice([r.randrange(1800), 600]), microseconds=r.randrange(3)),
             r.choice(["A", "A", "B", None, "C"])) for k in range(400)]
    rows.sort(key=lambda x: x[1] + dt.timedelta(minutes=r.randrange(55)))
    end = [(1000, T0 + dt.timedelta(days=3), "Z")]
    parts = [rows[:150] + [(2000, None, "A")], rows[150:170], rows[170:], end]
    stream = files(spark, tmp_path / "in", parts, "id long, ts timestamp, corridor string")
    got = {x.id: (x.corridor, x.ts, x.n_3h, x.n_6h) for x in jobs.run_available(jobs.live_counts(stream), "live_t").collect()}
    want = {}
    for i, t, c in rows:
        same = [u for _, u, d in rows if d == c]
        want[i] = (c or "unknown", t, *(sum(t - dt.timedelta(hours=h) <= u < t for u in same) for h in (3, 6)))
    assert got == want
    assert state_rows(jobs.live_counts(stream), tmp_path, "append") <= 2          # the last report and its history


def test_last_rows_equal_a_ranking(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, T0 + dt.timedelta(minutes=r.randrange(60)), r.choice("mmn"), float(k), 0.5) for k in range(300)]
    rows.append((999, None, "m", 1.0, 0.5))
    stream = files(spark, tmp_path / "in", [rows[:120], rows[120:130], rows[130:]],
                   "id long, ts timestamp, model string, latency_ms double, confidence double")
    recent = jobs.run_recent(stream, keep=40)
    for m in "mn":
        best = sorted((x for x in rows if x[2] == m and x[1]), key=lambda x: (x[1], x[0]))[-40:]
        assert sorted(x.id for x in recent.where(F.col("model") == m).collect()) == sorted(x[0] for x in best)
    means = {x.model: (x.n, x.avg_latency_ms) for x in jobs.recent_means(recent).collect()}
    assert means["m"][0] == 40
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(stream.schema).parquet(str(tmp_path / "none"))
    assert jobs.run_recent(empty).count() == 0


def test_warning_feeds_as_streams_equal_the_batch(spark, tmp_path):
    """Windows of one feed alone, no rows of another, several batches; alerts are five rows a window."""
    r = random.Random(5)
    at = lambda: T0 + dt.timedelta(minutes=r.randrange(600))
    reports = [(at(), r.choice(["PENDING", "RESOLVED", "ON_SCENE"]), r.choice(["water_logging", "accident", "other", None]),
                r.choice(["road work", "Crash", None])) for _ in range(30)] + [(None, "PENDING", "accident", None)]
    cams = [(at() + dt.timedelta(hours=6), r.choice(["JAMMED", "LOW"]), float(r.randrange(500))) for _ in range(20)]
    rain = [(at() - dt.timedelta(hours=5), float(r.randrange(20))) for _ in range(25)]
    schemas = ["ts timestamp, status string, event_cause string, description string", "ts timestamp, density string, queue_length_m double",
               "ts timestamp, rain_mm double"]
    feeds = [files(spark, tmp_path / f"f{k}", [x[:10], x[10:]], schema) for k, (x, schema) in enumerate(zip((reports, cams, rain), schemas))]
    live = jobs.run_available(jobs.early_warning_stream(*feeds, watermark="1 day"), "warn_t", ["window_start"])
    weather = (spark.createDataFrame(rain, schemas[2]).groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.avg("rain_mm").alias("rain_mm"))
               .withColumn("visibility_km", jobs.sight(F.col("rain_mm")))
               .withColumn("flood_risk", F.when(F.col("rain_mm") > 5, "MEDIUM").otherwise("LOW")))
    batch = jobs.early_warning(spark.createDataFrame(reports, schemas[0]), spark.createDataFrame(cams, schemas[1]), weather)
    assert sorted(live.collect()) == sorted(batch.select(*live.columns).collect()) and live.count() > 12
    alerts = jobs.alert_rows(live).collect()
    assert len(alerts) == 5 * live.count() and {a.alert_id for a in alerts} == {v[0] for v in jobs.ALERTS.values()}


def test_state_of_windows_is_evicted(spark, tmp_path):
    """Telemetry and warnings hold the open windows only."""
    rows = [(T0 + dt.timedelta(hours=k), "m", 1.0, 0.5) for k in range(30)]
    stream = files(spark, tmp_path / "in", [rows[:20], rows[20:]], "ts timestamp, model string, latency_ms double, confidence double")
    assert state_rows(jobs.telemetry(stream), tmp_path) <= 2
    rain = files(spark, tmp_path / "rain", [[(t, 3.0) for t, *_ in rows]], "ts timestamp, rain_mm double")
    reports = files(spark, tmp_path / "r", [[(rows[-1][0], "PENDING", "accident", None)]],
                    "ts timestamp, status string, event_cause string, description string")
    cams = files(spark, tmp_path / "c", [[(rows[-1][0], "JAMMED", 10.0)]], "ts timestamp, density string, queue_length_m double")
    (tmp_path / "w").mkdir()
    assert state_rows(jobs.early_warning_stream(reports, cams, rain), tmp_path / "w") <= 2
