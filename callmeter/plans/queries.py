"""The registered queries: each applies one operator to the log that the events table stands for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fold, intake, integrity, panel, snapshot
from ..schema import CALL_KEY, USAGE
from ..sources import adapter, store
from ..streaming import calls as stream
from .requests import resolve_request

#: The snapshots' fixed present, zone and range.
REQUEST = resolve_request(days=30, time_zone="Asia/Shanghai", as_of=datetime(2024, 1, 30, 23, 59, 59, tzinfo=UTC))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir or, where that is unset and all runs in one
    process, a local one."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


log, headers, size = adapter.session_log, adapter.session_headers, adapter.log_size


def live(spark, d):
    return fold.live_events(log(spark, d), headers(spark, d), events=size(spark, d))


def events(spark, d):
    return fold.annotate(live(spark, d))


def calls(spark, d):
    return fold.build_calls(log(spark, d), headers(spark, d), events=size(spark, d))


def flat(rows: DataFrame) -> DataFrame:
    """Calls with their usage in columns."""
    short = ("input", "output", "cache_read", "cache_write")
    used = [F.col(f"{u}_usage.{c}").alias(f"{u[0]}_{s}") for u in ("provisional", "final") for c, s in zip(USAGE, short)]
    return rows.select("session_id", "created_at", "workspace", "day", "attempt_id", "turn", "step", "provider", "model", "started_at", "outcome", "retry_scheduled", *used)


def selected(spark, d):
    return snapshot.select_calls(calls(spark, d), REQUEST)


def models(spark, d):
    return snapshot.model_rollup(selected(spark, d))


def daily(spark, d):
    return snapshot.daily_rollup(snapshot.calendar_spine(spark, REQUEST), selected(spark, d))


def panel_rows(spark, d, feed=snapshot.event_feed):
    return panel.panel_events(feed(selected(spark, d))).withColumn("local_day", panel.panel_local_day(REQUEST.time_zone))


def kept(spark, rows: DataFrame) -> DataFrame:
    """rows stored, for those who use them more than once."""
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def week(spark, d):
    rows = kept(spark, panel_rows(spark, d, snapshot.feed_rows))
    return panel.filter_period(rows, 7, panel.infer_end_day(rows))


def buckets(spark, d):
    rows = kept(spark, panel_rows(spark, d, snapshot.feed_rows))
    end = panel.infer_end_day(rows)
    chosen = panel.filter_provider_model(panel.filter_period(rows, 7, end), "p1")
    return panel.buckets_from_events(panel.bucket_spine(spark, end, 7), chosen)


def as_text(m: str):
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(pairs, ",").alias(m)


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with their place in an order, for comparison."""
    return rows.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("place"), "*")


# ---- sources and sinks ----


@query
def read_log(spark, d):
    path = scratch(spark)
    log(spark, d).write.parquet(path)
    return store.read_log(spark, path)


@query
def merge_live_cold(spark, d):
    cold = log(spark, d)
    known = cold.where(F.col("session_id").cast("long") % 5 == 0).withColumn("event_time", F.col("event_time") + 1)
    return store.merge_live_cold(cold, known).select("session_id", "seq", "kind", "event_time")


@query
def drop_fork_prefix(spark, d):
    return store.drop_fork_prefix(log(spark, d), headers(spark, d)).select("session_id", "seq", "kind")


@query
def scan_calls(spark, d):
    """Two batches, the second with every call again and the first with stale outcomes: the latest state counts."""
    path, now = scratch(spark), calls(spark, d)
    store.upsert_calls(now.withColumn("outcome", F.lit(None).cast("string")).withColumn("last_seq", F.col("last_seq") - 1), path, 1)
    store.upsert_calls(now, path, 2)
    return flat(store.scan_calls(spark, path)).drop("workspace", "day", "turn", "step", "provider", "model", "started_at", "retry_scheduled")


@query
def session_cursor(spark, d):
    return fold.session_cursor(log(spark, d), headers(spark, d), size(spark, d)).select("session_id", "created_at", "workspace", "observed_seq", as_text("active_attempts"), as_text("successful_attempts"))


@query
def replay_from_cursor(spark, d):
    """The log in two parts, the second folded from the cursor that the first one left."""
    path, rows, own = scratch(spark), kept(spark, log(spark, d)), kept(spark, headers(spark, d))
    first = rows.where("seq < 40")
    none = fold.session_cursor(rows, own).where("false")
    cursor = kept(spark, fold.replay_from_cursor(spark, first, own, none, path, 1))
    fold.replay_from_cursor(spark, rows, own, cursor, path, 2)
    return flat(store.scan_calls(spark, path))


def spoiled(spark, d):
    """The log with an event in seven spoiled: a field missing or negative, or an outcome that there isn't."""
    rows, fault = log(spark, d), F.col("seq") * 31 + F.col("event_time")
    nth = lambda n: (fault % 7 == 0) & (fault.bitwiseAND(7) == n)
    gone = lambda c, n: F.when(~nth(n), F.col(c))
    less = lambda c, n: F.when(nth(n), -1 - F.col(c)).otherwise(F.col(c))
    return rows.withColumns({
        "turn": gone("turn", 0), "step": less("step", 1), "attempt_id": gone("attempt_id", 2), "provider": gone("provider", 3), "started_at": less("started_at", 4),
        "output_tokens": F.when(nth(5), -1 - F.col("output_tokens")).when(~nth(6), F.col("output_tokens")), "outcome": F.when(nth(7), "lost").otherwise(F.col("outcome")),
    })


@query
def isolation(spark, d):
    """The calls of a spoiled log, good and bad events told apart in one pass, and how many bad ones each session has."""
    good, bad = intake.split_log(spark, spoiled(spark, d), scratch(spark))
    found = flat(fold.build_calls(good, headers(spark, d))).select(F.lit("call").alias("part"), "session_id", "attempt_id", "outcome", "retry_scheduled", "p_input", "p_output", "f_input", "f_output")
    return found.unionByName(bad.groupBy(F.concat(F.lit("bad: "), "reason").alias("part"), "session_id").agg(F.count(F.lit(1)).alias("p_input")), allowMissingColumns=True)


@query
def drop_disposed(spark, d):
    cursor = fold.session_cursor(log(spark, d), headers(spark, d), size(spark, d))
    s = F.col("session_id").cast("long")
    other = F.when(s % 2 == 0, F.col("created_at") + 1).otherwise(F.col("created_at")).alias("created_at")
    return fold.drop_disposed(cursor, cursor.where(s % 3 == 0).select("session_id", other, "workspace")).select("session_id", "created_at", "workspace", "observed_seq")


@query
def validate_calls(spark, d):
    s = F.col("started_at")
    bad = calls(spark, d).withColumns({
        "created_at": F.when(s % 11 == 0, -F.col("created_at")).otherwise(F.col("created_at")), "day": F.when(s % 7 == 0, "").otherwise(F.col("day")),
        "turn": F.when(s % 5 == 0, -1 - F.col("turn")).otherwise(F.col("turn")), "outcome": F.when(s % 13 == 0, "bad").otherwise(F.col("outcome")),
        "final_usage": F.when(s % 3 == 0, F.col("final_usage").withField("output_tokens", -1 - F.col("final_usage.output_tokens"))).otherwise(F.col("final_usage")),
    })
    return integrity.validate_calls(bad).select("session_id", "attempt_id", "ok_numbers", "ok_texts", "ok_day", "ok_outcome", "ok_usage", "valid")


@query
def validate_cursor(spark, d):
    """Cursors some of which have a bad seq, a key that is no step, or an attempt without an id."""
    cursor = fold.session_cursor(log(spark, d), headers(spark, d), size(spark, d))
    s = F.col("session_id").cast("long")
    bad = cursor.withColumns({
        "observed_seq": F.when(s % 4 == 0, -2).otherwise(F.col("observed_seq")),
        "active_attempts": F.when(s % 3 == 0, F.map_concat("active_attempts", F.create_map(F.lit("first"), F.lit("a")))).otherwise(F.col("active_attempts")),
        "successful_attempts": F.when(s % 5 == 0, F.transform_values("successful_attempts", lambda k, v: F.lit(None).cast("string"))).otherwise(F.col("successful_attempts")),
    })
    return integrity.validate_cursor(bad).select("session_id", "ok_seq", "ok_active", "ok_successful", "valid")


# ---- the fold ----


@query
def classify_event(spark, d):
    return log(spark, d).select("session_id", "seq", "kind", fold.classify_event().alias("action"))


@query
def carry_route(spark, d):
    return fold.carry_route(log(spark, d)).select("session_id", "seq", "route_provider", "route_model")


@query
def call_key(spark, d):
    return calls(spark, d).select(C.call_key().alias("call_key"))


@query
def step_key(spark, d):
    return calls(spark, d).select("session_id", "attempt_id", C.step_key().alias("step_key"))


@query
def same_lifecycle(spark, d):
    s = F.col("session_id").cast("long")
    h = headers(spark, d).withColumn("old_at", F.when(s % 3 == 0, F.col("created_at") + 1).otherwise(F.col("created_at"))).withColumn("old_cwd", F.when(s % 7 != 0, F.col("cwd")))
    return h.select("session_id", C.same_lifecycle(F.col("old_at"), F.col("old_cwd"), F.col("created_at"), F.col("cwd")).alias("same"))


@query
def utc_day(spark, d):
    return log(spark, d).select("session_id", "seq", C.utc_day("event_time").alias("day"))


@query
def zone_day(spark, d):
    return log(spark, d).select("session_id", "seq", C.zone_day("event_time", "America/New_York").alias("new_york"), C.zone_day("event_time", "Pacific/Kiritimati").alias("kiritimati"))


@query
def shift_day(spark, d):
    day = C.utc_day("event_time")
    return log(spark, d).select("session_id", "seq", C.shift_day(day, -29).alias("before"), C.shift_day(day, 365).alias("after"))


@query
def open_attempts(spark, d):
    return calls(spark, d).where(~F.col("attempt_id").startswith("legacy:")).select(*CALL_KEY, "turn", "step", "provider", "model", "started_at")


@query
def close_attempts(spark, d):
    return calls(spark, d).where("outcome is not null").where(~F.col("attempt_id").startswith("legacy:")).select(*CALL_KEY, "outcome")


@query
def active_attempt_at(spark, d):
    return events(spark, d).where("kind in ('chunk', 'message')").select("session_id", "seq", "active")


@query
def successful_attempt_at(spark, d):
    return events(spark, d).where("kind in ('chunk', 'message')").select("session_id", "seq", "successful")


@query
def provisional_usage(spark, d):
    return flat(calls(spark, d)).where("p_input is not null").select(*CALL_KEY, "p_input", "p_output", "p_cache_read", "p_cache_write")


@query
def final_usage(spark, d):
    return flat(calls(spark, d)).where("f_input is not null").select(*CALL_KEY, "f_input", "f_output", "f_cache_read", "f_cache_write")


@query
def legacy_attempts(spark, d):
    return calls(spark, d).where(F.col("attempt_id").startswith("legacy:")).select(*CALL_KEY, "turn", "step", "provider", "model", "started_at", "outcome")


@query
def mark_retries(spark, d):
    return fold.mark_retries(events(spark, d)).select(*CALL_KEY)


@query
def usage_defaults(spark, d):
    return log(spark, d).where("input_tokens is not null").select("session_id", "seq", C.usage().alias("u")).select("session_id", "seq", "u.*")


@query
def effective_usage(spark, d):
    used = C.effective_usage()
    return calls(spark, d).select(*CALL_KEY, *[used[c].alias(c) for c in USAGE])


@query
def build_calls(spark, d):
    return flat(calls(spark, d))


# ---- the snapshot ----


@query
def day_range_filter(spark, d):
    short = resolve_request(days=7, time_zone=REQUEST.time_zone, as_of=REQUEST.as_of)
    return snapshot.day_range_filter(calls(spark, d), short).select(*CALL_KEY, "local_day")


@query
def workspace_filter(spark, d):
    return calls(spark, d).where(snapshot.workspace_filter("/ws/2")).select(*CALL_KEY, "workspace")


@query
def attempt_measures(spark, d):
    return calls(spark, d).select(*CALL_KEY, *C.attempt_measures())


@query
def model_rollup(spark, d):
    return snapshot.model_rollup(calls(spark, d))


@query
def order_models(spark, d):
    rows = snapshot.order_models(models(spark, d))
    return placed(rows, *[F.collate(F.coalesce(c, F.lit("")), "UNICODE") for c in ("workspace", "provider", "model")]).select("place", "workspace", "provider", "model", "requests")


@query
def calendar_spine(spark, d):
    """The spine of the days from the log's last day back."""
    last = log(spark, d).agg(F.max(C.zone_day("event_time", REQUEST.time_zone)).alias("end_day"))
    return panel.bucket_spine(spark, last, REQUEST.days)


@query
def daily_rollup(spark, d):
    return daily(spark, d)


@query
def event_feed(spark, d):
    return snapshot.event_feed(selected(spark, d))


@query
def snapshot_parts(spark, d):
    parts = snapshot.snapshot(spark, calls(spark, d), REQUEST)
    figures = ["requests", "input_tokens", "output_tokens"]
    key = F.when(F.col("part") == "daily", F.col("day")).otherwise(F.concat_ws("|", F.coalesce("workspace", F.lit("-")), "provider", "model"))
    rows = parts["rollups"].select("part", key.alias("key"), *figures)
    total = parts["events"].agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return rows.unionByName(total.select(F.lit("events").alias("part"), F.lit(None).cast("string").alias("key"), *figures))


QUERIES["snapshot"] = QUERIES.pop("snapshot_parts")


# ---- the panel ----


@query
def panel_events(spark, d):
    return panel.panel_events(snapshot.event_feed(selected(spark, d)))


@query
def panel_models(spark, d):
    return panel.panel_models(models(spark, d))


@query
def panel_daily(spark, d):
    return panel.panel_daily(daily(spark, d))


@query
def panel_local_day(spark, d):
    return panel_rows(spark, d).select("at", "local_day")


@query
def filter_provider_model(spark, d):
    return panel.filter_provider_model(panel_rows(spark, d), "p1", "m2").select("at", "provider", "model", "outcome")


@query
def filter_period(spark, d):
    return week(spark, d).select("at", "provider", "model", "local_day")


@query
def infer_end_day(spark, d):
    by_day = panel.infer_end_day(panel_rows(spark, d), panel.panel_daily(daily(spark, d)), REQUEST.through_day)
    return panel.infer_end_day(panel_rows(spark, d)).select(F.col("end_day").alias("from_events"), by_day.scalar().alias("from_daily"))


@query
def model_breakdown(spark, d):
    return panel.model_breakdowns(panel_rows(spark, d, snapshot.feed_rows))


@query
def total_tokens(spark, d):
    return panel.panel_models(models(spark, d)).select("provider", "model", C.total_tokens())


@query
def rank_models(spark, d):
    rows = panel.rank_models(panel.panel_models(models(spark, d)))
    return placed(rows, F.desc("total"), "provider", "model").select("place", "provider", "model", "total")


@query
def provider_options(spark, d):
    return panel.provider_options(panel_rows(spark, d))


@query
def model_options(spark, d):
    return panel.model_options(panel_rows(spark, d), "p1")


@query
def panel_totals(spark, d):
    return panel.panel_totals(week(spark, d))


@query
def buckets_from_events(spark, d):
    return buckets(spark, d)


@query
def write_marts(spark, d):
    """The daily mart, first with the figures of half the calls, then brought up to date by the days that changed."""
    path, chosen = scratch(spark), kept(spark, selected(spark, d))
    spine = snapshot.calendar_spine(spark, REQUEST)
    store.write_marts({"daily": snapshot.daily_rollup(spine, chosen.where("started_at % 2 = 0"))}, path)
    store.write_marts({"daily": kept(spark, store.changed_days(snapshot.daily_rollup(spine, chosen), path))}, path)
    return store.read_daily(spark, path)


@query
def upsert_calls(spark, d):
    """Three batches, the last after a compaction of the others, and another compaction: the latest state of each call."""
    path, now = scratch(spark), kept(spark, calls(spark, d))
    stale = now.withColumn("outcome", F.lit(None).cast("string")).withColumn("last_seq", F.col("last_seq") - 1)
    store.upsert_calls(stale, path, 1)
    store.upsert_calls(now.where("started_at % 3 = 0"), path, 2)
    store.compact_calls(spark, path, 2)
    store.upsert_calls(now.where("started_at % 3 > 0"), path, 3)
    store.compact_calls(spark, path, 3)
    store.sweep_calls(spark, path)
    return flat(store.scan_calls(spark, path))


@query
def buckets_from_daily(spark, d):
    by_day = panel.panel_daily(daily(spark, d))
    return panel.buckets_from_daily(panel.bucket_spine(spark, panel.infer_end_day(by_day, by_day), 7), by_day)


@query
def bucket_share(spark, d):
    return panel.bucket_share(buckets(spark, d))


@query
def request_curve(spark, d):
    return panel.request_curve(buckets(spark, d))


@query
def compact_number(spark, d):
    used = C.effective_usage()["input_tokens"]
    rows = selected(spark, d).where(used.isNotNull())
    return rows.select("session_id", "attempt_id", C.compact_number(used * 37).alias("small"), C.compact_number(F.col("started_at") * used).alias("large"))


@query
def exact_number(spark, d):
    return calls(spark, d).select("session_id", "attempt_id", C.exact_number("started_at").alias("plain"), C.exact_number("started_at", True).alias("grouped"))


@query
def date_label(spark, d):
    return daily(spark, d).select("day", C.date_label("day").alias("label"))


@query
def model_label(spark, d):
    return panel.panel_models(models(spark, d)).select("provider", "model", C.model_label().alias("long"), C.model_label(False).alias("short"))


# ---- integrity ----

_FAULT = ("session_id", "seq", "attempt_id", "turn", "step")


@query
def dup_start(spark, d):
    return integrity.dup_start(log(spark, d, dirty=True)).select(*_FAULT)


@query
def orphan_end(spark, d):
    return integrity.orphan_end(log(spark, d, dirty=True)).select(*_FAULT)


@query
def field_mismatch(spark, d):
    return integrity.field_mismatch(log(spark, d, dirty=True)).select(*_FAULT)


@query
def open_at_end(spark, d):
    return integrity.open_at_end(log(spark, d, dirty=True)).select(*_FAULT)


# ---- streams: the log arrives in three parts, each session's events in order; the stream stops and goes on between ----


def delivered(spark: SparkSession, rows: DataFrame, path: str, parts: int = 3):
    """Appends a log to the folder `path` in `parts` parts, yielding after each. They share every session's seqs evenly."""
    last = F.max("seq").over(W.partitionBy("session_id", "created_at"))
    rows = kept(spark, rows.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("seq") * parts / (last + 1)))))
    for i in range(parts):
        rows.where(F.col("part") == i).drop("part").write.mode("append").parquet(path)
        yield i


@query
def stream_calls(spark, d):
    stream.use_rocksdb(spark)
    source, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for _ in delivered(spark, log(spark, d), source):
        changed = stream.stream_calls(store.stream_log(spark, source), headers(spark, d))
        stream.write_calls(changed, path, checkpoint, availableNow=True).awaitTermination()
    return flat(store.scan_calls(spark, path))


@query
def stream_from_batch(spark, d):
    """A batch folds the first third of every session, a stream that starts from its cursor and calls the rest."""
    stream.use_rocksdb(spark)
    source, path, checkpoint, own, rows = scratch(spark), scratch(spark), scratch(spark), headers(spark, d), kept(spark, log(spark, d))
    early = F.col("seq") < F.floor(F.max("seq").over(W.partitionBy("session_id", "created_at")) / 3)
    rows = kept(spark, rows.withColumn("early", early))
    first = rows.where("early").drop("early")
    store.upsert_calls(fold.build_calls(first, own), path, -1)
    rows.where("not early").drop("early").write.parquet(source)
    changed = stream.stream_calls(store.stream_log(spark, source), own, kept(spark, fold.session_cursor(first, own)), store.scan_calls(spark, path, progress=True))
    stream.write_calls(changed, path, checkpoint, availableNow=True).awaitTermination()
    return flat(store.scan_calls(spark, path))


@query
def stream_cursor(spark, d):
    """The cursor of a stream that has taken the whole log, from its state."""
    stream.use_rocksdb(spark)
    source, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    log(spark, d).write.parquet(source)
    stream.write_calls(stream.stream_calls(store.stream_log(spark, source), headers(spark, d)), path, checkpoint, availableNow=True).awaitTermination()
    return stream.stream_cursor(spark, checkpoint).select("session_id", "created_at", "workspace", "observed_seq", "route_provider", "route_model", as_text("active_attempts"), as_text("successful_attempts"))


@query
def stream_integrity(spark, d):
    stream.use_rocksdb(spark)
    source, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for _ in delivered(spark, log(spark, d, dirty=True), source):
        faults = stream.stream_integrity(store.stream_log(spark, source))
        faults.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.parquet(path).select("session_id", "seq", "attempt_id", "fault")
