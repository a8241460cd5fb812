"""The usage snapshot: selected calls, rollups by model and by day, and the event feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import attempt_measures, effective_usage, shift_day, sums, zone_day
from ..plans.requests import Request
from ..schema import MEASURES, USAGE

_ORDER = ("started_at", "session_id", "created_at", "attempt_id")


def day_range_filter(calls: DataFrame, request: Request) -> DataFrame:
    """calls with local_day, the zone's day of started_at, within the request's days.

    The stored UTC day is at most one day off, so it prunes partitions before the exact test.
    """
    near = calls.where(F.col("day").between(shift_day(F.lit(request.from_day), -1), shift_day(F.lit(request.through_day), 1)))
    return near.withColumn("local_day", zone_day("started_at", request.time_zone)).where(F.col("local_day").between(request.from_day, request.through_day))


def workspace_filter(workspace: str | None) -> Column:
    """No workspace means all; otherwise rows without one never match."""
    return F.lit(True) if workspace is None else F.col("workspace") == workspace


def select_calls(calls: DataFrame, request: Request) -> DataFrame:
    return day_range_filter(calls, request).where(workspace_filter(request.workspace))


def model_rollup(calls: DataFrame) -> DataFrame:
    """The ten measures by workspace (absent is a group of its own), provider and model."""
    keys = ("workspace", "provider", "model")
    return calls.select(*keys, *attempt_measures()).groupBy(*keys).agg(*sums())


def order_models(models: DataFrame) -> DataFrame:
    """In the order of workspace (absent first), provider, model, by the root locale's collation."""
    return models.orderBy(*[F.collate(F.coalesce(c, F.lit("")), "UNICODE") for c in ("workspace", "provider", "model")])


def calendar_spine(spark: SparkSession, request: Request) -> DataFrame:
    """One row for each of the request's days."""
    days = F.sequence(F.lit(request.from_day).cast("date"), F.lit(request.through_day).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days.cast("array<string>")).alias("day"))


def daily_rollup(spine: DataFrame, calls: DataFrame) -> DataFrame:
    """The ten measures for every day of the spine, zeros included; calls have local_day. The spine has 366 rows at
    most, by the request's bound, and so has the grouped side."""
    by_day = calls.select(F.col("local_day").alias("day"), *attempt_measures()).groupBy("day").agg(*sums())
    return spine.join(F.broadcast(by_day), "day", "left").na.fill(0, list(MEASURES))


def feed_rows(calls: DataFrame) -> DataFrame:
    """Calls as events: at, workspace, provider, model, outcome (started where there is none), retried, and the four
    counters, absent where unmetered; in the order of calls."""
    used = effective_usage()
    return calls.select(F.col("started_at").alias("at"), "workspace", "provider", "model", F.coalesce("outcome", F.lit("started")).alias("outcome"), F.col("retry_scheduled").alias("retried"), *[used[c].alias(c) for c in USAGE], *_ORDER[1:])


def event_feed(calls: DataFrame) -> DataFrame:
    """feed_rows ordered by time. Those who only filter or sum events do without the order: to sort them by ranges Spark
    samples the calls first, which folds the log a second time."""
    return feed_rows(calls.orderBy(*_ORDER))


def rollups(spark: SparkSession, calls: DataFrame, request: Request) -> DataFrame:
    """Both rollups of selected calls in one scan and one aggregation, by grouping sets: rows with `part` (models or
    daily), workspace, provider, model, day and the measures. Days without a call come from the spine."""
    keys = [F.col(c) for c in ("workspace", "provider", "model")]
    day = F.col("local_day").alias("day")
    rows = calls.select(*keys, day, *attempt_measures())
    both = rows.groupingSets([keys, [F.col("day")]], *keys, F.col("day")).agg(*sums(), F.grouping("day").alias("by_model"))
    zero = [F.lit(0).cast("long").alias(c) for c in MEASURES]
    none = [F.lit(None).cast("string").alias(c) for c in ("workspace", "provider", "model")]
    spine = calendar_spine(spark, request).select(*none, "day", *zero, F.lit(0).cast("tinyint").alias("by_model"))
    # The spine has a row for each of at most 366 days, so adding it is a second sum over as many rows.
    days = both.unionByName(spine).groupBy("workspace", "provider", "model", "day", "by_model").agg(*sums())
    return days.select(F.when(F.col("by_model") == 1, "models").otherwise("daily").alias("part"), "workspace", "provider", "model", "day", *MEASURES)


def snapshot(spark: SparkSession, calls: DataFrame, request: Request, keep: bool = False) -> dict[str, DataFrame]:
    """params, events, models and daily over one selection, and `rollups`, the last two from one scan (see rollups). With
    `keep`, the selection is cached while the parts are used, and the caller unpersists snapshot()["selected"] afterwards."""
    chosen = select_calls(calls, request)
    chosen = chosen.persist() if keep else chosen
    params = spark.range(1).select(
        F.lit(request.workspace).cast("string").alias("workspace"), F.lit(request.days).cast("long").alias("days"), F.lit(request.from_day).alias("from_day"), F.lit(request.through_day).alias("through_day"),
        F.lit(request.time_zone).alias("time_zone"), F.lit(request.as_of.isoformat()).alias("updated_at"),
    )
    return {"params": params, "selected": chosen, "rollups": rollups(spark, chosen, request), "events": event_feed(chosen), "models": order_models(model_rollup(chosen)), "daily": daily_rollup(calendar_spine(spark, request), chosen).orderBy("day")}
