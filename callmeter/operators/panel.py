"""Report queries over a snapshot's parts: filters, breakdowns, buckets and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import shift_day, sums, total_tokens, zone_day

#: The figures of a report row.
FIGURES = ("requests", "input", "output", "cached", "cache_hit", "unmetered", "failed", "retried")


def panel_events(feed: DataFrame) -> DataFrame:
    """The event feed in the report's terms; metered where any counter is present."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counters = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    metered = F.coalesce(*[F.col(c) for c in counters]).isNotNull()
    return feed.select(
        "at", "provider", "model", "outcome", "retried", n(F.col("input_tokens")).alias("input"), n(F.col("output_tokens")).alias("output"),
        (n(F.col("cache_read_tokens")) + n(F.col("cache_write_tokens"))).alias("cached"), n(F.col("cache_read_tokens")).alias("cache_hit"), metered.alias("metered"),
    )


def _renamed() -> list[Column]:
    return [
        F.col("requests"), F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), (F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("cached"), F.col("cache_read_tokens").alias("cache_hit"),
        F.col("unmetered_requests").alias("unmetered"), F.col("failed_requests").alias("failed"), F.col("retry_requests").alias("retried"),
    ]


def panel_models(models: DataFrame) -> DataFrame:
    """Model rows in the report's terms, workspaces merged."""
    return models.select("provider", "model", *_renamed()).groupBy("provider", "model").agg(*sums(FIGURES))


def panel_daily(daily: DataFrame) -> DataFrame:
    return daily.select("day", *_renamed())


def panel_local_day(zone: str) -> Column:
    """The zone's day of `at`, null where that isn't positive."""
    return F.when(F.col("at") > 0, zone_day("at", zone))


def filter_provider_model(events: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    events = events if provider is None else events.where(F.col("provider") == provider)
    return events if model is None else events.where(F.col("model") == model)


def infer_end_day(events: DataFrame, daily: DataFrame | None = None, today: str | None = None) -> DataFrame:
    """One row, end_day: the latest day of events (local_day), or of non-empty daily rows, else today."""
    days = events.select(F.col("local_day").alias("day")) if daily is None else daily.where("requests > 0").select("day")
    return days.agg(F.coalesce(F.max("day"), F.lit(today)).alias("end_day"))


def filter_period(events: DataFrame, days: int, end: DataFrame) -> DataFrame:
    """events (local_day) of the `days` (7 or 30) days up to end's end_day; end is one row."""
    last = end.scalar()
    return events.where(F.col("local_day").between(shift_day(last, 1 - days), last))


def figures() -> list[Column]:
    """The sums of events' figures."""
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("requests"), *sums(("input", "output", "cached", "cache_hit")), flag(~F.col("metered")).alias("unmetered"),
        flag(F.col("outcome").isin("failure", "aborted")).alias("failed"), flag(F.col("retried")).alias("retried"),
    ]


def model_breakdown(events: DataFrame, show_provider: bool) -> DataFrame:
    """Figures by model, or by provider and model; without it provider is ''."""
    if show_provider:
        return events.groupBy("provider", "model").agg(*figures())
    return events.groupBy("model").agg(*figures()).select(F.lit("").alias("provider"), "model", *FIGURES)


def model_breakdowns(events: DataFrame) -> DataFrame:
    """Both breakdowns from one pass: figures by model, with provider '', and by provider and model."""
    sets = events.groupingSets([["model"], ["provider", "model"]], "provider", "model").agg(F.grouping("provider").alias("merged"), *figures())
    return sets.select(F.when(F.col("merged") == 1, F.lit("")).otherwise(F.col("provider")).alias("provider"), "model", *FIGURES)


def rank_models(rows: DataFrame) -> DataFrame:
    """Rows by total tokens, most first; ties by provider and model."""
    return rows.withColumn("total", total_tokens()).orderBy(F.desc("total"), "provider", "model")


def provider_options(events: DataFrame) -> DataFrame:
    return events.select("provider").distinct().orderBy("provider")


def model_options(events: DataFrame, provider: str | None = None) -> DataFrame:
    return filter_provider_model(events, provider).select("model").distinct().orderBy("model")


def panel_totals(events: DataFrame) -> DataFrame:
    """One row of grand totals; zeros where there are no events."""
    return events.agg(*figures())


def bucket_spine(spark: SparkSession, end: DataFrame, days: int) -> DataFrame:
    """The `days` days up to end's end_day."""
    last = F.col("end_day").cast("date")
    return end.select(F.explode(F.sequence(F.date_add(last, 1 - days), last, F.expr("interval 1 day")).cast("array<string>")).alias("day"))


def buckets_from_events(spine: DataFrame, events: DataFrame) -> DataFrame:
    """Figures of events (local_day) for every day of the spine. Both sides have a row per day of it at most."""
    grouped = events.join(F.broadcast(spine.withColumnRenamed("day", "local_day")), "local_day").groupBy(F.col("local_day").alias("day")).agg(*figures())
    return spine.join(grouped, "day", "left").na.fill(0, list(FIGURES))


def buckets_from_daily(spine: DataFrame, daily: DataFrame) -> DataFrame:
    """The same from report rows by day, where no provider or model is chosen."""
    return spine.join(daily, "day", "left").na.fill(0, list(FIGURES))


def bucket_share(buckets: DataFrame) -> DataFrame:
    """buckets with input, output and cached as percentages of the largest bucket's total (1 at least). Buckets
    number 30 at most."""
    top = F.greatest(F.lit(1), F.max(F.col("input") + F.col("output") + F.col("cached")).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return buckets.select("day", *[(F.lit(100.0) * F.col(c) / top).alias(f"{c}_share") for c in ("input", "output", "cached")])


def request_curve(buckets: DataFrame) -> DataFrame:
    """Points of the request curve: x from 0 to 100 (50 for a single bucket), y from 36 down to 6. Buckets number 30 at
    most, so windows over all of them are small."""
    all_ = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    i, n = F.row_number().over(W.orderBy("day")) - 1, F.count(F.lit(1)).over(all_)
    return buckets.select("day", F.when(n == 1, 50.0).otherwise(100.0 * i / F.greatest(F.lit(1), n - 1)).alias("x"), (36.0 - 30.0 * F.col("requests") / F.greatest(F.lit(1), F.max("requests").over(all_))).alias("y"))
