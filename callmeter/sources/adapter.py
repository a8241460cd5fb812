"""A session log derived from the events table: the input of all queries here.

Every event of a user becomes a few log events of that user's session, in one of six shapes; see SHAPES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dealt

#: The log events, with an end's outcome, that an event of each type stands for. Sign-ups have two shapes, by parity of k.
SHAPES = {
    "error": [("start", None), ("end", "failure"), ("retry", None)],
    "view": [("start", None), ("chunk", None), ("end", "aborted")],
    "click": [("start", None), ("chunk", None), ("chunk", None), ("end", "success"), ("message", None)],
    "purchase": [("context", None), ("message", None)],
    "signup0": [("header", None), ("start", None)],
    "signup1": [("start", None), ("message", None), ("end", "success")],
}


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows with k, v and ms (floored)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("value") * 10).cast("long").alias("v"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000").alias("ms"),
    )


def log_size(spark: SparkSession, sf_dir: str) -> int:
    """About how many events the log has, three for each of the table's, which its files' footers count."""
    return 3 * spark.read.parquet(f"{sf_dir}/events.parquet").count()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's events with the place in the session: turn, step and creation."""
    e, user = dealt(table_events(spark, sf_dir), log_size(spark, sf_dir), "user_id"), W.partitionBy("user_id")
    before = user.orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.count_if(F.col("event_type") != "error").over(before), F.lit(0))
    return e.select("*", F.floor(n / 8).cast("long").alias("turn"), (n % 8).alias("step"), F.min("ms").over(user).alias("created_at"))


def session_log(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The log (schema.LOG). dirty: some starts are missing or doubled and some ends name another model, for checks."""
    e = events(spark, sf_dir)
    shape = F.when(F.col("event_type") == "signup", F.concat(F.lit("signup"), (F.col("k") % 2).cast("string"))).otherwise(F.col("event_type"))
    steps = F.create_map(*[x for name, rows in SHAPES.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(o).cast("string").alias("outcome")) for k, o in rows]))])
    rows = e.select("*", F.posexplode(steps[shape]).alias("i", "s")).select("*", "s.kind", "s.outcome").where((F.col("kind") != "retry") | (F.col("k") % 5 != 0))
    session = W.partitionBy("user_id").orderBy("ms", "event_id", "i")
    copies = 1
    model = F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))
    if dirty:
        start = F.col("kind") == "start"
        rows = rows.where(~(start & (F.col("event_id") % 50 == 0)))
        copies = F.when(start & (F.col("event_id") % 51 == 0), 2).otherwise(1)
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        session = W.partitionBy("user_id").orderBy("ms", "event_id", "i", "copy")
        model = F.when((F.col("kind") == "end") & (F.col("event_id") % 53 == 0), "mx").otherwise(model)
    placed = F.col("kind").isin("start", "end", "retry", "chunk", "message")
    routed = F.col("kind").isin("start", "end", "header", "context")
    attempt = F.col("kind").isin("start", "end")
    used = (F.col("kind") == "chunk") | ((F.col("kind") == "message") & (F.col("k") % 7 != 0))
    return rows.select(
        F.col("user_id").cast("string").alias("session_id"), "created_at", (F.row_number().over(session) - 1).cast("long").alias("seq"), (F.col("ms") + F.col("i")).alias("event_time"), "kind",
        F.when(placed, F.col("turn")).alias("turn"), F.when(placed, F.col("step")).alias("step"), F.when(attempt, F.concat(F.lit("a"), F.col("event_id").cast("string"))).alias("attempt_id"), "outcome",
        F.when(routed, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("provider"), F.when(routed, model).alias("model"), F.when(attempt, F.col("ms")).alias("started_at"),
        F.when(used, F.col("v") + F.col("i")).alias("input_tokens"), F.when(used, 3 * F.col("k")).alias("output_tokens"),
        F.when(used & (F.col("k") % 2 == 0), 5 * F.col("k")).alias("cache_read_tokens"), F.when(used & (F.col("k") % 3 == 0), F.col("k")).alias("cache_write_tokens"),
    )


def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session (schema.HEADERS)."""
    u = F.col("user_id")
    return table_events(spark, sf_dir).groupBy("user_id").agg(F.min("ms").alias("created_at")).select(
        u.cast("string").alias("session_id"), "created_at", F.when(u % 4 != 0, F.concat(F.lit("/ws/"), (u % 4).cast("string"))).alias("cwd"), F.when(u % 10 == 0, F.lit(6)).cast("long").alias("seed_length")
    )
