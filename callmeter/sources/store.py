"""Reading logs, and storing calls and marts, on plain Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CALL_KEY, CALLS, LOG, MEASURES, PROGRESS, names

#: Log events that one task takes, about: some 300 MB in the sorts of the fold.
SHARE = 1 << 18


def dealt(rows: DataFrame, events: int, *key: str) -> DataFrame:
    """rows dealt by key to as many tasks as `events` log events take, SHARE each. Few events are left to Spark: it joins
    small shuffle partitions by their compressed size, and a log's hold too many rows for that."""
    spark = rows.sparkSession
    least, tasks = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events // SHARE)
    return rows if tasks <= min(least, spark.sparkContext.defaultParallelism) else rows.repartition(max(tasks, least), *key)


def _json_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").schema(f"{LOG}, corrupt string").json(path)


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored log with the declared schema. Files that can't be read are skipped; broken JSON lines and lines without a
    session are left out, see broken_lines."""
    if fmt == "json":
        return _json_log(spark, path).where("corrupt is null and session_id is not null").drop("corrupt")
    return spark.read.option("ignoreCorruptFiles", "true").schema(LOG).format(fmt).load(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) for every line of a JSON log that read_log leaves out; line is null where it is valid JSON without a
    session."""
    rows = _json_log(spark, path).where("corrupt is not null or session_id is null")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("corrupt").alias("line"), "session_id").drop("session_id")


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The log as a stream of the files that arrive in a folder: sessions' events and, of kind `disposed`, their ends."""
    return spark.readStream.schema(LOG).options(**options).format(fmt).load(path)


def merge_live_cold(cold: DataFrame, live: DataFrame) -> DataFrame:
    """A session known live wins over its stored copy."""
    return cold.join(live.select("session_id").distinct(), "session_id", "left_anti").unionByName(live)


def drop_fork_prefix(log: DataFrame, headers: DataFrame) -> DataFrame:
    """Without the events that a forked session inherited."""
    seeds = headers.select("session_id", "created_at", "seed_length")
    return log.join(seeds, ["session_id", "created_at"], "left").where("seq >= coalesce(seed_length, 0)").drop("seed_length")


def upsert_calls(calls: DataFrame, path: str, batch: int) -> None:
    """Appends changed calls (with first_seq and last_seq) as one batch; writing a batch again replaces it and changes
    nothing else."""
    calls.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch}")


_STORED = f"{CALLS}, {PROGRESS}, batch_id bigint"


def _fs(spark: SparkSession, path: str):
    """(file system, function from text to path) of a store, by Hadoop's own interface."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def generation(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(number, last batch compacted) of a store's current generation, or None before its first compaction. It is in the
    name of an empty file, `path.compacted/current/NUMBER-BATCH`, of which the greatest number counts."""
    fs, hadoop = _fs(spark, path)
    folder = hadoop(f"{path}.compacted/current")
    found = [tuple(map(int, f.getPath().getName().rsplit("-", 1))) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max(found, default=None)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.option("basePath", path).schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def all_calls(spark: SparkSession, path: str) -> DataFrame:
    """Every stored state of every call: of the current generation, and of the batches after it."""
    now = generation(spark, path)
    rows = _read(spark, path)
    if now is None:
        return rows
    number, last = now
    return _read(spark, f"{path}.compacted/{number}").unionByName(rows.where(F.col("batch_id") > last))


def scan_calls(spark: SparkSession, path: str, before: int | None = None, progress: bool = False) -> DataFrame:
    """The latest state of every call (schema.CALLS; with `progress`, first_seq and last_seq as well). before: of the
    batches with smaller numbers only. A store that isn't there yet has no calls."""
    rows = all_calls(spark, path)
    last = latest_calls(rows if before is None else rows.where(F.col("batch_id") < before))
    return last if progress else last.drop(*names(PROGRESS))


def latest_calls(rows: DataFrame) -> DataFrame:
    """Of each call key the row with the last last_seq, or batch_id. A call's day never changes, so it is a key as well:
    filters on it reach the scan and prune its partitions. The aggregation sorts, so many rows are first dealt by key,
    SHARE to a task (files' footers count them); few are reduced where they are."""
    key = (*CALL_KEY, "day")
    kept = [c for c in rows.columns if c not in (*key, "batch_id")]
    tasks = -(-rows.count() // SHARE)
    if tasks > rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, *key)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct("last_seq", "batch_id")).alias("r"))
    return last.select(*key, "r.*").select(*[c for c in rows.columns if c != "batch_id"])


def compact_calls(spark: SparkSession, path: str, through: int) -> int:
    """Makes a new generation of a store from its batches up to number `through`, one row per call, and returns its
    number. Batches after it stay what they are and may go on arriving.

    The generation is written beside the current one. What makes it current is one empty file, renamed into place, so a
    reader sees the old state or the new one, and a compaction that fails halfway has changed nothing. Days that no batch
    touched since the last generation are taken over as they are, without being aggregated anew. sweep_calls removes what
    readers no longer need.
    """
    now = generation(spark, path)
    number = 1 if now is None else now[0] + 1
    fs, hadoop = _fs(spark, path)
    target = f"{path}.compacted/{number}"
    rows = all_calls(spark, path).where(F.col("batch_id") <= through)
    if now is not None:
        old = _read(spark, f"{path}.compacted/{now[0]}")
        # Days are few and rows of one are many: broadcast, or a shuffle by day would make a day one task's.
        touched = F.broadcast(rows.where(F.col("batch_id") > now[1]).select("day").distinct())
        kept = old.join(touched, "day", "left_anti")
        kept.drop("batch_id").write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch_id={now[1]}")
        rows = rows.join(touched, "day", "left_semi")
    latest_calls(rows).write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch_id={through}")
    fs.mkdirs(hadoop(f"{path}.compacted/current"))
    made = hadoop(f"{target}/_made")
    fs.create(made, True).close()
    if not fs.rename(made, hadoop(f"{path}.compacted/current/{number}-{through}")):
        raise OSError(f"generation {number} couldn't be made current")
    return number


def sweep_calls(spark: SparkSession, path: str) -> None:
    """Removes batches that the current generation holds, and former generations. For when no reader that began before
    the last compaction is still at work."""
    now = generation(spark, path)
    if now is None:
        return
    fs, hadoop = _fs(spark, path)
    for f in fs.listStatus(hadoop(path)):
        kind, _, value = f.getPath().getName().partition("=")
        if kind == "batch_id" and int(value) <= now[1]:
            fs.delete(f.getPath(), True)
    for folder in ("", "/current"):
        for f in fs.listStatus(hadoop(f"{path}.compacted{folder}")):
            number = f.getPath().getName().split("-")[0]
            if number.isdigit() and int(number) < now[0]:
                fs.delete(f.getPath(), True)


def write_marts(parts: dict[str, DataFrame], path: str) -> None:
    """Publishes a snapshot's parts, each in its folder. Daily rows replace the days they are of and leave all others."""
    for name, df in parts.items():
        if name == "daily":
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def changed_days(daily: DataFrame, path: str) -> DataFrame:
    """The daily rows that a mart at `path` hasn't yet, or has with other figures: what write_marts has to write."""
    spark = daily.sparkSession
    figures = [c for c in daily.columns if c != "day"]
    fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop(f"{path}/daily")):
        return daily
    old = read_daily(spark, path).select("day", F.xxhash64(*figures).alias("old"))
    return daily.join(old, "day", "left").where(~F.xxhash64(*figures).eqNullSafe(F.col("old"))).drop("old")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The daily rows of a mart: what panel.panel_daily and panel.buckets_from_daily take."""
    return spark.read.schema("day string, " + ", ".join(f"{c} bigint" for c in MEASURES)).parquet(f"{path}/daily")
