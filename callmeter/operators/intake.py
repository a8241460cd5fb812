"""What the fold can take: one classification of log events for batch and stream, good ones apart from bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG, OUTCOMES, USAGE

_PLACED = ("start", "end", "retry", "chunk", "message")


def _rules() -> list[tuple[str, Column]]:
    """(reason, condition) for everything that makes an event one that no call could be stored from."""
    kind, metered = F.col("kind"), F.col("kind").isin("chunk", "message") & F.col("input_tokens").isNotNull()
    found = [(f"without {c}", F.col(c).isNull()) for c in ("session_id", "created_at", "seq", "kind")]
    found += [(f"negative {c}", F.col(c) < 0) for c in ("created_at", "seq")]

    def of(kinds: Column, needed: tuple[str, ...], counts: tuple[str, ...]) -> None:
        found.extend((f"without {c}", kinds & F.col(c).isNull()) for c in (*needed, *counts))
        found.extend((f"negative {c}", kinds & (F.col(c) < 0)) for c in counts)

    of(kind.isin(*_PLACED), (), ("turn", "step"))
    of(kind.isin("start", "end"), ("attempt_id",), ())
    of(kind.isin("start", "header", "context"), ("provider", "model"), ())
    of(kind == "start", (), ("started_at",))
    of(kind == "message", (), ("event_time",))
    of(kind == "end", ("outcome",), ())
    found.append(("unknown outcome", (kind == "end") & ~F.col("outcome").isin(*OUTCOMES)))
    of(metered, ("output_tokens",), ())
    found += [(f"negative {c}", metered & (F.col(c) < 0)) for c in USAGE]
    return found


def fault_reason() -> Column:
    """Why the fold can't take an event: all reasons, joined by commas; null where it can."""
    return F.nullif(F.concat_ws(", ", *[F.when(bad, reason) for reason, bad in _rules()]), F.lit(""))


def is_good() -> Column:
    """Whether the fold can take an event; the same rules as fault_reason, without the texts."""
    bad = F.lit(False)
    for _, b in _rules():
        bad = bad | F.coalesce(b, F.lit(False))
    return ~bad


def judged(log: DataFrame) -> DataFrame:
    """log with `reason`."""
    return log.withColumn("reason", fault_reason())


def good_events(log: DataFrame) -> DataFrame:
    return log.where(is_good())


def bad_events(log: DataFrame) -> DataFrame:
    """What is left out of the fold, with the reason."""
    return judged(log).where("reason is not null")


def split_log(spark: SparkSession, log: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(good events, bad events with their reason), from one pass over log: it is stored at `path`, the two apart, so each
    is read without the other. One bad event costs nothing but itself."""
    judged(log).withColumn("quarantined", F.col("reason").isNotNull()).write.partitionBy("quarantined").parquet(path)
    rows = spark.read.schema(f"{LOG}, reason string, quarantined boolean").parquet(path)
    return rows.where("not quarantined").drop("reason", "quarantined"), rows.where("quarantined").drop("quarantined")
