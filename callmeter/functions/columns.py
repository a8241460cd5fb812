"""Column expressions: keys, days, usage, measures, labels and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MEASURES, USAGE

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# How JSON writes the characters that have a short escape.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(c: str | Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for x in map(chr, range(32)):
        out = F.replace(out, F.lit(x), F.lit(_SHORT.get(x, f"\\u{ord(x):04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def call_key() -> Column:
    """A call's key as JSON text, for export; inside, the three columns are the key."""
    return F.concat(F.lit("["), json_text("session_id"), F.lit(","), F.col("created_at").cast("string"), F.lit(","), json_text("attempt_id"), F.lit("]"))


def step_key() -> Column:
    return F.concat_ws(":", F.col("turn").cast("string"), F.col("step").cast("string"))


def same_lifecycle(created_at: Column, workspace: Column, other_created_at: Column, other_workspace: Column) -> Column:
    """Whether a stored cursor belongs to the same life of a session: equal creation and workspace, absent being equal."""
    return (created_at == other_created_at) & workspace.eqNullSafe(other_workspace)


def instant(ms: str | Column) -> Column:
    """An epoch-millisecond instant as a UTC timestamp without zone; independent of the session's zone."""
    return F.timestamp_add("MILLISECOND", _col(ms), F.expr(EPOCH))


def utc_day(ms: str | Column) -> Column:
    return instant(ms).cast("date").cast("string")


def zone_day(ms: str | Column, zone: str | Column) -> Column:
    """The calendar day of an instant in an IANA zone, as yyyy-MM-dd."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, instant(ms)).cast("date").cast("string")


def shift_day(day: str | Column, days: int | Column) -> Column:
    """Calendar arithmetic on a yyyy-MM-dd text."""
    return F.date_add(_col(day).cast("date"), days).cast("string")


def usage() -> Column:
    """The event's usage with cache counters defaulting to 0; null where the event has none."""
    return F.when(F.col("input_tokens").isNotNull(), F.struct("input_tokens", "output_tokens", F.coalesce("cache_read_tokens", F.lit(0).cast("long")).alias("cache_read_tokens"), F.coalesce("cache_write_tokens", F.lit(0).cast("long")).alias("cache_write_tokens")))


def effective_usage() -> Column:
    """The final usage, or the provisional one: whole, never mixed."""
    return F.coalesce("final_usage", "provisional_usage")


def attempt_measures() -> list[Column]:
    """The ten measures of one call. A call that only started is neither a success nor a failure."""
    used = effective_usage()
    tokens = [F.coalesce(used[c], F.lit(0).cast("long")).alias(c) for c in USAGE]
    flags = {
        "requests": F.lit(True), "successful_requests": F.col("outcome") == "success", "failed_requests": F.col("outcome").isin("failure", "aborted"),
        "retry_requests": F.col("retry_scheduled"), "metered_requests": used.isNotNull(), "unmetered_requests": used.isNull(),
    }
    return tokens + [F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(k) for k, c in flags.items()]


def sums(columns=MEASURES) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns]


def total_tokens() -> Column:
    return (F.col("input") + F.col("output") + F.col("cached")).alias("total")


def exact_number(x: str | Column, grouped: bool = False) -> Column:
    return F.format_number(_col(x), 0) if grouped else _col(x).cast("string")


def compact_number(x: str | Column) -> Column:
    """999, 1.24K, 10K, 999.99K, 1M: at most two decimals, half up, the unit after rounding; no grouping."""
    x = _col(x).cast("decimal(38,0)")

    def unit(k: int, u: str) -> Column:
        m, half = (F.lit(v).cast("decimal(20,0)") for v in (1000**k, 1000**k // 2))
        n = x * 100 + half
        hundredths = ((n - n % m) / m).cast("decimal(32,0)")  # quotients of decimals are rounded themselves, but whole ones are exact
        return F.concat(F.regexp_replace((hundredths / 100).cast("decimal(38,2)").cast("string"), r"\.?0+$", ""), F.lit(u))

    return F.when(x < 1000, x.cast("string")).when(x < 999_995, unit(1, "K")).when(x < 999_995_000, unit(2, "M")).when(x < 999_995_000_000, unit(3, "B")).otherwise(unit(4, "T"))


def date_label(day: str | Column) -> Column:
    return F.date_format(_col(day).cast("date"), "MMM d")


def model_label(show_provider: bool = True) -> Column:
    return F.when((F.col("provider") != "") & F.lit(show_provider), F.concat_ws(" / ", "provider", "model")).otherwise(F.col("model"))
