"""Checks of a log's starts and ends, and of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import OUTCOMES


def attempt_records(log: DataFrame) -> DataFrame:
    """Starts and ends, each with the record of its attempt just before it (was_*). The whole log counts."""
    w = W.partitionBy("session_id", "created_at", "attempt_id").orderBy("seq")
    at = log.where("kind in ('start', 'end')")
    return at.withColumn("was", F.lag(F.struct("kind", "turn", "step", "provider", "model")).over(w)).withColumn("next_kind", F.lead("kind").over(w))


def dup_start(log: DataFrame) -> DataFrame:
    """Starts of an attempt that is open."""
    return attempt_records(log).where("kind = 'start' and was.kind = 'start'")


def orphan_end(log: DataFrame) -> DataFrame:
    """Ends of an attempt that isn't open."""
    return attempt_records(log).where("kind = 'end' and coalesce(was.kind, 'end') = 'end'")


def field_mismatch(log: DataFrame) -> DataFrame:
    """Ends whose turn, step, provider or model isn't their start's."""
    fields = F.struct("turn", "step", "provider", "model")
    was = F.struct("was.turn", "was.step", "was.provider", "was.model")
    return attempt_records(log).where((F.col("kind") == "end") & (F.col("was.kind") == "start") & ~fields.eqNullSafe(was))


def open_at_end(log: DataFrame) -> DataFrame:
    """The starts of attempts that never closed: evidence of a crash, not a fault."""
    return attempt_records(log).where("kind = 'start' and next_kind is null")


def _count(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) >= 0)


def validate_calls(calls: DataFrame) -> DataFrame:
    """calls with one boolean per rule and `valid`, all of them: split on it into valid rows and quarantine."""
    used = [F.col(u).isNull() | ((F.col(f"{u}.input_tokens") >= 0) & (F.col(f"{u}.output_tokens") >= 0) & (F.col(f"{u}.cache_read_tokens") >= 0) & (F.col(f"{u}.cache_write_tokens") >= 0)) for u in ("provisional_usage", "final_usage")]
    rules = {
        "ok_numbers": _count("created_at") & _count("turn") & _count("step") & _count("started_at"),
        "ok_texts": F.col("session_id").isNotNull() & F.col("attempt_id").isNotNull() & F.col("provider").isNotNull() & F.col("model").isNotNull(),
        "ok_day": F.coalesce(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "ok_outcome": F.col("outcome").isNull() | F.col("outcome").isin(*OUTCOMES),
        "ok_usage": F.coalesce(used[0] & used[1], F.lit(False)),
    }
    out = calls.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()])
    return out.withColumn("valid", F.expr(" and ".join(rules)))


def validate_cursor(cursor: DataFrame) -> DataFrame:
    """cursor with one boolean per rule and `valid`. The maps have to lead from a step key to an attempt's id."""
    def ok_map(c: str) -> Column:
        entry = lambda k, v: k.rlike(r"^\d+:\d+$") & v.isNotNull()
        return F.coalesce(F.size(F.map_filter(c, lambda k, v: ~entry(k, v))) == 0, F.lit(False)) & F.col(c).isNotNull()

    rules = {
        "ok_session": F.col("session_id").isNotNull(), "ok_created": _count("created_at"), "ok_seq": F.col("observed_seq") >= -1,
        "ok_active": ok_map("active_attempts"), "ok_successful": ok_map("successful_attempts"),
    }
    out = cursor.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()])
    return out.withColumn("valid", F.expr(" and ".join(rules)))
