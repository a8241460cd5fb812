"""From the log to one row per call: the ordered, stateful fold, as windows and aggregations.

Every state of the fold but the route belongs to one step of one session. Ordinary sessions are partitioned by session
once, so the windows by attempt and by step and the aggregations sort anew but don't shuffle anew. Sessions of very many
events are dealt by ranges of seq for their route, then by attempt, by step and by call, so that no task holds one whole.
A fold can also go on from what a former one left, a cursor and its stored calls: these join the new events as rows of
their own kinds, `known` calls and the `state` of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import step_key, usage, utc_day
from ..schema import CALL_USAGE, CURSOR, STEP, names
from ..sources.store import dealt, scan_calls, upsert_calls
from .intake import good_events

_SESSION = ("session_id", "created_at")
_EFFECTIVE = ("start", "end", "retry", "chunk", "message", "known", "state")
#: What a `known` or `state` row brings along; null on events.
_SEED = f"struct<active:string,successful:string,outcome:string,retried:boolean,provisional:{CALL_USAGE},final:{CALL_USAGE},first_seq:bigint,last_seq:bigint>"
#: Events from which on a session is folded apart from the ordinary ones.
MOST = 1_000_000
#: Seqs of a huge session that one task takes to carry the route.
SPAN = 1 << 18


def classify_event() -> Column:
    """What the fold does with an event of this kind; null for none."""
    k = F.col("kind")
    return (
        F.when(k.isin("header", "context"), "route").when(k == "start", "open").when(k == "end", "close").when(k == "retry", "mark_retry")
        .when((k == "chunk") & F.col("input_tokens").isNotNull(), "provisional_usage").when(k == "message", "message")
    )


def _range(log: DataFrame) -> list[str]:
    return ["range"] if "range" in log.columns else []


def carry_route(log: DataFrame) -> DataFrame:
    """log with route_provider and route_model: the latest route at or before the event, of the whole log.

    Where log has a column `range`, of seqs that lie together, each range is a task of its own, and what the earlier ones
    end with is taken from a table of one row per range.
    """
    key = [*_SESSION, *_range(log)]
    here = F.when(F.col("kind").isin("header", "context"), F.struct("provider", "model"))
    log = log.withColumn("route", F.last(here, ignorenulls=True).over(W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    if "range" in key:
        ends = log.groupBy(*key).agg(F.max_by("route", F.when(F.col("route").isNotNull(), F.col("seq"))).alias("inherited"))
        earlier = W.partitionBy(*_SESSION).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        log = log.join(ends.withColumn("inherited", F.last("inherited", ignorenulls=True).over(earlier)), key, "left")
        log = log.withColumn("route", F.coalesce("route", "inherited")).drop("inherited", "range")
    unknown = F.lit("unknown")
    return log.withColumn("route_provider", F.coalesce("route.provider", unknown)).withColumn("route_model", F.coalesce("route.model", unknown)).drop("route")


def huge_sessions(log: DataFrame, most: int = MOST) -> DataFrame:
    """The sessions of more than `most` events: at most one for every `most` events of the log."""
    return log.groupBy(*_SESSION).agg(F.count(F.lit(1)).alias("events")).where(F.col("events") > most).select(*_SESSION)


def live_events(log: DataFrame, headers: DataFrame, seeds: DataFrame | None = None, huge: bool = False, span: int = SPAN, events: int | None = None) -> DataFrame:
    """The good events a session doesn't inherit, with their route and the session's workspace, and `seed`,
    which is null on them. seeds: rows of what was folded before. huge: sessions are dealt by ranges
    of `span` seqs. events: how many the log has, about; by default they are counted."""
    own, key = headers.select(*_SESSION, F.col("cwd").alias("workspace"), "seed_length"), [*_SESSION]
    rows = good_events(log).withColumn("seed", F.lit(None).cast(_SEED))
    if seeds is not None:
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    if huge:  # headers meet ranges first, so that events meet them range by range
        rows, key = rows.withColumn("range", F.floor(F.col("seq") / span)), [*_SESSION, "range"]
        own = rows.select(*key).distinct().join(own, [*_SESSION], "left")
        return carry_route(rows.join(own, key, "left")).where("seq >= coalesce(seed_length, 0) or seed is not null")
    rows = dealt(rows, (log if seeds is None else rows).count() if events is None else events, *_SESSION)
    return carry_route(rows).join(own, key, "left").where("seq >= coalesce(seed_length, 0) or seed is not null")


def annotate(live: DataFrame) -> DataFrame:
    """live events that matter, with valid_end, active and successful (the step's attempts just before the event), and
    legacy: the id that a message without an attempt of its own gives its step's made-up call."""
    e = live.where(F.col("kind").isin(*_EFFECTIVE))
    kind, attempt = F.col("kind"), F.coalesce("attempt_id", F.concat(F.lit("#"), F.col("seq").cast("string")))
    by_attempt = W.partitionBy(*_SESSION, "attempt_key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*STEP).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("attempt_key", attempt)
    e = e.withColumn("valid_end", (kind == "end") & (F.max(kind.isin("start", "known")).over(by_attempt))).drop("attempt_key")
    e = e.withColumn("won", won()).select("*", F.last(opened(), ignorenulls=True).over(before)["id"].alias("active"), F.last("won", ignorenulls=True).over(before).alias("earlier"))
    # A legacy call is made only where nothing succeeded before, and any success comes after it.
    alone = F.when((kind == "message") & F.col("active").isNull() & F.col("earlier").isNull(), F.col("seq"))
    legacy = F.concat(F.lit("legacy:"), step_key())
    e = e.withColumn("first", F.min(alone).over(before.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("legacy", F.when(F.col("seq") == F.col("first"), legacy)).withColumn("successful", F.coalesce("earlier", F.when(F.col("first") < F.col("seq"), legacy)))
    return e.drop("earlier", "won", "first")


def opened() -> Column:
    """The attempt that is open in a step from an event on, as a struct: null for no change, its id for none."""
    kind, none = F.col("kind"), F.lit(None).cast("string")
    return F.when(kind == "start", F.struct(F.col("attempt_id").alias("id"))).when(F.col("valid_end"), F.struct(none.alias("id"))).when(kind == "state", F.struct(F.col("seed.active").alias("id")))


def won() -> Column:
    """The attempt that succeeds in a step with an event."""
    return F.when(F.col("valid_end") & (F.col("outcome") == "success"), F.col("attempt_id")).when(F.col("kind") == "state", F.col("seed.successful"))


def retry_marks(calls: Column, retries: Column) -> Column:
    """Which of a step's calls its retries mark, as an array of (id, seq of the retry): the general rule.

    calls: array of structs with attempt_id, first (its start: started_at), first_seq, marked and ends (seq, failed), those
    of calls that began in this step, wherever they ended; retries: array of seqs. A retry marks the failed or aborted call
    that started last and isn't marked yet (ties: whose start came last). The ends and retries are replayed once per step.
    """
    call, mark = "struct<at:bigint,seq:bigint,id:string>", "array<struct<id:string,seq:bigint>>"
    ended = F.flatten(F.transform(calls, lambda c: F.transform(c["ends"], lambda x: F.struct(x["seq"].alias("seq"), F.when(x["failed"], "f").otherwise("s").alias("op"), F.struct(c["first"]["started_at"].alias("at"), c["first_seq"].alias("seq"), c["attempt_id"].alias("id")).alias("call")))))
    asked = F.transform(retries, lambda q: F.struct(q.alias("seq"), F.lit("r").alias("op"), F.lit(None).cast(call).alias("call")))
    before = F.transform(F.filter(calls, lambda c: c["marked"]), lambda c: F.struct(c["attempt_id"].alias("id"), F.lit(-1).cast("long").alias("seq")))
    begin = F.struct(F.array().cast(f"array<{call}>").alias("open"), before.cast(mark).alias("marked"))

    def step(s, e):
        others = F.filter(s["open"], lambda c: c["id"] != e["call"]["id"])
        last = F.array_max(s["open"])
        add = F.when(F.exists(s["marked"], lambda m: m["id"] == e["call"]["id"]), s["open"]).otherwise(F.concat(others, F.array(e["call"])))
        retry = (e["op"] == "r") & last.isNotNull()
        open_ = F.when(e["op"] == "f", add).when(e["op"] == "s", others).when(retry, F.filter(s["open"], lambda c: c["id"] != last["id"])).otherwise(s["open"])
        return F.struct(open_.alias("open"), F.when(retry, F.concat(s["marked"], F.array(F.struct(last["id"].alias("id"), e["seq"].alias("seq"))))).otherwise(s["marked"]).alias("marked"))

    return F.aggregate(F.array_sort(F.concat(ended, asked)), begin, step, lambda s: s["marked"])


def mark_retries(events: DataFrame) -> DataFrame:
    """(session_id, created_at, attempt_id) of annotated events' calls marked as retried."""
    return fold_calls(events).where("retry_scheduled").select("session_id", "created_at", "attempt_id")


def _by_call(events: DataFrame) -> DataFrame:
    """One row per call, with all its fields but the mark of a retry, and one per step with retries, whose seqs it has."""
    kind, seed, seq = F.col("kind"), F.col("seed"), F.col("seq")
    known, legacy = kind == "known", F.col("legacy").isNotNull()
    begins, failed = (kind == "start") | known, lambda c: F.coalesce(c.isin("failure", "aborted"), F.lit(False))
    target = F.when(begins | F.col("valid_end"), F.col("attempt_id")).when(kind == "chunk", F.col("active")).when(kind == "message", F.coalesce("legacy", "successful"))
    e = events.withColumn("call", target).withColumn("usage", usage()).withColumn("at", F.when(kind == "retry", F.struct("turn", "step"))).where("call is not null or at is not null")
    first = F.when(begins, F.struct("turn", "step", "provider", "model", "started_at", F.lit(None).cast("string").alias("outcome")))
    made = F.when(legacy, F.struct("turn", "step", F.col("route_provider").alias("provider"), F.col("route_model").alias("model"), F.col("event_time").alias("started_at"), F.lit("success").alias("outcome")))
    ended = F.when(F.col("valid_end"), F.col("outcome")).when(known, seed["outcome"])
    used = lambda k, old: (F.when((kind == k) & F.col("usage").isNotNull(), F.col("usage")).when(known, seed[old]))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), seq))
    end = F.when(F.col("valid_end"), F.struct("seq", failed(F.col("outcome")).alias("failed"))).when(known & seed["outcome"].isNotNull(), F.struct(F.lit(-1).cast("long").alias("seq"), failed(seed["outcome"]).alias("failed")))
    return e.groupBy("session_id", "created_at", "workspace", F.col("call").alias("attempt_id"), "at").agg(
        F.min_by(F.coalesce(first, made), F.when(begins | legacy, seq)).alias("first"),
        F.min(F.when(begins | legacy, seq)).alias("first_seq"),
        last(ended).alias("ended"), last(used("chunk", "provisional")).alias("provisional_usage"), last(used("message", "final")).alias("final_usage"),
        F.max(F.coalesce(seed["last_seq"], seq)).alias("last_seq"), F.max(F.when(seed.isNull(), seq)).alias("changed"),
        F.coalesce(F.max(seed["retried"]), F.lit(False)).alias("marked"),
        F.collect_list(end).alias("ends"), F.collect_list(F.when(kind == "retry", seq)).alias("retries"),
    ).where("first is not null or at is not null")


def fold_calls(events: DataFrame) -> DataFrame:
    """annotated events → one row per call (schema.CALLS), first_seq and last_seq (the events that made it and changed it
    last), and changed, whether an event did so, not only a seed.

    Each event knows the call it changes, so one aggregation by call gives all its fields but the mark of a retry. That is
    a matter of the step it began in: where no call ends twice and failures come in the order of their starts, retries
    close failures as brackets do, so failures and retries of one depth alternate, and a failure that a retry follows is
    marked. Only steps of another kind, with retries, are replayed as a whole.
    """
    units = _by_call(events)
    is_call = F.col("first").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, seq: F.struct(F.lit(kind).alias("kind"), seq.alias("seq"))
    failures = F.transform(F.filter("ends", lambda x: x["failed"] & ~F.col("marked")), lambda x: item("f", x["seq"]))
    items = F.when(is_call, F.concat(F.array(item("c", none("long"))), failures)).otherwise(F.transform("retries", lambda q: item("r", q)))
    payload = F.struct("attempt_id", "first", "first_seq", "ended", "provisional_usage", "final_usage", "last_seq", "changed", "marked", "ends")
    rows = units.select(
        "session_id", "created_at", "workspace", F.coalesce("first.turn", "at.turn").alias("turn"), F.coalesce("first.step", "at.step").alias("step"), "attempt_id",
        F.col("first.started_at").alias("started"), "first_seq", (F.size("ends") > 1).alias("again"), payload.alias("call"), F.explode(items).alias("i"),
    ).select("*", F.col("i.kind").alias("kind"), F.col("i.seq").alias("seq")).drop("i").withColumn("call", F.when(F.col("kind") == "c", F.col("call")))
    kind, step = F.col("kind"), [*STEP[:2], "workspace", *STEP[2:]]
    by_seq = W.partitionBy(*step).orderBy("seq", "started", "first_seq")
    so_far, before, whole = (by_seq.rowsBetween(W.unboundedPreceding, end) for end in (0, -1, W.unboundedFollowing))
    begun, gone = F.struct("started", "first_seq"), F.when(kind == "f", 1).when(kind == "r", -1).otherwise(0)
    rows = rows.select("*", F.sum(gone).over(so_far).alias("run"), F.last(F.when(kind == "f", begun), ignorenulls=True).over(before).alias("earlier"))
    again = F.col("again") | F.coalesce((kind == "f") & (F.col("earlier") > begun), F.lit(False))
    rows = rows.select("*", F.min("run").over(so_far).alias("low"), F.max(again).over(whole).alias("disorder"), F.max(kind == "r").over(whole).alias("retried"))
    depth = F.col("run") - F.least(F.lit(0), "low")
    rows = rows.withColumn("level", F.when(kind == "f", depth).when(kind == "r", depth + 1)).withColumn("odd", F.col("disorder") & F.col("retried"))
    following = F.lead(F.struct("kind", "seq")).over(W.partitionBy(*step, "level").orderBy("seq", "started", "first_seq"))
    rows = rows.withColumn("following", following).withColumn("mark", F.when((kind == "f") & (F.col("following.kind") == "r"), F.col("following.seq")))
    groups = rows.groupBy(*step, F.when(~F.col("odd"), F.col("attempt_id")).alias("one")).agg(
        F.collect_list("call").alias("calls"), F.max("mark").alias("mark"), F.max("odd").alias("odd"), F.collect_list(F.when(F.col("odd") & (kind == "r"), F.col("seq"))).alias("retries"),
    )
    groups = groups.withColumn("marks", F.when(F.col("odd"), retry_marks(F.col("calls"), F.col("retries"))))
    calls = groups.select("session_id", "created_at", "workspace", "mark", "odd", "marks", F.explode("calls").alias("c")).select("session_id", "created_at", "workspace", "mark", "odd", "marks", "c.*")
    replayed = F.get(F.filter("marks", lambda m: (m["id"] == F.col("attempt_id")) & (m["seq"] >= 0)), F.lit(0))["seq"]
    calls = calls.withColumn("mark", F.when(F.col("odd"), replayed).otherwise(F.col("mark")))
    return calls.select(
        "session_id", "created_at", "workspace", utc_day("first.started_at").alias("day"), "attempt_id", "first.turn", "first.step", "first.provider", "first.model", "first.started_at",
        F.coalesce("ended", "first.outcome").alias("outcome"), (F.col("marked") | F.col("mark").isNotNull()).alias("retry_scheduled"), "provisional_usage", "final_usage",
        "first_seq", F.greatest("last_seq", "mark").alias("last_seq"), (F.col("changed").isNotNull() | F.col("mark").isNotNull()).alias("changed"),
    )


def build_calls(log: DataFrame, headers: DataFrame, most: int | None = None, span: int = SPAN, events: int | None = None) -> DataFrame:
    """The calls of a log (schema.CALLS, first_seq and last_seq): a function of the log alone, whatever was stored before.
    Events that the fold can't take (see intake) are left out.

    most: sessions of more events are dealt to many tasks, by `span` seqs, by steps and by calls, apart from the others.
    Whether there are any is counted first; where there is none, all goes the ordinary way. events: how many the log has,
    about; by default they are counted.
    """
    def fold(rows: DataFrame, huge: bool) -> DataFrame:
        return fold_calls(annotate(live_events(rows, headers, huge=huge, span=span, events=events))).drop("changed")

    huge = None if most is None else huge_sessions(log, most)
    if huge is None or huge.isEmpty():
        return fold(log, False)
    ordinary, large = (log.join(F.broadcast(huge), [*_SESSION], how) for how in ("left_anti", "left_semi"))
    return fold(ordinary, False).unionByName(fold(large, True))


def _cursor(live: DataFrame) -> DataFrame:
    """schema.CURSOR of live events with seeds, one row per session with an event."""
    key = ["session_id", "created_at", "workspace"]
    e = annotate(live).withColumn("opened", opened()).withColumn("won", F.coalesce(won(), F.col("legacy")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    steps = e.groupBy(*key, "turn", "step").agg(last("opened")["id"].alias("active"), last("won").alias("successful"))

    def as_map(c: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(step_key(), F.col(c))))).alias(f"{c}_attempts")

    maps = steps.groupBy(*key).agg(as_map("active"), as_map("successful"))
    seen = live.where("seed is null").groupBy(*key).agg(F.max("seq").alias("observed_seq"), F.max_by(F.struct("route_provider", "route_model"), "seq").alias("route"))
    same = (seen["session_id"] == maps["session_id"]) & (seen["created_at"] == maps["created_at"]) & seen["workspace"].eqNullSafe(maps["workspace"])
    out = seen.join(maps, same, "left")
    empty = F.create_map().cast("map<string,string>")
    return out.select(*[seen[c] for c in key], "observed_seq", "route.route_provider", "route.route_model", F.coalesce("active_attempts", empty).alias("active_attempts"), F.coalesce("successful_attempts", empty).alias("successful_attempts"))


def session_cursor(log: DataFrame, headers: DataFrame, events: int | None = None) -> DataFrame:
    """schema.CURSOR: per session with a live event observed_seq, the route there, and maps from step key to its open and
    to its successful attempt. events: as in build_calls."""
    return _cursor(live_events(log, headers, events=events))


def same_life(cursor: DataFrame, headers: DataFrame) -> DataFrame:
    """The cursors that belong to the life of their session that headers tell of: equal creation and workspace."""
    own = headers.select(*_SESSION, F.col("cwd").alias("own"))
    return cursor.join(own, [*_SESSION]).where(F.col("workspace").eqNullSafe(F.col("own"))).select(*cursor.columns)


def state_rows(cursor: DataFrame) -> DataFrame:
    """(session_id, created_at, observed_seq, turn, step, active, successful) of every step in a cursor's maps."""
    at = F.explode(F.array_distinct(F.concat(F.map_keys("active_attempts"), F.map_keys("successful_attempts"))))
    s = cursor.select("*", at.alias("at"))
    place = F.split("at", ":")
    return s.select(*_SESSION, "observed_seq", place[0].cast("long").alias("turn"), place[1].cast("long").alias("step"), F.col("active_attempts")[F.col("at")].alias("active"), F.col("successful_attempts")[F.col("at")].alias("successful"))


def seed_rows(cursor: DataFrame, calls: DataFrame) -> DataFrame:
    """What a cursor and the stored calls (with first_seq and last_seq) of its sessions bring to a fold that goes on: the
    route as a context, calls as `known`, steps as `state`, none of them beyond observed_seq."""
    def seed(**given):
        kinds = dict(f.split(":", 1) for f in _SEED.replace(CALL_USAGE, "USAGE")[7:-1].split(","))
        return F.struct(*[given.get(k, F.lit(None)).cast(CALL_USAGE if t == "USAGE" else t).alias(k) for k, t in kinds.items()]).alias("seed")

    route = cursor.select(*_SESSION, F.col("observed_seq").alias("seq"), F.lit("context").alias("kind"), F.col("route_provider").alias("provider"), F.col("route_model").alias("model"), seed())
    known = calls.select(*_SESSION, F.col("first_seq").alias("seq"), F.lit("known").alias("kind"), "turn", "step", "attempt_id", "provider", "model", "started_at", seed(
        outcome=F.col("outcome"), retried=F.col("retry_scheduled"), provisional=F.col("provisional_usage"), final=F.col("final_usage"), first_seq=F.col("first_seq"), last_seq=F.col("last_seq")))
    steps = state_rows(cursor).select(*_SESSION, F.col("observed_seq").alias("seq"), F.lit("state").alias("kind"), "turn", "step", seed(active=F.col("active"), successful=F.col("successful")))
    return route.unionByName(known, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)


def new_events(log: DataFrame, headers: DataFrame, cursor: DataFrame) -> DataFrame:
    """The events beyond the cursor of their session's life; all of those of sessions without one."""
    seen = same_life(cursor, headers).select(*_SESSION, "observed_seq")
    return log.join(seen, [*_SESSION], "left").where("seq > coalesce(observed_seq, -1)").drop("observed_seq")


def resume(log: DataFrame, headers: DataFrame, cursor: DataFrame, calls: DataFrame, most: int | None = None, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(changed calls, new cursor) of a log from where a cursor stopped. Only events beyond the cursor are read; what came
    before is in the cursor and in the stored calls (schema.CALLS, first_seq, last_seq). most: where a session has more
    new events than that, all are dealt by `span` seqs, by steps and by calls."""
    new = new_events(log, headers, cursor)
    touched = good_events(new).select(*_SESSION).distinct()
    at = same_life(cursor, headers).join(touched, [*_SESSION], "left_semi")
    seeds = seed_rows(at, calls.join(at.select(*_SESSION), [*_SESSION], "left_semi"))
    huge = most is not None and not huge_sessions(new, most).isEmpty()
    live = live_events(new, headers, seeds, huge, span)
    now = _cursor(live)
    others = cursor.join(now.select("session_id"), "session_id", "left_anti")
    return fold_calls(annotate(live)).where("changed").drop("changed"), others.select(*names(CURSOR)).unionByName(now)


def replay_from_cursor(spark: SparkSession, log: DataFrame, headers: DataFrame, cursor: DataFrame, path: str, batch: int) -> DataFrame:
    """Brings the calls store at `path` up to date with log as its batch number `batch`, and returns the new cursor. An
    empty cursor folds everything; a batch that is folded again replaces itself."""
    changed, now = resume(log, headers, cursor, scan_calls(spark, path, before=batch, progress=True), MOST)
    upsert_calls(changed, path, batch)
    return now


def drop_disposed(cursor: DataFrame, disposed: DataFrame) -> DataFrame:
    """Cursors without those of disposed sessions (session_id, created_at, workspace) of the same life."""
    same = (cursor["session_id"] == disposed["session_id"]) & (cursor["created_at"] == disposed["created_at"]) & cursor["workspace"].eqNullSafe(disposed["workspace"])
    return cursor.join(disposed, same, "left_anti")
