"""The fold and the integrity check as events arrive: one keyed state per session, changed rows out."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.columns import utc_day
from ..operators.fold import same_life, state_rows
from ..operators.intake import fault_reason, good_events
from ..operators.snapshot import snapshot
from ..plans.requests import Request
from ..schema import CALLS, CURSOR, LOG, PROGRESS, USAGE, names
from ..sources.store import scan_calls, upsert_calls

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What Python and Spark hand each other has few columns, as each costs a conversion per row: events and calls are JSON.
_OUT = "session_id string, created_at bigint, workspace string, call string, dropped bigint, bad string"
_CALL = (
    "attempt_id string, turn bigint, step bigint, provider string, model string, started_at bigint, outcome string, retry_scheduled boolean, "
    "provisional array<bigint>, final array<bigint>, first_seq bigint, last_seq bigint"
)
_FAULTS = "session_id string, created_at bigint, seq bigint, attempt_id string, fault string"
_SESSION_STATE = "seen bigint, provider string, model string, workspace string, live boolean"
#: What a turn's state holds, as JSON: by step the open and the successful attempt, by id the calls that began in the turn.
_TURN = (
    "open map<string,string>, won map<string,string>, calls map<string,struct<step:bigint,provider:string,model:string,at:bigint,outcome:string,retried:boolean,"
    "prov:array<bigint>,fin:array<bigint>,first:bigint,seq:bigint>>"
)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Event(dict):
    """An event by its fields, of which JSON leaves out those that are null."""

    def __missing__(self, field: str) -> None:
        return None


def _used(e: Event) -> list | None:
    return None if e["input_tokens"] is None else [e[c] or 0 for c in USAGE]


class Homes:
    """The turn in which each of a session's attempts began, in buckets by a hash of the attempt's id: each is read at most
    once in a batch, and written once if it changed. There are 2^depth of them, `most` ids in each at most, or about, and
    bucket 0 knows the depth. Every access to state is a message to Spark, so one for each attempt would take longer than
    the fold. fresh: the session has no state yet."""

    def __init__(self, state, fresh: bool, most: int = 512):
        self._state, self._fresh, self._most, self._held, self._changed = state, fresh, most, {}, set()

    def _bucket(self, n: int) -> list:
        if n not in self._held:
            found = None if self._fresh else self._state.getValue((n,))
            self._held[n] = [0, {}] if found is None else json.loads(found[0])
        return self._held[n]

    def _of(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << self._bucket(0)[0]) - 1)

    def get(self, name: str) -> int | None:
        return self._bucket(self._of(name))[1].get(name)

    def put(self, name: str, turn: int) -> None:
        n = self._of(name)
        self._bucket(n)[1][name] = turn
        self._changed.add(n)
        if len(self._bucket(0)[1]) > self._most:
            self._split()

    def _split(self) -> None:
        depth = self._bucket(0)[0] + 1
        ids = [x for n in range(1 << depth - 1) for x in self._bucket(n)[1].items()]
        self._held = {n: [0, {}] for n in range(1 << depth)}
        self._held[0][0], self._changed = depth, set(self._held)
        for name, turn in ids:
            self._held[self._of(name)][1][name] = turn

    def write(self) -> None:
        for n in self._changed:
            self._state.updateValue((n,), (json.dumps(self._held[n]),))


class Turns:
    """A session's turns as a batch uses them: each is read at most once, and written once if it changed. fresh: the session
    has no state yet."""

    def __init__(self, turns, homes, fresh: bool):
        self._turns, self._homes, self._fresh, self._held, self._changed = turns, Homes(homes, fresh), fresh, {}, set()

    def __getitem__(self, turn: int) -> dict:
        if turn not in self._held:
            found = None if self._fresh else self._turns.getValue((turn,))
            self._held[turn] = {"open": {}, "won": {}, "calls": {}} if found is None else json.loads(found[0])
        return self._held[turn]

    def change(self, turn: int) -> dict:
        self._changed.add(turn)
        return self[turn]

    def home(self, name: str, turn: int) -> int | None:
        """The turn in which an attempt began: as a rule the given one."""
        return turn if name in self[turn]["calls"] else self._homes.get(name)

    def begin(self, name: str, turn: int, call: dict) -> None:
        self.change(turn)["calls"][name] = call
        self._homes.put(name, turn)

    def write(self) -> None:
        for turn in self._changed:
            self._turns.updateValue((turn,), (json.dumps(self._held[turn]),))
        self._homes.write()


class CallFold(StatefulProcessor):
    """Applies a session's events in order of seq, once each, and puts out the calls that a batch changed, one row without
    a call for the number of events that came too late, and bad events as they came.

    State: the last seq applied, the route and the workspace; by turn, its steps' open and successful attempts and the
    calls that began in it; by attempt, that turn (see Homes). A batch reads and writes the turns that its events name. The state begins with what was folded before, if that is given, and grows with the session until
    a `disposed` event of the same workspace clears it, or `idle` milliseconds pass without an event; the calls that were
    put out stay. Events of another workspace begin a new life. An event at or below the last seq is not applied again; a
    gap is passed over.
    """

    def __init__(self, idle: int | None = None):
        self._idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._session = handle.getValueState("session", _SESSION_STATE)
        self._turns = handle.getMapState("turns", "turn bigint", "json string")
        self._homes = handle.getMapState("homes", "bucket bigint", "json string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["turn"] is None:
            self._session.update(tuple(initialState[c] for c in names(_SESSION_STATE)))
        else:
            self._turns.updateValue((initialState["turn"],), (initialState["json"],))
            homes = Homes(self._homes, False)
            for name in json.loads(initialState["json"])["calls"]:
                homes.put(name, initialState["turn"])
            homes.write()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        blank = dict.fromkeys(names(_OUT)) | {"session_id": key[0], "created_at": key[1]}
        if key[0] is None:  # bad events, dealt by a hash; they have no state
            yield from (Row(**blank | {"created_at": None, "bad": e["event"]}) for e in rows)
            return
        held = self._session.get()
        seen, provider, model, life, live = held or (-1, "unknown", "unknown", None, None)
        turns, route, changed, dropped, cleared = Turns(self._turns, self._homes, held is None), [provider, model], {}, 0, live is None
        for e in sorted((Event(json.loads(r["event"])) for r in rows), key=lambda e: e["seq"]):
            seq, same = e["seq"], live is None or e["workspace"] == life
            if e["kind"] == "disposed" and not same:
                continue
            if not same:  # another life of the session
                self._clear()
                seen, route, live, turns = -1, ["unknown", "unknown"], False, Turns(self._turns, self._homes, True)
            if seq <= seen:
                dropped += 1
                continue
            seen, life, cleared, live = seq, e["workspace"], False, bool(live)
            if e["kind"] == "disposed":
                self._clear()
                seen, route, live, turns, cleared = -1, ["unknown", "unknown"], None, Turns(self._turns, self._homes, True), True
                continue
            if e["kind"] in ("header", "context"):
                route = [e["provider"], e["model"]]
            if seq >= (e["seed_length"] or 0):
                live = True
                if found := self._apply(turns, route, e):
                    turn, name = found
                    c = turns.change(turn)["calls"][name]
                    c["seq"] = seq
                    changed[name] = turn, c, life
        for name, (turn, c, workspace) in changed.items():
            yield Row(**blank | {"workspace": workspace, "call": json.dumps({
                "attempt_id": name, "turn": turn, "step": c["step"], "provider": c["provider"], "model": c["model"], "started_at": c["at"], "outcome": c["outcome"],
                "retry_scheduled": c["retried"], "provisional": c["prov"], "final": c["fin"], "first_seq": c["first"], "last_seq": c["seq"],
            })})
        if dropped:
            yield Row(**blank | {"workspace": life, "call": json.dumps({"last_seq": seen}), "dropped": dropped})
        if not cleared:
            self._session.update((seen, *route, life, live))
            turns.write()
            if self._idle is not None:
                for t in list(self._handle.listTimers()):
                    self._handle.deleteTimer(t)
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._clear()
        return iter([])

    def _clear(self) -> None:
        for state in (self._session, self._turns, self._homes):
            state.clear()

    @staticmethod
    def _apply(turns: Turns, route: list, e: Event) -> tuple[int, str] | None:
        """The call that an event changes, as its turn and id, if any."""
        kind, turn, step = e["kind"], e["turn"], str(e["step"])
        if kind not in ("start", "end", "chunk", "message", "retry"):
            return None
        here = turns[turn]

        def begin(name: str, provider: str, model: str, at: int, outcome: str | None) -> None:
            turns.begin(name, turn, {"step": e["step"], "provider": provider, "model": model, "at": at, "outcome": outcome, "retried": False, "prov": None, "fin": None, "first": e["seq"], "seq": e["seq"]})

        def call(name: str) -> tuple[int, dict]:
            home = turns.home(name, turn)
            return home, turns[home]["calls"][name]

        if kind == "start":
            name = e["attempt_id"]
            turns.change(turn)["open"][step] = name
            if (home := turns.home(name, turn)) is not None:
                return home, name
            begin(name, e["provider"], e["model"], e["started_at"], None)
            return turn, name
        if kind == "end":
            home = turns.home(name := e["attempt_id"], turn)
            if home is None:
                return None
            turns[home]["calls"][name]["outcome"] = e["outcome"]
            turns.change(turn)["open"].pop(step, None)
            if e["outcome"] == "success":
                here["won"][step] = name
            return home, name
        if kind == "chunk" and (used := _used(e)) and (name := here["open"].get(step)) is not None:
            home, c = call(name)
            c["prov"] = used
            return home, name
        if kind == "message":
            name, used = here["won"].get(step), _used(e)
            if name is None and step not in here["open"]:
                turns.change(turn)["won"][step] = name = f"legacy:{turn}:{step}"
                begin(name, *route, e["event_time"], "success")
            elif name is None or used is None:
                return None
            home, c = call(name)
            c["fin"] = used or c["fin"]
            return home, name
        if kind == "retry":
            failed = [(c["at"], c["first"], n) for n, c in here["calls"].items() if c["step"] == e["step"] and c["outcome"] in ("failure", "aborted") and not c["retried"]]
            if failed:
                here["calls"][name := max(failed)[2]]["retried"] = True
                return turn, name
        return None

    def close(self) -> None:
        pass


def _initial(headers: DataFrame, cursor: DataFrame, calls: DataFrame) -> DataFrame:
    """What CallFold starts from: of each session one row for its cursor, and one per turn with its state as JSON."""
    cursor = same_life(cursor, headers)
    key = ["session_id", "created_at"]
    first = cursor.select(*key, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("json"), F.col("observed_seq").alias("seen"), F.col("route_provider").alias("provider"), F.col("route_model").alias("model"), "workspace", F.lit(True).alias("live"))
    used = lambda u: F.when(F.col(u).isNotNull(), F.array(*[F.col(f"{u}.{c}") for c in USAGE]))
    c = F.struct("step", "provider", "model", F.col("started_at").alias("at"), "outcome", F.col("retry_scheduled").alias("retried"), used("provisional_usage").alias("prov"), used("final_usage").alias("fin"), F.col("first_seq").alias("first"), F.col("last_seq").alias("seq"))
    known = calls.join(cursor.select(*key), key, "left_semi").select(*key, "turn", F.struct("attempt_id", c.alias("c")).alias("call"))
    at = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.col("step").cast("string").alias("k"), F.col(name).alias("v")))
    steps = state_rows(cursor).select(*key, "turn", at("active").alias("open"), at("successful").alias("won"))
    as_map = lambda name: F.map_from_entries(F.collect_list(name)).alias({"call": "calls"}.get(name, name))
    turns = known.unionByName(steps, allowMissingColumns=True).groupBy(*key, "turn").agg(as_map("open"), as_map("won"), as_map("call"))
    text = F.to_json(F.struct("open", "won", "calls"), {"ignoreNullFields": "false"})
    return first.unionByName(turns.select(*key, "turn", text.alias("json")), allowMissingColumns=True)


def stream_calls(log: DataFrame, headers: DataFrame, cursor: DataFrame | None = None, calls: DataFrame | None = None, disposals: DataFrame | None = None, idle: int | None = None) -> DataFrame:
    """Changed calls (schema.CALLS, first_seq, last_seq) of a streaming log, see write_calls. Rows without an attempt_id
    count, in `dropped`, a session's events that came too late, or hold, in `bad`, an event that the fold can't take, as
    JSON with the reason: good and bad come from one pass.

    headers is a static table, joined by session. cursor and calls (schema.CURSOR; schema.CALLS, first_seq, last_seq): what
    a batch fold left, from which the stream goes on. disposals: a stream of (session_id, created_at, workspace, seq) of
    sessions that ended, beside `disposed` events in the log. idle: milliseconds of processing time without an event after
    which a session's state goes.
    """
    own = headers.select("session_id", "created_at", F.col("cwd").alias("workspace"), "seed_length")
    columns = names(LOG)
    reason = fault_reason()
    rows = log.select(*columns, reason.alias("reason"))
    ok = F.col("reason").isNull()
    spread = F.pmod(F.xxhash64(*columns), F.lit(256)).cast("long")
    rows = rows.withColumn("bad", F.when(~ok, F.to_json(F.struct(*columns, "reason"))))
    rows = rows.withColumn("session_id", F.when(ok, F.col("session_id"))).withColumn("created_at", F.when(ok, F.col("created_at")).otherwise(spread)).drop("reason")
    rows = rows.join(own, ["session_id", "created_at"], "left")
    if disposals is not None:
        rows = rows.unionByName(disposals.select("session_id", "created_at", "workspace", "seq", F.lit("disposed").alias("kind")), allowMissingColumns=True)
    rows = rows.select("session_id", "created_at", F.coalesce("bad", F.to_json(F.struct(*columns[2:], "workspace", "seed_length"))).alias("event"))
    seeds = None if cursor is None else _initial(headers, cursor, calls).groupBy("session_id", "created_at")
    out = rows.groupBy("session_id", "created_at").transformWithState(CallFold(idle), _OUT, "Update", "None" if idle is None else "ProcessingTime", seeds)

    def used(c: str):
        return F.when(F.col(c).isNotNull(), F.struct(*[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(USAGE)]))

    out = out.withColumn("c", F.from_json("call", _CALL)).select("session_id", "created_at", "workspace", "c.*", "dropped", "bad")
    full = out.withColumn("day", utc_day("started_at")).withColumn("provisional_usage", used("provisional")).withColumn("final_usage", used("final"))
    return full.select(*names(CALLS), *names(PROGRESS), "dropped", "bad")


def write_calls(calls: DataFrame, path: str, checkpoint: str, late: str | None = None, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Upserts a stream of changed calls into a store; a repeated batch replaces itself. With `late`, the numbers of events
    that came too late go there, by batch (session_id, created_at, dropped); with `quarantine`, the events that the fold
    couldn't take, with the reason."""
    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        upsert_calls(batch.where("attempt_id is not null").drop("dropped", "bad"), path, number)
        if late:
            batch.where("dropped > 0").select("session_id", "created_at", "dropped").write.mode("overwrite").parquet(f"{late}/batch_id={number}")
        if quarantine:
            batch.where("bad is not null").select(F.from_json("bad", f"{LOG}, reason string").alias("e")).select("e.*").write.mode("overwrite").parquet(f"{quarantine}/batch_id={number}")
        batch.unpersist()

    return calls.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**trigger).start()


def stream_cursor(spark: SparkSession, checkpoint: str) -> DataFrame:
    """schema.CURSOR as the stream with that checkpoint left it after its last batch, read from its state: what a flush or
    a close would save, and what a later batch or stream can go on from."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    key = [F.col("key.session_id").alias("session_id"), F.col("key.created_at").alias("created_at")]
    seen = state("session").select(*key, "value.*").where("live")
    turns = state("turns").select(*key, F.col("user_map_key.turn").alias("turn"), F.from_json("user_map_value.json", _TURN).alias("t"))

    def entries(name: str):
        return F.transform(F.map_entries(f"t.{name}"), lambda e: F.struct(F.concat_ws(":", F.col("turn").cast("string"), e["key"]).alias("k"), e["value"].alias("v")))

    maps = turns.groupBy("session_id", "created_at").agg(*[F.map_from_entries(F.flatten(F.collect_list(entries(name)))).alias(f"{name}s") for name in ("open", "won")])
    empty = F.create_map().cast("map<string,string>")
    out = seen.join(maps, ["session_id", "created_at"], "left").select(
        "session_id", "created_at", "workspace", F.col("seen").alias("observed_seq"), F.col("provider").alias("route_provider"), F.col("model").alias("route_model"),
        F.coalesce("opens", empty).alias("active_attempts"), F.coalesce("wons", empty).alias("successful_attempts"),
    )
    return out.select(*names(CURSOR))


def snapshot_after_drain(spark: SparkSession, running: StreamingQuery, path: str, request: Request, keep: bool = False) -> dict[str, DataFrame]:
    """A snapshot of the calls store once all that has arrived is in it."""
    running.processAllAvailable()
    return snapshot(spark, scan_calls(spark, path), request, keep)


class Integrity(StatefulProcessor):
    """Checks starts and ends as they arrive; the state maps an open attempt to its start's fields. It begins with the
    attempts that the past left open, if they are given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getMapState("open", "attempt_id string", "fields string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        e = initialState
        self._open.updateValue((e["attempt_id"],), (json.dumps([e["turn"], e["step"], e["provider"], e["model"]]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for e in sorted((r for r in rows if r["kind"] in ("start", "end")), key=lambda r: r["seq"]):
            name, fields = (e["attempt_id"],), json.dumps([e["turn"], e["step"], e["provider"], e["model"]])
            known = self._open.getValue(name)[0] if self._open.containsKey(name) else None
            fault = None
            if e["kind"] == "start":
                fault = "dup_start" if known is not None else None
                self._open.updateValue(name, (fields,))
            elif known is None:
                fault = "orphan_end"
            else:
                fault = "field_mismatch" if known != fields else None
                self._open.removeKey(name)
            if fault:
                yield Row(session_id=key[0], created_at=key[1], seq=e["seq"], attempt_id=e["attempt_id"], fault=fault)

    def close(self) -> None:
        pass


def stream_integrity(log: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """(session_id, created_at, seq, attempt_id, fault) of a streaming log, without the events that have no place in it (see
    intake). opened: the starts that the log before it left open (integrity.open_at_end)."""
    seeds = None if opened is None else opened.select("session_id", "created_at", "attempt_id", "turn", "step", "provider", "model").groupBy("session_id", "created_at")
    return good_events(log).groupBy("session_id", "created_at").transformWithState(Integrity(), _FAULTS, "Append", "None", seeds)
