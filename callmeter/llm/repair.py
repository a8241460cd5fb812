"""Repair of the structure of conversations: cheapest edits by dynamic programming, ties by prefix doubling (operator 12).

A repaired conversation is an optional system message and then pairs of a user's and an assistant's. A node of the search
is a place between rows and one of four states: nothing said yet, after the system, after the user, after the assistant.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, with_row

#: Rows and characters of text in a piece of a conversation, at most (a piece has one row at least).
ROWS, CHARS = 4096, 4 << 20
#: Nodes that are searched together.
CELLS = 1 << 16
FAR = 1 << 40
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: The edits' initials in ASCII order; 0 ends an audit.
INITIALS = np.frombuffer(b"\0DIKR", np.uint8)
ROLE = {2: "user", 3: "assistant"}
#: By state: where the next of user and assistant leads, and where each initial (s, u, a, other) does, 4 being nowhere.
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
#: Cost of what a conversation's end still lacks, by state.
END = np.array([0, 2 * INSERT, INSERT, 0])

_SPACE = r"\x20\x09-\x0D"
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv_id long, part long, place long, role string, text string"
_PIECE = "piece long, codes binary, matrix array<long>, entry int, exits array<int>, audits array<string>, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"
_ALL = f"{AUDIT}, {_PIECE}"


# ---- one group of conversations, or of pieces, at a time ----


def costs(codes: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Cost from each node to the end. codes: (n, length), a row's initial + 4 * fault, conversations aligned at their
    ends; exits: (n, 4), costs beyond the last row. → (length + 1, n, 4)."""
    n, length = codes.shape
    d = np.full((length + 1, n, 5), FAR, np.int64)
    d[length, :, :4] = exits
    each = np.arange(n)[:, None]
    for at in range(length - 1, -1, -1):
        initial, fault = codes[:, at] & 3, codes[:, at] >> 2
        after, late, gone = d[at + 1], (fault == 1)[:, None] * CUT_OFF, np.where(fault >= 2, FAR, 0)[:, None]
        base = np.minimum(after[:, :4] + DELETE, np.minimum(after[each, KEEP[:, initial].T], after[:, NEXT] + REROLE) + late + gone)
        d[at, :, 2] = np.minimum(base[:, 2], base[:, 3] + INSERT)
        d[at, :, 3] = np.minimum(base[:, 3], base[:, 2] + INSERT)
        d[at, :, 0] = np.minimum(base[:, 0], d[at, :, 2] + INSERT)
        d[at, :, 1] = np.minimum(base[:, 1], d[at, :, 2] + INSERT)
        np.minimum(d[at], FAR, out=d[at])
    return d


def least_audits(codes: np.ndarray, exits: np.ndarray, starts: np.ndarray, last: bool) -> tuple[list[str], np.ndarray]:
    """The ASCII-least of the cheapest audits from given starts (row, place, state) and the state each ends in.

    Every node's optimal arcs are ranked by their initial; no two share one, since a state allows one next role, so the
    least arc is a pointer. Pointers and ranks are then doubled: a node's rank by its next 2^k initials and that of the
    node its pointer leads to give the rank by 2^(k+1). When all starts have come to an end, equal ranks are equal
    audits, and each distinct one is read off once, by following the doubled pointers. last: the end of a piece is that
    of its conversation, where what is lacking is still inserted.
    """
    d = costs(codes, exits)
    length, n = d.shape[0] - 1, d.shape[1]
    here, after = d[:-1, :, :4], d[1:]
    initial, fault = codes.T & 3, codes.T >> 2
    late = np.where(fault >= 2, FAR, (fault == 1) * CUT_OFF)[:, :, None]
    kept = KEEP.T[initial]
    layer = (np.arange(length + 1)[:, None] * n + np.arange(n))[:, :, None] * 4
    options = [  # in the order of their initials: whether optimal, and where to
        (here == after[:, :, :4] + DELETE, layer[1:] + np.arange(4)),
        (here == here[:, :, NEXT] + INSERT, layer[:-1] + NEXT),
        (here == np.take_along_axis(after, kept, 2) + late, layer[1:] + kept),
        (np.ones_like(here, bool), layer[1:] + NEXT),
    ]
    rank = np.zeros((length + 1, n, 4), np.int64)
    to = np.broadcast_to(layer + np.arange(4), rank.shape).copy()
    for k in range(len(options), 0, -1):
        best, where = options[k - 1]
        rank[:-1][best] = k
        to[:-1][best] = np.broadcast_to(where, best.shape)[best]
    if last:
        lacks = END > 0
        rank[length][:, lacks] = 2
        to[length] = np.where(lacks, layer[length] + NEXT, to[length])
    rank, pointer = rank.reshape(-1), to.reshape(-1)
    first, begin = rank, (starts[:, 1] * n + starts[:, 0]) * 4 + starts[:, 2]
    doubled = []
    while first[pointer[begin]].any():
        doubled.append(pointer)
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
    _, one, same = np.unique(rank[begin], return_index=True, return_inverse=True)
    path = begin[one][None]
    for step in doubled:
        path = np.concatenate([path, step[path]])
    audits = [row.tobytes().rstrip(b"\0").decode() for row in INITIALS[first[path]].T]
    return [audits[i] for i in same], pointer[begin] & 3


def grouped(codes: np.ndarray, sizes: np.ndarray):
    """(members, codes aligned at their ends, their lengths) of conversations laid one after the other, those of like
    length together, CELLS at most in a group or one alone."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    order, i = np.argsort(sizes, kind="stable")[::-1], 0
    while i < len(order):
        length = int(sizes[order[i]])
        who = order[i : i + max(1, CELLS // max(length, 1))]
        i += len(who)
        block = np.full((len(who), length), 8, np.int64)
        column = np.arange(length) - (length - sizes[who])[:, None]
        block[column >= 0] = codes[(at[who][:, None] + column)[column >= 0]]
        yield who, block, sizes[who]


def audits_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least audit of each whole conversation, and its cost."""
    texts, cost = [""] * len(sizes), np.zeros(len(sizes), np.int64)
    for who, block, length in grouped(codes, sizes):
        n, width = block.shape
        exits = np.broadcast_to(END, (n, 4))
        cost[who] = costs(block, exits)[width - length, np.arange(n), 0]
        found, _ = least_audits(block, exits, np.stack([np.arange(n), width - length, np.zeros(n, np.int64)], 1), True)
        for i, text in zip(who, found):
            texts[i] = text
    return texts, cost


def matrix(codes: np.ndarray) -> np.ndarray:
    """Costs through a piece, from each state before it to each after it."""
    d = costs(np.repeat(codes[None], 4, 0), np.where(np.eye(4, dtype=bool), 0, FAR))
    return d[0, :, :4].T


def edited(audit: str, state: int, codes, roles, texts):
    """(role, text) of what an audit makes of rows."""
    i = 0
    for edit in audit:
        if edit == "K":
            state = KEEP[state, codes[i] & 3]
            yield roles[i], texts[i]
        elif edit != "D":
            state = NEXT[state]
            yield ROLE[int(state)], texts[i] if edit == "R" else ""
        i += edit != "I"


# ---- conversations in a sorted partition ----


def starts_of(conv: pa.Array) -> np.ndarray:
    """Whether each row is the first of its conversation."""
    null, ids = conv.is_null().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return new


class Rows:
    """Sorted rows of whole conversations or of a piece of one, as arrays; dropped rows only say that there is one."""

    def __init__(self, batch: pa.RecordBatch):
        conv, turn, code = (batch.column(i) for i in range(3))
        new = starts_of(conv)
        self.conv = conv.filter(pa.array(new))
        kept = code.is_valid().to_numpy(zero_copy_only=False)
        self.of = (np.cumsum(new) - 1)[kept]
        self.codes = code.fill_null(0).to_numpy()[kept].astype(np.int64)
        self.null, self.turn = turn.is_null().to_numpy(zero_copy_only=False)[kept], turn.fill_null(0).to_numpy()[kept]
        self.roles, self.texts = (batch.column(i).filter(pa.array(kept)) for i in (3, 4))
        self.n = len(self.conv)
        self.sizes = np.bincount(self.of, minlength=self.n)
        self.faults = {name: np.bincount(self.of[self.codes >> 2 == k], minlength=self.n) for k, name in ((1, "truncated"), (2, "duplicate"), (3, "blank"))}
        self.illegal = np.bincount(self.of[1:][(self.of[1:] == self.of[:-1]) & ~legal(self.codes[:-1], self.codes[1:])], minlength=self.n)

    def turns(self) -> list[tuple]:
        """(first, last, number of distinct) turns of each conversation, nulls aside."""
        of, turn = self.of[~self.null], self.turn[~self.null]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (turn[1:] != turn[:-1])
        low, high, count = [None] * self.n, [None] * self.n, np.bincount(of[fresh], minlength=self.n)
        for i, t in zip(of[fresh].tolist(), turn[fresh].tolist()):
            low[i], high[i] = (t if low[i] is None else low[i]), t
        return list(zip(low, high, count.tolist()))


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initials follow one another as su, ua or au."""
    a, b = a & 3, b & 3
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def gaps(low, high, count: int) -> int:
    return 0 if low is None else min(high - low + 1 - count, (1 << 63) - 1)


def table_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def whole(rows: Rows, messages: bool) -> pa.RecordBatch:
    """Repairs whole conversations. messages: keep what was made of them instead of its hash."""
    audits, cost = audits_of(rows.codes, rows.sizes)
    roles, texts, codes, out, at = rows.roles.to_pylist(), rows.texts.to_pylist(), rows.codes.tolist(), [], 0
    for i, (conv, turns, size) in enumerate(zip(rows.conv.to_pylist(), rows.turns(), rows.sizes.tolist())):
        to = at + size
        made = list(edited(audits[i], 0, codes[at:to], roles[at:to], texts[at:to]))
        row = {"conv_id": conv, "gaps": gaps(*turns), "illegal": int(rows.illegal[i]), "cost": int(cost[i]), "audit": audits[i]} | {k: int(v[i]) for k, v in rows.faults.items()}
        row["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode("utf-8", "surrogatepass")).hexdigest()
        if messages:
            row |= {"roles": [r for r, _ in made], "texts": [t for _, t in made]}
        out.append(row)
        at = to
    return table_of(out, arrow(_ALL))


def piece(rows: Rows, number: int) -> pa.RecordBatch:
    """A piece of one conversation, with the costs through it."""
    low, high, count = rows.turns()[0]
    return table_of([{
        "conv_id": rows.conv.to_pylist()[0], "illegal": int(rows.illegal[0]), **{k: int(v[0]) for k, v in rows.faults.items()}, "piece": number, "codes": rows.codes.astype(np.uint8).tobytes(),
        "matrix": matrix(rows.codes).reshape(-1).tolist(), "first_turn": low, "last_turn": high, "turns": count, "roles": rows.roles.to_pylist(), "texts": rows.texts.to_pylist(),
    }], arrow(_ALL))


def in_order(batches, messages: bool, most: int = ROWS):
    """Sorted batches (conv_id, turn, code, role, text) of a partition → repaired conversations, and pieces of those that
    reach over the partition's edges or have more than `most` rows."""
    number, open_, before = TaskContext.get().partitionId() << 32, None, True

    def cut(rows: pa.RecordBatch):
        """The rows of one conversation as pieces."""
        nonlocal number
        sizes, i = np.cumsum(rows.column(5).to_numpy()), 0
        while i < len(rows):
            j = max(i + 1, min(i + most, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHARS, "right"))))
            yield piece(Rows(rows.slice(i, j - i)), number)
            number, i = number + 1, j

    for batch in batches:
        rows = batch if open_ is None else pa.concat_batches([open_, batch])
        edges = np.flatnonzero(starts_of(rows.column(0)))
        if before and len(edges) > 1:  # the first conversation may have begun in the partition before
            yield from cut(rows.slice(0, edges[1]))
            rows, edges, before = rows.slice(edges[1]), edges[1:] - edges[1], False
        if len(edges) > 1:
            yield whole(Rows(rows.slice(0, edges[-1])), messages)
        open_ = rows.slice(edges[-1])
        if len(open_) > most or open_.nbytes > CHARS:
            yield from cut(open_)
            open_, before = None, True
    if open_ is not None:
        yield from cut(open_)


# ---- conversations in pieces ----


def from_the_end(batches):
    """Pieces (conv_id, piece, matrix), of each conversation from the last to the first → piece and the costs beyond it."""
    conv, beyond, seen = None, END, False
    for batch in batches:
        out = []
        for c, number, through in zip(*(batch.column(i).to_pylist() for i in range(3))):
            last = not seen or c != conv
            conv, seen, beyond = c, True, END if last else beyond
            out.append((number, beyond.tolist(), last))
            beyond = (np.array(through).reshape(4, 4) + beyond).min(1)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.bool_()))], ["piece", "beyond", "last"])


def by_entry(batches):
    """Pieces with the costs beyond them → with the least audit and the state after it, for each state before it."""
    for batch in batches:
        last, beyond = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("last", "beyond"))
        audits, exits, cost = [], [], []
        for raw, end, out in zip(batch.column(batch.schema.get_field_index("codes")).to_pylist(), last, beyond):
            codes, exit_ = np.frombuffer(raw, np.uint8).astype(np.int64)[None], np.array([out])
            a, s = least_audits(codes, exit_, np.stack([np.zeros(4, np.int64), np.zeros(4, np.int64), np.arange(4)], 1), end)
            audits.append(a)
            exits.append(s.tolist())
            cost.append(int(costs(codes, exit_)[0, 0, 0]))
        made = {"audits": pa.array(audits, pa.list_(pa.string())), "exits": pa.array(exits, pa.list_(pa.int32())), "cost": pa.array(cost, pa.int64())}
        yield pa.record_batch([made.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c not in ("last", "beyond")], [c for c in batch.schema.names if c not in ("last", "beyond")])


def from_the_start(batches, messages: bool):
    """Pieces of each conversation in order → the conversation's row or, for messages, one row per piece. What is held is
    the audit and a running hash."""
    schema, held = arrow(_ALL), None
    names = [c.split()[0] for c in _ALL.split(", ")]

    def done(h):
        return {"conv_id": h["conv_id"], "gaps": gaps(h["low"], h["high"], h["turns"]), "cost": h["cost"], "audit": "".join(h["audit"]), "repaired_sha256": h["sha"].hexdigest()} | {c: h[c] for c in ("blank", "duplicate", "truncated", "illegal")}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held is None or held["conv_id"] != r["conv_id"]:
                if held is not None and not messages:
                    out.append(done(held))
                held = {"conv_id": r["conv_id"], "state": 0, "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "lines": 0, "low": None, "high": None, "turns": 0, "code": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            h = held
            for c in ("blank", "duplicate", "truncated", "illegal"):
                h[c] += r[c]
            if r["turns"]:
                h["turns"] += r["turns"] - (r["first_turn"] == h["high"])
                h["low"], h["high"] = r["first_turn"] if h["low"] is None else h["low"], r["last_turn"]
            codes = r["codes"]
            if codes:
                if h["code"] is not None:
                    h["illegal"] += not legal(np.int64(h["code"]), np.int64(codes[0]))
                h["code"] = codes[-1]
            audit, made = r["audits"][h["state"]], []
            for role, text in edited(audit, h["state"], codes, r["roles"], r["texts"]):
                h["sha"].update((("\n" if h["lines"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                h["lines"] += 1
                made.append((role, text))
            h["audit"].append(audit)
            h["state"] = r["exits"][h["state"]]
            if messages:
                out.append({"conv_id": r["conv_id"], "piece": r["piece"], "roles": [m[0] for m in made], "texts": [m[1] for m in made]})
        if out:
            yield table_of([dict.fromkeys(names) | row for row in out], schema)
    if held is not None and not messages:
        yield table_of([dict.fromkeys(names) | done(held)], schema)


# ---- as Spark jobs ----


def faults(rows: DataFrame, ties: list[str]) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped and the columns `ties`) with `code`: a row's initial (s, u, a, other) and
    4 times its first fault: 1 truncated, 2 duplicate, 3 blank; null where dropped. Only the first of equal rows isn't a
    duplicate; minima are taken before rows meet them, so a text that recurs very often is split like any other key."""
    key = ["conv_id", "role", "digest"]
    at = F.struct("turn", *ties)
    rows = rows.withColumn("digest", F.when(~F.col("dropped"), F.unhex(F.sha2("text", 256))))
    first = rows.where("not dropped").groupBy(*key).agg(F.min(at).alias("first_at"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    both = rows.alias("r").join(first.alias("f"), same, "left").select("r.*", "first_at").drop("digest")
    blank, ended = ~F.col("text").rlike(f"[^{_SPACE}]"), F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault = F.when(blank, 3).when(F.col("first_at") != at, 2).when(~ended, 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    return both.withColumn("code", F.when(~F.col("dropped"), code)).drop("first_at")


def repair(spark: SparkSession, rows: DataFrame, ties: list[str] | None = None, dropped: str | None = None, messages: bool = False, most: int = ROWS) -> DataFrame:
    """Repairs the conversations of rows (conv_id, turn, role, text); AUDIT, one row per conv_id.

    Rows are taken in the order of turn (nulls first), role, the text's first 64 characters and `ties` (columns that tell
    rows apart; by default their place in their file). Kept rows cost 0, deleted ones 3 (blank and repeated ones have to be), a new role user or
    assistant 2, an inserted empty message 2, and rows that stay truncated 1 more; the result reads `(s?(ua)+)?` by the
    initials of roles. audit has the edits' initials, the ASCII-least of the cheapest. messages: the repaired messages
    instead (MESSAGES), ordered by part and place. Rows where the column `dropped`, if given, is true count for their
    conv_id only.

    Null roles and texts are one space, and null conv_ids one conversation; an empty role fits nowhere; gaps saturate at
    the largest long; an empty table gives no rows; other columns are ignored.

    Rows are sorted by ranges, so that a conversation of any size is dealt to many tasks. Those that lie within a range
    are repaired there. Of others each piece gives the costs through it, from which the costs beyond each piece follow,
    then its audits by the state before it; what passes through one task in order is 16 numbers per piece and, for
    SHA-256 and the audit, which are one value per conversation, its pieces one by one.
    """
    if ties is None:
        rows, ties = with_row(spark, rows, "tie"), ["tie"]
    gone = F.lit(False) if dropped is None else F.coalesce(F.col(dropped), F.lit(False))
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, gone.alias("dropped"), *ties)
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), *ties]
    dealt = faults(clean, ties).repartitionByRange(*order).sortWithinPartitions(*order)
    shown = F.when(F.col("code") < 8, F.col("text"))
    done = stored(spark, dealt.select("conv_id", "turn", "code", "role", shown.alias("text"), F.coalesce(F.length(shown), F.lit(0)).alias("size")).mapInArrow(lambda b: in_order(b, messages, most), _ALL))

    pieces = done.where("piece is not null")
    ends = pieces.select("conv_id", "piece", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(from_the_end, "piece long, beyond array<long>, last boolean")
    ready = pieces.join(ends, "piece").select(*done.columns, "beyond", "last").mapInArrow(by_entry, _ALL)
    joined = ready.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(lambda b: from_the_start(b, messages), _ALL)
    every = done.where("piece is null").unionByName(joined)
    if not messages:
        return every.select(*[c.split()[0] for c in AUDIT.split(", ")])
    one = every.select("conv_id", F.coalesce("piece", F.lit(0).cast("long")).alias("part"), F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m"))
    return one.select("conv_id", "part", F.col("place").cast("long").alias("place"), F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def damage(conversations: DataFrame, row: str) -> DataFrame:
    """Conversations (conv_id, turn, role, text, and `row`, a number of each row's own) with faults by the crc32 of
    `conv_id:turn` modulo 20: 0 drops a row (it stays, marked), 1 empties its text, 2 takes the marks .!? from it, 3
    repeats it, 4 makes its role user. Nulls are one space, but a null turn stays one."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").when(fault == 0, "").otherwise(role).alias("role"), F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"), F.col(row).alias("row"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op12_prefix_doubling_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damage(with_row(spark, table(spark, sf_dir, "conversations")), "row"), ["row", "copy"], "dropped")
