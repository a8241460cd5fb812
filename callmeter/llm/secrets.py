"""Secret scans over an incremental blob ledger (operator 8). DataFrame and SQL functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table


@dataclass(frozen=True)
class Rule:
    """pattern's leftmost non-overlapping matches count where group `group` has `least` characters or more.

    A changed rule gets a new version: blobs scanned under the old one count as unseen for it.
    """

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The kinds of secrets, their patterns and least lengths.
BASE_RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Kinds that are found besides: a private key's header, and a token of three dotted base64 parts.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)

FINDING = "array<struct<start:long,end:long,ok:boolean>>"
FOUND = "array<struct<start:long,end:long,kind:string,version:int>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's accepted matches in text as an array of (start, end), in code points.

    The gaps between matches, from split, and the matches themselves alternate, so running sums of their lengths give
    the positions. Without a match (the usual case) neither is computed.
    """
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    size = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(size, F.length).alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("out"))

    def step(acc, row):
        s = acc["at"] + row["gap"]
        e = s + F.coalesce(row["hit"], F.lit(0))
        one = F.array(F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), F.coalesce(row["size"] >= rule.least, F.lit(False)).alias("ok")))
        return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

    every = F.aggregate(rows, start, step, lambda acc: acc["out"])
    kept = F.transform(F.filter(every, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"]))
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def with_blobs(versions: DataFrame) -> DataFrame:
    """versions (path, text) with blob, the content address: SHA-256 of the text, a null text being empty."""
    return versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): each blob that some rule version hasn't scanned yet, once, with those rules' kinds.

    Which row stands for a blob is settled on hashes and paths alone, with map-side minima; texts move once, to meet
    the chosen rows.
    """
    todo = F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules])
    owner = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        owner = owner.withColumn("todo", todo)
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        owner = owner.join(done, "blob", "left").select("blob", "path", F.array_except(todo, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where("size(todo) > 0")
    v, o = versions.alias("v"), owner.hint("shuffle_hash").alias("o")
    return v.join(o, (F.col("v.blob") == F.col("o.blob")) & F.col("v.path").eqNullSafe(F.col("o.path"))).select("v.blob", "v.text", "o.todo")


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows (blob, rules, found) for blobs (blob, text, todo): the rule versions scanned, and what they found."""
    def found(r: Rule) -> Column:
        hits = F.transform(spans(F.col("text"), r), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
        return F.when(F.array_contains("todo", f"{r.kind}/{r.version}"), hits).otherwise(F.array().cast(FOUND))

    return blobs.select("blob", F.col("todo").alias("rules"), F.flatten(F.array(*map(found, rules))).alias("found"))


def update_ledger(spark: SparkSession, versions: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Scans what the ledger at `path` hasn't seen of versions (path, text), appends it there, and returns the ledger.

    Versions are any historical states of files: the same content under many paths or in many versions is one blob.
    A failed call leaves earlier appends whole; rows that repeated versions or calls write twice count once.
    """
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
        ledger.limit(1).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan(unseen(with_blobs(versions), ledger, rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def hits_by_blob(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found) for the blobs with findings under the given rule versions: an array of (start, end, kind) by start."""
    current = F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules])
    hits = ledger.where("size(found) > 0").groupBy("blob").agg(F.flatten(F.collect_set("found")).alias("found"))
    kept = F.filter("found", lambda s: F.array_contains(current, F.concat_ws("/", s["kind"], s["version"])))
    return hits.select("blob", F.array_sort(F.array_distinct(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))).alias("found"))


def met(left: DataFrame, hits: DataFrame, on: str, most: int = 100_000) -> DataFrame:
    """left with what the blobs' stored hits say: up to `most` of them are broadcast; beyond that both sides are shuffled,
    plainly, so that the shuffle can be split where a blob is hot."""
    return left.join(F.broadcast(hits) if hits.count() <= most else hits, on, "left")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(path, blob, found) for every row of versions (path, blob): the ledger's findings joined back to every path.

    Only blobs with findings take part, as one stored row each, so a blob that a third of the paths share meets them
    without being gathered in one place.
    """
    found = F.coalesce("found", F.array().cast("array<struct<start:long,end:long,kind:string>>"))
    return met(versions, stored(versions.sparkSession, hits_by_blob(ledger, rules)), "blob").select("path", "blob", found.alias("found"))


def scan_documents(spark: SparkSession, docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, rounds: int = 2) -> DataFrame:
    """(doc_id, blob, found) for every row of docs (doc_id, text), by the ledger at that path or a new one.

    The rows come in `rounds` shares by a hash of doc_id, each of which meets the ledger that the former ones filled: what
    they share is scanned once, a round shuffles its own texts only, and a run that fails leaves its finished rounds in
    the ledger, so that the next one with the same ledger scans the rest.

    A null text is the empty blob, without findings; a null doc_id is a path like any other; repeated rows come out as
    often as they occur (where the path that stands for a blob repeats, so does its scan, to the same ledger entry); an
    empty table gives none; other columns are ignored.
    """
    versions, path = docs.select(F.col("doc_id").alias("path"), "text"), ledger or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for i in range(rounds):
        known = update_ledger(spark, versions.where(F.pmod(F.xxhash64("path"), F.lit(rounds)) == i), path, rules)
    return findings(with_blobs(versions).select("path", "blob"), known, rules).withColumnRenamed("path", "doc_id")


def redact(spark: SparkSession, docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by `mark` (overlapping ones by one) and n_chars, if there is such a column,
    as it is then; rows without findings, null texts, null ids and repeated rows stay as they are, and so do all other
    columns, whatever their names; an empty table stays empty."""
    columns = docs.columns
    known = update_ledger(spark, docs.select(F.col("doc_id").alias("path"), "text"), ledger or f"{shared_dir(spark)}/{uuid.uuid4().hex}", rules)
    address = F.sha2(F.coalesce("text", F.lit("")), 256)
    hits = stored(spark, hits_by_blob(known, rules)).select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("__found", start, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = met(docs.withColumn("__blob", address), hits, "__blob")
    changed = F.size(F.coalesce("__found", F.array().cast("array<struct<start:long,end:long,kind:string>>"))) > 0
    joined = joined.withColumn("text", F.when(changed, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*columns)


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(spark, table(spark, sf_dir, "documents"))
    order = {r.kind: i for i, r in enumerate(BASE_RULES + MORE_RULES)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    ranked = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(r: Rule) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}")

    base = F.filter("s", lambda x: x["rank"] < len(BASE_RULES))
    return found.withColumn("s", ranked).select("doc_id", *map(count, BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
