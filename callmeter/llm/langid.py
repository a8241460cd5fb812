"""Language identification by bit-sliced n-gram Bloom filters (operator 7)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, stored, table, with_row

UNKNOWN = "und"
HASHES = 3
#: With fewer n-grams than this in every filter, too little is learned to say that a text is in none of the languages.
ENOUGH = 300


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character trigrams around each letter, runs of other characters being one blank; and the text of each."""
    raw = np.frombuffer("\n\n".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t.lower()) for t in texts])
    letter = _letters()[raw]
    c = np.where(letter, raw, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    g = c[at - 1] << np.uint64(42) | c[at] << np.uint64(21) | c[at + 1]
    starts = np.cumsum(np.concatenate([[2], lengths[:-1] + 2]))
    return g, np.searchsorted(starts, at, "right") - 1


def blocks(batch: pa.RecordBatch, column: int, chars: int = 1 << 18):
    """Row ranges of a batch with about `chars` characters each, and their texts."""
    texts, first, size = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars or i + 1 == batch.num_rows:
            yield first, i + 1, texts
            texts, first, size = [], i + 1, 0


def positions(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(g)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


class Languages:
    """How a text's language follows from its hits: `fill` is the share of its `size` slots that each language's filter has."""

    def __init__(self, langs: list[str], fill: np.ndarray, size: int):
        self.langs, self.bits, self.false = langs, int(size - 1).bit_length(), fill**HASHES
        self.enough = bool(len(langs)) and -np.log1p(-np.minimum(fill, 1 - 1e-9)).max() * size / HASHES >= ENOUGH

    def choose(self, total: np.ndarray, hits: np.ndarray) -> list[tuple[str, float, int, float | None]]:
        """Each text's language, its share of all hits, the number of n-grams and which share of them the language's
        filter holds, corrected for false positives (None where too little is learned), from the number of n-grams and of
        each language's hits."""
        out = []
        for n, found in zip(total, hits):
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0, int(n), 0.0 if self.enough else None))
                continue
            right = np.maximum(0, (found - n * self.false) / np.maximum(1e-9, 1 - self.false))
            best = int(np.argmax(right))
            out.append((self.langs[best], float(right[best] / right.sum()) if right.sum() else 0.0, int(n), float(right[best] / n) if self.enough else None))
        return out


class Filters(Languages):
    """One Bloom filter per language, bit-sliced: slot s holds a bitmask, in words of 64 bits, of the languages whose filter
    has bit s."""

    def __init__(self, langs: list[str], slots: np.ndarray):
        self.slots = slots.reshape(len(slots), -1)
        super().__init__(langs, np.array([self._bit(self.slots, i).mean() for i in range(len(langs))]), len(slots))

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The languages whose filter holds each n-gram, as bitmasks."""
        found = [self.slots[p] for p in positions(g, self.bits)]
        return found[0] & found[1] & found[2]

    def decide(self, texts: list[str]) -> list[tuple[str, float, int, float | None]]:
        """What `choose` says of each text."""
        g, of = grams(texts)
        total = np.bincount(of, minlength=len(texts)).astype(float)
        m = self.masks(g) if self.langs else g
        hits = np.array([np.bincount(of, self._bit(m, i), len(texts)) for i in range(len(self.langs))])
        return self.choose(total, hits.reshape(len(self.langs), len(texts)).T)


class SlotTable:
    """The same filters with their slots in a stored Spark table (slot, mask0, mask1...), for alphabets whose n-grams are
    too many for the driver."""

    def __init__(self, langs: list[str], slots: DataFrame, bits: int):
        self.slots, self.masks = slots, slots.columns[1:]
        held = [F.sum(self._bit(i)) for i in range(len(langs))]
        self.languages = Languages(langs, np.array([x or 0 for x in slots.agg(*held).first()]) / 2.0**bits, 1 << bits)

    @staticmethod
    def _bit(i: int):
        return F.shiftrightunsigned(f"mask{i // 64}", i % 64).bitwiseAND(F.lit(1))

    def hits(self, texts: DataFrame, row: str) -> DataFrame:
        """(row, n, hits) of each text with a letter: its n-grams and each language's hits. Each distinct n-gram looks its
        slots up once; then the texts' n-grams meet those that are held, by a plain join, which can be split where an
        n-gram is in most texts."""
        bits = self.languages.bits

        def count(batches):
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for lo, _, some in blocks(batch, 1):
                    g, of = grams(some)
                    order = np.lexsort((g, of))
                    g, of = g[order], of[order]
                    first = np.flatnonzero(np.concatenate([[len(g) > 0], (g[1:] != g[:-1]) | (of[1:] != of[:-1])])[: len(g)])
                    n = np.diff(first, append=len(g))
                    for i in range(0, len(first), 50_000):
                        at = first[i : i + 50_000]
                        yield pa.record_batch({row: pa.array(rows[lo + of[at]]), "gram": pa.array(g[at].astype(np.int64)), "n": pa.array(n[i : i + 50_000])})

        def place(batches):
            for batch in batches:
                for p in positions(batch.column(0).to_numpy().astype(np.uint64), bits):
                    yield pa.record_batch({"gram": batch.column(0), "slot": pa.array(p)})

        every = texts.select(row, "text").mapInArrow(count, f"`{row}` long, gram long, n long")
        asked = every.select("gram").distinct().mapInArrow(place, "gram long, slot long").join(self.slots, "slot")
        held = asked.groupBy("gram").agg(F.count("*").alias("found"), *[F.expr(f"bit_and({m})").alias(m) for m in self.masks]).where(F.col("found") == HASHES).drop("found")
        met = every.join(held, "gram", "left")
        sums = [F.coalesce(F.sum(F.col("n") * self._bit(i)), F.lit(0)).cast("double") for i in range(len(self.languages.langs))]
        return met.groupBy(row).agg(F.sum("n").alias("n"), F.array(*sums).alias("hits"))


def learn(docs: DataFrame, share: float = 0.3, least: int = 3, max_bits: int = 22) -> Filters | SlotTable:
    """Filters from docs (text, lang): a language has an n-gram seen `least` times or more whose rate there is at least
    `share` of its highest rate in any language.

    Counts cover all of docs: each task sums its own, Spark adds them up. The filters grow with the n-grams they hold, 16
    slots for each. Their slots are made in Spark too; up to 2**max_bits of them, of 64 bits for every 64 languages, come
    to the driver and from there to every task, more stay a table (SlotTable). Null texts and languages teach nothing;
    without any language, every text is `und`.
    """
    docs = docs.where("lang is not null and text is not null").select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}

        def compact(some):
            g, inverse = np.unique(np.concatenate([x[0] for x in some]), return_inverse=True)
            return [(g, np.bincount(inverse, np.concatenate([x[1] for x in some])).astype(np.int64))]

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, texts in blocks(batch, 1):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[lo:hi], texts):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    g, n = np.unique(grams(some)[0], return_counts=True)
                    held.setdefault(lang, []).append((g, n))
                    if len(held[lang]) >= 16:
                        held[lang] = compact(held[lang])
        for lang, some in held.items():
            g, n = compact(some)[0]
            for i in range(0, len(g), 50_000):
                part = g[i : i + 50_000]
                yield pa.record_batch({"lang": pa.array([lang] * len(part)), "gram": pa.array(part.astype(np.int64)), "n": pa.array(n[i : i + 50_000])})

    counts = docs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], np.zeros(1 << 10, np.uint64))
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))])[F.col("lang")]
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])[F.col("lang")]
    each = counts.select("gram", "n", rate.alias("rate"), number.alias("i")).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("n", "rate", "i")).alias("each"))
    member = F.filter("each", lambda x: (x["n"] >= least) & (x["rate"] >= share * F.col("top")))
    width = -(-len(langs) // 64)

    def word(k: int):
        bit = lambda x: F.when(F.floor(x["i"] / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), x["i"] % 64)).otherwise(F.lit(0).cast("long"))
        return F.aggregate("member", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))).alias(f"mask{k}")

    members = each.select("gram", member.alias("member")).where("size(member) > 0").select("gram", *map(word, range(width)))
    bits = max(10, int(16 * members.count() - 1).bit_length())

    masks = [f"mask{k}" for k in range(width)]

    def place(batches):
        for batch in batches:
            for p in positions(batch.column(0).to_numpy().astype(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(p), *batch.columns[1:]], names=["slot", *masks])

    found = members.mapInArrow(place, ", ".join(f"{x} long" for x in ["slot", *masks])).groupBy("slot").agg(*[F.expr(f"bit_or({x})").alias(x) for x in masks])
    if bits > max_bits:
        found = stored(docs.sparkSession, found)
        counts.unpersist()
        return SlotTable(langs, found, bits)
    found = found.toArrow()
    counts.unpersist()
    slots = np.zeros((1 << bits, width), np.uint64)
    for k, x in enumerate(masks):
        slots[found.column(0).to_numpy(), k] = found.column(x).to_numpy().view(np.uint64)
    return Filters(langs, slots)


def predict(docs: DataFrame, filters: Filters | SlotTable, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, n_grams and held (after `prefix`): the language whose filter, corrected for its false
    positives, holds most of the text's n-grams, its share of all languages' hits, the number of n-grams and the share of
    them that its filter holds (null where no filter has ENOUGH n-grams). `und` and 0 for null texts and those without a
    letter; ties go to the first language in order. Repeated rows stay, as do all columns but any of these four names."""
    spark = docs.sparkSession
    names = [prefix + x for x in ("lang_pred", "score", "n_grams", "held")]
    kept = docs.drop(*names)
    if isinstance(filters, SlotTable):
        return _predict_by_table(kept, filters, names)
    shared = spark.sparkContext.broadcast(filters)
    at = kept.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, texts in blocks(batch, at):
                lang, score, n, held = zip(*shared.value.decide(texts))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(held, pa.float64())], names=[*part.schema.names, *names])

    more = zip(names, (T.StringType(), T.DoubleType(), T.LongType(), T.DoubleType()))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(*x) for x in more)]))


def _predict_by_table(docs: DataFrame, filters: SlotTable, names: list[str]) -> DataFrame:
    """docs with what the slot table says of each text, by a number of each row's own."""
    row = "_" * (1 + max(map(len, [*docs.columns, *names]))) + "row"
    known = filters.languages

    def run(batches):
        for batch in batches:
            n = batch.column(1).to_numpy().astype(float)
            lang, score, count, held = zip(*known.choose(n, np.array(batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(held, pa.float64())], names=[row, *names])

    rows = with_row(docs.sparkSession, docs, row)
    types = ("string", "double", "long", "double")
    said = filters.hits(rows, row).mapInArrow(run, ", ".join(f"`{x}` {t}" for x, t in zip([row, *names], ("long", *types))))
    rest = (F.lit(UNKNOWN), F.lit(0.0), F.lit(0).cast("long"), F.lit(0.0 if known.enough else None).cast("double"))
    return rows.join(said, row, "left").select(*docs.columns, *[F.coalesce(x, y).alias(x) for x, y in zip(names, rest)])


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the row's doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op7_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out(4, 2) & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
