"""Document fingerprints by one-permutation MinHash (operator 2). DataFrame and SQL functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BINS = 256
LOW_BITS = 8
WORDS = 5
TRIES = 24


def _probes(bins: int) -> list[list[int]]:
    """For each bin, all bins in the order in which it tries to borrow from them when empty: every bin has its own order,
    from a shared seed (optimal densification), so that two texts with the same empty bin borrow alike."""
    draw = random.Random(20170817)
    return [draw.sample(range(bins), bins) for _ in range(bins)]


def bin_minima(text: Column, bins: int = BINS, words: int = WORDS) -> Column:
    """array<long>, ordered by bin: the smallest shingle hash of each bin that has any.

    Each shingle of `words` words (the whole text where it has fewer) is hashed once; the hash's top bits are its bin,
    so sorting puts bins side by side and the first of each run is the bin's minimum.
    """
    shift = 64 - (bins - 1).bit_length()
    w = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x))

    def shingles(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(n - words, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))

    h = F.aggregate(F.array(w), F.array().cast("array<bigint>"), lambda _, x: F.when(F.size(x) > 0, shingles(x)).otherwise(F.array().cast("array<bigint>")))
    ordered = F.aggregate(F.array(F.sort_array(h)), F.array().cast("array<bigint>"), lambda _, s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift))))
    return ordered


def fingerprint(minima: Column, bins: int = BINS, bits: int = LOW_BITS) -> Column:
    """Hex of the bins' low-order `bits` (4 or 8) bits, bin by bin; empty for a text without words.

    Hashes sort as signed numbers, so bin numbers run from -bins / 2. An empty bin takes the value of the first filled
    bin of its probe sequence. The first TRIES of these are looked up one by one; where all are empty, as only in short
    texts, it is the filled bin of least rank in the sequence.
    """
    shift, half, digits = 64 - (bins - 1).bit_length(), bins // 2, bits // 4
    code = F.transform(minima, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND((1 << bits) - 1)), digits, "0")))
    held = F.map_from_arrays(F.transform(minima, lambda x: (F.shiftright(x, shift) + half).cast("int")), code)
    order = _probes(bins)
    ranks = [sorted(range(bins), key=row.__getitem__) for row in order]  # the inverse of each order
    probes = F.array(*[F.array(*[F.lit(b) for b in row[:TRIES]]) for row in order])
    # One string for each bin, of the ranks of all bins in its sequence, three hex digits each.
    rank = F.array(*[F.lit("".join(f"{r:03x}" for r in row)) for row in ranks])

    def fill(m: Column) -> Column:
        def value(i):
            borrowed = F.aggregate(F.get(probes, i), F.lit(None).cast("string"), lambda acc, b: F.coalesce(acc, F.try_element_at(m, b)))
            least = F.array_min(F.transform(F.map_keys(m), lambda b: F.concat(F.substr(F.get(rank, i), b * 3 + 1, F.lit(3)), b.cast("string"))))
            return F.coalesce(F.try_element_at(m, i), borrowed, F.try_element_at(m, F.substr(least, F.lit(4), F.lit(9)).cast("int")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), value), "")

    made = F.aggregate(F.array(held), F.lit(""), lambda _, m: fill(m))
    return F.when(F.size(minima) > 0, made).otherwise(F.lit(""))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = LOW_BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal bins less what chance alone would make equal
    (2**-bits), rescaled and held within 0 and 1. Two empty texts are alike (1), an empty and another are not (0)."""
    digits = bits // 4

    def code(x: Column, i: Column) -> Column:
        return F.substr(x.cast("binary"), i * digits + 1, F.lit(digits))

    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda acc, i: acc + (code(a, i) == code(b, i)).cast("int"))
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), (same / float(bins) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(estimate)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column, a null text being empty. Equal texts have equal fingerprints; other
    columns, repeated rows and empty tables pass through."""
    return docs.withColumn("__minima", bin_minima(F.coalesce(F.col(text), F.lit("")))).withColumn(name, fingerprint(F.col("__minima"))).drop("__minima")


def with_range(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs with `bucket`: consecutive numbers of ranges of ascending doc_id, of about `rows` rows. Rows with a null id are
    dealt by a hash of their text to numbers below 0.

    Borders are approximate quantiles of doc_id; how good they are changes balance only. A row's range is found among
    up to 1024 coarse borders by nested conditions, then among the fine borders between two of those.
    """
    k = max(1, min(100_000, docs.count() // rows))
    at = [F.lit(i / k) for i in range(1, k)] or [F.lit(0.5)]
    borders = sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*at), max(10_000, 10 * k))).first()[0] or []))
    width = -(-max(1, len(borders)) // 1024)
    coarse = borders[width - 1 :: width]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= coarse[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    bucket = search(0, len(coarse))
    if width > 1:
        fine = F.array(*[F.array(*[F.lit(b) for b in borders[i * width : (i + 1) * width - 1]]).cast("array<bigint>") for i in range(len(coarse) + 1)])
        bucket = bucket * width + F.size(F.filter(F.get(fine, bucket), lambda b: b < F.col("doc_id")))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(k))).otherwise(bucket).cast("int"))


def with_successor(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, guest) for docs (doc_id, text): each document beside the next one.

    Order is ascending doc_id, ties by text; after the last comes the first. A null id has no place in the order: next to
    it is nothing, and it is next to nothing. Documents are dealt out by
    ranges of doc_id, texts moving once; each range also gets the first document of the next range as a guest row,
    which ends its order and is to be dropped by the caller. Which documents are guests is settled on ids, of which the
    driver sees one per range (at most 100,001).
    """
    spark = docs.sparkSession
    placed = with_range(docs)
    heads = placed.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    visits = [(b["doc_id"], heads[i - 1]["bucket"]) for i, b in enumerate(heads)]
    visits = F.broadcast(spark.createDataFrame(visits, "head long, host int"))
    rows = placed.join(visits, placed["doc_id"] == visits["head"], "left")
    seat = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(seat)).otherwise(F.array(seat, F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))
    rows = rows.select("doc_id", "text", F.explode(seats).alias("seat")).select("doc_id", "text", "seat.*")
    order = W.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    return rows.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)).alias("next_text"), "guest")


def op2_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = with_successor(docs).withColumn("edited", edited).select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    rows = with_fingerprint(with_fingerprint(rows), "edited", "edited_fingerprint").drop("text", "edited")
    following = F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("place"))
    rows = rows.withColumn("following", F.when(F.col("doc_id").isNotNull(), following).otherwise(F.lit(""))).where("not guest")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"))
