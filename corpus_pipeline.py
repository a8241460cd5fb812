"""From raw documents to packed training sequences: toxicity, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm import jaccard, langid, packing, secrets, toxicity
from callmeter.llm.common import stored, table, with_row


#: The share of its n-grams that a document's best language must hold, and from how many n-grams on. In the given tables
#: it is 0.536 or more for every document and 0.429 or more for 10 characters cut out of one; random letters reach 0.17,
#: sentences of five other languages in Latin letters 0.32, other scripts 0.
FLOOR, SHORT = 0.4, 8


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as tell it apart from the columns of docs."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that a model learned from `labels` scores 0.7 or more. Null and empty texts stay, repeated rows
    fare alike, an empty table stays empty, and other columns stay as they are, whatever their names."""
    model, mark = toxicity.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "toxicity")
    return toxicity.score(docs, model, mark).where(F.col(mark) < 0.7).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: null texts, those without a letter, those of which no language's filter
    holds an n-gram and, from SHORT n-grams on, those of which the best filter holds less than FLOOR of them. Fills in a
    missing lang. Where too little is learned (no text with a lang, or no filter of langid.ENOUGH n-grams), every text
    with a letter stays; without any language a missing lang stays null. Repeated rows fare alike, an empty table stays
    empty, and other columns stay as they are, whatever their names."""
    p = unused(docs, "lang_id_")
    held, n_grams = F.col(f"{p}held"), F.col(f"{p}n_grams")
    kept = langid.predict(docs, langid.learn(docs), p).where(n_grams > 0)
    kept = kept.where(held.isNull() | ((held > 0) & ((n_grams < SHORT) | (held >= FLOOR))))
    return kept.withColumn("lang", F.coalesce("lang", F.nullif(f"{p}lang_pred", F.lit(langid.UNKNOWN)))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of documents linked by a Jaccard similarity of 0.8 or more of their five-word
    shingles: that of the smallest doc_id, one without an id only where all lack it, any of those that repeat it. All
    rows take part, each by a number of its own. Documents without words are all kept."""
    rows = with_row(spark, docs.select(F.struct(*docs.columns).alias("doc")))
    classes = jaccard.near_rows(spark, rows.select("row", "doc.doc_id", "doc.text"), words=5, num=80, den=100)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = classes.groupBy(F.coalesce("root", "row"), F.col("root").isNull()).agg(first["row"].alias("row")).select("row")
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; no document goes. See secrets.redact for nulls and repeated rows."""
    return secrets.redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left: of a null or empty text, its end alone; of repeated rows, each; see packing.pack."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", toxic), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]

#: Learned scores, n-gram filters and byte-pair merges can't be expressed in SQL; the tests hold each stage against a
#: brute-force version or an exact round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass the stages, each stage's result being stored; of an empty table, none."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
