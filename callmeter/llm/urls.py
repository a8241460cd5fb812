"""URL filtering: given rules for hosts and paths, and association rules mined from what they decide (operator 13)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, with_row


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The given rules of the query.
GIVEN = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
_URL = r"://([^/?#]*)([^?#]*)([\s\S]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent tokens up to which a row's combinations are all counted.
WHOLE = 10
RULES = "name string, antecedent array<string>, verdict string, confidence double, support long, size int, key string"


def url_parts(url: str = "url") -> tuple[Column, Column, Column]:
    """Host (in lower case), path, and what follows it: all empty where there is no `://`."""
    host, path, rest = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2, 3))
    return F.translate(host, _UPPER, _LOWER), path, rest


def fitting(rules, host: Column, path: Column) -> Column:
    """The longest rule (rule, verdict) for a host, its subdomains included, and the start of a path; null for none. Of
    equally long ones the first counts."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """The distinct words of a url's host, path and query, marked by where they stand."""
    words = lambda c, mark: F.transform(F.filter(F.split(F.translate(c, _UPPER, _LOWER), r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(rest, "q:")))


def frequent_tokens(labelled: DataFrame, least: float, blocked: float, total: int) -> DataFrame:
    """Tokens of labelled rows (tokens, verdict) in `least` rows or more, with `tells`: how far from the average the share
    of blocked rows is among a token's rows (a chi-square statistic)."""
    base = max(min(blocked / total, 1 - 1e-9), 1e-9)
    n, b = F.col("n"), F.col("b")
    counts = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").cast("long").alias("blocked")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"))
    return counts.where(n >= least).select("token", n.alias("token_rows"), ((b - n * base) ** 2 / (n * (base * (1 - base)))).alias("tells"))


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (with `tokens`) beside each of the rules whose whole antecedent they hold. A rule is looked up by its rarest
    token only, so a set meets the rules filed under its tokens, not all that share one with it."""
    return sets.withColumn("key", F.explode("tokens")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)


def deciding_sets(spark: SparkSession, told: DataFrame, least: float) -> DataFrame:
    """The sets of tokens that rules can have, of rows (row, verdict, token) of any length: antecedent (sorted), n (rows that
    hold it), b (blocked ones among them).

    Left out is what mine would drop, and with it all that is wider: sets with neither verdict in `least` rows, those that
    as many rows hold as hold one with a token less, and those beyond a set whose rows all have one verdict. Sets grow by a
    token a round, from two of the same row that differ in their last.
    """
    pairs = stored(spark, told.select("row", (F.col("verdict") == "block").cast("long").alias("blocked"), F.array("token").alias("antecedent")))
    known, found = None, None
    while True:
        counts = pairs.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")).where(F.greatest(F.col("b"), F.col("n") - F.col("b")) >= least)
        if known is not None:
            less = counts.select("antecedent", "n", F.explode("antecedent").alias("token")).select("antecedent", "n", F.array_remove("antecedent", F.col("token")).alias("less"))
            inner = less.join(known.select(F.col("antecedent").alias("less"), F.col("n").alias("less_n")), "less").groupBy("antecedent").agg(F.count(F.lit(1)).alias("k"), F.bool_and(F.col("less_n") > F.col("n")).alias("free"))
            counts = counts.join(inner.where("free and k = size(antecedent)").select("antecedent"), "antecedent", "left_semi")
        counts = stored(spark, counts)
        found = counts if found is None else found.unionByName(counts)
        known = counts.where("b > 0 and b < n")
        if known.isEmpty():
            return found
        held = stored(spark, pairs.join(known.select("antecedent"), "antecedent", "left_semi").select("row", "blocked", F.expr("slice(antecedent, 1, size(antecedent) - 1)").alias("start"), F.element_at("antecedent", -1).alias("token")))
        other = held.select("row", "start", F.col("token").alias("next"))
        pairs = stored(spark, held.join(other, ["row", "start"]).where("token < next").select("row", "blocked", F.concat("start", F.array("token", "next")).alias("antecedent")))


def mine(spark: SparkSession, labelled: DataFrame, min_support: float = 0.002, min_count: int = 8, min_confidence: float = 0.9, items: int | None = None) -> DataFrame:
    """Association rules from labelled rows (row, tokens, verdict): name, antecedent, verdict, confidence, support (rows
    with both), size, and key, the antecedent's rarest token.

    All of a row's frequent tokens count. FP-growth runs over them and the verdict where no row has more than WHOLE, and so
    2^WHOLE combinations; where one has, sets that can't matter are left out as they grow (see deciding_sets), with the same
    rules. A rule needs min_support of the rows, min_count rows at least, and min_confidence; and it is dropped where a rule
    for the same verdict with fewer of its tokens is as confident. items: of each row only so many tokens, the most
    telling; by default all.
    """
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("verdict") == "block").cast("long")), F.lit(0))).first()
    least = max(min_support * total, min_count)
    if total < least:
        return spark.createDataFrame([], RULES)
    frequent = stored(spark, frequent_tokens(labelled, least, blocked, total))
    told = labelled.select("row", "verdict", F.explode("tokens").alias("token")).join(frequent, "token")
    best = F.sort_array(F.collect_list(F.struct((-F.col("tells")).alias("tells"), "token")))
    best = best if items is None else F.slice(best, 1, items)
    baskets = stored(spark, told.groupBy("row", "verdict").agg(best.alias("best")).select("row", "verdict", F.concat(F.col("best.token"), F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    n, longest = baskets.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if n < least:
        return spark.createDataFrame([], RULES)
    then = F.col("consequent")[0]
    if longest - 1 <= WHOLE:
        model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(baskets)
        found = model.associationRules.where(then.startswith("=")).select("consequent", "antecedent", "confidence", F.round(F.col("support") * n).cast("long").alias("support"))
    else:
        sets = deciding_sets(spark, baskets.select("row", "verdict", F.explode("items").alias("token")).where(~F.startswith("token", F.lit("="))), least)
        each = F.explode(F.array(*[F.struct(F.array(F.lit(f"={v}")).alias("consequent"), rows.alias("support")) for v, rows in (("block", F.col("b")), ("allow", F.col("n") - F.col("b")))])).alias("r")
        found = sets.select("antecedent", "n", each).select("r.*", "antecedent", (F.col("r.support") / F.col("n")).alias("confidence")).where((F.col("support") >= least) & (F.col("confidence") >= min_confidence))
    found = found.select(
        F.concat_ws(" ", then, F.array_sort("antecedent")).alias("name"), "antecedent", F.substring(then, 2, 5).alias("verdict"), "confidence", "support", F.size("antecedent").alias("size"),
    )
    rarest = found.select("name", F.explode("antecedent").alias("token")).join(frequent, "token").groupBy("name").agg(F.min_by("token", F.struct("token_rows", "token")).alias("key"))
    found = stored(spark, found.join(rarest, "name"))
    wider = found.select(F.col("name").alias("of"), F.col("verdict").alias("of_verdict"), F.col("confidence").alias("of_confidence"), F.col("size").alias("of_size"), F.col("antecedent").alias("tokens"))
    beaten = matches(wider, found).where("verdict = of_verdict and size < of_size and confidence >= of_confidence").select(F.col("of").alias("name")).distinct()
    return stored(spark, found.join(beaten, "name", "left_anti"))


def judge(spark: SparkSession, pages: DataFrame, rules=GIVEN, otherwise: str = "allow", **mining) -> DataFrame:
    """pages (page_id, url) → page_id, host, path, rule, verdict, and by: the name of the mined rule that decided.

    The longest of the given rules that fits decides. The urls they decide are the labelled rows that association rules
    are mined from (see mine); of those that a url's tokens hold, the most confident decides, then the one with more
    support, more tokens, block before allow, and the greater name. Urls that no rule holds get `otherwise`.

    A null url, or one without `://`, has an empty host and path and no rule; a null page_id stays null; repeated rows
    are each judged, and count each in mining; an empty table gives no rows; other columns are ignored.
    """
    host, path, rest = url_parts()
    rows = with_row(spark, pages).select("row", F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"), F.contains("url", F.lit("://")).alias("is_url"))
    rows = rows.withColumn("given", F.when(F.col("is_url"), fitting(rules, F.col("host"), F.col("path"))))
    rows = stored(spark, rows.select("row", "page_id", "host", "path", "given.rule", "given.verdict", tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens")))
    mined = mine(spark, rows.where("rule is not null"), **mining)
    strength = F.struct("confidence", "support", "size", "verdict", "name")
    best = matches(rows.where("rule is null").select("row", "tokens"), mined).groupBy("row").agg(F.max(strength).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "best.verdict", F.lit(otherwise)).alias("verdict"), F.col("best.name").alias("by"))


def op13_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))
