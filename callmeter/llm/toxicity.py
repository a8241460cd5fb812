"""Toxicity by non-negative positive-unlabelled learning (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bytes, stored, table, with_row
from .langid import blocks, held_out

PREFIXES = (4, 5, 6)
#: A feature that occurs this often is a further feature: it is XORed with the constant.
OFTEN = ((2, np.uint64(0x5555555555555555)), (4, np.uint64(0xAAAAAAAAAAAAAAAA)))

_WORD = np.zeros(256, bool)
_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text and the text each belongs to: whole words and their first 4 to 6 bytes."""
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    gap = np.ones(len(raw) + 1, bool)
    gap[1:] = ~_WORD[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    hashed = Bytes(_LOWER[raw])
    of = np.searchsorted(ends, start, "right")
    found, owner = [hashed.slices(start, end)], [of]
    for k in PREFIXES:
        long = end - start > k
        found.append(hashed.slices(start[long], start[long] + k) * np.uint64(2 * k + 1))
        owner.append(of[long])
    return np.concatenate(found), np.concatenate(owner)


def counted(f: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text and the texts, in the texts' order, with those for what occurs repeatedly."""
    by = np.lexsort((f, of))
    f, of = f[by], of[by]
    start = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (of[1:] != of[:-1])])) if len(f) else np.zeros(0, int)
    n = np.diff(np.append(start, len(f)))
    f, of = f[start], of[start]
    every, owner = np.concatenate([f, *(f[n >= k] ^ x for k, x in OFTEN)]), np.concatenate([of, *(of[n >= k] for k, _ in OFTEN)])
    by = np.argsort(owner, kind="stable")
    return every[by], owner[by]


class Known:
    """A set of features: positions of those that it holds, -1 for others. A small table of 16-bit ends sorts out most."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features)
        self.ends = np.zeros(1 << 16, bool)
        self.ends[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), -1, np.int64)
        maybe = np.flatnonzero(self.ends[(f & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.features, f[maybe]), len(self.features) - 1)
            out[maybe] = np.where(self.features[at] == f[maybe], at, -1)
        return out


@dataclass
class Model:
    """A logistic classifier of which features occur: a weight for each of its features, in their order."""

    features: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = Known(self.features)
        self.base = Known(np.unique(np.concatenate([self.features, *(self.features ^ x for _, x in OFTEN)])))

    def score(self, texts: list[str]) -> np.ndarray:
        f, of = features(texts)
        use = self.base.find(f) >= 0
        f, of = counted(f[use], of[use])
        at = self.known.find(f)
        total = np.bincount(of[at >= 0], self.weight[at[at >= 0]], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _cover(positive: list[np.ndarray], chosen: np.ndarray, lift: np.ndarray, times: int = 3) -> np.ndarray:
    """Which of the chosen features to keep: in turn the one that adds most, its lift times the positives it covers that
    fewer than `times` features cover so far. Words that merely stand in copies of some positive add nothing."""
    known = Known(chosen)
    col = [at[at >= 0] for at in map(known.find, positive)]
    row = np.repeat(np.arange(len(positive)), [len(c) for c in col])
    col = np.concatenate(col) if col else np.zeros(0, int)
    covered, free, kept = np.zeros(len(positive), int), np.ones(len(chosen), bool), []
    while free.any():
        gain = np.bincount(col[covered[row] < times], minlength=len(chosen)) * free
        best = int(np.argmax(gain * lift))
        if gain[best] < max(3, 0.002 * len(positive)):
            break
        kept.append(best)
        free[best] = False
        covered[row[col == best]] += 1
    return np.array(sorted(kept), int)


def lifted(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, most: int = 4096) -> np.ndarray:
    """Positions of the features that the positives have at least 3 times as often as the unlabelled texts do, by 6
    standard errors or more; `most` of them at most, the surest."""
    pp, pu = in_p / max(1, n_p), (in_u + 0.5) / max(1, n_u)
    z = (pp - pu) / np.sqrt(pu * (1 + 1e-9 - np.minimum(pu, 1)) / max(1, n_p) + 1e-12)
    good = np.flatnonzero((pp >= 3 * pu) & (z >= 6))
    return np.sort(good[np.argsort(-z[good], kind="stable")[:most]])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = 4096, steps: int = 1500, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Fits the non-negative risk  prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])  with the logistic loss.

    positive, unlabelled: the distinct features of each text. The model's features are a cover of the lifted ones. Where the negative part of the risk falls
    below zero, the step goes up that part's gradient instead, as the method has it.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    np_, nu = len(positive), len(unlabelled)
    f, n = np.unique(np.concatenate(positive), return_counts=True)
    chosen = f[n >= 3]
    known = Known(chosen)

    def having(texts: list[np.ndarray]) -> np.ndarray:
        at = known.find(np.concatenate(texts))
        return np.bincount(at[at >= 0], minlength=len(chosen))

    in_p, in_u = having(positive), having(unlabelled)
    good = lifted(in_p, np_, in_u, nu, most)
    chosen = chosen[good][_cover(positive, chosen[good], (in_p / np_ / ((in_u + 0.5) / nu))[good])]
    known = Known(chosen)

    def sparse(rows):
        idx = [at[at >= 0] for at in map(known.find, rows)]
        return np.concatenate(idx) if idx else np.zeros(0, int), np.repeat(np.arange(len(rows)), [len(i) for i in idx])

    (ip, rp), (iu, ru) = sparse(positive), sparse(unlabelled)
    k = len(chosen)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, steps + 1):
        sp = sig(np.bincount(rp, w[ip], np_) + b)
        su = sig(np.bincount(ru, w[iu], nu) + b)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gp, gu = -prior * sp / np_, su / nu  # of the negative part
        if negative >= 0:
            gp = gp - prior * (1 - sp) / np_
        else:
            gp, gu = -gp, -gu
        g = np.append(np.bincount(ip, gp[rp], k) + np.bincount(iu, gu[ru], k) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:k], b - step[k]
    return Model(chosen, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 10_000, prior: float | None = None, most: int = 4096) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    Positives are the documents that a label confirms as toxic; unlabelled are any documents, whatever their label. Of
    each, a sample of at most max_positive and max_unlabelled rows is fitted, in numpy: those of the lowest hashes of
    doc_id, one row of each id, however often it occurs. The sample is stored once. `most` bounds the lifted features
    that its cover is taken from. The class prior, unless given, is the toxic share of all labelled ids. Null ids, texts
    and labels teach nothing.
    """
    spark = docs.sparkSession
    texts = with_row(spark, docs.select("doc_id", "text")).where("doc_id is not null and text is not null")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    order = F.xxhash64(F.col("doc_id"))
    ids = texts.select("doc_id").distinct()
    known = ids.join(marks.where("toxic = 1"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive)
    any_ids = ids.orderBy(order, "doc_id").limit(max_unlabelled)
    drawn = known.withColumn("positive", F.lit(True)).unionByName(any_ids.withColumn("unlabelled", F.lit(True)), allowMissingColumns=True)
    drawn = drawn.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    few = F.broadcast(spark.createDataFrame(drawn.collect(), drawn.schema))
    drawn = texts.select("row", "doc_id").join(few, "doc_id").groupBy(*few.columns).agg(F.min("row").alias("row"))
    few = F.broadcast(spark.createDataFrame(drawn.collect(), drawn.schema))
    sample = stored(spark, texts.join(few, ["row", "doc_id"]).select("doc_id", "text", "positive", "unlabelled"))
    positive, unlabelled = sample.where("positive"), sample.where("unlabelled")

    def extracted(rows: DataFrame, wanted: Known | None) -> DataFrame:
        """(doc_id, f): the features, all or those wanted, of rows of the sample."""
        shared = spark.sparkContext.broadcast(wanted)

        def run(batches):
            for batch in batches:
                for lo, hi, text in blocks(batch, 1):
                    f, of = counted(*features(text))
                    if shared.value is not None:
                        keep = shared.value.find(f) >= 0
                        f, of = f[keep], of[keep]
                    cut = np.searchsorted(of, np.arange(len(text) + 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(f.view(np.int64)))], names=["doc_id", "f"])

        return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<bigint>")

    def gathered(rows: DataFrame) -> list[np.ndarray]:
        table = rows.toArrow()
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        f = [x.flatten().to_numpy().view(np.uint64) for x in table.column("f").chunks]
        ends = [np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in table.column("f").chunks]
        texts = [v[a:b] for v, e in zip(f, ends) for a, b in zip(e, e[1:])]
        return [texts[i] for i in order]

    def counts(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The features that `least` texts have or more, in order, and how many do."""
        n = rows.select(F.explode("f").alias("f")).groupBy("f").count().where(F.col("count") >= least).toArrow()
        f, n = n.column("f").to_numpy().view(np.uint64), n.column("count").to_numpy()
        return np.sort(f), n[np.argsort(f)]

    n_p, n_u = positive.count(), unlabelled.count()
    often, in_p = counts(extracted(positive, None), 3)
    seen, n = counts(extracted(unlabelled, Known(often)), 1)
    in_u = np.zeros(len(often), np.int64)
    in_u[np.searchsorted(often, seen)] = n
    wanted = Known(often[lifted(in_p, n_p, in_u, n_u, most)])
    return train(gathered(extracted(positive, wanted)), gathered(extracted(unlabelled, wanted)), prior, most)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with column `name`, the probability that the whole text is toxic. Null and empty texts score as texts without
    any known feature; repeated rows stay; an empty table stays empty; all columns but one of that name stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    at = kept.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, texts in blocks(batch, at):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts), pa.float64())], names=[*part.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
