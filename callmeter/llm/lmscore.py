"""Language-model scoring by cross-entropy difference (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, stored, table, words
from .langid import blocks

SCHEMA = "doc_id long, n_tokens long, ce_target double, ce_background double, ce_diff double"
#: Beginning and end of a document, as a word: each document is followed by one and preceded by one.
EDGE = np.uint64(0x8C7F0AAC97C4AA2F)
#: What a word never seen counts, and the weight of a word's own share beside its share after the word before.
NEW, WEIGHT = 0.5, 10.0
TARGET, BACKGROUND, ASKED = 1, 2, 4


@dataclass
class Models:
    """Two matched bigram models over one vocabulary, all words of both corpora.

    p(b | a) = (c(a, b) + WEIGHT * q(b)) / (c(a) + WEIGHT),  q(b) = (c(b) + NEW) / (N + NEW * V),
    where c counts the corpus, scaled so that both models have the same number N of words (the smaller corpus's), and V
    is the size of the vocabulary. A document that belongs to a corpus is left out of that corpus's counts when it is
    scored itself.

    Held here are the words and the bigrams that make up a `share` of all occurrences or more, of which there can be only
    1 / share each, with how often each occurs in the target and in the background. All others' counts never leave the
    executors: `score` counts them where it looks them up.
    """

    total: tuple[int, int]
    size: int
    words: np.ndarray
    word_counts: np.ndarray
    bigrams: np.ndarray
    bigram_counts: np.ndarray

    def __post_init__(self):
        n = max(1, min(x for x in self.total if x) if any(self.total) else 1)
        self.scale = [n / x if x else 0.0 for x in self.total]
        self.whole = n + NEW * self.size

    def loss(self, k: int, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The loss of a word in model k by its own and its bigram's count there, and its part as the next one's context."""
        pair, word = pair * self.scale[k], word * self.scale[k]
        return -np.log(pair + WEIGHT * (word + NEW) / self.whole) + np.log(word + WEIGHT)


def place(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The position of each key in the sorted array known, -1 for others."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, hash of the bigram that it ends) for every word and every document's end, and words per document."""
    each = [words(t) for t in texts]
    n = np.array([len(w) for w in each])
    b = [np.append(w, EDGE) for w in each if len(w)]
    a = [np.concatenate([[EDGE], w]) for w in each if len(w)]
    of = np.repeat(np.arange(len(texts)), np.where(n > 0, n + 1, 0))
    if not b:
        return of, np.zeros(0, np.uint64), np.zeros(0, np.uint64), n
    b = np.concatenate(b)
    return of, b, mix(mix(np.concatenate(a)) + b), n


def marked(batch: pa.RecordBatch):
    """Pieces of a batch (doc_id, text, marks): ids, marks and texts."""
    for lo, hi, texts in blocks(batch, 1):
        yield batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_numpy(), texts


def fit(corpus: DataFrame, share: float = 2.0**-16, hold: int = 1 << 20) -> Models:
    """Models from corpus (doc_id, text, marks), marks being the sum of TARGET, BACKGROUND and ASKED.

    Every word of every text of both corpora is counted. Each task first sums up `hold` words at a time and passes on
    what makes up a `share` there (and occurs more than three times); what makes up a share in all is then counted
    exactly. The driver gets at most 2 / share keys. The vocabulary is counted as distinct words, which a task sums up
    before they are shuffled.
    """
    spark = corpus.sparkSession

    def frequent(batches):
        def close(part):
            b, h, w = (np.concatenate(x) for x in zip(*part))
            for kind, key in ((0, b), (1, h)):
                key, n = np.unique(key, return_counts=True)
                if kind == 0:
                    yield rows(2, key[key != EDGE], np.zeros(len(key) - (EDGE in key), np.int64))
                keep = n > max(3, share * len(b))
                yield rows(kind, key[keep], n[keep])
            yield rows(3, np.arange(2, dtype=np.uint64), np.array([((w & m) > 0).sum() for m in (TARGET, BACKGROUND)]))

        def rows(kind, key, n):
            return pa.record_batch({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        part, size = [], 0
        for batch in batches:
            for _, marks, texts in marked(batch):
                of, b, h, _ = bigrams(texts)
                part.append((b, h, marks[of]))
                size += len(b)
                if size >= hold:
                    yield from close(part)
                    part, size = [], 0
        if size:
            yield from close(part)

    learned = corpus.where(F.col("marks").bitwiseAND(TARGET + BACKGROUND) > 0)
    keys = learned.mapInArrow(frequent, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = stored(spark, keys.groupBy("kind", F.when(F.col("kind") != 2, F.col("key")).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("keys")))
    sums = {r["key"]: r["n"] for r in found.where("kind = 3").collect()}
    total = (sums.get(0, 0), sums.get(1, 0))
    size = sum(r["keys"] for r in found.where("kind = 2").collect())
    often = [np.sort(found.where((F.col("kind") == kind) & (F.col("n") >= share * max(total))).select("key").toArrow().column(0).to_numpy().view(np.uint64)) for kind in (0, 1)]

    def count(batches):
        n = [np.zeros((len(keys), 2), np.int64) for keys in often]
        for batch in batches:
            for _, marks, texts in marked(batch):
                of, b, h, _ = bigrams(texts)
                for keys, sums, x in zip(often, n, (b, h)):
                    at = place(keys, x)
                    for m in (0, 1):
                        sums[:, m] += np.bincount(at[(at >= 0) & ((marks[of] & (1 << m)) > 0)], minlength=len(keys))
        for kind, sums in enumerate(n):
            at = np.flatnonzero(sums.any(1))
            yield pa.record_batch({"kind": pa.array(np.full(len(at), kind, np.int32)), "at": pa.array(at), "t": pa.array(sums[at, 0]), "g": pa.array(sums[at, 1])})

    exact = learned.mapInArrow(count, "kind int, at long, t long, g long").groupBy("kind", "at").agg(F.sum("t").alias("t"), F.sum("g").alias("g")).toArrow()
    counts = [np.zeros((len(keys), 2), np.int64) for keys in often]
    for kind in (0, 1):
        of = exact.column("kind").to_numpy() == kind
        counts[kind][exact.column("at").to_numpy()[of]] = np.stack([exact.column(k).to_numpy()[of] for k in "tg"], 1)
    return Models(total, size, often[0], counts[0], often[1], counts[1])


_SENT = "bucket int, block long, ids array<long>, n array<long>, t array<double>, g array<double>, data binary"
_BACK = "block long, ids array<long>, n array<long>, t array<double>, g array<double>, data binary"


#: Columns of a block's bigrams: bigram (the lowest bits of its hash, and whether its word is rare), word (its hash if
#: rare, else its place among the frequent words), how often both occur in the document, and the document with its marks.
_ASKED = ("<u8", "<u8", "<u4", "<u4", "<u4")
#: Columns of what comes back: document, its losses in both models.
_TOLD = ("<u4", "<f8", "<f8")
#: So many bits of a bigram's hash travel, beside its word.
BITS = np.uint64(48)


def _pack(types: tuple[str, ...], *arrays: np.ndarray) -> bytes:
    """Arrays of the same length, byte by byte, so that bytes alike stand together, and compressed."""
    raw = b"".join(a.astype(t).view(np.uint8).reshape(len(a), -1).T.tobytes() for t, a in zip(types, arrays))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(types: tuple[str, ...], data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    parts = np.split(raw, np.cumsum(sizes)[:-1] * (len(raw) // sum(sizes)))
    return [np.ascontiguousarray(p.reshape(size, -1).T).view(t)[:, 0] for p, size, t in zip(parts, sizes, types)]


def score(corpus: DataFrame, models: Models, hold: int = 1 << 20, bucket_size: int = 1 << 20) -> DataFrame:
    """SCHEMA for every row of corpus (doc_id, text, marks) that is ASKED, by the models of the same corpus: the mean loss
    per word, the end being one, under both models, and ce_diff, target less background; lower means more like the target.

    Each document's distinct bigrams meet all others of their last word in a bucket: there the corpus's counts and each
    document's losses are summed up. Words and bigrams that are frequent (see Models) don't pile up in one bucket: frequent
    words' bigrams are dealt by bigram, and frequent bigrams are answered where the document is read. Documents
    travel as blocks of about `hold` bigrams, some ten bytes a bigram; sums come back per document and bucket, as doubles.

    corpus is to give its rows in the same order whenever it is read (a stored table does). Texts without words, and null
    ones, have no loss: zeros, n_tokens 0. Repeated rows come out as often as they occur; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored. Words are told apart by 64-bit hashes, and bigrams of one word
    by 48 bits of theirs.
    """
    spark = corpus.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(models.total) // bucket_size + 1)
    shared = spark.sparkContext.broadcast(models)

    def ask(batches):
        model, base, block = shared.value, TaskContext.get().partitionId() << 32, 0
        ids, heads, sent, size, docs = [], [], [], 0, 0

        def close():
            every = [np.concatenate(x) for x in zip(*sent)]
            bucket = every.pop()
            by = np.lexsort((every[0] >> BITS, bucket))
            at = np.searchsorted(bucket[by], np.arange(buckets + 1))
            x, y, n, m, d = (c[by] for c in every)
            use = np.flatnonzero(at[1:] > at[:-1])
            data = [_pack(_ASKED, x[s:e], y[s:e], n[s:e], m[s:e], np.diff(d[s:e], prepend=np.uint32(0))) for s, e in zip(at[use], at[use + 1])]
            columns = [pa.array([i for part in ids for i in part.to_pylist()], pa.int64()), *(pa.array(np.concatenate(h)) for h in zip(*heads))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([block % buckets], pa.int32()), pa.array([base + block]), *lists, pa.nulls(1, pa.binary())], names=["bucket", "block", "ids", "n", "t", "g", "data"])
            none = [pa.nulls(len(use), c.type) for c in lists]
            yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array(np.full(len(use), base + block)), *none, pa.array(data, pa.binary())], names=["bucket", "block", "ids", "n", "t", "g", "data"])

        for batch in batches:
            for some, marks, texts in marked(batch):
                of, b, h, length = bigrams(texts)
                by = np.lexsort((h, of))
                first = np.flatnonzero(np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (of[by][1:] != of[by][:-1])])) if len(h) else np.zeros(0, int)
                n = np.diff(np.append(first, len(h)))
                w = np.lexsort((b, of))
                new = np.concatenate([[True], (b[w][1:] != b[w][:-1]) | (of[w][1:] != of[w][:-1])]) if len(b) else np.zeros(0, bool)
                run = np.cumsum(new) - 1
                m = np.empty(len(b), np.int64)
                m[w] = np.bincount(run)[run] if len(b) else 0
                of, b, h, m = (c[by][first] for c in (of, b, h, m))
                mark = marks[of]
                in_words, in_pairs = place(model.words, b), place(model.bigrams, h)
                here = np.flatnonzero((in_words >= 0) & (in_pairs >= 0) & ((mark & ASKED) > 0))
                sums = []
                for k in (0, 1):
                    own = (mark[here] >> k) & 1
                    loss = model.loss(k, model.bigram_counts[in_pairs[here], k] - n[here] * own, model.word_counts[in_words[here], k] - m[here] * own)
                    sums.append(np.bincount(of[here], n[here] * loss, len(texts)).astype(float))
                away = np.flatnonzero((in_words < 0) | (in_pairs < 0))
                rare = in_words[away] < 0
                route = mix(np.where(rare, b[away], h[away]) ^ np.uint64(0xA24BAED4963EE407))
                x = h[away] & ((np.uint64(1) << BITS) - np.uint64(1)) | rare.astype(np.uint64) << BITS
                y = np.where(rare, b[away], in_words[away].astype(np.uint64))
                sent.append((x, y, n[away].astype(np.uint32), m[away].astype(np.uint32), ((of[away] + docs) * 8 + mark[away]).astype(np.uint32), ((route >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)))
                ids.append(some)
                heads.append((np.where((marks & ASKED) > 0, length, -1), *sums))
                size, docs = size + len(away), docs + len(texts)
                if size >= hold or docs >= 1 << 24:
                    yield from close()
                    ids, heads, sent, size, docs, block = [], [], [], 0, 0, block + 1
        if docs:
            yield from close()

    def answer(batches):
        model = shared.value

        def close(part):
            block = np.repeat(np.arange(len(part)), [len(columns[0]) for _, columns in part])
            x, y, n, m, d = (np.concatenate(c) for c in zip(*(columns for _, columns in part)))
            n, m, mark, doc = n.astype(np.int64), m.astype(np.int64), d & np.uint32(7), (d >> np.uint32(3)).astype(np.int64)
            rare = x >> BITS > 0
            pair, word = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            by = np.lexsort((x, y))
            other = (y[by][1:] != y[by][:-1]) | (rare[by][1:] != rare[by][:-1])
            word[by] = np.concatenate([[0], np.cumsum(other)])
            pair[by] = np.concatenate([[0], np.cumsum(other | (x[by][1:] != x[by][:-1]))])
            asked = (mark & ASKED) > 0
            sums = []
            for k in (0, 1):
                own = (mark >> k) & 1
                of_pair, of_word = np.bincount(pair, n * own)[pair], np.bincount(word, n * own)[word]
                if len(model.words):
                    of_word = np.where(rare, of_word, model.word_counts[np.where(rare, 0, y).astype(np.int64), k])
                loss = model.loss(k, of_pair - n * own, of_word - m * own)
                sums.append((n * loss)[asked])
            key, at = np.unique(block[asked] << 32 | doc[asked], return_inverse=True)
            sums = [np.bincount(at, s, len(key)) for s in sums]
            cut = np.searchsorted(key >> 32, np.arange(len(part) + 1))
            use = [i for i in range(len(part)) if cut[i] < cut[i + 1]]
            doc = key & 0xFFFFFFFF
            data = [_pack(_TOLD, np.diff(doc[s:e], prepend=0), *(v[s:e] for v in sums)) for s, e in ((cut[i], cut[i + 1]) for i in use)]
            none = [pa.nulls(len(use), pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([part[i][0] for i in use], pa.int64()), *none, pa.array(data, pa.binary())], names=["block", "ids", "n", "t", "g", "data"])

        bucket, part = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                if not batch.column(6)[row].is_valid:
                    yield pa.RecordBatch.from_arrays([c.slice(row, 1) for c in batch.columns[1:]], names=["block", "ids", "n", "t", "g", "data"])
                    continue
                if (k := batch.column(0)[row].as_py()) != bucket and part:
                    yield close(part)
                    part = []
                bucket = k
                x = _unpack(_ASKED, batch.column(6)[row].as_py())
                x[4] = np.cumsum(x[4], dtype=np.uint32)
                part.append((batch.column(1)[row].as_py(), x))
        if part:
            yield close(part)

    def total(batches):
        def close(head, parts):
            ids, n, t, g = head
            for data in parts:
                at, of_target, of_background = _unpack(_TOLD, data)
                at = np.cumsum(at.astype(np.int64))
                t[at] += of_target
                g[at] += of_background
            keep = n >= 0
            each = np.where(n > 0, n + 1, 1)
            t, g = (t / each)[keep], (g / each)[keep]
            return pa.record_batch({"doc_id": ids.filter(pa.array(keep)), "n_tokens": pa.array(n[keep]), "ce_target": pa.array(t), "ce_background": pa.array(g), "ce_diff": pa.array(t - g)})

        block, head, parts = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                k = batch.column(0)[row].as_py()
                if k != block and head is not None:
                    yield close(head, parts)
                    head, parts = None, []
                block = k
                if batch.column(5)[row].is_valid:
                    parts.append(batch.column(5)[row].as_py())
                else:
                    head = (batch.column(1)[row].values, *(batch.column(c)[row].values.to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4)))
        if head is not None:
            yield close(head, parts)

    rows = corpus.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("marks").cast("int"))
    answers = rows.mapInArrow(ask, _SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, _BACK)
    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(total, SCHEMA)


def together(docs: DataFrame, target: DataFrame, background: DataFrame) -> DataFrame:
    """The corpus of separate tables docs (doc_id, text), to be scored, target (text) and background (text)."""
    def some(df: DataFrame, mark: int) -> DataFrame:
        ids = F.col("doc_id").cast("long") if mark == ASKED else F.lit(None).cast("long")
        return df.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(mark).alias("marks"))

    return some(docs, ASKED).unionByName(some(target, TARGET)).unionByName(some(background, BACKGROUND))


def labelled(docs: DataFrame, good: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The corpus of docs (doc_id, text), all of it background and to be scored, with the ids of good (doc_id) as target.

    Up to `most` ids are broadcast; beyond that docs meet them by a shuffle and are stored.
    """
    good = good.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    small = good.count() <= most
    hit = (F.broadcast(good) if small else good).withColumn("hit", F.lit(TARGET))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hit, "doc_id", "left")
    joined = joined.select("doc_id", "text", (F.coalesce("hit", F.lit(0)) + BACKGROUND + ASKED).alias("marks"))
    return joined if small else stored(docs.sparkSession, joined)


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; the target is what the labels call good (quality 1), the background is all documents."""
    corpus = labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return score(corpus, fit(corpus))
