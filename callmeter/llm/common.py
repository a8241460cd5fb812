"""What the corpus operators share: tables, stored intermediate results, hashing and graph classes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one process (a
    local master), a new local one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files go when it ends, not when the driver happens to collect its garbage. For
    actions whose results are stored: a DataFrame made within it is better not run twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def with_row(spark: SparkSession, docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with column `name`, a number of each row's own that stays the same whenever docs are read again.

    For rows scanned from Parquet files it is a 64-bit hash of the file and the row's place in it. Other docs are stored
    first, with a number.
    """
    kept = [c for c in docs.columns if c != name]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*kept, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
                raise
    return stored(spark, docs.select(*kept, F.monotonically_increasing_id().alias(name)))


# ---- 64-bit hashing in numpy; equal on every worker and in every run ----

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


class Bytes:
    """A byte string of which any slice is hashed in constant time."""

    def __init__(self, raw: np.ndarray):
        up, self._down = _power(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=self._sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(text: str) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of text with A-Z lower-cased, in order."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return Bytes(raw).slices(edge[0::2], edge[1::2])


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of text's n-word shingles; of the whole sequence where it has fewer words."""
    w = words(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _BASE + w[i : len(w) - n + 1 + i])
    return np.unique(h)


# ---- classes of linked nodes ----


class Forest:
    """Joins points 0..n-1 and keeps the joins that mattered: edges that span the classes, fewer than n."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, x: int, others: np.ndarray) -> None:
        """Joins x with each of the others; of those known to be together, with one."""
        for y in others[np.unique(self.root[others], return_index=True)[1]].tolist():
            self.unite(x, y)

    def unite(self, x: int, y: int) -> None:
        r, s = self.find(x), self.find(y)
        if r != s:
            self.root[max(r, s)] = min(r, s)
            self.edges.append((x, y))


def spanning(batches):
    """Batches of edges (a, b) reduced to a forest that joins the same nodes: as a whole, what a task has."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.unite(x, y)
        root = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
        other = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch({"a": pa.array(nodes[other]), "b": pa.array(nodes[root[other]])})


def components(spark: SparkSession, edges: DataFrame, reduced: bool = False) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the smallest node reachable.

    Each partition's edges are first reduced to a forest, unless `reduced` says that they are (a producer in Python does
    it itself, so that a task needs one Python worker, not two). Then come alternating large-star and small-star rounds:
    each keeps a number of edges linear in the input, groups only with map-side minima, and is stored in the shared
    folder. It ends when every node has one edge and leads to a node without any. Minima are stored before edges meet
    them: a join of two plain shuffles can be split where a node has very many edges.
    """
    def minima(e: DataFrame) -> DataFrame:
        return stored(spark, e.groupBy("a").agg(F.min("b").alias("m")))

    e = edges.where("a <> b").select("a", "b")
    e = stored(spark, e if reduced else e.mapInArrow(spanning, "a long, b long"))
    while True:
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").limit(1).count() == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(both).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = minima(e)
        e = e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = stored(spark, e)
    star = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
