"""Near duplicates among embeddings by cover trees and dual traversal (operator 6)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table

LEAF = 64
BLOCK = 1024


class CoverTree:
    """Nested levels over unit vectors. A node's children are points of it, its centre first, each further than the level's
    radius from the others; every point of the node is within that radius of the child it belongs to, and the radius
    halves from level to level. A node of LEAF points or fewer isn't split further.

    Nodes are arrays: centre (a point), radius (the largest distance from the centre to any point below), children, and
    the points' range in `order`.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.children, self.range = [], [], [], []
        todo = [(self._node(0, len(x)), 2.0)]
        while todo:
            node, cover = todo.pop()
            todo += [(child, cover / 2) for child in self._split(node, min(cover, self.radius[node]) / 2)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.size = np.array([hi - lo for lo, hi in self.range])

    def _distance(self, c: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[points] @ self.x[c])))

    def _node(self, lo: int, hi: int) -> int:
        self.centre.append(self.order[lo])
        self.radius.append(float(self._distance(self.order[lo], self.order[lo:hi]).max()))
        self.children.append(np.zeros(0, np.int64))
        self.range.append((lo, hi))
        return len(self.centre) - 1

    def _split(self, node: int, cover: float) -> list[int]:
        lo, hi = self.range[node]
        if hi - lo <= LEAF or self.radius[node] < 1e-9:
            return []
        points, nearest, label = self.order[lo:hi].copy(), np.full(hi - lo, np.inf), np.zeros(hi - lo, int)
        k = far = 0
        while nearest[far] > cover:
            d = self._distance(points[far], points)
            d[far] = 0
            closer = d < nearest
            nearest[closer], label[closer] = d[closer], k
            k, far = k + 1, int(np.argmax(nearest))
        by = np.lexsort((nearest, label))
        self.order[lo:hi] = points[by]
        ends = lo + np.searchsorted(label[by], np.arange(k + 1))
        self.children[node] = np.array([self._node(int(a), int(b)) for a, b in zip(ends, ends[1:])])
        return self.children[node].tolist()


def pairs(a: CoverTree, b: CoverTree, least: float):
    """Dual traversal: yields (rows of a, rows of b, matrix of links or True where all link), for all pairs of points.

    All pairs of children of two nodes are looked at together: those whose centres are further apart than the threshold's
    distance and both covering radii are set aside, those that stay below it with both radii are taken whole, and the
    others are descended into, or, where the bounds leave most of the pairs of points, compared point by point. With a is
    b, every pair of nodes comes once.
    """
    limit = math.sqrt(2 - 2 * least)
    slack = 1e-6  # bounds are in floating point; whatever is near them is compared point by point
    same = a is b
    stack = [(0, 0)]

    def points(t: CoverTree, i: int) -> np.ndarray:
        return t.order[t.range[i][0] : t.range[i][1]]

    while stack:
        i, j = stack.pop()
        own = same and i == j
        ca, cb = (t.children[k] if len(t.children[k]) else np.array([k]) for t, k in ((a, i), (b, j)))
        d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[ca]] @ b.x[b.centre[cb]].T)))
        both = a.radius[ca][:, None] + b.radius[cb][None, :]
        open_ = d - both <= limit + slack
        if own:
            open_ = np.triu(open_)
        whole = open_ & (d + both < limit - slack)
        if own:
            np.fill_diagonal(whole, False)
        left = open_ & ~whole
        work = (a.size[ca][:, None] * b.size[cb][None, :])[left].sum()
        if len(ca) == len(cb) == 1 and ca[0] == i and cb[0] == j or 4 * work * (2 if own else 1) >= a.size[i] * b.size[j]:
            p, q = points(a, i), points(b, j)
            m = a.x[p] @ b.x[q].T >= least
            if m.any():
                yield p, q, m
            continue
        for x, y in np.argwhere(whole):
            yield points(a, ca[x]), points(b, cb[y]), True
        stack += [(int(ca[x]), int(cb[y])) for x, y in np.argwhere(left)]


def link(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point of a and of b the weight of the points linked with it, and spanning edges (positions, b's after
    a's): a forest of the links, so that dense groups give a number of edges linear in their points."""
    same, n = a is b, len(a.x)
    ca, cb = np.zeros(n, np.int64), np.zeros(len(b.x), np.int64)
    root = np.arange(n + (0 if same else len(b.x)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []

    def join(x: int, y: int) -> None:
        r, s = find(x), find(y)
        if r != s:
            root[max(r, s)] = min(r, s)
            edges.append((x, y))

    for p, q, m in pairs(a, b, least):
        overlap = same and np.array_equal(p, q)
        if m is True:
            ca[p] += wb[q].sum()
            if overlap:
                ca[p] -= wa[p]
            else:
                cb[q] += wa[p].sum()
            for y in q:
                join(int(p[0]), int(y) + (0 if same else n))
            for x in p[1:]:
                join(int(x), int(q[0]) + (0 if same else n))
            continue
        if overlap:
            m = m & ~np.eye(len(p), dtype=bool)
        ca[p] += m @ wb[q]
        if not overlap:
            cb[q] += m.T @ wa[p]
        rows = np.flatnonzero(m.any(1))
        for x in rows:
            hit = np.flatnonzero(m[x])
            ids = root[q[hit] + (0 if same else n)]
            for y in q[hit[np.unique(ids, return_index=True)[1]]]:
                join(int(p[x]), int(y) + (0 if same else n))
    if same:
        return ca + cb, cb, np.array(edges, np.int64).reshape(-1, 2)
    return ca, cb, np.array(edges, np.int64).reshape(-1, 2)


PACKED = "label long, cell int, block long, width int, centre array<double>, radius double, nodes binary, weights binary, data binary"


def usable(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, embedding) with vector, the embedding in doubles, and node, the hash of label and vector:
    null where the label or vector is null, or the vector is empty, zero, or holds a null or non-finite component. Vectors
    whose squares could leave the range of doubles are brought to a largest component of 1."""
    rows = rows.withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    most = F.array_max(F.transform("vector", F.abs))
    rows = rows.withColumn("vector", F.when((most > 0) & ((most < 1e-100) | (most > 1e100)) & (most < float("inf")), F.transform("vector", lambda x: x / most)).otherwise(F.col("vector")))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vector", lambda x: x != 0)
    good = F.col("label").isNotNull() & F.coalesce(~bad & ~zero, F.lit(False))
    return rows.withColumn("node", F.when(good, F.xxhash64("label", "vector")))


def packed(spark: SparkSession, nodes: DataFrame, block: int = BLOCK, most: int = 64) -> DataFrame:
    """Blocks of about `block` nodes (label, node, weight, vector; stored), each one row (PACKED).

    The upper levels of one cover tree per label and vector length, made by Spark: about one pivot for every `block`
    nodes, `most` at most, picked by hash, split a label of more than a block into cells by the nearest pivot; larger
    cells are split by hash. Counts are map-side sums of ids. What vectors are joined with is stored first, so that the
    shuffle of a hot label can be split, and they are then dealt by block, not by label.
    """
    key = ["label", "width"]
    nodes = nodes.withColumn("width", F.size("vector"))
    ids = nodes.select("node", *key)
    big = stored(spark, ids.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    step = F.ceil(F.col("n") / F.least(F.lit(most), F.ceil(F.col("n") / block)))
    chosen = ids.join(big, key).where(F.pmod(F.xxhash64("node"), step) == 0).select("node")
    pivots = stored(spark, nodes.join(chosen, "node", "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("vector")).alias("pivots")))

    def dot(p):
        return F.aggregate(F.zip_with("vector", p, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * x))

    nearest = F.array_max(F.transform("pivots", lambda p, i: F.struct(dot(p).alias("d"), i.alias("i"))))["i"]
    cells = stored(spark, nodes.join(pivots, key, "left").select("node", *key, F.coalesce(nearest, F.lit(0)).alias("cell")))
    parts = stored(spark, cells.groupBy(*key, "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")))
    place = cells.join(parts, [*key, "cell"]).select("node", "cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("part"))
    dealt = nodes.join(place, "node").repartition(*key, "cell", "part")
    rows = dealt.groupBy(*key, "cell", "part").agg(F.collect_list(F.struct("node", "weight", "vector")).alias("rows"))
    rows = rows.select(*key, "cell", F.xxhash64(*key, "cell", "part").alias("block"), "rows").select("label", "width", "cell", "block", "rows")

    def pack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(4)[k].values
                width = batch.column(1)[k].as_py()
                x = np.ascontiguousarray(rows.field(2).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
                u = x / np.sqrt((x * x).sum(1))[:, None]
                mean = u.mean(0)
                centre = u[int(np.argmax(u @ mean))]
                radius = float(np.sqrt(np.maximum(0, 2 - 2 * (u @ centre))).max())
                yield pa.record_batch({
                    "label": batch.column(0).slice(k, 1), "cell": batch.column(2).slice(k, 1), "block": batch.column(3).slice(k, 1), "width": batch.column(1).slice(k, 1),
                    "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]),
                    "nodes": pa.array([rows.field(0).to_numpy().tobytes()]), "weights": pa.array([rows.field(1).to_numpy().tobytes()]), "data": pa.array([u.tobytes()]),
                })

    return rows.mapInArrow(pack, PACKED)


def near_pairs(spark: SparkSession, blocks: DataFrame, least: float = 0.93) -> DataFrame:
    """(a, b, linked) over stored blocks: rows without b give the weight of the nodes that a pair of blocks links with
    node a; rows with b are links that span all linked classes.

    Pairs of blocks of a label whose centres are further apart than the limit and both radii are set aside; each
    remaining pair is a dual traversal of two cover trees in one task, of bounded size.
    """
    limit = math.sqrt(2 - 2 * least) + 1e-6
    head = blocks.select("label", "width", "block", "centre", "radius")
    x, y = head.alias("x"), head.alias("y")
    dot = F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) - F.col("x.radius") - F.col("y.radius")
    both = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.width") == F.col("y.width")) & (F.col("x.block") <= F.col("y.block")) & (apart <= limit))
    both = both.select(F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    data = [blocks.select(F.col("block").alias(k), F.struct("width", "nodes", "weights", "data").alias(f"of_{k}")) for k in "pq"]
    both = both.join(data[0], "p").join(data[1], "q").select("p", "q", "of_p", "of_q").repartition("p", "q")

    def traverse(batches):
        def load(s):
            return CoverTree(np.frombuffer(s["data"], np.float64).reshape(-1, s["width"])), np.frombuffer(s["weights"], np.int64), np.frombuffer(s["nodes"], np.int64)

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                ta, wa, na = load(batch.column(2)[k].as_py())
                tb, wb, nb = (ta, wa, na) if same else load(batch.column(3)[k].as_py())
                ca, cb, edges = link(ta, tb, wa, wb, least)
                ids = na if same else np.concatenate([na, nb])
                sums = ca if same else np.concatenate([ca, cb])
                hit = np.flatnonzero(sums)
                a = np.concatenate([ids[hit], ids[edges[:, 0]]])
                b = pa.array(np.concatenate([np.zeros(len(hit), np.int64), ids[edges[:, 1]]]), mask=np.arange(len(a)) < len(hit))
                yield pa.record_batch({"a": pa.array(a), "b": b, "linked": pa.array(np.concatenate([sums[hit], np.zeros(len(edges), np.int64)]))})

    return both.mapInArrow(traverse, "a long, b long, linked long")


def near_classes(spark: SparkSession, rows: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, label, embedding).

    Rows link where labels are equal and the cosine, in doubles, is at least `least`. Rows of no use (see usable) link
    with nothing; a row with a null vec_id links like any other, has the least id that it reaches as its component, null
    where there is none, and isn't kept; repeated rows link with each other and come out as
    often as they occur; vectors of different lengths don't link; an empty table gives no rows; other columns are
    ignored. Equal vectors are one weighted node, so a group of copies costs what one vector does. Labels may be of any
    type that can be hashed; labels and vectors are told apart by 64-bit hashes.
    """
    rows = usable(rows.select("vec_id", "label", "embedding"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.xxhash64(F.first("label")).alias("label"), F.first("vector").alias("vector"))
    nodes = stored(spark, nodes)
    found = stored(spark, near_pairs(spark, stored(spark, packed(spark, nodes)), least))
    linked = found.where("b is null").groupBy("a").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "node")
    member = components(spark, found.where("b is not null").select("a", "b"))
    ids = nodes.select("node", "least_id", "weight").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Stored: a join of two plain shuffles can be split where a class or a group of copies is hot.
    least_ids = stored(spark, ids.groupBy("root").agg(F.min("least_id").alias("component_id")))
    ids = ids.join(least_ids, "root").join(linked, "node", "left").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"))
    ids = stored(spark, ids)
    out = rows.select("vec_id", "node").join(ids, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, table(spark, sf_dir, "embeddings"))
