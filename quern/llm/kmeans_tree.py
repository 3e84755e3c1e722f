"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most SAMPLE vectors (the first by a hash of their number) and has at most LEAVES
leaves, so that it is small at any size. Every row is indexed: it goes down to the nearest child at each node. Largest
inner products are nearest points once each vector has one component more that brings all to the same length. A query
takes nodes from a priority queue, nearest first, and so visits leaves in an order of its own. How many it visits is
widened until calibration, on at most PROBES queries with exact neighbours found by a full scan, reaches RECALL.

Neighbouring leaves share blocks of bounded size; a leaf too large for one, as of many equal vectors, takes several. A
query is dealt once to each block that holds a leaf it visits, and all rows there are scored on the original vectors.

Cases: vectors null, zero, or with null or non-finite components, and rows without an id, take no part; vectors of
another length than the query's are no candidates (each length has a tree of its own); equal rows are candidates of one
another, ties go to the smaller vec_id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import BLOCK_VALUES, matrix, search_blocks, usable

SAMPLE, LEAVES, BRANCH, LEAF_ROWS = 16_384, 1024, 8, 128
PROBES, RECALL, EVERY, K = 200, 0.95, 20, 20


class Tree:
    """Nodes in depth-first order: centres, children (empty for a leaf), and each leaf's number."""

    def __init__(self, x: np.ndarray, leaves: int, longest: float, seed: int = 5):
        self.longest = longest
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        draw = np.random.default_rng(seed)
        self._grow(self.lifted(x), leaves, draw)
        self.centre = np.stack(self.centres)
        self.half = (self.centre**2).sum(1) / 2
        self.leaf = np.full(len(self.children), -1, dtype=np.int64)
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def _grow(self, x: np.ndarray, leaves: int, draw: np.random.Generator) -> int:
        at = len(self.children)
        self.centres.append(x.mean(0))
        self.children.append([])
        if leaves <= 1 or len(x) < 2 * BRANCH:
            return at
        parts = self._parts(x, min(BRANCH, leaves), draw)
        if len(parts) > 1:
            for part in parts:
                self.children[at].append(self._grow(part, max(1, round(leaves * len(part) / len(x))), draw))
        return at

    @staticmethod
    def _parts(x: np.ndarray, k: int, draw: np.random.Generator) -> list[np.ndarray]:
        centre = x[draw.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(8):
            near = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
            centre = np.stack([x[near == j].mean(0) if (near == j).any() else centre[j] for j in range(len(centre))])
        near = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        return [x[near == j] for j in range(len(centre)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: the nearest child, node after node."""
        x, node = self.lifted(x), np.zeros(len(x), dtype=np.int64)
        for at, own in enumerate(self.children):  # children come after their parents
            mine = np.flatnonzero(node == at)
            if own and len(mine):
                node[mine] = np.array(own)[(x[mine] @ self.centre[own].T - self.half[own]).argmax(1)]
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query its first `most` leaves, best bin first."""
        far = self.half - np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.centre.T
        out = []
        for row in far.tolist():
            queue, seen = [(0.0, 0)], []
            while queue and len(seen) < most:
                _, node = heapq.heappop(queue)
                own = self.children[node]
                if own:
                    for child in own:
                        heapq.heappush(queue, (row[child], child))
                else:
                    seen.append(int(self.leaf[node]))
            out.append(seen)
        return out


def _assigned(tree: Tree, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), batch.column("dim"), batch.column("v"), pa.array(leaf)], ["uid", "vec_id", "dim", "v", "leaf"])

    return run


def _dealt(tree: Tree, dim: int, most: int, blocks: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                to = [sorted({b for leaf in seen for b in range(*blocks[leaf])}) for seen in tree.visits(matrix(part.column("v"), dim), most)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(t) for t in to]))
                block = np.array([b for t in to for b in t], dtype=np.int64)
                for a in range(0, len(block), 4_000):
                    own = row.slice(a, 4_000)
                    yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 4_000]), *[part.column(c).take(own) for c in ("uid", "vec_id", "dim", "v")]], ["block", "uid", "vec_id", "dim", "v"])

    return run


class Rows:
    def __init__(self, uid: np.ndarray, x: np.ndarray):
        self.uid, self.x = uid, x
        self.length = np.sqrt((x**2).sum(1))


def best_products(block: Rows, uids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k largest inner products; equal rows get equal scores wherever they stand."""
    near = q @ block.x.T
    out = []
    for i, uid in enumerate(uids):
        row = near[i]
        own = np.flatnonzero(block.uid == uid)
        row[own] = -np.inf
        n = len(row) - len(own)
        if n > k:
            # the fast product may be off by rounding: all that may be among the k best are scored again
            slack = 1e-12 * block.length.max() * np.sqrt((q[i] ** 2).sum())
            place = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack)
        else:
            place = np.flatnonzero(row > -np.inf)
        score = (block.x[place] * q[i]).sum(1)
        best = np.lexsort((place, -score))[:k]  # rows of a block are sorted by vec_id
        out.append((place[best], score[best]))
    return out


def _exact(rows: DataFrame, probes: pa.Table, dim: int, k: int) -> DataFrame:
    """(quid, uid, leaf) of each probe's k nearest by a full scan."""
    uid, q = probes["uid"].to_numpy(), matrix(probes["v"].combine_chunks(), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, leaf, vec = (batch.column(c).to_numpy() for c in ("uid", "leaf", "vec_id"))
                found = best_products(Rows(own, matrix(batch.column("v"), dim)), uid, q, k)
                place = np.concatenate([p for p, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, [len(p) for p, _ in found])), pa.array(vec[place]), pa.array(leaf[place]), pa.array(np.concatenate([s for _, s in found]))], ["quid", "vec_id", "leaf", "score"])

    found = rows.mapInArrow(run, "quid long, vec_id long, leaf long, score double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k)


def calibrate(tree: Tree, rows: DataFrame, probes: pa.Table, dim: int, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit, and the probes' recall then."""
    if not probes.num_rows:
        return tree.leaves, 1.0
    rank = {}
    for uid, seen in zip(probes["uid"].to_pylist(), tree.visits(matrix(probes["v"].combine_chunks(), dim), tree.leaves), strict=True):
        rank[uid] = {leaf: i for i, leaf in enumerate(seen)}
    # at most PROBES * k rows
    needed = np.sort([rank[r.quid][r.leaf] for r in _exact(rows, probes, dim, k).select("quid", "leaf").collect()])
    if not len(needed):
        return tree.leaves, 1.0
    most = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return most, float((needed < most).mean())


def _first(rows: DataFrame, n: int) -> pa.Table:
    """At most n rows, the first by a hash of their number."""
    return rows.orderBy(F.xxhash64("uid"), "uid").limit(n).select("uid", "v").toArrow()


def _one_length(rows: DataFrame, dim: int, every: int, k: int, recall: float) -> DataFrame:
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).head()
    sample = matrix(_first(rows, SAMPLE)["v"].combine_chunks(), dim)
    tree = Tree(sample, max(1, min(LEAVES, n // LEAF_ROWS)), float(longest))
    at = save(rows.mapInArrow(_assigned(tree, dim), "uid long, vec_id long, dim int, v array<double>, leaf long"), "leaves")
    queries = at.filter(F.col("vec_id") % every == 0)
    most, _ = calibrate(tree, at, _first(queries, PROBES), dim, k, recall)
    counts = {r.leaf: r["n"] for r in at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most LEAVES rows
    size, blocks, used, filled = max(256, BLOCK_VALUES // dim), [], 0, 0
    for leaf in range(tree.leaves):
        c = counts.get(leaf, 0)
        if filled and filled + c > size:
            used, filled = used + 1, 0
        if c > size:
            parts = -(-c // size)
            blocks.append((used, used + parts))
            used += parts
        else:
            blocks.append((used, used + 1))
            filled += c
    table = rows.sparkSession.createDataFrame([(i, a, b - a) for i, (a, b) in enumerate(blocks)], "leaf long, first long, parts long")
    dealt = at.join(F.broadcast(table), "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    asked = queries.select("uid", "vec_id", "dim", "v").mapInArrow(_dealt(tree, dim, most, blocks), "block long, uid long, vec_id long, dim int, v array<double>")
    return search_blocks(dealt.drop("leaf", "first", "parts"), asked, Rows, best_products, k, "double")


def nearest(embeddings: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row whose id `every` divides."""
    rows = usable(embeddings, zeros=False)
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in rows.groupBy("dim").agg(F.count(F.lit(1))).orderBy("dim").collect():  # one row a length
        out = out.unionByName(_one_length(rows.filter(F.col("dim") == row.dim), row.dim, every, k, recall))
    return out
