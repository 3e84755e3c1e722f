"""Vectors and queries in blocks: a block of rows is held by one task, the queries for it stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Components in a block (4 MB as doubles), and queries that are scored against it at once.
BLOCK_VALUES, AT_ONCE = 1 << 19, 256


def usable(embeddings: DataFrame, zeros: bool) -> DataFrame:
    """(uid, vec_id, dim, v): the vectors that take part, saved; uid numbers the rows. Null ids take no part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = embeddings.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(~F.coalesce(bad, F.lit(True)))
    if not zeros:
        found = found.filter(F.exists("v", lambda x: x != 0.0))
    saved = save(found.select("vec_id", F.size("v").alias("dim"), "v"), "vectors")
    # numbered over a saved table, so that a task that runs again gives the same numbers
    return save(saved.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "dim", "v"), "numbered")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (block, query uids, query vectors, k) -> for every query the places of its k best rows in the block, and their scores
Kernel = Callable[[object, np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]


def _search(prepare: Callable, kernel: Kernel, k: int, kind: pa.DataType):
    """Streams rows sorted by block, dim and kind: first (kind 0) the block's rows, then (kind 1) its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, ids = None, [], None, None

        def ready():
            uid, vec, x = (np.concatenate(p) for p in zip(*held, strict=True))
            order = np.lexsort((uid, vec))
            return (uid[order], vec[order]), prepare(uid[order], x[order])

        for batch in batches:
            if not batch.num_rows:
                continue
            at, dims, kinds = (batch.column(c).to_numpy() for c in ("block", "dim", "kind"))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (dims[1:] != dims[:-1]) | (kinds[1:] != kinds[:-1])])
            for start, end in zip(edges, np.r_[edges[1:], len(at)], strict=True):
                part = batch.slice(start, end - start)
                now = (at[start], dims[start])
                if now != key:
                    key, held, block = now, [], None
                uid, vec = part.column("uid").to_numpy(), part.column("vec_id").to_numpy()
                if kinds[start] == 0:
                    held.append((uid, vec, matrix(part.column("v"), int(dims[start]))))
                    continue
                if not held:
                    continue
                if block is None:
                    ids, block = ready()
                for a in range(0, len(uid), AT_ONCE):
                    s = slice(a, a + AT_ONCE)
                    found = kernel(block, uid[s], matrix(part.column("v").slice(a, AT_ONCE), int(dims[start])), k)
                    n = [len(p) for p, _ in found]
                    if not sum(n):
                        continue
                    place = np.concatenate([p for p, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid[s], n)), pa.array(np.repeat(vec[s], n)), pa.array(ids[0][place]), pa.array(ids[1][place]), pa.array(np.concatenate([x for _, x in found]), kind)], ["quid", "query_id", "uid", "vec_id", "score"])

    return run


def search_blocks(rows: DataFrame, queries: DataFrame, prepare: Callable, kernel: Kernel, k: int, score: str) -> DataFrame:
    """Each query's k best of the rows in the blocks it is dealt to: query_id, rank, vec_id, score.

    rows and queries: block, uid, vec_id, dim, v. Only the k best of a block leave it.
    """
    names = ["block", "dim", "kind", "uid", "vec_id", "v"]
    both = rows.withColumn("kind", F.lit(0)).select(names).unionByName(queries.withColumn("kind", F.lit(1)).select(names))
    kind = pa.int64() if score == "long" else pa.float64()
    found = both.repartition("block").sortWithinPartitions("block", "dim", "kind", "uid").mapInArrow(_search(prepare, kernel, k, kind), f"quid long, query_id long, uid long, vec_id long, score {score}")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_of(uid: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("long")
