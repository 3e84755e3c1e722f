"""Exact top-k by vector-approximation files.

Components x become floor(256 * x); the score is the integer inner product. Rows are dealt to blocks by a hash of their
number, and every query to every block. A block keeps for each component a cell of at most CELLS between the block's
least and greatest value; the scan of the cells bounds every score from above and below. Exact vectors are then read in
the order of their upper bounds, until the kth score found is above the next bound. The blocks' k best are merged.

Cases: vectors null or with null or non-finite components, and rows without an id, take no part; vectors of another
length than the query's are no candidates; all-zero and empty vectors score 0; equal rows are candidates of one another,
ties go to the smaller vec_id; scores beyond 64 bits are held at its ends; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BLOCK_VALUES, block_of, search_blocks, usable

SCALE, CELLS, EVERY, K, READ = 256, 128, 50, 5, 32


class VaFile:
    """A block's cells, their lower ends and widths, and its exact vectors."""

    def __init__(self, uid: np.ndarray, x: np.ndarray):
        self.uid, self.exact = uid, np.floor(SCALE * x)
        self.place = {}
        low, high = (self.exact.min(0), self.exact.max(0)) if self.exact.size else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        self.width = np.maximum(np.ceil((high - low + 1) / CELLS), 1)
        self.low = low
        self.cells = ((self.exact - low) // self.width).astype(np.uint8)
        self.largest = float(np.abs(self.exact).max()) if self.exact.size else 0.0
        order = np.argsort(uid)
        self.sorted_uid, self.order = uid[order], order

    def where(self, uid: int) -> int:
        """The place of a row, or -1."""
        k = int(np.searchsorted(self.sorted_uid, uid))
        return int(self.order[k]) if k < len(self.sorted_uid) and self.sorted_uid[k] == uid else -1


def _dots(x: np.ndarray, q: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if safe:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in whole], dtype=np.int64)


def scan(block: VaFile, uids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    queries = np.floor(SCALE * vectors)
    n, dim = block.exact.shape
    top = float(np.abs(queries).max()) if queries.size else 0.0
    # below this every product and sum of the scan is a whole number that a double holds exactly
    safe = (block.largest + 2 * float(block.width.max(initial=1)) + 1) * (top + 1) * max(dim, 1) < 2**53
    if safe:
        ends = block.low + block.cells * block.width
        upper = queries @ ends.T + (np.maximum(queries, 0) @ (block.width - 1))[:, None]
        gap = np.abs(queries) @ (block.width - 1)  # upper less lower bound, the same for all rows
    out = []
    for i, (uid, q) in enumerate(zip(uids, queries, strict=True)):
        own = block.where(uid)
        if not safe:
            score = _dots(block.exact, q, False)
            place = np.arange(n)
        else:
            bound = upper[i]
            if own >= 0:
                bound = bound.copy()
                bound[own] = -np.inf
            if n > k:
                least = np.partition(bound, n - k)[n - k] - gap[i]
                place = np.flatnonzero(bound >= least)
            else:
                place = np.flatnonzero(bound > -np.inf)
            place = place[np.argsort(-bound[place], kind="stable")]
            score, kth = np.empty(len(place), dtype=np.int64), -np.inf
            read = 0
            while read < len(place) and bound[place[read]] >= kth:
                s = slice(read, read + READ)
                score[s] = _dots(block.exact[place[s]], q, True)
                read = min(read + READ, len(place))
                if read >= k:
                    kth = np.partition(score[:read], read - k)[read - k]
            place, score = place[:read], score[:read]
        if own >= 0:
            other = place != own
            place, score = place[other], score[other]
        best = np.lexsort((place, -score.astype(np.float64) if safe else np.array([-int(v) for v in score], dtype=object)))[:k]  # rows of a block are sorted by vec_id
        out.append((place[best], score[best]))
    return out


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest score for each row whose id `every` divides."""
    rows = usable(embeddings, zeros=True)
    values = rows.agg(F.sum(F.greatest("dim", F.lit(1)))).head()[0] or 0
    blocks = max(1, -(-int(values) // BLOCK_VALUES))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return search_blocks(rows.withColumn("block", block_of(F.col("uid"), blocks)), queries, VaFile, scan, k, "long")
