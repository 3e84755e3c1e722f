"""Best-fit packing with Martello-Toth dominance reduction.

Texts become token ids (byte-level BPE and an end id); one longer than a sequence is cut into full pieces behind a first
piece that holds the rest. How pieces share sequences depends on the counts of the at most 1024 lengths alone, so the
plan is made from that histogram on the driver, whatever the number of documents: dominance fixes, for every copy of a
length at once, a piece alone (nothing fits beside it), a pair that fills a sequence, or a pair whose partner no feasible
set of smaller pieces exceeds; best-fit decreasing packs the rest. Every piece then finds its place by its number among
the pieces of its length, which each partition counts by itself and a small table of offsets makes global.

Cases: a null or empty text is one piece of the end id alone; repeated rows and null ids are packed as rows of their
own; an empty table gives an empty table; other columns are ignored, or kept by `keep_packed`.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, save, small, strings, tokenizer_path

CAPACITY, END, WORDS_HELD = 1024, 2, 250_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of texts, as the vocabulary file gives them, as little-endian 32-bit bytes.

    A space before anything but white space always begins a new pre-token, so what lies between single spaces is encoded
    by itself and kept in a bounded cache; other texts are encoded whole.
    """

    def __init__(self):
        import tiktoken

        with open(tokenizer_path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})
        self.words = WordCache(lambda w: np.array(self.encoding.encode_ordinary(" " + w), dtype="<u4").tobytes(), WORDS_HELD)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        parts = text.split(" ")
        for i in range(1, len(parts)):
            if parts[i][:1].isspace():
                return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        first = np.array(self.encoding.encode_ordinary(parts[0]), dtype="<u4").tobytes()
        return first + b"".join(map(self.words.__getitem__, parts[1:]))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(k, capacity) for k in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long, nth long"


def _pieces_of(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = ByteBpe(), np.zeros(capacity + 1, dtype=np.int64)
        pid = TaskContext.get().partitionId()
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                ids = bpe.encode(text) + end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([pid] * len(doc), pa.int64()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    return run


def _reach(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """most[f]: the largest sum up to f of two or more pieces of the sizes, each as often as wanted; 0: none."""
    one = np.zeros(capacity + 1, dtype=bool)
    one[sizes] = True
    two = np.zeros(capacity + 1, dtype=bool)
    for s in sizes:  # sums of at least two, counted upwards so that earlier sums are complete
        two[s:] |= one[: capacity + 1 - s]
    for total in range(1, capacity + 1):
        if not two[total]:
            smaller = sizes[sizes < total]
            two[total] = bool(two[total - smaller].any())
    best = np.where(two, np.arange(capacity + 1), 0)
    return np.maximum.accumulate(best)


def reduce_dominated(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of counts (by length) the sets that dominate all others with their largest piece: (lengths, how often)."""
    fixed = []
    changed = True
    while changed and counts.any():
        changed = False
        sizes = np.flatnonzero(counts)
        most = _reach(sizes, capacity)
        for s in sizes[::-1]:
            if not counts[s]:
                continue
            free, present = capacity - int(s), np.flatnonzero(counts)
            own = 1 if counts[s] > 1 else 0
            fits = [int(x) for x in present[present <= free] if x != s or own]
            if not fits:
                fixed.append(((int(s),), int(counts[s])))
                counts[s], changed = 0, True
                continue
            best = max(fits)
            # a pair that fills the sequence, or whose partner no two or more pieces that fit exceed, dominates
            if best == free or most[free] <= best:
                times = int(counts[s] // 2 if best == s else min(counts[s], counts[best]))
                fixed.append(((int(s), best), times))
                counts[s] -= times
                counts[best] -= times
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over what is left; sequences filled alike are held as one entry with a number."""
    by_free: dict[int, list[list]] = {}  # free tokens -> [lengths, how often]
    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        counts[s] = 0
        while left:
            free = min((f for f, found in by_free.items() if f >= s and found), default=None)
            if free is None:
                each = capacity // s  # all of one length: a new sequence takes as many as fit
                times, rest = divmod(left, each)
                for lengths, n in (((s,) * each, times), ((s,) * rest, 1 if rest else 0)):
                    if n:
                        by_free.setdefault(capacity - s * len(lengths), []).append([lengths, n])
                left = 0
                continue
            lengths, n = by_free[free].pop()
            take = min(n, left)
            if take < n:
                by_free[free].append([lengths, n - take])
            by_free.setdefault(free - s, []).append([lengths + (s,), take])
            left -= take
    return [(lengths, n) for found in by_free.values() for lengths, n in found]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how often), from the number of pieces of each length."""
    counts = counts.astype(np.int64).copy()
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first number of each run of its pieces, the run's first sequence, and its place there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, n in patterns:
        at = 0
        for s in lengths:
            runs.setdefault(s, []).append((used.get(s, 0), base, at))
            used[s] = used.get(s, 0) + n
            at += s
        base += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def _places(slots: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for s in np.unique(length):
                mine = length == s
                first, base, at = slots[int(s)]
                k = np.searchsorted(first, number[mine], side="right") - 1
                sequence[mine] = base[k] + number[mine] - first[k]
                offset[mine] = at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = save(docs.select("doc_id", "text").mapInArrow(_pieces_of(capacity), PIECES), "pieces")
    counted = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    # by length, which has a row a partition: far fewer than pieces
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    slots = _slots(plan(counts, capacity))
    numbered = pieces.join(small(offsets.select("length", "pid", "base")), ["length", "pid"]).withColumn("number", F.col("base") + F.col("nth"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_places(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
