"""SimHash near-duplicates by random bit sampling.

A document's 256-bit SimHash is taken over its distinct shingles of five words (lower case, runs of letters, digits and
underscores; fewer than five words: one shingle of them all). Several tables each group documents by BITS sampled
coordinates; a bucket above CAP is split, its parts' leaders are searched together, and then all pairs of its rows that are
not yet in one class are compared, two blocks at a time. Candidates within LOOSE bits are verified: within TIGHT bits with
enough shingles the distance decides (such a pair is over 0.9 alike), else the exact Jaccard similarity of the shingle
sets, 0.8 or more. The links of the buckets' spanning forests are verified first, and of the other candidates those whose
ends these have not connected; every candidate of a bucket is one of the two. A class is a connected group of links; equal texts are one class whatever they hold.

Cases: a null text counts as empty; all empty texts are one class; a text without words is alike only to equal texts;
repeated rows are equal texts; a null doc_id keeps its row and its class; an empty table gives an empty table; other
columns are ignored, or kept unchanged by `keep_one`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, column, linked, save, searched, small, strings, two_hashes

WIDTH, WORDS = 256, 4
SHINGLE, SIMILARITY = 5, 0.8
TABLES, BITS, CAP = 32, 12, 4096
TIGHT, LOOSE, SURE = 20, 60, 32

_word = re.compile(r"\w+")
_mul = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_hash_of = WordCache(lambda w: xxhash.xxh64_intdigest(w), 400_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = _word.findall(text.lower())
    h = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h)
    if not n:
        return h
    size = min(n, SHINGLE)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out += h[k : n - size + 1 + k] * _mul[k]
    out = np.sort(_mix(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def simhash(found: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words: each bit is what most shingles have there."""
    count = np.zeros(WIDTH, dtype=np.int64)
    for k in range(0, len(found), 4080):
        part = found[k : k + 4080]
        spread = np.empty((len(part), WORDS), dtype=np.uint64)
        for j in range(WORDS):
            spread[:, j] = _mix(part + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bits = np.unpackbits(spread.view(np.uint8), axis=1)
        for b in range(0, len(part), 255):
            count += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(found)).view(np.uint64)


_SKETCH = f"doc_id long, h0 long, h1 long, n int, {', '.join(f's{i} long' for i in range(WORDS))}"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = np.empty(batch.num_rows, dtype=np.int32)
        sig = np.zeros((batch.num_rows, WORDS), dtype=np.uint64)
        for i, text in enumerate(strings(batch.column("text"))):
            found = shingles(text)
            count[i] = len(found)
            if len(found):
                sig[i] = simhash(found)
        words = sig.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h0"), batch.column("h1"), pa.array(count), *[pa.array(words[:, j].copy()) for j in range(WORDS)]], ["doc_id", "h0", "h1", "n", *[f"s{j}" for j in range(WORDS)]])


def _coordinates() -> np.ndarray:
    draw = np.random.default_rng(20_240_229)
    return np.stack([draw.permutation(WIDTH)[:BITS] for _ in range(TABLES)])


def _deal():
    """Rows for every table, with its bucket."""
    picks = _coordinates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2_000):
                batch = whole.slice(k, 2_000)
                sig = np.stack([column(batch, f"s{j}") for j in range(WORDS)], axis=1).astype(np.int64)
                bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1).astype(np.int64)
                keys = np.stack([(t << 40) | (bits[:, p] @ (1 << np.arange(BITS))) for t, p in enumerate(picks)], axis=1)
                row = np.repeat(np.arange(batch.num_rows), TABLES)
                arrays = [pa.array(keys.reshape(-1))] + [pa.array(column(batch, c)[row]) for c in ("h0", "n", *[f"s{j}" for j in range(WORDS)])]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "h0", "n", *[f"s{j}" for j in range(WORDS)]])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = [shingles(t).view(np.int64) for t in strings(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("h0"), part.column("h1"), pa.array(found, pa.list_(pa.int64()))], ["h0", "h1", "found"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        left, right = batch.column("fa"), batch.column("fb")
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(a) + len(b) - both))
        yield batch.select(["u0", "u1", "v0", "v1"]).filter(pa.array(keep, pa.bool_()))


def sketches(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    h0, h1 = two_hashes(text)
    return save(docs.select("doc_id", h0.alias("h0"), h1.alias("h1"), text.alias("text")).mapInArrow(_sketch, _SKETCH), "sketches")


def near_links(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(node, root), structs of h0 and h1: the different texts that verified candidates connect; see components."""
    sig = [f"s{j}" for j in range(WORDS)]
    nodes = save(sketch.filter("n > 0").groupBy("h0", "h1").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in sig]), "nodes")
    dealt = nodes.select("h0", "n", *sig).mapInArrow(_deal(), f"bucket long, h0 long, n int, {', '.join(f'{s} long' for s in sig)}")
    signed = lambda rows: rows.join(nodes.select("h0", "n", *sig), "h0")
    text = F.coalesce(F.col("text"), F.lit(""))
    h0, h1 = two_hashes(text)
    texts = docs.select("doc_id", h0.alias("h0"), h1.alias("h1"), text.alias("text"))
    node = lambda x: F.struct(F.col(f"{x}0").alias("h0"), F.col(f"{x}1").alias("h1"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x, y: nodes.select(F.col("h0").alias(f"{x}0"), F.col("h0").alias(f"{y}0"), F.col("h1").alias(f"{y}1"), F.col("n").alias(f"n{x}"))
        marked = save(pairs.join(side("a", "u"), "a0").join(side("b", "v"), "b0").withColumn("sure", (F.col("d") <= TIGHT) & (F.least("na", "nb") >= SURE)).select("u0", "u1", "v0", "v1", "sure"), "near-sized")
        open_ = marked.filter(~F.col("sure")).drop("sure")
        ends = open_.select(F.col("u0").alias("h0"), F.col("u1").alias("h1")).unionByName(open_.select(F.col("v0").alias("h0"), F.col("v1").alias("h1"))).distinct()
        wanted = save(ends.join(nodes.select("h0", "h1", F.col("doc_id").alias("least")), ["h0", "h1"]), "wanted")
        # one of a text's rows, or the few with one id, is fetched, not all its copies
        fetched = texts.join(small(wanted), ["h0", "h1"]).filter(F.col("doc_id").eqNullSafe(F.col("least")))
        found = save(fetched.select("h0", "h1", "text").mapInArrow(_sets, "h0 long, h1 long, found array<long>").dropDuplicates(["h0", "h1"]), "sets")
        own = lambda x, y: found.select(F.col("h0").alias(f"{x}0"), F.col("h1").alias(f"{x}1"), F.col("found").alias(f"f{y}"))
        exact = open_.join(own("u", "a"), ["u0", "u1"]).join(own("v", "b"), ["v0", "v1"]).mapInArrow(_jaccard, "u0 long, u1 long, v0 long, v1 long")
        return exact.unionByName(marked.filter("sure").drop("sure")).select(node("u").alias("u"), node("v").alias("v"))

    return linked([searched(dealt, signed, WORDS, TIGHT, LOOSE, CAP, "near", SIMILARITY, sure=SURE)], verify, "near", WORDS)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes of texts): the latter (h0, h1, class_id, root0, root1, copies) for texts with companions.

    root0, root1 name the text whose smallest doc_id is class_id.
    """
    sketch = sketches(docs)
    found = near_links(docs, sketch)
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    member = found.unionByName(roots).select("node.h0", "node.h1", "root")
    rows = sketch.groupBy("h0", "h1").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    mine = save(rows.join(member, ["h0", "h1"], "left").filter((F.col("copies") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", F.struct("h0", "h1"))), "members")
    # nulls last: a class has its smallest id, if it has one
    first = mine.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h0", "h1")).alias("f"), F.sum("copies").alias("size"))
    out = mine.join(small(save(first, "first")), "root").select("h0", "h1", F.col("f.doc_id").alias("class_id"), F.col("f.h0").alias("root0"), F.col("f.h1").alias("root1"), "copies", F.col("size").alias("class_size"))
    return sketch, save(out, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size (its rows)."""
    sketch, found = classes(docs)
    joined = sketch.select("doc_id", "h0", "h1").join(small(found.select("h0", "h1", "class_id", "class_size")), ["h0", "h1"], "left")
    return joined.select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: the one with its smallest doc_id. All columns stay as they are."""
    _, found = classes(docs)
    own = "_q" * (1 + max(len(c) for c in docs.columns))  # longer than any column's name
    h0, h1 = two_hashes(F.coalesce(F.col("text"), F.lit("")))
    names = {c: f"{own}{i}" for i, c in enumerate(found.columns)}
    table = small(found).select(*[F.col(c).alias(n) for c, n in names.items()])
    marked = docs.withColumn(f"{own}a", h0).withColumn(f"{own}b", h1)
    joined = marked.join(table, (F.col(f"{own}a") == F.col(names["h0"])) & (F.col(f"{own}b") == F.col(names["h1"])), "left")
    alone = F.col(names["h0"]).isNull()
    first = (F.col(names["h0"]) == F.col(names["root0"])) & (F.col(names["h1"]) == F.col(names["root1"])) & F.col("doc_id").eqNullSafe(F.col(names["class_id"]))
    kept = joined.filter(alone | first)
    # rows repeated with one id and text are one document; few, as all others are gone by now
    single = kept.filter(alone | (F.col(names["copies"]) == 1)).select(*docs.columns)
    repeated = kept.filter(~alone & (F.col(names["copies"]) > 1)).dropDuplicates([f"{own}a", f"{own}b"]).select(*docs.columns)
    return single.unionByName(repeated)
