"""Helpers shared by the operators: saved tables, streamed groups, linked signatures, components."""

from __future__ import annotations

import atexit
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the smaller side of a join may be broadcast (at most about 40 bytes a row).
BROADCAST_ROWS = 500_000
#: Rows of a block of a large bucket; two blocks are compared at a time.
BLOCK = 8192
#: Times that the leaders of a split bucket's parts are searched together.
ROUNDS = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine), a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is scratch space
        pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a saved table for broadcast if it has at most that many rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, *names: str) -> str:
    """A column name that no column of df has."""
    name = names[0] if names else "q"
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column, one at a time; null: empty."""
    for x in column:
        yield x.as_py() or ""


def two_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("quern"), text)


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by keys; a group is in one table."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(count - 1, dtype=bool)
        for key in keys:
            values = table[key].combine_chunks() if table[key].num_chunks != 1 else table[key].chunk(0)
            values = values.to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        ends = np.flatnonzero(change)
        if len(ends):
            cut = int(ends[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    values = table[name] if isinstance(table, pa.Table) else table.column(name)
    return values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


LINKS = "kind int, a0 long, b0 long, d int"
#: Kinds of rows of LINKS: a link of a bucket's spanning forest, another candidate, a row (b0) of part d of a large bucket (a0) of which only a forest is there.
TREE, OTHER, LARGE = 0, 1, 2


def _rows(kind: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 50_000):
        s = slice(k, k + 50_000)
        x, y = (a[s], b[s]) if kind == LARGE else (np.minimum(a[s], b[s]), np.maximum(a[s], b[s]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(x), pa.array(y), pa.array(d[s].astype(np.int32))], ["kind", "a0", "b0", "d"])


def _lead(own: np.ndarray, tight: int) -> Iterator[int]:
    """Rows that lead: each other row is within `tight` of a leader before it."""
    todo, first = np.ones(len(own), dtype=bool), 0
    while first < len(own):
        yield first
        todo[distances(own, own[first]) <= tight] = False
        todo[first] = False
        rest = np.flatnonzero(todo[first:])
        first = first + int(rest[0]) if len(rest) else len(own)


def _apart(length: np.ndarray, n: np.ndarray | int, ratio: float) -> np.ndarray:
    """Where sizes differ by more than the ratio allows."""
    return np.minimum(length, n) < ratio * np.maximum(length, n)


def _tree(own: np.ndarray, length: np.ndarray, loose: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest links that connect all rows which links within `loose` connect (a minimum spanning forest)."""
    far = np.iinfo(np.int64).max
    best, by = np.full(len(own), far), np.zeros(len(own), dtype=np.int64)
    left, at, found = np.arange(1, len(own)), 0, []
    while len(left):
        d = distances(own[left], own[at])
        if ratio:
            d[_apart(length[left], length[at], ratio)] = far
        nearer = left[d < best[left]]
        best[nearer] = d[d < best[left]]
        by[nearer] = at
        k = int(np.argmin(best[left]))
        at = int(left[k])
        if best[at] <= loose:
            found.append((by[at], at, best[at]))
        left = np.delete(left, k)
    i, j, d = np.array(found, dtype=np.int64).reshape(-1, 3).T
    return i, j, d


def _few(own: np.ndarray, length: np.ndarray, loose: int, ratio: float, a_row: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All pairs within `loose`, if they are at most `a_row` for each row."""
    found, count = [], 0
    for k in range(0, len(own), 64):
        d = np.bitwise_count(own[k : k + 64, None, 0] ^ own[None, k:, 0]).astype(np.uint16)
        for w in range(1, own.shape[1]):
            d += np.bitwise_count(own[k : k + 64, None, w] ^ own[None, k:, w])
        i, j = np.nonzero(d <= loose)
        i, j = i[i < j], j[i < j]
        keep = ~_apart(length[k + i], length[k + j], ratio)
        i, j = i[keep], j[keep]
        found.append((k + i, k + j, d[i, j]))
        count += len(i)
        if count > a_row * len(own):
            return None
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the links of a spanning forest, earlier links first, the class of each of the n rows)."""
    label, kept, left = np.arange(n), [], np.arange(len(i))
    while True:
        a, b = label[i[left]], label[j[left]]
        apart = a != b
        if not apart.any():
            return np.concatenate(kept) if kept else left[:0], label
        left, low, high = left[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        joined, at = np.unique(high, return_index=True)
        kept.append(left[at])
        parent = np.arange(n)
        parent[joined] = low[at]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _groups_of(table: pa.Table, words: int) -> tuple[np.ndarray, ...]:
    """(buckets, parts, nodes, signatures, starts of groups, their sizes)"""
    bucket, part = column(table, "bucket"), column(table, "part")
    sig = np.stack([column(table, f"s{i}") for i in range(words)], axis=1).astype(np.int64).view(np.uint64)
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    return bucket, part, column(table, "h0"), sig, starts, np.diff(np.r_[starts, len(bucket)])


def _links_of(words: int, tight: int, loose: int, every: int, ratio: float = 0.0, sure: int | None = None, other: tuple[int, int] | None = None) -> Callable:
    """Streams sorted buckets and links near signatures.

    Buckets of at most `every` rows: all their pairs are compared, all rows with those a few places on at once whatever
    their bucket, and all within `loose` are linked whose sizes allow it (least / greatest n is `ratio` or more). A link
    within `tight` of rows of `sure` or more needs no further check: of such links a spanning forest stays, and rows that
    it connects get no other. Of a larger bucket that has many near pairs a minimum spanning forest is linked, and its rows are
    named, so that the caller can have the rest of its pairs by `rest_of_buckets`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ["bucket", "part"]):
            bucket, part, node, sig, starts, sizes = _groups_of(table, words)
            n = len(bucket)
            length = column(table, "n") if "n" in table.column_names else np.ones(n, dtype=np.int32)
            end = np.repeat(np.where(sizes <= every, starts + sizes, starts), sizes)
            size_of, most = np.repeat(sizes, sizes), int(sizes[sizes <= every].max(initial=0))
            at = np.flatnonzero((size_of <= every) & (size_of > 1))
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lag in range(1, most):
                if lag in (1, 4, 16, 32, 64, 128):  # rows of buckets that still reach so far; buckets stay together
                    at = at[size_of[at] > lag]
                    flat = [np.ascontiguousarray(sig[at, w]) for w in range(words)]
                d = np.bitwise_count(flat[0][lag:] ^ flat[0][:-lag]).astype(np.uint16)
                for f in flat[1:]:
                    d += np.bitwise_count(f[lag:] ^ f[:-lag])
                hit = np.flatnonzero(d <= loose)
                i, j = at[hit], at[hit + lag]
                own = (j < end[i]) & ~_apart(length[i], length[j], ratio)
                if other:
                    own &= (d[hit] <= other[1]) | (bucket[i] < other[0])
                if own.any():
                    near.append((i[own], j[own], d[hit[own]]))
            for start, size in zip(starts[sizes > every].tolist(), sizes[sizes > every].tolist(), strict=True):
                own = slice(start, start + size)
                near_by = other[1] if other and bucket[start] >= other[0] else loose
                few = _few(sig[own], length[own], near_by, ratio)
                if few is not None:
                    near.append((few[0] + start, few[1] + start, few[2]))
                    continue
                i, j, d = _tree(sig[own], length[own], near_by, ratio)
                yield from _rows(TREE, node[own][i], node[own][j], d)
                yield from _rows(LARGE, bucket[own], node[own], part[own])
            if near:
                i, j, d = map(np.concatenate, zip(*near, strict=True))
                order = np.argsort(d, kind="stable")
                i, j, d = i[order], j[order], d[order]
                if sure is not None:
                    certain = (d <= tight) & (np.minimum(length[i], length[j]) >= sure)
                    places = np.flatnonzero(certain)
                    kept, label = _forest(i[places], j[places], n)
                    yield from _rows(TREE, node[i[places[kept]]], node[j[places[kept]]], d[places[kept]])
                    rest = np.flatnonzero(label[i] != label[j])
                    i, j, d = i[rest], j[rest], d[rest]
                first = np.zeros(len(i), dtype=bool)
                first[_forest(i, j, n)[0]] = True
                yield from _rows(TREE, node[i[first]], node[j[first]], d[first])
                yield from _rows(OTHER, node[i[~first]], node[j[~first]], d[~first])

    return run


def _rest_of(words: int, loose: int, ratio: float) -> Callable:
    """Streams sorted pairs of blocks of a bucket's rows with labels (l0, l1) and links all near rows with different labels.

    Rows of side 0 are compared with those of side 1, or with each other where a block is paired with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for table in complete_groups(batches, ["bucket", "part"]):
            _, _, node, sig, starts, sizes = _groups_of(table, words)
            length = column(table, "n") if "n" in table.column_names else np.ones(len(node), dtype=np.int32)
            side = column(table, "side")
            _, label = np.unique(np.stack([column(table, "l0"), column(table, "l1")], axis=1), axis=0, return_inverse=True)
            label = label.reshape(-1)
            for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                own = slice(start, start + size)
                s, n, x, name, y = sig[own], length[own], label[own], node[own], side[own]
                values, counts = np.unique(x, return_counts=True)
                most, at = values[np.argmax(counts)], np.arange(size)
                alone = y.min() == y.max()
                # rows of the largest label meet the others from these
                for i in np.flatnonzero(x != most).tolist():
                    to = np.flatnonzero((x != x[i]) & ((x == most) | (at > i)) & (alone | (y != y[i])))
                    d = distances(s[to], s[i])
                    hit = np.flatnonzero((d <= loose) & ~_apart(n[to], n[i], ratio))
                    held.append((np.full(len(hit), name[i]), name[to[hit]], d[hit]))
                    count += len(hit)
                    if count >= 50_000:
                        yield from _rows(OTHER, *map(np.concatenate, zip(*held, strict=True)))
                        held, count = [], 0
        if count:
            yield from _rows(OTHER, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _leaders_of(words: int, tight: int) -> Callable:
    """Streams sorted parts of split buckets and returns the rows that lead in their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ["bucket", "part"]):
            _, _, _, sig, starts, sizes = _groups_of(table, words)
            keep = [start + first for start, size in zip(starts.tolist(), sizes.tolist(), strict=True) for first in _lead(sig[start : start + size], tight)]
            if keep:
                yield from table.take(pa.array(keep)).combine_chunks().to_batches()

    return run


def _dealt(rows: DataFrame, cap: int, level: int, heavy: DataFrame | None) -> DataFrame:
    """rows with part: 0, or in a heavy bucket one of as many as it has times `cap` rows, by a hash of h0."""
    if heavy is None:
        return rows.withColumn("part", F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64("h0", F.lit(level)), F.ceil(F.col("rows") / cap))
    return rows.join(small(heavy), "bucket", "left").withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "h0")


def heavy_buckets(rows: DataFrame, cap: int, name: str) -> DataFrame:
    """(bucket, rows) of the buckets of more than `cap` rows, by the sixteenth of the rows whose h0 says so; saved."""
    # small caps are those of tests
    share = 16 if cap >= 256 else 1
    seen = rows.filter(F.pmod(F.shiftrightunsigned("h0", 20), F.lit(share)) == 0).groupBy("bucket").agg((F.count(F.lit(1)) * share).alias("rows"))
    return save(seen.filter(F.col("rows") > cap), f"{name}-heavy")


def link_buckets(rows: DataFrame, words: int, tight: int, loose: int, cap: int, every: int = 64, name: str = "links", ratio: float = 0.0, sure: int | None = None, other: tuple[int, int] | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """Candidates (kind, a0, b0, d), see LINKS, between rows of one bucket whose signatures differ in at most `loose` bits; saved.

    rows: bucket long, h0 long, s0... long, and n int if sizes count. Buckets of at most `every` rows give all their
    pairs (but see _links_of), those up to `cap` a minimum spanning forest, and `rest_of_buckets` gives what is left. A
    bucket of more than `cap` rows (`heavy`, else by `heavy_buckets`) is split into parts of about `cap` rows by a hash of
    h0; each part is searched, and the parts' leaders, then a much smaller bucket, are searched together, again in parts if
    they are too many, the last time in one part of up to BLOCK rows. That links near copies cheaply; the other pairs of its parts are what `searched` has
    `rest_of_buckets` compare. Which buckets are split changes no candidate. other: (first bucket, the `loose` of
    buckets from there on).
    """
    found = None
    sized = "n" in rows.columns
    own = ["h0", *(["n"] if sized else []), *[f"s{i}" for i in range(words)]]
    rows = rows.select("bucket", *own)
    for level in range(ROUNDS):
        if level == ROUNDS - 1:
            cap = max(cap, BLOCK)
        if level or heavy is None:
            heavy = heavy_buckets(rows, cap, name)
        any_heavy = bool(heavy.head(1))
        dealt = _dealt(rows, cap, level, heavy if any_heavy else None)
        part = _in_order(dealt.select("bucket", "part", *own)).mapInArrow(_links_of(words, tight, loose, every, ratio, sure, other), LINKS)
        found = part if found is None else found.unionByName(part)
        if not any_heavy or level == ROUNDS - 1:
            break
        split = _in_order(dealt.filter(F.col("rows").isNotNull()).select("bucket", "part", *own))
        rows = save(split.mapInArrow(_leaders_of(words, tight), split.schema).drop("part"), f"{name}-leaders")
    return save(found.groupBy("a0", "b0", F.when(F.col("kind") == LARGE, F.col("d")).alias("k")).agg(F.min("kind").alias("kind"), F.min("d").alias("d")).select("kind", "a0", "b0", "d"), name)


def searched(rows: DataFrame, signed: Callable, words: int, tight: int, loose: int, cap: int, name: str, ratio: float, **more) -> tuple:
    """A search of `linked`: the candidates of `link_buckets`, what signs its rows, its loose and ratio, and the rows
    (bucket, h0) of the buckets that were split, null if none was."""
    heavy = heavy_buckets(rows, cap, name)
    found = link_buckets(rows, words, tight, loose, cap, name=name, ratio=ratio, heavy=heavy, **more)
    split = rows.join(small(heavy), "bucket", "left_semi").select("bucket", "h0") if heavy.head(1) else None
    return found, signed, loose, ratio, split


def rest_of_buckets(found: DataFrame, signed: Callable, labels: DataFrame, words: int, loose: int, ratio: float = 0.0, split: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The candidates (kind, a0, b0, d) that `link_buckets` left out: near rows of one large bucket with different labels.

    signed: from (bucket, h0, l0, l1, parts) to the same with s0... and n. labels: (h0, l0, l1) of rows that have one, not
    their own; a row without is its own label. split: (bucket, h0) of the buckets that were split, all their rows. Buckets
    all of whose rows have one label, such as those of a group of near copies, are left out before signatures are fetched.
    A bucket of more than `block` rows is dealt to blocks of about so many, and every two of them are compared by some task.
    """
    some = found.filter(F.col("kind") == LARGE).select(F.col("a0").alias("bucket"), F.col("b0").alias("h0"))
    some = (some if split is None else some.unionByName(split)).distinct()
    some = save(some.join(small(labels), "h0", "left").withColumn("l0", F.coalesce("l0", "h0")).withColumn("l1", F.coalesce("l1", F.lit(0))), "large")
    if not some.head(1):
        return found.limit(0)
    mixed = some.groupBy("bucket").agg(F.min("l0").alias("x"), F.max("l0").alias("y"), F.min("l1").alias("u"), F.max("l1").alias("v"), F.count(F.lit(1)).alias("rows"))
    mixed = save(mixed.filter("x <> y or u <> v").select("bucket", F.ceil(F.col("rows") / block).cast("long").alias("parts")), "large-mixed")
    own = signed(some.join(small(mixed), "bucket")).withColumn("own", F.pmod(F.xxhash64("h0", F.lit(-1)), "parts"))
    both = own.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = both.withColumn("part", F.least("own", "x") * F.col("parts") + F.greatest("own", "x")).withColumn("side", (F.col("own") > F.col("x")).cast("int"))
    return _in_order(both.drop("own", "x", "parts")).mapInArrow(_rest_of(words, loose, ratio), LINKS)


def linked(searches: list[tuple[DataFrame, Callable, int, float]], verify: Callable, name: str, words: int) -> DataFrame:
    """(node, root), structs of h0 and h1: the rows that verified candidates connect; see `components`.

    searches: candidates of `link_buckets`, what signs its rows (see rest_of_buckets), its loose and its ratio, and the rows
    of its split buckets (see searched), without which rows of two parts meet by leaders only. verify: from candidates (a0, b0, d) with a0 and b0 the h0 of rows to verified links (u, v). The links of the spanning forests are
    verified first; of the other candidates, those of large buckets included, only what they have not connected.
    """
    ends = ["a0", "b0", "d"]
    pairs = lambda kind: functools.reduce(DataFrame.unionByName, [found.filter(F.col("kind") == kind).select(*ends) for found, *_ in searches])
    once = lambda rows: rows.groupBy("a0", "b0").agg(F.min("d").alias("d"))
    found = save(components(verify(once(pairs(TREE))), f"{name}-parts"), f"{name}-roots")
    root = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    label = save(root.select(F.col("node.h0").alias("h0"), F.col("root.h0").alias("l0"), F.col("root.h1").alias("l1")).dropDuplicates(["h0"]), f"{name}-labels")
    a = label.select(F.col("h0").alias("a0"), F.col("l0").alias("la"), F.col("l1").alias("ma"))
    b = label.select(F.col("h0").alias("b0"), F.col("l0").alias("lb"), F.col("l1").alias("mb"))
    left = pairs(OTHER).join(small(a), "a0", "left").join(small(b), "b0", "left").filter("la is null or lb is null or la <> lb or ma <> mb").select(*ends)
    for links, signed, loose, ratio, *split in searches:
        left = left.unionByName(rest_of_buckets(links, signed, label, words, loose, ratio, *split).select(*ends))
    more = save(once(left), f"{name}-rest")
    # links of classes, which connect what the first ones have left apart
    a, b = (found.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    links = verify(more).join(small(a), "u", "left").join(small(b), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    over = save(components(links, f"{name}-joined"), f"{name}-over")
    moved = found.join(small(over.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # roots and rows alone that have come under another root
    return save(moved.unionByName(over), f"{name}-linked")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v), root the smallest node it is connected with; no root's own row.

    Alternating large and small stars: each round takes every node's smallest neighbour by a pre-aggregated minimum and
    a join, so that a hub's links are never in one task. Rounds are saved; their number grows with the logarithm, and
    more than `rounds` are an error.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = save(links.filter(F.col("u") != F.col("v")).select(*pair).distinct(), name)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        lower = moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


@functools.cache
def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder may be named in QUERN_TOKENIZERS."""
    folder = os.environ.get("QUERN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache(dict):
    """word -> value, made on demand; emptied when it holds `limit` words, so that memory stays bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
