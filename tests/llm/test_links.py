"""Candidates of a bucket: all of them reach verification."""

import numpy as np

from quern.llm import common
from quern.llm.common import link_buckets, save


def _bucket(spark, sigs, sizes=None):
    rows = [(1, i, i, s, sizes[i] if sizes else 1) for i, s in enumerate(sigs)]
    return save(spark.createDataFrame(rows, "bucket long, h0 long, h1 long, s0 long, n int"), "test")


def test_small_buckets_keep_every_candidate(spark):
    draw = np.random.default_rng(2)
    sigs = [int(sum(1 << int(b) for b in draw.choice(60, 3, replace=False))) for _ in range(40)]
    found = {(r.a0, r.b0) for r in link_buckets(_bucket(spark, sigs), 1, 1, 6, cap=500).collect()}
    assert found == {(a, b) for a in range(40) for b in range(a + 1, 40) if (sigs[a] ^ sigs[b]).bit_count() <= 6}


def test_only_certain_links_stand_for_others(spark):
    # 0 to 19 are certain copies; 20 to 24 are near all of them but too short to be certain; 25 has another size
    sigs = [1 << i for i in range(20)] + [3 << (2 * i + 20) for i in range(5)] + [1]
    sizes = [40] * 20 + [31] * 5 + [90]
    links = {(r.a0, r.b0) for r in link_buckets(_bucket(spark, sigs, sizes), 1, 2, 6, cap=500, ratio=0.7, sure=32).collect()}
    assert sum(b < 20 for _, b in links) == 19 and {x for a, b in links if b < 20 for x in (a, b)} == set(range(20))
    assert {(a, b) for a, b in links if b >= 20} == {(a, b) for b in range(20, 25) for a in range(b)}


def _reached(found, n):
    label = list(range(n))
    for r in found:
        if r.kind != 2:
            a, b = label[r.a0], label[r.b0]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_large_buckets_connect_what_their_pairs_connect(spark):
    draw = np.random.default_rng(8)
    sigs = [int(x) for x in draw.integers(0, 2**62, 8)]
    sigs = [sigs[k % 8] ^ sum(1 << int(b) for b in draw.choice(60, int(draw.integers(0, 4)), replace=False)) for k in range(200)]
    found = link_buckets(_bucket(spark, sigs), 1, 1, 5, cap=500, every=20).collect()
    label = list(range(200))
    for a in range(200):
        for b in range(a + 1, 200):
            if (sigs[a] ^ sigs[b]).bit_count() <= 5 and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    assert _reached(found, 200) == label


def test_pairs_that_trees_leave_apart_are_verified(spark):
    # a and b are each alike c by signature, but only a and b are alike in truth: the forest links them through c
    from pyspark.sql import functions as F

    from quern.llm.common import linked

    sigs = [0b000, 0b110, 0b011] + [1 << (10 + k) | 1 << 40 for k in range(30)]
    rows = _bucket(spark, sigs)
    truth = {(1, 2), (5, 20)}
    for every in (64, 4):  # all pairs, and a large bucket of which a forest is linked

        def verify(pairs):
            ok = F.concat_ws(",", "a0", "b0").isin([f"{a},{b}" for a, b in truth])
            end = lambda x: F.struct(F.col(x).alias("h0"), F.col(x).alias("h1"))
            return pairs.filter(ok).select(end("a0").alias("u"), end("b0").alias("v"))

        found = link_buckets(rows, 1, 0, 3, cap=500, every=every)
        signed = lambda some: some.join(rows.select("h0", "n", "s0"), "h0")
        got = {(r.node.h0, r.root.h0) for r in linked([(found, signed, 3, 0.0)], verify, "test", 1).collect()}
        assert got == {(2, 1), (20, 5)}


def test_split_buckets_link_what_their_leaders_miss(spark):
    # all rows are near each other by signature, so that each part has one leader, but only some pairs are alike in truth
    from pyspark.sql import functions as F

    from quern.llm.common import linked, searched

    draw = np.random.default_rng(4)
    sigs = [sum(1 << int(b) for b in draw.choice(60, 2, replace=False)) for _ in range(120)]
    rows = _bucket(spark, sigs)
    truth = {tuple(sorted(map(int, draw.choice(120, 2, replace=False)))) for _ in range(40)}

    def verify(pairs):
        ok = F.concat_ws(",", "a0", "b0").isin([f"{a},{b}" for a, b in truth])
        end = lambda x: F.struct(F.col(x).alias("h0"), F.col(x).alias("h1"))
        return pairs.filter(ok).select(end("a0").alias("u"), end("b0").alias("v"))

    signed = lambda some: some.join(rows.select("h0", "n", "s0"), "h0")
    want = list(range(120))
    for _ in range(120):
        for a, b in truth:
            want[a] = want[b] = min(want[a], want[b])
    own = common.rest_of_buckets.__defaults__
    for block in (8192, 16):
        common.rest_of_buckets.__defaults__ = (*own[:-1], block)
        got = {r.node.h0: r.root.h0 for r in linked([searched(rows, signed, 1, 4, 4, 10, "test", 0.0)], verify, "test", 1).collect()}
        assert [got.get(k, k) for k in range(120)] == want
    common.rest_of_buckets.__defaults__ = own
