"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of CHUNK + OVERLAP bytes that cover it whole. Learned byte vectors
pass FILTERS learned filters, 8 bytes wide, every 4 bytes; each filter's maximum over a chunk feeds a small hidden layer,
and the mean and the maximum of the chunks' hidden values give the text's one probability that its label is 1.

The network is fitted on the driver, on at most SAMPLE labelled texts a class of at most SAMPLE_BYTES bytes (256 kB) each, the
first by a hash of doc_id; scoring reads every text whole. The sample's balance is corrected to that of all labels.

Cases: a null text counts as empty and gets a score as any other; a null doc_id is scored and not held out; labels that
are null, not 0 or 1, or without a document are ignored, a document labelled twice has its larger label; without labels
of both kinds every score is the share of label 1 (0.5 without labels); an empty table gives an empty table; other
columns never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import strings

CHUNK, OVERLAP, DIMS, FILTERS, HIDDEN = 448, 64, 8, 48, 24
ROWS, SPAN = CHUNK // 4, (CHUNK + OVERLAP) // 4 - 1  # positions from chunk to chunk, and in a chunk
SAMPLE, SAMPLE_BYTES, STEPS, BATCH = 2500, 262_144, 900, 32
SEGMENT = 128  # chunks that are worked on at once
PAD = 256


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _segments(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """Padded bytes of up to SEGMENT chunks, and how many they are."""
    chunks = max(1, -(-(len(data) - OVERLAP) // CHUNK))
    raw = np.frombuffer(data, dtype=np.uint8)
    for first in range(0, chunks, SEGMENT):
        n = min(SEGMENT, chunks - first)
        out = np.full(n * CHUNK + OVERLAP, PAD, dtype=np.int16)
        part = raw[first * CHUNK : first * CHUNK + len(out)]
        out[: len(part)] = part
        yield out, n


def _starts(counts: list[int]) -> np.ndarray:
    """First position of every chunk of the segments laid end to end."""
    base = np.cumsum([0, *[n * ROWS + OVERLAP // 4 for n in counts[:-1]]])
    return np.concatenate([b + ROWS * np.arange(n) for b, n in zip(base, counts, strict=True)])


class Network:
    """Parameters by name; all float32 arrays."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        make = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"bytes": make(257, DIMS) * 16, "filters": make(8 * DIMS, FILTERS), "fb": np.zeros(FILTERS, np.float32), "w1": make(FILTERS, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": make(2 * HIDDEN, 1)[:, 0], "b2": np.zeros(1, np.float32)}

    def pooled(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each chunk's maximum of every filter."""
        p, half = self.p, 4 * DIMS
        rows = p["bytes"][tokens].reshape(-1, half)
        out = rows[:-1] @ p["filters"][:half]
        out += rows[1:] @ p["filters"][half:]
        bounds = np.stack([starts, starts + SPAN], axis=1).reshape(-1)
        out = np.concatenate([out, np.full((2, FILTERS), -np.inf, np.float32)]) if bounds[-1] >= len(out) else out
        return np.maximum(np.maximum.reduceat(out, bounds, axis=0)[::2] + p["fb"], 0)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One number a text; segments are gathered to about 64 kB."""
        total = np.zeros((len(texts), HIDDEN), np.float64)
        most = np.full((len(texts), HIDDEN), -np.inf, np.float64)
        chunks = np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def flush():
            nonlocal size
            if held:
                counts = [n for _, _, n in held]
                hidden = np.maximum(self.pooled(np.concatenate([t for _, t, _ in held]), _starts(counts)) @ self.p["w1"] + self.p["b1"], 0)
                at = np.cumsum([0, *counts[:-1]])
                sums, tops = np.add.reduceat(hidden, at, axis=0), np.maximum.reduceat(hidden, at, axis=0)
                for k, (i, _, n) in enumerate(held):
                    total[i] += sums[k]
                    most[i] = np.maximum(most[i], tops[k])
                    chunks[i] += n
                held.clear()
                size = 0

        for i, data in enumerate(texts):
            for tokens, n in _segments(data):
                held.append((i, tokens, n))
                size += len(tokens)
                if size >= 65_536:
                    flush()
        flush()
        return np.concatenate([total / np.maximum(chunks, 1)[:, None], most], axis=1) @ self.p["w2"].astype(np.float64) + self.p["b2"][0]

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over a batch of short texts."""
        p, half = self.p, 4 * DIMS
        parts = [(i, *s) for i, t in enumerate(texts) for s in _segments(t)]
        counts = [n for *_, n in parts]
        owner = np.repeat([i for i, *_ in parts], counts)
        tokens, starts = np.concatenate([t for _, t, _ in parts]), _starts(counts)
        rows = p["bytes"][tokens].reshape(-1, half)
        pre = rows[:-1] @ p["filters"][:half] + rows[1:] @ p["filters"][half:]
        place = starts[:, None] + pre[starts[:, None] + np.arange(SPAN)].argmax(axis=1)  # chunk x filter
        top = pre[place, np.arange(FILTERS)] + p["fb"]
        pool = np.maximum(top, 0)
        hid = pool @ p["w1"] + p["b1"]
        act = np.maximum(hid, 0)
        n = len(texts)
        share = 1 / np.bincount(owner, minlength=n).astype(np.float32)
        mean = np.stack([np.bincount(owner, act[:, k], n) for k in range(HIDDEN)], axis=1) * share[:, None]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most = np.maximum.reduceat(act, first, axis=0)
        both = np.concatenate([mean, most], axis=1).astype(np.float32)
        z = np.clip(both @ p["w2"] + p["b2"], -30, 30)
        dz = ((1 / (1 + np.exp(-z))) - labels).astype(np.float32) / n
        g = {"w2": both.T @ dz, "b2": dz.sum(keepdims=True)}
        spread = dz[owner, None]
        dact = spread * share[owner, None] * p["w2"][:HIDDEN] + spread * p["w2"][HIDDEN:] * (act >= most[owner]) * (act > 0)
        dhid = dact * (hid > 0)
        g |= {"w1": pool.T @ dhid, "b1": dhid.sum(0)}
        dtop = (dhid @ p["w1"].T) * (top > 0)
        g["fb"] = dtop.sum(0)
        window = tokens[(place * 4)[:, :, None] + np.arange(8)]  # chunk x filter x byte
        seen = p["bytes"][window].reshape(len(starts), FILTERS, -1)
        g["filters"] = np.einsum("cfd,cf->df", seen, dtop, optimize=True)
        back = (dtop[:, :, None] * p["filters"].T[None]).reshape(-1, DIMS)
        flat = window.reshape(-1)
        g["bytes"] = np.stack([np.bincount(flat, back[:, d], 257) for d in range(DIMS)], axis=1)
        return g


def fit(texts: list[bytes], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 11) -> Network:
    """A network fitted by Adam; `share` is that of label 1 among all labels, to which the sample is corrected."""
    net = Network()
    labels = np.asarray(labels, np.float32)
    prior = lambda x: np.log(min(max(x, 1e-3), 1 - 1e-3) / (1 - min(max(x, 1e-3), 1 - 1e-3)))
    if len(set(labels.tolist())) < 2:
        net.p["w2"][:] = 0
        net.p["b2"][0] = prior(share)
        return net
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v, np.float32) for k, v in net.p.items()}
    second = {k: np.zeros_like(v, np.float32) for k, v in net.p.items()}
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = [*order, *draw.permutation(len(texts)).tolist()]
        pick, order = order[:BATCH], order[BATCH:]
        rate = 0.006 * min(1, step / 30) * (0.5 + 0.5 * np.cos(np.pi * step / (steps + 1)))
        for k, v in net.gradient([texts[i] for i in pick], labels[pick]).items():
            first[k] = 0.9 * first[k] + 0.1 * v.astype(np.float32)
            second[k] = 0.99 * second[k] + 0.01 * v.astype(np.float32) ** 2
            net.p[k] = net.p[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8) + rate * 2e-3 * net.p[k] * (k != "b2")).astype(np.float32)
    net.p["b2"][0] += prior(share) - prior(float(labels.mean()))
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network:
    """Fits on a bounded sample of the labelled texts that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    row = known.agg(F.avg("label")).head()[0]
    picked = None
    for kind in (0, 1):
        part = known.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce(F.col("text"), F.lit(""))
    # at most 2 * sample ids
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").filter(F.octet_length("text") <= SAMPLE_BYTES).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    kept = sorted((r.doc_id, r.text, r.label) for r in found.toLocalIterator())
    return fit([t.encode() for _, t, _ in kept], np.array([y for *_, y in kept]), 0.5 if row is None else float(row), steps)


def _scores(net: Network, batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows)
    column = batch.column("text")
    for k in range(0, len(out), 64):
        z = net.logits([t.encode("utf-8", "surrogatepass") for t in strings(column.slice(k, 64))])
        out[k : k + 64] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(net, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The documents whose score is 0.5 or more, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(net, batch) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
