"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of at least 16 letters, digits and `+/_.-=` with a digit in them, and values of at least 8 characters
that are assigned to a name such as password or token. The forest judges each by its length, its character transitions,
how much of it dictionary words cover, its path (the document's source) and its neighbouring words. It is fitted in numpy
on the driver on a bounded number of labelled findings (`findings.labelled_findings`, or a caller's own).

Cases: a null text counts as empty; a null source is no path; each place of a repeated secret is a finding; rows are
scanned by themselves, so repeated rows give repeated findings and a null doc_id stays null; an empty table gives an
empty table; other columns are ignored, or kept unchanged by `redact`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings
from .findings import WORDS, labelled_findings

TREES, DEPTH, LEAST, FINDINGS, THRESHOLD = 40, 10, 3, 4000, 0.5
MASK = "[SECRET]"

_run = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.-]{16,}={0,2}")
_digit = re.compile(r"\d")
_names = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
_value = re.compile(r"""(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)["']?\s{0,3}(?::=|=>|[:=])\s{0,3}["']?([^\s"'<>(){},;]{8,})""")
_dictionary = frozenset(w for w in WORDS if len(w) > 3) | {"password", "secret", "token", "your", "here", "change", "example", "environ"}
_good = re.compile(r"(?i)pass|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth")
_bad = re.compile(r"(?i)commit|\bsha|revision|blob|parent|merge|md5|checksum|etag|digest|integrity|uuid|\bid\b|trace|request|image|base64,|@$")
_test = re.compile(r"(?i)test|example|sample|fixture|lock|\.sum|docs?/")
_placeholder = re.compile(r"(?i)your|here|change|example|xxxx|0000|1234567|insert|environ|process\.env|config\.|placeholder")
_prefix = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abps]-|glpat-|eyJ|AIza)")
CONTEXT = 48


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a secret, in order, none overlapping."""
    found = [m.span() for m in _run.finditer(text) if _digit.search(m[0])]
    low = text.lower()
    if any(n in low for n in _names):
        found += [m.span(1) for m in _value.finditer(text)]
    found.sort()
    out: list[tuple[int, int]] = []
    for start, end in found:
        while end > start and text[end - 1] in ".,-":
            end -= 1
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        elif end > start:
            out.append((start, end))
    return out


_common = np.zeros((256, 256), dtype=np.float32)
for _w in WORDS:
    for _a, _b in zip(_w, _w[1:], strict=False):
        _common[ord(_a), ord(_b)] += 1
_common = np.log((_common + 0.05) / (_common.sum(1, keepdims=True) + 0.05 * 256))


def _covered(value: str) -> float:
    """The share of the characters that dictionary words of four letters or more cover."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), 3, -1):
            if low[at : at + size] in _dictionary:
                n += size
                at += size
                break
        else:
            at += 1
    return n / len(low)


def features(before: str, value: str, after: str, path: str) -> list[float]:
    raw = np.frombuffer(value.encode("latin-1", "replace"), dtype=np.uint8)
    kinds = np.select([(raw >= 48) & (raw <= 57), (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90)], [0, 1, 2], 3)
    n = len(raw)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    low = np.where(kinds == 2, raw + 32, raw)
    near = before[-CONTEXT:]
    last = near.rstrip(" \t\"'=:>")
    bad, good = [m.start() for m in _bad.finditer(near)], [m.start() for m in _good.finditer(near)]
    hexes = bool(re.fullmatch(r"[0-9a-fA-F]+", value))
    return [
        float(len(value)),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(_common[low[:-1], low[1:]].mean()) if n > 1 else 0.0,
        float(-(p * np.log2(p)).sum()),
        *share.tolist(),
        len(p) / n,
        _covered(value),
        float(hexes),
        float(hexes and len(value) in (32, 40, 64)),
        float(value.count("-") == 4 and len(value) == 36),
        float(value.count("/") + value.count(".")),
        float(value.count("_") + value.count("-")),
        float(bool(_prefix.match(value))),
        float(bool(_placeholder.search(value))),
        float(bool(good)),
        float(bool(bad)),
        float(max(good, default=-1) - max(bad, default=-1)),
        float(bool(re.search(r"[=:]\s*[\"']?$", near))),
        float(near[-1:] in ("'", '"') and bool(near)),
        float(after[:1] in ("'", '"') and bool(after)),
        float(len(near) - len(last)),
        float(bool(_test.search(path))),
        float(path.count("/") + path.count(".")),
    ]


class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right child, share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = draw.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[pick], y[pick].astype(np.float64), 0, nodes, draw)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, draw: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, y.mean()])
        if depth >= DEPTH or len(y) < 2 * LEAST or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in draw.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            left = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (left >= LEAST) & (len(y) - left >= LEAST)
            if ok.any():
                a, b = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(y) - left)
                gini = np.where(ok, left * a * (1 - a) + (len(y) - left) * b * (1 - b), np.inf)
                k = int(gini.argmin())
                if gini[k] < best[0]:
                    best = (gini[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        left = self._grow(x[go], y[go], depth + 1, nodes, draw)
        right = self._grow(x[~go], y[~go], depth + 1, nodes, draw)
        nodes[at] = [best[1], best[2], left, right, y.mean()]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = tree[at, 0].astype(np.int64)
                go = x[rows, np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(f < 0, at, np.where(go, tree[at, 2], tree[at, 3]).astype(np.int64))
            total += tree[at, 4]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    """A forest from at most FINDINGS labelled findings (before, candidate, after, path, label)."""
    findings = (labelled_findings(FINDINGS) if findings is None else findings)[:FINDINGS]
    return Forest(np.array([features(*f[:4]) for f in findings]), np.array([f[4] for f in findings]))


def _judged(forest: Forest, texts: list[str], paths: list[str]) -> list[tuple[int, int, int, float]]:
    """(row, start, end, score) of the accepted candidates."""
    spans = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t)]
    out = []
    for k in range(0, len(spans), 4_000):
        part = spans[k : k + 4_000]
        x = np.array([features(texts[i][max(0, a - CONTEXT) : a], texts[i][a:b], texts[i][b : b + CONTEXT], paths[i]) for i, a, b in part])
        out += [(*s, float(p)) for s, p in zip(part, forest.score(x), strict=True) if p >= THRESHOLD]
    return out


def _path(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row a finding: doc_id, start, length (code points), crc32 of the secret, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = list(strings(batch.column("text")))
                found = _judged(forest, texts, batch.column("path").to_pylist())
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] - f[1] for f in found], pa.int64()), pa.array([zlib.crc32(texts[i][a:b].encode()) for i, a, b, _ in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())], ["doc_id", "start", "length", "secret_crc32", "score"])

    return docs.select("doc_id", "text", _path(docs).alias("path")).mapInArrow(run, "doc_id long, start long, length long, secret_crc32 long, score double")


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents, all of them, with MASK in place of each secret; n_chars, where there is one, counts the new text."""
    text_at = docs.columns.index("text")
    source_at = docs.columns.index("source") if "source" in docs.columns else None
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = list(strings(batch.column(text_at)))
                paths = [str(p or "") for p in batch.column(source_at).to_pylist()] if source_at is not None else [""] * len(texts)
                found = _judged(forest, texts, paths)
                if not found:
                    yield batch
                    continue
                new = batch.column(text_at).to_pylist()
                for i, a, b, _ in reversed(found):
                    new[i] = new[i][:a] + MASK + new[i][b:]
                columns = list(batch.columns)
                columns[text_at] = pa.array(new, columns[text_at].type)
                if count_at is not None:
                    counts, hit = columns[count_at].to_pylist(), {f[0] for f in found}
                    columns[count_at] = pa.array([len(new[i]) if i in hit else c for i, c in enumerate(counts)], columns[count_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
