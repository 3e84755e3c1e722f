"""Fuzzy line dedup: one occurrence is kept of each group of alike lines, over all documents.

A line is normalised (lower case, ASCII white space as single spaces, none at the ends) and named by 128 bits; equal lines are
first counted together. Distinct lines get a 64-bit SimHash of their words. Two of them are candidates if their SimHashes
differ in at most 3 bits: then one of four blocks of 16 bits is equal, which is what is joined on (with `grams` 2 bits and
three blocks of 21). A block value that more than CAP lines share is split by a second pigeonhole step, as many blocks of
the other bits, which is exact as well, and what is still too large is compared whole, two blocks of rows at a time. With `grams`, which the query and the pipeline
set, candidates are also those of MinHash over the lines' runs of bytes (GRAMS), which survive changed words: minima are
taken, a few of them make a band, and lines that share a band meet if their sketches (the SimHash of a longer line, low
bits of the minima of a short one) differ in at most LOOSE (LOOSE_SHORT) bits and their lengths allow the similarity. Candidates are
linked if their normalised texts' edit similarity, 1 - distance / longer length, is SIMILARITY or more; those of spanning
forests are verified first, and of the others only what these have not connected. Of a connected group the occurrence with
the smallest (doc_id, hash of its text, line number) stays; the others' lines are removed from their texts.

Cases: lines that are blank stay; a null text stays null; texts that lose all their lines become empty, their rows stay;
rows equal in doc_id and text are one document and are treated alike; null ids come first; an empty table gives an empty
table; other columns are kept unchanged whatever their names.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, linked, save, searched, small, strings

BITS, NEAR, SIMILARITY, CAP = 64, 3, 0.8, 1024
#: Bits in which SimHashes may differ where MinHash bands search, too.
NEAR_TOO = 2
LOOSE, LOOSE_SHORT = 20, 17
#: Lines of more than SHORT bytes, and lines of at most a quarter more: bytes of a gram, minima of a band, bands.
SHORT, GRAMS = 80, ((6, 4, 10), (5, 3, 14))
#: Minima of a longer line, of a short one.
BINS = (64, 64)
#: Names of lines that a task remembers.
SEEN = 200_000
#: Documents of a batch of lines; lines that are sketched together, so that their arrays stay in a core's cache.
DOCUMENTS, TOGETHER = 100, 150
#: Pairs whose distances are worked out together: at most, at least, the longest of them, and numbers of their table.
LANES, FEW, LONGEST, TABLE = 2048, 48, 4096, 1 << 20

_odd = np.random.default_rng(77).integers(1, 2**63, 64).astype(np.uint64) | np.uint64(1)
_letter = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_blanks = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c", b" \n", b"\n ")


def normalised(line: str) -> str:
    """Lower case, ASCII white space as single spaces, none at the ends."""
    return b" ".join(line.lower().encode().split()).decode()


def _lines_of(text: str) -> list[bytes]:
    """A text's normalised lines."""
    data = text.lower().encode()
    if data[:1] == b" " or data[-1:] == b" " or any(b in data for b in _blanks):
        return [b" ".join(line.split()) for line in data.split(b"\n")]
    return data.split(b"\n")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhashes(lines: list[bytes]) -> np.ndarray:
    """A 64-bit SimHash of the words of each normalised line; none may be empty.

    Words without a letter or digit, such as the bars of a table's row, count only where a line has no others. A word's
    hash is a polynomial of its bytes, taken for all words of all lines at once. The bits' counts are kept eight to a
    64-bit number and added for up to 255 words, which no count outgrows.
    """
    raw = np.frombuffer(b"\n".join(lines), dtype=np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.r_[0, ends + 1]
    sizes = np.r_[ends, len(raw)] - starts
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    place = np.arange(len(raw)) - np.repeat(starts, np.r_[sizes[:-1] + 1, sizes[-1]])
    values = (raw.astype(np.uint64) + np.uint64(1)) * powers[place]
    values[ends] = 0
    h = _mix(np.add.reduceat(values, starts))
    first = np.flatnonzero(np.r_[True, raw[ends] == 10])
    counts = np.diff(np.r_[first, len(h)])
    worth = np.logical_or.reduceat(_letter[raw], starts)
    total = np.add.reduceat(worth.astype(np.int64), first)
    worth |= np.repeat(total == 0, counts)
    total = np.where(total == 0, counts, total)
    if not worth.all():
        h, counts = h[worth], total
    parts = -(-counts // 255)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(counts) - counts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    some = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(-1, BITS)
    ones = np.add.reduceat(some, first, axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(np.uint64)[:, 0]


def _grams(lines: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each gram of the lines, their ends marked by blanks; the number of each line's grams)"""
    raw = np.frombuffer(b"".join(b" " + x + b" " * (gram - 1) for x in lines), dtype=np.uint8)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + gram
    counts = sizes - gram + 1
    two = (raw[:-1].astype(np.uint32) << np.uint32(8)) | raw[1:]
    n = len(raw) - gram + 1
    h = (two[:n] << np.uint32(16)) | two[2 : n + 2]
    if gram == 6:
        h = (h.astype(np.uint64) << np.uint64(16)) | two[4 : n + 4]
    else:
        h = (h.astype(np.uint64) << np.uint64(8)) | raw[4 : n + 4]
    inside = np.ones(n, dtype=bool)
    ends = np.cumsum(sizes)[:-1]
    for k in range(1, gram):  # grams that reach into the next line
        inside[ends - k] = False
    h = h[inside]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h, counts


def long_minima(lines: list[bytes], gram: int, bins: int) -> np.ndarray:
    """Minima of lines longer than SHORT: one hash a gram, which names its bin (a power of two of them); empty bins borrow
    from the next. Of a line with many grams those hashes are left out early that are six times the mean minimum or more."""
    none = np.iinfo(np.uint64).max
    h, counts = _grams(lines, gram)
    value = h >> np.uint64(21)
    most = np.minimum(2.0**43 * 6 * bins / counts, 2.0**43).astype(np.uint64)
    keep = value < np.repeat(most, counts)
    keep |= np.repeat(np.add.reduceat(keep, np.cumsum(counts) - counts, dtype=np.int64) == 0, counts)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)[keep]
    # up to 2 ** 15 lines a call: line, bin, 43 bits of the hash
    key = (line << np.uint64(49)) | (((h[keep] >> np.uint64(16)) & np.uint64(bins - 1)) << np.uint64(43)) | value[keep]
    key.sort()
    group = key >> np.uint64(43)
    first = key[np.r_[True, group[1:] != group[:-1]]]
    out = np.full((len(lines), bins), none, dtype=np.uint64)
    out[(first >> np.uint64(49)).astype(np.int64), (first >> np.uint64(43)).astype(np.int64) & (bins - 1)] = _mix(first & np.uint64((1 << 43) - 1))
    rows = np.flatnonzero((out == none).any(axis=1))
    while len(rows):
        lent = np.roll(out[rows], -1, axis=1)
        out[rows] = np.where((out[rows] == none) & (lent != none), lent + np.uint64(0x632BE59BD9B4E019), out[rows])
        rows = rows[(out[rows] == none).any(axis=1)]
    return out


def short_minima(lines: list[bytes], gram: int, bins: int) -> np.ndarray:
    """Minima of short lines: a hash a gram and bin."""
    h, counts = _grams(lines, gram)
    begin = np.cumsum(counts) - counts
    return np.stack([np.minimum.reduceat(h * m, begin) for m in _odd[:bins]], axis=1)


def _bands(least: np.ndarray, rows: int, many: int) -> np.ndarray:
    """32 bits for each band, two bands to a column."""
    value = np.zeros((len(least), many), dtype=np.uint64)
    for k in range(rows):
        value = _mix(value + least[:, k : many * rows : rows] + np.uint64(k + 1))
    return np.ascontiguousarray((value >> np.uint64(32)).astype(np.uint32)).view(np.int64)


def _banded(lines: list[bytes]) -> list[pa.Array]:
    """Of each line: the low bits of a short line's minima, and its bands as columns, null where it has none."""
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    low, out = np.zeros(len(lines), dtype=np.int64), []
    short = size <= SHORT * 5 // 4
    for own, minima, bins, (gram, rows, many) in zip((size > SHORT, short), (long_minima, short_minima), BINS, GRAMS, strict=True):
        at = np.flatnonzero(own)
        bands = np.zeros((len(lines), many // 2), dtype=np.int64)
        for k in range(0, len(at), TOGETHER):
            s = at[k : k + TOGETHER]
            least = minima([lines[i] for i in s.tolist()], gram, bins)
            bands[s] = _bands(least, rows, many)
            if minima is short_minima:
                low[s] = np.packbits((_mix(least) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)[:, 0]
        out += [pa.array(bands[:, k].copy(), mask=~own) for k in range(many // 2)]
    return [pa.array(low, mask=~short), *out]


SKETCH = ["s0", "n"]
WIDE = [*SKETCH, "low", *[f"{x}{k}" for x, (_, _, many) in zip("bc", GRAMS, strict=True) for k in range(many // 2)]]
_types = {"n": "int", "line": "int"}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} {_types.get(c, 'long')}" for c in names)


def _hashes(lines: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=np.int64).reshape(-1, 2)


def _lines(batches: Iterator[pa.RecordBatch], sketch: str | None) -> Iterator[pa.RecordBatch]:
    """A row for each line that is not blank: its document's key and id, its number, its name, with `sketch` what it is
    searched by, null where an equal line came shortly before."""
    seen: set[bytes] = set()
    for whole in batches:
        for k in range(0, whole.num_rows, DOCUMENTS):
            batch = whole.slice(k, DOCUMENTS)
            row, number, lines = [], [], []
            for i, text in enumerate(strings(batch.column("text"))):
                for j, line in enumerate(_lines_of(text)):
                    if line:
                        row.append(i)
                        number.append(j)
                        lines.append(line)
            if not row:
                continue
            at, h = pa.array(row), _hashes(lines)
            arrays = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
            if sketch:
                if len(seen) > SEEN:
                    seen.clear()
                new, named, data = [], np.full(len(lines), -1), h.tobytes()
                for i in range(len(lines)):
                    name = data[16 * i : 16 * i + 16]
                    if name not in seen:
                        seen.add(name)
                        named[i] = len(new)
                        new.append(lines[i])
                if new:
                    sims = np.concatenate([simhashes(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)])
                    own = [pa.array(sims.view(np.int64)), pa.array([len(x.decode()) for x in new], pa.int32()), *(_banded(new) if sketch == "grams" else [])]
                    place = pa.array(named, mask=named < 0)
                    own = [x.take(place) for x in own]
                else:
                    own = [pa.nulls(len(lines), pa.int32() if c == "n" else pa.int64()) for c in (WIDE if sketch == "grams" else SKETCH)]
                arrays = [batch.column("dk").take(at), pa.array(number, pa.int32()), *arrays, *own]
                names = ["dk", "line", "h0", "h1", *(WIDE if sketch == "grams" else SKETCH)]
            else:
                arrays = [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(number, pa.int32()), *arrays]
                names = ["doc_id", "th", "line", "h0", "h1"]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h0, h1, out = [], [], []
        for text, wanted in zip(strings(batch.column("text")), batch.column("wanted"), strict=True):
            # a line end is no letter and no mark, so that lower case is that of the whole text
            lines = text.split("\n")
            for w in wanted.as_py():
                h0.append(w["h0"])
                h1.append(w["h1"])
                out.append(normalised(lines[w["line"]]))
        if out and not (_hashes([x.encode() for x in out]) == np.array([h0, h1]).T).all():
            raise RuntimeError("line_dedup: a line is not where it was found")
        yield pa.RecordBatch.from_arrays([pa.array(h0, pa.int64()), pa.array(h1, pa.int64()), pa.array(out, pa.string())], ["h0", "h1", "text"])


def _buckets(lines: DataFrame, cap: int = CAP, near: int = NEAR) -> DataFrame:
    """A row for each block that a line is searched by: near + 1 blocks, of which two lines within `near` bits share one."""
    width, many = 64 // (near + 1), near + 1
    block = lambda i: F.shiftrightunsigned("s0", width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long")) + F.lit(i << 40).cast("long")
    first = lines.select("h0", "n", "s0", F.posexplode(F.array(*map(block, range(many)))).alias("i", "bucket"))
    over = save(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("bucket", F.lit(True).alias("over")), "over")
    if not over.head(1):
        return first.select("bucket", "h0", "n", "s0")
    marked = first.join(small(over), "bucket", "left")
    # the bits without block i, and a block of them
    own = (64 - width) // many
    rest = f"((s0 & (shiftleft(1L, {width} * i) - 1L)) | shiftleft(shiftrightunsigned(shiftrightunsigned(s0, {width} * i), {width}), {width} * i))"
    blocks = ", ".join(f"xxhash64(bucket, {j}, shiftrightunsigned({rest}, {own * j}) & {(1 << own) - 1}L)" for j in range(many))
    parts = F.expr(f"case when over then array({blocks}) else array(bucket) end")
    return marked.select(F.explode(parts).alias("bucket"), "h0", "n", "s0")


def _band_rows(lines: DataFrame) -> DataFrame:
    """A row for each band of a line: short and longer lines have bands of their own."""
    out = None
    for x, sketch, (_, _, many) in zip("bc", ("s0", "low"), GRAMS, strict=True):
        half = [F.shiftrightunsigned(f"{x}{k // 2}", 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit((64 * (x == "c") + k) << 32) for k in range(many)]
        part = lines.filter(F.col(f"{x}0").isNotNull()).select(F.explode(F.array(*half)).alias("bucket"), "h0", "n", F.col(sketch).alias("s0"))
        out = part if out is None else out.unionByName(part)
    return out


def _document(docs: DataFrame) -> DataFrame:
    """Documents with a hash of the text, and a key by which rows equal in id and text are one document."""
    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64("doc_id", "text").alias("dk"), "text")


def _distance(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger: a column of the table at a time, its steps as bits of two numbers."""
    if not a:
        return min(len(b), most + 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score, left, size = (1 << len(a)) - 1, 1 << len(a) - 1, len(a), len(b), -(-len(a) // 8)
    step = max(64, len(a) // 32)
    up, down = full, 0
    for c in b:
        same = at.get(c, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = (down | ~(h | up)) & full, up & h
        left -= 1
        last_up, last_down = up, down
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        if score - left > most:
            return most + 1
        if left and not left % step:
            # the column's cells and the least that each has still to go
            done = len(b) - left
            steps = [np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), dtype=np.uint8), count=len(a), bitorder="little").astype(np.int32) for v in (last_up, last_down)]
            cells = done - 1 + np.r_[0, np.cumsum(steps[0] - steps[1])]
            if (cells + np.abs(np.arange(len(a), -1, -1) - left - 1)).min() > most:
                return most + 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = (less | ~(x | more)) & full, more & x
    return min(score, most + 1)


def _bound(x: list[str], y: list[str], most: int, ahead: int = 40) -> int:
    """An upper bound of the distance of two texts of words, most + 1 if it finds none: at a difference it goes on where
    the next two words agree again, in time that grows with the words."""
    i = j = bound = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        found = None
        places: dict[tuple, int] = {}
        for v in range(min(ahead, len(y) - j), -1, -1):
            places[tuple(y[j + v : j + v + 2])] = v
        for u in range(min(ahead, len(x) - i) + 1):
            if found is not None and u > found[0]:
                break
            v = places.get(tuple(x[i + u : i + u + 2]))
            if v is not None and (found is None or u + v < found[0]):
                found = (u + v, u, v)
        if found is None:
            return most + 1
        _, u, v = found
        bound += max(sum(len(w) + 1 for w in x[i : i + u]), sum(len(w) + 1 for w in y[j : j + v]))
        if bound > most:
            return most + 1
        i, j = i + u, j + v
    return bound + max(sum(len(w) + 1 for w in x[i:]), sum(len(w) + 1 for w in y[j:]))


def _least(up: np.ndarray, down: np.ndarray, more: np.ndarray, less: np.ndarray, first: int, last: int, j: int, m: np.ndarray, columns: int) -> np.ndarray:
    """A lower bound of each lane's distance after step j of `_within`: the least that a cell of the words' columns has come
    to and has still to go. A path may pass between the columns of two words, beside a cell; hence 3 less."""
    top = j - first + 1 + (np.bitwise_count(up[:first]).sum(axis=0, dtype=np.int64) - np.bitwise_count(down[:first]).sum(axis=0, dtype=np.int64))
    found = np.full(len(m), np.iinfo(np.int64).max)
    for w in range(first, last + 1):
        at = j - w + 1
        steps = [np.unpackbits(v[w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) for v in (up, down)]
        cells = np.cumsum(steps[0] - steps[1], axis=1, dtype=np.int32)
        left = (m - (columns - at) - 64 * w - 1).astype(np.int32)[:, None] - np.arange(64, dtype=np.int32)
        found = np.minimum(found, np.minimum(top + np.abs(left[:, 0] + 1), top + (cells + np.abs(left)).min(axis=1)))
        top = top + cells[:, -1] - (more[w + 1].astype(np.int64) - less[w + 1].astype(np.int64))
    return found - 3


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most `most`, which the difference of its lengths does not exceed.

    Columns as bits as in `_distance`, in words of 64 rows, a pair to a lane of arrays; word w is one column behind word
    w - 1, so that one step is taken for all words. A word takes part only while it is within the largest `most` of the
    diagonal: what lies outside counts as a step from it, never too little, and no path of `most` steps leads there. The
    texts of a pair get a common end, which changes no distance, so that all the second ones have one length. A few times on
    the way, lanes are left out whose cells all have too far to go.
    """
    lanes, columns, reach = len(a), max(map(len, b)), max(1, int(most.max()))
    ends = [" " * (columns - len(x)) for x in b]
    m = np.fromiter((len(x) + len(e) for x, e in zip(a, ends, strict=True)), dtype=np.int64, count=lanes)
    rows, text = (np.frombuffer("".join(x + e for x, e in zip(side, ends, strict=True)).encode("utf-32-le"), dtype=np.uint32) for side in (a, b))
    number = np.zeros(0x110000, dtype=np.int32)
    number[rows] = 1
    letters = np.flatnonzero(number)
    number[letters] = np.arange(1, len(letters) + 1)
    many, width = len(letters) + 1, -(-int(m.max()) // 64)
    lane, place = np.repeat(np.arange(lanes), m), np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)
    same = np.zeros(lanes * many * width, dtype=np.uint64)
    np.bitwise_or.at(same, (lane * many + number[rows]) * width + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    code = np.ascontiguousarray(((np.arange(lanes) * many)[:, None] + number[text].reshape(lanes, columns)).T) * width
    word, one, top = np.arange(width)[:, None], np.uint64(1), np.uint64(63)
    up, down = np.full((width, lanes), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros((width, lanes), dtype=np.uint64)
    # the step of the row above each word
    more, less = np.ones((width + 1, lanes), dtype=np.uint64), np.zeros((width + 1, lanes), dtype=np.uint64)
    out, alive, step = np.zeros(lanes, dtype=bool), np.arange(lanes), max(32, columns // 8)
    for j in range(columns + width - 1):
        first, last = max(0, j - columns + 1, -((63 + reach - j) // 65)), min(width - 1, j, (j + reach) // 65)
        if first > last:
            continue
        own, below = slice(first, last + 1), slice(first + 1, last + 2)
        at = code[j - last : j - first + 1][::-1] + word[own]
        eq, p, q = same.take(at), up[own], down[own]
        x = eq | q
        eq |= less[own]
        h = eq & p
        h += p
        h ^= p
        h |= eq
        minus = p & h
        h |= p
        plus = np.invert(h, out=h)
        plus |= q
        more_own, less_own = plus << one, minus << one
        more_own |= more[own]
        less_own |= less[own]
        np.right_shift(plus, top, out=more[below])
        np.right_shift(minus, top, out=less[below])
        more[first], less[first] = 1, 0
        np.bitwise_and(more_own, x, out=q)
        x |= more_own
        np.invert(x, out=x)
        np.bitwise_or(less_own, x, out=p)
        if j % step == step - 1 and j < columns - 32:
            near = _least(up, down, more, less, first, last, j, m, columns) <= most
            if near.sum() <= 0.8 * len(alive):
                alive, m, most, code = alive[near], m[near], most[near], np.ascontiguousarray(code[:, near])
                up, down, more, less = (np.ascontiguousarray(v[:, near]) for v in (up, down, more, less))
                if not len(alive):
                    return out
    bits = np.clip(m - 64 * word, 0, 64).astype(np.uint64)
    mask = np.where(bits == 64, np.iinfo(np.uint64).max, (one << (bits & top)) - one)
    out[alive] = columns + np.bitwise_count(up & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & mask).sum(axis=0, dtype=np.int64) <= most
    return out


def _rest(a: str, b: str) -> tuple[bool | None, str, str, int]:
    """(whether the texts are alike if their lengths and words tell, else null; what differs of each; the distance allowed).

    What both begin and end with is left out. The longer rest, and for equally many words the longer of each pair of
    different words, bound the distance from above.
    """
    most = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False, a, b, most
    n = 0
    for size in (4096, 256, 16, 1):
        while n + size <= min(len(a), len(b)) and a[n : n + size] == b[n : n + size]:
            n += size
    a, b, n = a[n:], b[n:], 0
    for size in (4096, 256, 16, 1):
        while n + size <= min(len(a), len(b)) and a[len(a) - n - size : len(a) - n] == b[len(b) - n - size : len(b) - n]:
            n += size
    a, b = a[: len(a) - n], b[: len(b) - n]
    if max(len(a), len(b)) <= most:
        return True, a, b, most
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v) <= most:
        return True, a, b, most
    return None, a, b, most


def alike(a: str, b: str) -> bool:
    """Whether the edit similarity is SIMILARITY or more: by `_rest`, an alignment of words, or else the distance."""
    sure, a, b, most = _rest(a, b)
    if sure is not None:
        return sure
    return (len(a) > 200 and _bound(a.split(" "), b.split(" "), most) <= most) or _distance(a, b, most) <= most


def all_alike(left: list[str], right: list[str]) -> np.ndarray:
    """`alike` of each pair. Pairs of about one length that `_rest` leaves open are worked out together, if they are not few."""
    rests = [_rest(a, b) for a, b in zip(left, right, strict=True)]
    out = np.array([bool(sure) for sure, *_ in rests], dtype=bool)
    size = [max(len(a), len(b)) for _, a, b, _ in rests]
    todo = sorted((i for i, (sure, *_) in enumerate(rests) if sure is None), key=size.__getitem__)
    letters = len(set().union(*(rests[i][1] for i in todo))) + 1 if todo else 1
    while todo:
        most = size[todo[-1]]
        lanes = min(LANES, TABLE // max(letters * -(-most // 64), most))
        some = todo[-lanes:] if most <= LONGEST and lanes >= FEW else []
        some = some[bisect.bisect_left(some, most // 2, key=size.__getitem__) :]
        if len(some) < FEW:
            i = todo.pop()
            out[i] = alike(left[i], right[i])
            continue
        del todo[-len(some) :]
        out[some] = _within([rests[i][1] for i in some], [rests[i][2] for i in some], np.array([rests[i][3] for i in some]))
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = all_alike(list(strings(batch.column("ta"))), list(strings(batch.column("tb"))))
        yield batch.select(["u0", "u1", "v0", "v1"]).filter(pa.array(keep))


def fuzzy_links(docs: DataFrame, distinct: DataFrame, cap: int = CAP, *, grams: bool = False) -> DataFrame:
    """(node, root), structs of h0 and h1: the distinct lines that alike candidates connect; see components."""
    signed = lambda rows: rows.join(distinct.select("h0", "n", "s0"), "h0")
    near = NEAR_TOO if grams else NEAR
    searches = [searched(_buckets(distinct, cap, near), signed, 1, near, near, cap, "line-pairs", SIMILARITY)]
    if grams:
        sketch = F.when(F.col("bucket") >= F.lit(64 << 32), F.col("low")).otherwise(F.col("s0")).alias("s0")
        signed = lambda rows: rows.join(distinct.select("h0", "n", "s0", "low"), "h0").select(*rows.columns, "n", sketch)
        searches.append(searched(_band_rows(distinct), signed, 1, NEAR, LOOSE, cap, "gram-pairs", SIMILARITY, other=(64 << 32, LOOSE_SHORT)))
    texts: list[DataFrame] = []

    def fetch(ends: DataFrame) -> DataFrame:
        places = distinct.join(small(ends), "h0").select("h0", "h1", "dk", "line")
        wanted = save(places.groupBy("dk").agg(F.collect_list(F.struct("h0", "h1", "line")).alias("wanted")), "line-places")
        found = _document(docs).join(small(wanted, BROADCAST_ROWS // 4), "dk").select("text", "wanted").mapInArrow(_texts, "h0 long, h1 long, text string")
        # rows equal in id and text give a line each
        return save(found.dropDuplicates(["h0", "h1"]), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        # the rest of a split bucket has lines that no forest links; their texts are not there yet
        ends = pairs.select(F.col("a0").alias("h0")).unionByName(pairs.select(F.col("b0").alias("h0"))).distinct()
        for known in texts:
            ends = ends.join(known.select("h0"), "h0", "left_anti")
        ends = save(ends, "line-ends")
        if not texts or ends.head(1):
            texts.append(fetch(ends))
        known = functools.reduce(DataFrame.unionByName, texts)
        side = lambda x, y: known.select(F.col("h0").alias(f"{x}0"), F.col("h0").alias(f"{y}0"), F.col("h1").alias(f"{y}1"), F.col("text").alias(f"t{x}"))
        full = pairs.select("a0", "b0").join(side("a", "u"), "a0").join(side("b", "v"), "b0")
        good = full.select("u0", "u1", "v0", "v1", "ta", "tb").mapInArrow(_verified, "u0 long, u1 long, v0 long, v1 long")
        return good.select(F.struct(F.col("u0").alias("h0"), F.col("u1").alias("h1")).alias("u"), F.struct(F.col("v0").alias("h0"), F.col("v1").alias("h1")).alias("v"))

    return linked(searches, verify, "lines", 1)


def removed_lines(docs: DataFrame, cap: int = CAP, *, grams: bool = False) -> DataFrame:
    """(doc_id, th, lines): the numbers of the lines that go, for the documents that lose any; saved."""
    own = WIDE if grams else SKETCH
    lines = _document(docs).select("dk", "text").mapInArrow(functools.partial(_lines, sketch="grams" if grams else "words"), _schema(["dk", "line", "h0", "h1", *own]))
    # longs and ints only, which hash aggregation takes; the first of both is that of one row
    places = [F.first(c).alias(c) for c in ("dk", "line")]
    distinct = save(lines.groupBy("h0", "h1").agg(*places, F.count(F.lit(1)).alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in own]), "distinct-lines")
    found = fuzzy_links(docs, distinct, cap, grams=grams)
    member = save(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select("node.h0", "node.h1", "root"), "line-members")
    repeated = distinct.filter("copies > 1").select("h0", "h1").join(small(member), ["h0", "h1"], "left_anti").select("h0", "h1", F.struct("h0", "h1").alias("root"))
    groups = save(member.unionByName(repeated), "line-repeats")
    # lines are read again, which costs less than keeping them
    places = _document(docs).select("doc_id", "th", "text").mapInArrow(functools.partial(_lines, sketch=None), "doc_id long, th long, line int, h0 long, h1 long")
    places = save(places.join(small(groups), ["h0", "h1"]).select("doc_id", "th", "line", "root"), "line-occurrences")
    at = F.struct("doc_id", "th", "line")
    kept = save(places.groupBy("root").agg(F.min(at).alias("kept")), "line-kept")
    gone = places.join(small(kept), "root").filter(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th")) & (F.col("line") == F.col("kept.line"))))
    return save(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines")), "removed")


def _marked(docs: DataFrame, own: str, grams: bool) -> DataFrame:
    """docs with the numbers of the lines to remove, null if none, in a column that no other is named like."""
    gone = removed_lines(docs, grams=grams)
    if (gone.agg(F.sum(F.size("lines"))).head()[0] or 0) <= 4 * BROADCAST_ROWS:
        gone = small(gone)
    gone = gone.select(F.col("doc_id").alias(f"{own}d"), F.col("th").alias(f"{own}t"), F.col("lines").alias(own))
    return docs.withColumn(f"{own}h", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(f"{own}d")) & (F.col(f"{own}h") == F.col(f"{own}t")), "left")


def _cut(own: str):
    """The text without the marked lines."""
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(own), i))
    return F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, *, grams: bool = False) -> DataFrame:
    """The documents, all of them, without the removed lines; n_chars, where there is one, counts the new text."""
    own = "_q" * (1 + max(len(c) for c in docs.columns))
    text = {"text": _cut(own)}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.char_length(_cut(own)).cast(docs.schema["n_chars"].dataType))
    return _marked(docs, own, grams).select(*[text[c].alias(c) if c in text else F.col(c) for c in docs.columns])


def report(docs: DataFrame, *, grams: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, and its new text."""
    own = "_q" * (1 + max(len(c) for c in docs.columns))
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return _marked(docs.select("doc_id", "text"), own, grams).select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.coalesce(F.when(F.col(own).isNotNull(), F.size(own)), F.lit(0)).alias("n_removed"), _cut(own).alias("text"))
