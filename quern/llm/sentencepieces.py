"""SentencePiece encoding and decoding by a prefix table of merge types.

A BPE encoding of a prefix ends in one token only. Going left to right, that token is the one among the pieces that an
automaton finds to end there which is compatible with the last token of the prefix before it: undoing both tokens' merges
from the latest on, no merge across their border would have come earlier. The ids are then read backwards from the end. Chunks of up to LONG characters are worked
on together, one position of all of them at a time; longer ones one by one.
No piece holds a space mark behind another character, so that what follows each run of spaces is encoded by itself, and
kept in a bounded cache.

Cases: a null text counts as empty and becomes the end id alone; characters outside the vocabulary become byte pieces;
repeated rows are rows of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, strings, tokenizer_path

MODEL, MARK, WORDS_HELD = "piece_bpe_32k.model", "▁", 400_000
LONG, PAIRS_HELD = 48, 1_000_000
UNKNOWN_SURFACE = " ⁇ "


class Table:
    """Open addressing in arrays: long -> int; -1 where a key is missing."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            same = seen == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (seen != -1)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are distinct and not in it."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            self.__init__(max(self.bits + 1, int(4 * (len(k) + len(keys))).bit_length()))
            self.add(k, v)
        self.count += len(keys)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several keys for one place the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            done = np.zeros(len(keys), dtype=bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + (self.keys[at[left]] != -1)) & (len(self.keys) - 1)


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path(MODEL))
        size = len(model)
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.unk, self.eos = model.unk_id(), model.eos_id()
        self.control = {i for i in range(size) if model.is_control(i)}
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(size) if i not in self.byte_of and i not in self.control and i != self.unk and not model.is_unused(i)]
        self.id_of = {self.piece[i]: i for i in plain}
        merged = sorted((i for i in plain if len(self.piece[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank = dict.fromkeys(plain, -1) | {t: k for k, t in enumerate(merged)}
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for t in [i for i in plain if len(self.piece[i]) == 1] + merged:
            if self._own(t):
                self.automaton.add_word(self.piece[t], (t, len(self.piece[t])))
        self.automaton.make_automaton()
        self.fits = WordCache(lambda pair: self._compatible(*pair), 400_000)
        self.chunks: dict[str, str] = {}
        self.surfaces = WordCache(self._chunk_surface, WORDS_HELD)
        self.plain = {str(t): self.piece[t].replace(MARK, " ") for t in self.rank}
        self.names = [str(i) for i in range(size)]
        self._tables()

    def _tables(self) -> None:
        """The automaton's tree as arrays: (node, character) -> node, and node -> token."""
        chars = sorted({c for p in self.id_of for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        code = {c: k + 1 for k, c in enumerate(chars)}
        nodes: dict[int, int] = {}
        token = [-1]
        for text, t in self.id_of.items():
            at = 0
            for c in text:
                key = at * self.width + code[c]
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                at = nodes[key]
            if self.rank[t] < 0 or t in self.split:
                token[at] = t
        self.token = np.array(token, dtype=np.int32)
        self.tree = Table(18)
        self.tree.add(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.size_of = np.array([len(p) for p in self.piece], dtype=np.int32)
        self.pairs = Table(18)

    def _own(self, t: int) -> bool:
        """Whether a piece's text is encoded as that piece; notes its last merge."""
        parts = list(self.piece[t])
        if len(parts) == 1:
            return True
        while len(parts) > 1:
            best = min(((self.rank[c], k) for k in range(len(parts) - 1) if (c := self.id_of.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return False
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        # a part that is a character outside the vocabulary can't have been merged
        self.split[t] = (self.id_of[last[0]], self.id_of[last[1]])
        return True

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' texts, side by side, are encoded as these two tokens."""
        if left < 0 or right < 0:  # a character without a piece joins nothing
            return True
        limit = len(self.rank) + 1
        while True:
            across = self.id_of.get(self.piece[left] + self.piece[right])
            if across is not None and self.rank[across] < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a > b:
                limit, left = a, self.split[left][1]
            elif b >= 0:
                limit, right = b + 1, self.split[right][0]
            else:
                return True

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already marks."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        width = [1] * (n + 1)
        done, fits = 0, self.fits
        for end, (t, size) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # characters that no piece ends with
                done += 1
                if last[done] is None:
                    last[done] = -1
            if last[end] is None:
                before = end - size
                if before == 0 or fits[last[before], t]:
                    last[end], width[end] = t, size
        for k in range(1, n + 1):
            if last[k] is None:
                last[k] = -1
        out, at = [], n
        while at:
            t = last[at]
            if t < 0:
                out += [self.id_of_byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(t)
                at -= width[at]
        out.reverse()
        return out

    def _matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every token in the classes of characters: its last place, and its id."""
        at = np.flatnonzero(flat)
        node = np.zeros(len(at), dtype=np.int64)
        ends, found = [], []
        step = 0
        while len(at):
            node = self.tree.get(node * self.width + flat[at + step])
            on = node >= 0
            at, node = at[on], node[on].astype(np.int64)
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            ends.append(at[hit] + step)
            found.append(token[hit])
            step += 1
            on = at + step < len(flat)
            at, node = at[on], node[on]
        return np.concatenate(ends), np.concatenate(found)

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Compatible pairs; what isn't known yet is found out one by one, and kept."""
        key = left.astype(np.int64) * len(self.piece) + right
        out = self.pairs.get(key)
        for _ in range(2):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            new = np.unique(key[open_])
            if self.pairs.count > PAIRS_HELD:
                self.pairs = Table(18)
            self.pairs.add(new, np.fromiter((self._compatible(int(k) // len(self.piece), int(k) % len(self.piece)) for k in new), np.int32, len(new)))
            out[open_] = self.pairs.get(key[open_])
        return out > 0

    def _together(self, texts: list[str]) -> list[str]:
        """Ids of many short chunks, joined by spaces."""
        joined = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # a place of class 0 before each chunk, so that no token crosses
        starts = np.cumsum(sizes + 1) - sizes
        flat = np.zeros(len(joined) + len(texts), dtype=np.int64)
        place = np.arange(len(joined)) + np.repeat(np.arange(1, len(texts) + 1), sizes)
        flat[place] = self.classes[joined]
        off = np.zeros(len(flat), dtype=np.int64)
        off[place] = place - np.repeat(starts, sizes)
        ends, found = self._matches(flat)
        last = np.full(len(flat), -1, dtype=np.int64)
        order = np.argsort(off[ends], kind="stable")
        ends, found = ends[order], found[order]
        bounds = np.cumsum(np.bincount(off[ends], minlength=1))
        begin = 0
        for k, end in enumerate(bounds.tolist()):
            e, t = ends[begin:end], found[begin:end]
            begin = end
            before = e - self.size_of[t]
            left = last[before]
            free = (self.size_of[t] == k + 1) | (left < 0)
            asked = np.flatnonzero(~free)
            if len(asked):
                free[asked] = self._fit(left[asked], t[asked])
            last[e[free]] = t[free]
        # backwards, all chunks at once; those with characters outside the vocabulary by themselves
        at, chunk, steps = starts + sizes - 1, np.arange(len(texts)), []
        count, odd = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        while len(at):
            token = last[at]
            steps.append((chunk, token))
            count[chunk] += 1
            odd[chunk[token < 0]] = True
            at = at - np.where(token < 0, 1, self.size_of[token])
            on = at >= starts[chunk]
            at, chunk = at[on], chunk[on]
        ends = np.cumsum(count)
        ids = np.empty(ends[-1], dtype=np.int64)
        for k, (chunk, token) in enumerate(steps):
            ids[ends[chunk] - 1 - k] = token
        names, edges = list(map(self.names.__getitem__, ids.tolist())), [0, *ends.tolist()]
        out = [" ".join(names[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        for k in np.flatnonzero(odd):
            out[k] = " ".join(map(str, self.encode_chunk(texts[k])))
        return out

    def _chunk_surface(self, ids: str) -> str:
        try:
            return "".join(map(self.plain.__getitem__, ids.split(" ")))
        except KeyError:  # bytes
            return self._surface(map(int, ids.split(" ")))[0]

    def know(self, keys: Iterable[str]) -> None:
        """Fills the cache for these chunks; it is emptied first if it would grow too large."""
        new = [k for k in set(keys) if k not in self.chunks]
        if not new:
            return
        if len(self.chunks) + len(new) > WORDS_HELD:
            self.chunks.clear()
            new = list(set(keys))
        short = [k for k in new if len(k) < LONG]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            self.chunks.update(zip(part, self._together([MARK + k.replace(" ", MARK) for k in part]), strict=True))
        for k in new:
            if len(k) >= LONG:
                self.chunks[k] = " ".join(map(str, self.encode_chunk(MARK + k.replace(" ", MARK))))

    def _keys(self, text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        keys, spaces = [], ""
        for part in parts:
            if part:
                keys.append(spaces + part)
                spaces = ""
            else:
                spaces += " "
        if spaces:  # at the end each further empty part is one mark; the chunk's own mark is not in its key
            keys.append(spaces[1:])
        return keys

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without control ids."""
        if not text:
            return []
        keys = self._keys(text)
        self.know(keys)
        return [int(i) for key in keys for i in self.chunks[key].split(" ")]

    def _surface(self, ids: Iterable[int]) -> tuple[str, bool]:
        """Text of ids, and whether its first character is a mark's space that may be the dummy prefix."""
        out: list[str] = []
        held = bytearray()
        first = None
        for t in ids:
            if t in self.byte_of:
                held.append(self.byte_of[t])
                first = False if first is None else first
                continue
            if held:
                out.append(_decoded(bytes(held)))
                held.clear()
            if t in self.control:
                continue
            first = (t != self.unk and self.piece[t].startswith(MARK)) if first is None else first
            out.append(UNKNOWN_SURFACE if t == self.unk else self.piece[t].replace(MARK, " "))
        out.append(_decoded(bytes(held)))
        return "".join(out), bool(first)

    def decode(self, ids: Iterable[int]) -> str:
        text, prefixed = self._surface(ids)
        return text[1:] if prefixed else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of its ids with the end id, their digest, and the decoded text's digest."""
        keys = [self._keys(t) if t else [] for t in texts]
        self.know([k for own in keys for k in own])
        out = []
        for own in keys:
            found = list(map(self.chunks.__getitem__, own))
            ids = " ".join([*found, self.names[self.eos]])
            out.append((ids.count(" ") + 1, _hex(ids), _hex(self.decode_names(found))))
        return out

    def decode_names(self, chunks: list[str]) -> str:
        """What chunks of ids, joined by spaces, are decoded to: a chunk begins with a mark, so that each is by itself."""
        return "".join(map(self.surfaces.__getitem__, chunks))[1:]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _decoded(data: bytes) -> str:
    """UTF-8, each byte that begins no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_held: list[Pieces] = []


def pieces() -> Pieces:
    """One model a process."""
    if not _held:
        _held.append(Pieces())
    return _held[0]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, ids (with the end id), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids = [[*model.encode(t), model.eos] for t in strings(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces()
        for batch in batches:
            column, found = batch.column("text"), []
            for k in range(0, batch.num_rows, 256):
                found += model.digests(list(strings(column.slice(k, 256))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
