"""Licence scan: passages whose word bigrams are those of a licence template, by Dice's coefficient.

A text is cut into pieces at line ends and behind sentence marks, those without words left out; a passage is a run of
pieces, or, for a notice inside a longer sentence, any run of as many words as the template has. Passages and templates
are normalised (lower case, words of letters and digits) and compared as multisets of word bigrams. A coefficient of
DICE or more bounds the sizes: a passage of a bigrams and a template of b need a and b to differ by no more than
(2 - DICE) / DICE, so that a template is only tried on passages of such sizes. It also makes a passage share so many of a
template's bigrams that one of a few words, its anchors, must be there: texts without any anchor are done with.
Overlapping finds leave the best one.

Cases: a null text counts as empty and has no finding; a text that holds a licence twice has two findings; repeated rows
give repeated findings, a null doc_id stays null; ties go to the longer, then the earlier passage, then the licence's
name; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import strings
from .license_templates import TEMPLATES

DICE = 0.8

_word = re.compile(r"[^\W_]+")
_edge = re.compile(r"\n|(?<=[.!?;:])\s")


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return 2 * both / (a.total() + b.total())


class Templates:
    """Templates with their bigrams, the passage sizes they allow, and their anchors."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE):
        self.least, self.all = least, []
        self.marks: dict[str, list[int]] = {}
        for name, text in templates:
            words = _word.findall(text.lower())
            own = bigrams(words)
            b = own.total()
            low, high = b * least / (2 - least), b * (2 - least) / least
            # a passage shares at least `low` bigrams: words that more than b - low bigrams hold can't all be missing
            free, anchors = dict(own), []
            for word in sorted(set(words), key=lambda w: (w in _FREQUENT, -len(w), w)):
                if b - sum(free.values()) > b - low:
                    break
                anchors.append(word)
                free = {k: n for k, n in free.items() if word not in k}
            for word in anchors:
                self.marks.setdefault(word, []).append(len(self.all))
            self.all.append((name, own, low, high))
        self.automaton = ahocorasick.Automaton()
        for word in self.marks:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def _anchored(self, low: str) -> list[tuple[int, str]]:
        """(place, anchor) of the anchors that are words of their own."""
        out, n = [], len(low)
        for end, word in self.automaton.iter(low):
            start = end + 1 - len(word)
            if (start and low[start - 1].isalnum()) or (end + 1 < n and low[end + 1].isalnum()):
                continue
            out.append((start, word))
        return out

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of the best passages that don't overlap, in order."""
        low = text.lower()
        if len(low) != len(text):  # lower case that changes lengths would move places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        anchors = self._anchored(low)
        if not anchors:
            return []
        at_word = [m.span() for m in _word.finditer(low)]
        starts = [a for a, _ in at_word]
        words = [low[a:b] for a, b in at_word]
        # pieces that hold words: their first words, and where they begin and end
        edges = [0, *[m.end() for m in _edge.finditer(low)], len(low)]
        first_word, spans = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            k = bisect_left(starts, a)
            if k < len(starts) and starts[k] < b:
                first_word.append(k)
                spans.append((a, b))
        first_word.append(len(words))
        pieces, tried, found = len(spans), set(), []
        grams: dict[tuple[int, int], Counter] = {}

        def attempt(a: int, b: int, t: int, start: int, end: int) -> None:
            """Words a to b against template t; start and end: the passage."""
            if (a, b, t) in tried:
                return
            tried.add((a, b, t))
            if (a, b) not in grams:
                grams[a, b] = bigrams(words[a:b])
            d = dice(grams[a, b], self.all[t][1])
            if d >= self.least:
                while start < end and low[start].isspace():
                    start += 1
                while end > start and low[end - 1].isspace():
                    end -= 1
                found.append((-d, start - end, start, self.all[t][0], end))

        place: dict[int, set[int]] = {}
        windows: list[tuple[int, str]] = []
        for start, word in sorted(anchors):
            k = bisect_right(starts, start) - 1  # an anchor may be part of a word with marks
            place.setdefault(bisect_right(first_word, k) - 1, set()).update(self.marks[word])
            windows.append((k, word))
        for i, wanted in place.items():
            most = max(self.all[t][3] for t in wanted)
            first = i
            while first >= 0 and first_word[i + 1] - first_word[first] - 1 <= most:  # runs that hold piece i
                last = i
                while last < pieces and first_word[last + 1] - first_word[first] - 1 <= most:
                    size = first_word[last + 1] - first_word[first]
                    for t in wanted:
                        if self.all[t][2] <= size - 1 <= self.all[t][3]:
                            attempt(first_word[first], first_word[last + 1], t, spans[first][0], spans[last][1])
                    last += 1
                first -= 1
        for k, word in windows:
            for t in self.marks[word]:
                n = self.all[t][1].total() + 1
                for a in range(max(0, k - n + 1), min(k, len(words) - n) + 1):
                    attempt(a, a + n, t, at_word[a][0], at_word[a + n - 1][1])
        out: list[tuple[int, int, str, float]] = []
        for d, _, start, name, end in sorted(found):
            if all(end <= s or start >= e for s, e, _, _ in out):
                out.append((start, end, name, -d))
        return sorted(out)


_FREQUENT = frozenset("the of to and in a is for or on with by this that any be as are from at it work under terms".split())  # noqa: SIM905


def scan(docs: DataFrame) -> DataFrame:
    """One row a finding: doc_id, license, start, length (code points of the text), dice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(strings(batch.column("text"))):
                for f in templates.find(text):
                    row.append(i)
                    found.append(f)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([f[2] for f in found], pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] - f[0] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())], ["doc_id", "license", "start", "length", "dice"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, start long, length long, dice double")
