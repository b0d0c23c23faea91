"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k = m * rate edits. Split into k + 1 pieces,
one of them must occur unchanged, so an automaton over all pieces finds every candidate place.
A hit climbs a binary tree over the pieces: a node of p pieces must match with at most p - 1
edits, and a place within the budget has a hit all of whose nodes do, so most false hits end at
their parent, on a score of characters. Myers' columns verify every node up to the whole item.

Items are taken in blocks of at most BLOCK_CHARS characters, each broadcast in its turn, however
many there are; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.editing import best_end, masks
from kinlake.llm.text import large_strings

BLOCK_CHARS = 4_000_000
LEAST_CHARS = 24
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W+")


def _folded(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    """Lower case, with one space for everything between words."""
    return _GAP.sub(" ", _folded(text)).strip()


class Matcher:
    """Finds items, given as (item_id, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 0):
        """Items of fewer than least_chars characters must occur unchanged, as whole words."""
        self.items, self.rate, self.least_chars, self.machine = items, rate, least_chars, None

    def __getstate__(self):
        return {"items": self.items, "rate": self.rate, "least_chars": self.least_chars, "machine": None}

    def _build(self) -> None:
        hits: dict[str, list[tuple[int, int]]] = {}
        self.nodes, self.cuts = [], []
        for n, (_, text) in enumerate(self.items):
            pieces = int(len(text) * self.rate) + 1 if len(text) >= self.least_chars else 1
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            self.cuts.append(cuts)
            self.nodes.append({})
            for i in range(pieces):
                hits.setdefault(text[cuts[i] : cuts[i + 1]], []).append((n, i))
        self.machine = ahocorasick.Automaton()
        for piece, found in hits.items():
            self.machine.add_word(piece, (len(piece), found))
        if hits:
            self.machine.make_automaton()

    def _path(self, n: int, i: int) -> list[tuple[int, int]]:
        """The nodes above piece i of item n, as ranges of pieces, from its parent to the root."""
        low, high, path = 0, len(self.cuts[n]) - 1, []
        while high - low > 1:
            path.append((low, high))
            mid = (low + high) // 2
            low, high = (low, mid) if i < mid else (mid, high)
        return path[::-1]

    def _masks(self, n: int, node: tuple[int, int], turned: bool = False) -> dict[str, int]:
        key = (*node, turned)
        if key not in self.nodes[n]:
            part = self.items[n][1][self.cuts[n][node[0]] : self.cuts[n][node[1]]]
            self.nodes[n][key] = masks(part[::-1] if turned else part)
        return self.nodes[n][key]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of matches in a normalised text; matches of an item don't overlap."""
        if self.machine is None:
            self._build()
        if not len(self.machine):
            return []
        found, done, tried = [], {}, set()
        for last, (size, places) in self.machine.iter(text):
            at = last + 1 - size
            for n, i in places:
                if at < done.get(n, -1):
                    continue
                if len(self.items[n][1]) < self.least_chars and (text[at - 1 : at].strip() or text[last + 1 : last + 2].strip()):
                    continue  # a short item within a word
                cuts, ok = self.cuts[n], True
                for low, high in self._path(n, i):
                    spare = high - low - 1
                    a = max(0, at - (cuts[i] - cuts[low]) - spare)
                    if (n, low, high, a) in tried:
                        ok = False
                        break
                    b = at + (cuts[high] - cuts[i]) + spare
                    hit = best_end(self._masks(n, (low, high)), cuts[high] - cuts[low], text[a:b], spare)
                    if hit is None:
                        tried.add((n, low, high, a))
                        ok = False
                        break
                if ok:
                    whole, m = (0, len(cuts) - 1), len(self.items[n][1])
                    spare = len(cuts) - 2
                    a = max(0, at - cuts[i] - spare)
                    score, end = best_end(self._masks(n, whole), m, text[a : at + m - cuts[i] + spare], spare)
                    back = text[max(0, a + end - m - spare) : a + end][::-1]
                    _, length = best_end(self._masks(n, whole, True), m, back, spare)
                    found.append((self.items[n][0], score, a + end - length, a + end))
                    done[n] = a + end
        return found


def _places(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The spans of the text itself that spans of its normalised form stand for."""
    spans = [m.span() for m in _WORD.finditer(_folded(text))]
    at: list[int] = []
    for n, (a, b) in enumerate(spans):
        if n:
            at.append(spans[n - 1][1])
        at.extend(range(a, b))
    return [(at[a], at[b - 1] + 1) for _, _, a, b in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every passage within the error budget of an item.

    Texts are compared in lower case with one space for all between words; distance counts edits
    of that form, start and end are code points of the text as it is. An item whose form is
    shorter than least_chars matches only unchanged and as whole words; one without a word, or a
    null one, matches nothing; a null text has no match;
    repeated items and rows each have their own matches; an empty table on either side gives an
    empty result; other columns are left out.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    schema = "doc_id long, item_id long, distance int, start int, end int"

    def scan(own) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = own.value
            for batch in batches:
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), large_strings(batch.column(1)), strict=True):
                    text = text.as_py()
                    if found := matcher.search(normal(text)):
                        rows += [(i, n, d, *p) for (n, d, _, _), p in zip(found, _places(text, found), strict=True)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_CHARS characters
        known = [(r["item_id"], t) for r in block if (t := normal(r["text"]))]
        parts.append(scan(spark.sparkContext.broadcast(Matcher(known, rate, least_chars))))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The documents without a match; their columns are kept."""
    hit = contaminated(docs, benchmark, rate).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
