"""Substring dedup: seed and extend, over all texts at once.

Seeds are winnowed anchors: of the hashes of ANCHOR consecutive words, the least in every window
of the given length. Equal windows have the same least hash at the same place, so each window is
owned by one anchor, and two places match over at least `length` words if and only if they share
an anchor and the words to its left and right agree over enough more. Texts are joined on
anchors: those that occur again are found by a grouped count, and the texts that have them are
read again. There each seed is extended both ways, to every window that reaches left and right of
it; windows with the same words meet by a second count, which stands for comparing each pair of
places (a passage at n places makes n rows here, not n * n pairs). A text's repeated windows
that overlap or touch are one maximal repeat; these spans are what is cut out.

Counts are combined before the shuffle and both joins back can be split, so a passage in a third
of all rows is no single task. Windows are known by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import chunks, mix, rolling, signed, spans, text_windows, word_hashes
from kinlake.llm.work import Scratch

ANCHOR = 12
_OTHER = np.uint64(0xA0761D6478BD642F)
EMPTY = hashlib.sha256(b"").hexdigest()


def winnow(hashes: np.ndarray, n: int) -> np.ndarray:
    """For every run of n consecutive hashes the index of the least, the last of equals."""
    value, index = hashes, np.arange(len(hashes), dtype=np.int64)
    have = 1
    while have < n:
        step = min(have, n - have)
        a, b = value[:-step], value[step:]
        take = b <= a
        value, index = np.where(take, b, a), np.where(take, index[step:], index[:-step])
        have += step
    return index


def owners(data: np.ndarray, offsets: np.ndarray, length: int):
    """(index of each text's first word, start words of all windows, anchor word of each, anchor hashes by word, word hashes)."""
    starts, ends, first = spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    k = min(ANCHOR, length)
    grams = rolling(hashes, k)
    valid = np.flatnonzero(text_windows(first, length))
    if not len(valid):
        return first, valid, valid, grams, hashes
    return first, valid, winnow(grams, length - k + 1)[valid], grams, hashes


def anchors(df: DataFrame, length: int) -> DataFrame:
    """(anchor, row, at): each text's winnowed anchors and their word positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in chunks(batch.column(1)):
                first, _, owner, grams, _ = owners(data, offsets, length)
                at = np.unique(owner)
                doc = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[at])), pa.array(ids[row + doc]), pa.array((at - first[doc]).astype(np.int32))], ["anchor", "row", "at"])

    return df.select("row", "text").mapInArrow(run, "anchor long, row long, at int")


def whole(df: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, digest): the digest of all words of each text joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for _, data, offsets in chunks(batch.column(2)):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = raw[a:b].split()
                    n.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.string())], ["row", "doc_id", "n_words", "digest"])

    return df.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, digest string")


def extend(seeded: DataFrame, length: int) -> DataFrame:
    """(window, other, row, at) for every window owned by one of the seeds of its text, with both hashes; seeded: row, text, seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            lists, flat = np.asarray(seeds.offsets), np.asarray(seeds.values)
            for row, data, offsets in chunks(batch.column(1)):
                first, at, owner, grams, hashes = owners(data, offsets, length)
                seeded = np.zeros(int(first[-1]) + 1, bool)
                n = len(offsets) - 1
                a, b = lists[row], lists[row + n]
                each = np.diff(lists[row : row + n + 1])
                place = flat[a:b] + np.repeat(first[:n], each)
                seeded[place[place < np.repeat(first[1:], each)]] = True
                keep = seeded[owner]
                at = at[keep]
                doc = np.searchsorted(first, at, "right") - 1
                keys = [pa.array(signed(rolling(h, length)[at])) for h in (hashes, mix(hashes ^ _OTHER))] if len(at) else [pa.array([], pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[row + doc]), pa.array((at - first[doc]).astype(np.int32))], ["window", "other", "row", "at"])

    return seeded.select("row", "text", "seeds").mapInArrow(run, "window long, other long, row long, at int")


def maximal(starts: np.ndarray, length: int) -> np.ndarray:
    """(start, end) of the maximal repeats that windows of `length` words from these starts make: windows that overlap or touch are one."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], np.diff(starts) > length])
    first = np.flatnonzero(new)
    return np.stack([starts[first], starts[np.append(first[1:], len(starts)) - 1] + length], 1)


def remove(marked: DataFrame, length: int) -> DataFrame:
    """(row, repeats, n_removed, kept): marked has row, text and starts, the first words of repeated windows; repeats are spans of words, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats, removed, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                spans_ = maximal(np.asarray(starts.values, np.int64), length).tolist()
                edges = [0, *(x for s in spans_ for x in s), len(words)]
                stay = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                repeats.append([{"start": a, "end": b} for a, b in spans_])
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(repeats, spans_type), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "repeats", "n_removed", "kept"])

    return marked.select("row", "text", "starts").mapInArrow(run, "row long, repeats array<struct<start:int,end:int>>, n_removed long, kept string")


def find_repeats(df: DataFrame, length: int = 35, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(whole texts, their words and whether all go; marked texts with the starts of windows to remove).

    A row is known by a 64-bit hash of its doc_id and text. Texts with the same words are one
    class: in a class of several all windows repeat, so all words of its texts go if they make a
    window, and only its first text takes part in the search.
    """
    docs = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    scratch = scratch or Scratch(df.sparkSession)
    every = scratch.keep(whole(docs))
    classes = scratch.keep(every.where(F.col("n_words") >= length).groupBy("digest").agg(F.count("*").alias("copies"), F.min("row").alias("leader")).where("copies > 1"))
    every = every.join(classes, "digest", "left").select(
        "row", "doc_id", "n_words", "digest", F.col("copies").isNotNull().alias("copied"), F.coalesce(F.col("leader") == F.col("row"), F.col("n_words") >= length).alias("leads")
    )
    every = scratch.keep(every)
    found = scratch.keep(anchors(docs, length))
    # tables of their own, so that the joins back have plain shuffles on both sides, which adaptive execution can split
    again = scratch.keep(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    seeds = found.join(again, "anchor").join(every.where("leads").select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.collect_set("at").alias("seeds"))
    seeds = scratch.keep(seeds)
    scratch.release(found, again)
    windows = scratch.keep(extend(docs.join(seeds, "row"), length))
    twice = scratch.keep(windows.groupBy("window", "other").agg(F.count("*").alias("n")).where("n > 1").select("window", "other"))
    marks = windows.join(twice, ["window", "other"]).groupBy("row").agg(F.collect_list("at").alias("starts"))
    marks = scratch.keep(marks.join(every.where("not copied").select("row"), "row", "left_semi"))
    scratch.release(windows, twice)
    return every, docs.join(marks, "row")


def deduplicate(df: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what stays of each text once repeated windows go.

    Rows without a doc_id are left out; all others are kept, also those that share a doc_id, which
    are texts of their own (rows with one doc_id and one text are copies of each other). A null
    text has no words; a text shorter than a window loses nothing, however often it occurs; a
    window that occurs twice in one text is removed at both places; other columns are left out; an
    empty table gives an empty result.
    """
    every, marked = find_repeats(df, length)
    cut = remove(marked, length).select("row", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return every.join(cut, "row", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
