"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text. A word's score is the sum of weights of its
hashed features (the word, its beginning and its end), and a 2 x 2 table scores transitions.
Token labels come from document labels of a bounded sample: a word of a toxic document is toxic
if it, or its beginning, occurs in enough toxic and in hardly any clean documents. The field is
trained by gradients of its conditional likelihood on those sequences, and a logistic curve is
fitted from the marginals' summary to the document labels. Every whole text is then tagged:
forward and backward passes run over blocks of STEP words side by side, joined exactly by the
products of their transition matrices, so a text of any length takes time in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import _LOWER, chunks, mix, spans, word_hashes

BUCKETS = 1 << 18
STEP = 64
SAMPLE = 2400
SAMPLE_CHARS = 6_000_000
HEAD, TAIL = 4, 3
_KINDS = mix(np.arange(11, 14, dtype=np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, index of each text's first word, feature buckets of each word: the word, its beginning, its end)."""
    starts, ends, first = spans(data, offsets)
    low = _LOWER[data]
    letters = ends.copy()
    for _ in range(3):  # closing punctuation is no part of a word here
        last = low[np.maximum(letters - 1, 0)]
        cut = ((last == 46) | (last == 44) | (last == 33) | (last == 63) | (last == 58) | (last == 59)) & (letters - starts > 1)
        letters = letters - cut
    word = word_hashes(low, starts, letters)
    head = word_hashes(low, starts, np.minimum(letters, starts + HEAD))
    tail_starts = np.maximum(starts, letters - TAIL)
    tail = word_hashes(low, tail_starts, letters)
    stacked = np.stack([word ^ _KINDS[0], head ^ _KINDS[1], tail ^ _KINDS[2]], 1) if len(starts) else np.zeros((0, 3), np.uint64)
    return starts, ends, first, (mix(stacked) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _normal(m: np.ndarray) -> np.ndarray:
    return m / m.sum(axis=(-2, -1), keepdims=True)


class Field:
    """The trained field: feature weights, transitions (2 x 2, from row to column), scores of the state before the first word, and the curve for documents."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.weights, self.transitions, self.start = weights, transitions, start
        self.curve = np.array([0.0, 0.0, 1.0])

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        """How much more each word scores as toxic than as clean."""
        return np.clip(self.weights[buckets].sum(1) + self.weights[-1], -30, 30)

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The chance that each word is toxic; scores of consecutive texts, first as by spans().

        Each text is cut into blocks of STEP words. A block's matrix is the product over its
        words; matrices of a text's blocks give the vectors that enter each block from both
        sides, and a pass within the blocks gives the marginals.
        """
        out = np.zeros(len(scores))
        n = np.diff(first)
        docs = np.flatnonzero(n)
        if not len(docs):
            return out
        blocks_of = -(-n[docs] // STEP)
        block_doc = np.repeat(np.arange(len(docs)), blocks_of)
        nth = np.arange(len(block_doc)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
        at = first[:-1][docs][block_doc] + nth * STEP
        size = np.minimum(STEP, first[:-1][docs][block_doc] + n[docs][block_doc] - at)
        grid = at[:, None] + np.arange(STEP)
        inside = np.arange(STEP) < size[:, None]
        odds = np.where(inside, np.exp(scores[np.minimum(grid, len(scores) - 1)]), 1.0)
        t = np.exp(self.transitions)
        s = np.exp(self.start)
        total = len(at)
        # a word's matrix is t scaled by its odds; padding is the identity
        product = np.tile(np.eye(2), (total, 1, 1))
        for k in range(STEP):
            step = product @ t
            step[:, :, 1] *= odds[:, k, None]
            product = np.where(inside[:, k, None, None], _normal(step), product)
        enter, leave = np.zeros((total, 2)), np.ones((total, 2))
        bounds = np.cumsum(blocks_of) - blocks_of
        most = int(blocks_of.max())
        vector = np.tile(s / s.sum(), (len(docs), 1))
        for k in range(most):
            live = np.flatnonzero(blocks_of > k)
            enter[bounds[live] + k] = vector[live]
            after = np.einsum("bi,bij->bj", vector[live], product[bounds[live] + k])
            vector[live] = after / np.abs(after).sum(1, keepdims=True)
        vector = np.ones((len(docs), 2))
        for k in range(most):
            live = np.flatnonzero(blocks_of > k)
            b = bounds[live] + blocks_of[live] - 1 - k
            leave[b] = vector[live]
            before = np.einsum("bij,bj->bi", product[b], vector[live])
            vector[live] = before / before.sum(1, keepdims=True)
        alpha = np.zeros((total, STEP, 2))
        v = enter
        for k in range(STEP):
            w = v @ t
            w[:, 1] *= odds[:, k]
            w /= w.sum(1, keepdims=True)
            v = np.where(inside[:, k, None], w, v)
            alpha[:, k] = v
        chance = np.zeros((total, STEP))
        v = leave
        for k in range(STEP - 1, -1, -1):
            both = alpha[:, k] * v
            chance[:, k] = both[:, 1] / both.sum(1)
            w = v.copy()
            w[:, 1] *= odds[:, k]
            w = w @ t.T
            w /= w.sum(1, keepdims=True)
            v = np.where(inside[:, k, None], w, v)
        out[grid[inside]] = chance[inside]
        return out

    def score(self, chance: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each text."""
        x = summary(chance, first)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -35, 35)))


def summary(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the log of the expected number of toxic words, and the log-odds that the likeliest is toxic."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    expected, likeliest = np.zeros(len(n)), np.full(len(n), 1e-6)
    if len(some):
        expected[some] = np.add.reduceat(chance, first[:-1][some])
        likeliest[some] = np.maximum.reduceat(chance, first[:-1][some])
    p = np.clip(likeliest, 1e-6, 1 - 1e-6)
    return np.stack([np.log(expected + 1e-3), np.log(p / (1 - p))], 1)


def _chunked(texts: list[str]):
    """Features of all texts as one array."""
    firsts, found, at = [np.zeros(1, np.int64)], [], 0
    for _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        _, _, first, buckets = features(data, offsets)
        found.append(buckets)
        firsts.append(first[1:] + at)
        at += int(first[-1])
    return np.concatenate(firsts), np.concatenate(found) if found else np.zeros((0, 3), np.int32)


def token_labels(buckets: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words count as toxic: those of toxic texts whose word, or its beginning, marks toxic texts."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    in_toxic, in_clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for kind in (0, 1):
        pairs = np.unique(doc.astype(np.int64) * BUCKETS + buckets[:, kind])
        bad = toxic[pairs // BUCKETS]
        in_toxic += np.bincount(pairs[bad] % BUCKETS, minlength=BUCKETS)
        in_clean += np.bincount(pairs[~bad] % BUCKETS, minlength=BUCKETS)
    n_toxic, n_clean = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    ratio = (in_toxic + 0.5) / (n_toxic + 1) / ((in_clean + 0.5) / (n_clean + 1))
    marks = (in_toxic >= max(3, n_toxic / 100)) & (ratio > 20)
    return toxic[doc] & marks[buckets[:, :2]].any(1)


def train(texts: list[str], toxic: np.ndarray, share: float | None = None, rounds: int = 25, rate: float = 0.3) -> Field:
    """Fits the field to sequences of STEP words of two thirds of the sample, then the curve to the others.

    share: of all labelled documents, that of toxic ones, which the curve's constant is set to.
    A sample without both labels gives a field that scores each text as their share."""
    curve_part = np.arange(len(texts)) % 3 == 2
    if len(texts) >= 30 and all(toxic[part].any() and not toxic[part].all() for part in (curve_part, ~curve_part)):
        field = _train_field([t for t, c in zip(texts, curve_part, strict=True) if not c], toxic[~curve_part], rounds, rate)
        rest, target = [t for t, c in zip(texts, curve_part, strict=True) if c], toxic[curve_part]
    else:
        field, rest, target = _train_field(texts, toxic, rounds, rate), texts, toxic
    if not len(rest) or target.all() or not target.any():
        return field
    first, buckets = _chunked(rest)
    x = np.column_stack([np.ones(len(target)), summary(field.marginals(field.emissions(buckets), first), first)])
    curve = np.zeros(3)
    for _ in range(50):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        curve += np.linalg.solve(hessian, x.T @ (target - p) - 0.1 * curve)
    if share is not None and 0 < share < 1:
        curve[0] += np.log(share / (1 - share)) - np.log(target.mean() / (1 - target.mean()))
    field.curve = curve
    return field


def _train_field(texts: list[str], toxic: np.ndarray, rounds: int, rate: float) -> Field:
    first, buckets = _chunked(texts)
    field = Field(np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros(2))
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    field.curve = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if not len(buckets) or toxic.all() or not toxic.any():
        return field
    labels = token_labels(buckets, first, toxic).astype(np.int64)
    n = np.diff(first)
    at = np.concatenate([np.arange(a, a + c, STEP) for a, c in zip(first[:-1], n, strict=True) if c])
    stop = np.repeat(first[1:][n > 0], -(-n[n > 0] // STEP))
    grid = at[:, None] + np.arange(STEP)
    inside = grid < stop[:, None]
    grid = np.minimum(grid, len(buckets) - 1)
    counts = np.zeros((2, 2))
    pairs = inside[:, 1:]
    np.add.at(counts, (labels[grid[:, :-1]][pairs], labels[grid[:, 1:]][pairs]), 1)
    flat, y = buckets[grid[inside]], labels[grid[inside]]
    squares = np.full(BUCKETS + 1, 1e-8)
    squares_t = np.full((2, 2), 1e-8)
    bounds = np.concatenate([[0], np.cumsum(inside.sum(1))])
    field.weights[-1] = -2.0
    for _ in range(rounds):
        scores = field.emissions(flat)
        p = field.marginals(scores, bounds)
        two = _pair_expectations(field, scores, bounds, p)
        gap = y - p
        slope = np.zeros(BUCKETS + 1)
        for kind in range(3):
            slope[:BUCKETS] += np.bincount(flat[:, kind], gap, minlength=BUCKETS)
        slope[-1] = gap.sum()
        slope -= 0.1 * field.weights
        squares += slope**2
        field.weights += rate * slope / np.sqrt(squares)
        slope_t = counts - two - 0.1 * field.transitions
        squares_t += slope_t**2
        field.transitions += 0.3 * rate * slope_t / np.sqrt(squares_t)
    return field


def _pair_expectations(field: Field, scores: np.ndarray, first: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of transitions, from the marginals of neighbours and the chain between them.

    For two states the joint chance of a neighbouring pair follows from both marginals and the
    pair's odds ratio, which is that of the transition table."""
    ratio = np.exp(field.transitions[0, 0] + field.transitions[1, 1] - field.transitions[0, 1] - field.transitions[1, 0])
    same = np.ones(len(scores), bool)
    same[first[:-1][np.diff(first) > 0]] = False
    b = np.flatnonzero(same)
    x, y = p[b - 1], p[b]
    if abs(ratio - 1) < 1e-9:
        both = x * y
    else:
        s = 1 + (x + y) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * x * y, 0))) / (2 * (ratio - 1))
    both = np.clip(both, 0, np.minimum(x, y))
    return np.array([[(1 - x - y + both).sum(), (y - both).sum()], [(x - both).sum(), both.sum()]])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Trains on at most `sample` labelled documents of both labels, of at most sample_chars characters in all, taken whole in an order by hash.

    So that one text can't fill the sample, texts of over a hundredth of sample_chars don't train; they are scored whole like all others."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held_in = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    order = F.xxhash64("doc_id", F.lit(4))
    picked = held_in.where("toxic = 1").orderBy(order).limit(sample // 3).unionByName(held_in.where("toxic <> 1").orderBy(order).limit(sample - sample // 3))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most `sample` rows of two columns
    rows = sorted(found.where(F.length("text") <= sample_chars // 100).collect(), key=lambda r: (r["doc_id"] * 0x9E3779B1) % (1 << 32))
    texts, toxic, size = [], [], 0
    for r in rows:
        if size + len(r["text"]) > sample_chars:
            break
        size += len(r["text"])
        texts.append(r["text"])
        toxic.append(r["toxic"] == 1)
    n, bad = held_in.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    return train(texts, np.array(toxic, bool), bad / n if n else None)


def tag(docs: DataFrame, field, least: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): the score of every whole text and its toxic spans, in code points, end exclusive.

    field: a broadcast Field. A span is a run of words whose marginals reach `least`. A null or
    empty text has no words, no span and the score of a text in which nothing was found; repeated
    rows are scored each; other columns are left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = field.value
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                starts, ends, first, buckets = features(data, offsets)
                chance = own.marginals(own.emissions(buckets), first)
                scores = own.score(chance, first)
                n = len(offsets) - 1
                found: list[list[dict]] = [[] for _ in range(n)]
                hits = np.flatnonzero(chance >= least)
                if len(hits):
                    doc = np.searchsorted(first, hits, "right") - 1
                    new = np.ones(len(hits), bool)
                    new[1:] = (np.diff(hits) != 1) | (np.diff(doc) != 0)
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(hits)) - 1
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        d = int(doc[a])
                        found[d].append({"start": int(points[starts[hits[a]]] - points[offsets[d]]), "end": int(points[ends[hits[b]]] - points[offsets[d]])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(scores), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
