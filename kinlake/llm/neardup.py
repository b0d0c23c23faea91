"""MinHash near-duplicates by an LSH forest.

Texts are sets of hashed word shingles; equal sets are one class. Each of TREES trees has its own
sequence of LONGEST minhashes, and its classes are put in the order of these sequences: one sort
by ranges over all trees, in which a run of like sequences may go on from one partition to the
next. Neighbours in an order are candidates by the length of the prefix that both share. The
depth at which they are adapts to the region: `depth` is enough everywhere, and so is up to two
less where a class has no neighbour that deep, as long as the two are each other's nearest; in a
crowded region neighbours share more, and each class still is a candidate of its two neighbours
only, so no region writes out its pairs. `depth` is the largest at which a pair at the threshold
shares no region of any of the trees with a chance below 1 in a million: 6 at 0.85, 4 at 0.8.

The components of these candidates are found: all classes of a region are in one component, so a
pair needs no link of its own to meet. Within each, minhashes are compared first, and only texts
of classes that are likely (up to 6 standard deviations off) to have a similar one are read again,
to confirm the links on full sets. A component of many classes is dealt to several tasks, one for
every two blocks of it, for either step, so any pair of it meets in one task and no task holds
more than two blocks. A task drops a pair only if both are linked already, if their sizes or their
minhashes rule the similarity out, or if the full sets do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import _LOWER, chunks, rolling, spans, text_windows, word_hashes
from kinlake.llm.work import Scratch, by_runs, components, deal, shuffled

HASHES = 128
TREES, LONGEST = 32, 8
#: How much less than `depth` is enough for two classes that are each other's nearest, but never less than SHALLOWEST.
SLACK, SHALLOWEST = 2, 4
#: Classes of a block while minhashes are compared, and classes and shingles of one while sets are.
BLOCK_ORDERS, BLOCK, SHINGLES = 2048, 1024, 2_000_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64)
#: Bytes of a tree's sequence: two of each minhash. No minhash is in two trees, so they are independent.
SEQUENCE = 2 * LONGEST


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of k consecutive words; a shorter text is one shingle, one without words none."""
    for _, data, offsets in chunks(column):
        starts, ends, first = spans(_LOWER[data], offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        grams, valid = rolling(hashes, k), text_windows(first, k)
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                assert valid[a] and valid[b - k]
                yield np.unique(grams[a : b - k + 1])
            else:
                yield rolling(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray, n: int = HASHES) -> np.ndarray:
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (_A[:n, None] * shingles[None, i : i + 4096] + _B[:n, None]).min(1))
    return low


def depth_for(percent: int) -> int:
    s = percent / 100
    return max(d for d in range(1, LONGEST + 1) if d == 1 or (1 - s**d) ** TREES <= 1e-6)


def signatures(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, orders): set_id digests the full set; orders holds each tree's sequence, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, orders = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                orders.append((minhashes(s, TREES * LONGEST) >> np.uint64(48)).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(orders, pa.binary())], ["doc_id", "n_shingles", "set_id", "orders"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, orders binary")


def shared_prefix(tree: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """For each row but the last, how many minhashes its sequence shares with that of the next row, none in another tree."""
    same = (sequence[1:] == sequence[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(1)


def deep_enough(prefix: np.ndarray, before: int, depth: int) -> np.ndarray:
    """Which of the prefixes make two rows candidates; before: the prefix that stands before the first, 0 follows the last."""
    least = max(depth - SLACK, min(depth, SHALLOWEST))
    left, right = np.concatenate([[before], prefix[:-1]]), np.concatenate([prefix[1:], [0]])
    return (prefix >= depth) | ((prefix >= least) & (prefix > left) & (prefix > right))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sequence = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, LONGEST)
    return batch.column(0).to_numpy(), sequence, batch.column(2).to_numpy()


def neighbours(spots: DataFrame, depth: int) -> DataFrame:
    """(a, b, tree, sequence) from spots (tree, sequence, doc_id) in order: a and b are candidates; rows with a tree are instead the first and the last of a partition, a its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, last = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield _edge(batch, 0)
            last = batch
            tree, sequence, doc = _rows(batch)
            if held is not None:
                tree, sequence, doc = (np.concatenate(x) for x in zip(held, (tree, sequence, doc), strict=True))
            prefix = shared_prefix(tree, sequence)
            if len(prefix) > 1:  # the last prefix waits for the next one
                good = np.flatnonzero(deep_enough(prefix, before, depth)[:-1])
                yield _links(doc[good], doc[good + 1])
                before = int(prefix[-2])
                held = tree[-2:], sequence[-2:], doc[-2:]
            else:
                held = tree, sequence, doc
        if last is not None:
            if len(held[0]) == 2 and deep_enough(shared_prefix(*held[:2]), before, depth)[0]:
                yield _links(held[2][:1], held[2][1:])
            yield _edge(last, last.num_rows - 1)

    def _links(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], ["a", "b", "tree", "sequence"])

    def _edge(batch, i):
        row = batch.slice(i, 1)
        return pa.RecordBatch.from_arrays([row.column(2), pa.nulls(1, pa.int64()), row.column(0).cast(pa.int32()), row.column(1).cast(pa.binary())], ["a", "b", "tree", "sequence"])

    return spots.mapInArrow(run, "a long, b long, tree int, sequence binary")


def candidates(classes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between neighbours of all orders; classes: doc_id, orders."""
    spots = classes.where("orders is not null").select("doc_id", "orders", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    spots = spots.select("tree", F.expr(f"substring(orders, tree * {SEQUENCE} + 1, {SEQUENCE})").alias("sequence"), "doc_id")
    order = ["tree", "sequence", "doc_id"]
    found = scratch.keep(neighbours(spots.repartitionByRange(*order).sortWithinPartitions(*order), depth))
    edges = found.where("tree is not null").select("tree", "sequence", F.col("a").alias("doc_id"))  # two rows of each partition
    over = neighbours(edges.repartition(1).sortWithinPartitions(*order), depth).where("tree is null")
    return found.where("tree is null").select("a", "b").unionByName(over.select("a", "b")).where("a <> b").distinct()


def _sketch(s: np.ndarray) -> np.ndarray:
    return (minhashes(s) >> np.uint64(56)).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, exactly."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirm(ids: np.ndarray, sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar sets: a spanning forest of the similarity graph of one group.

    cross: a block number for each; only pairs of different blocks are compared then. Pairs that
    are connected already are not compared; every other pair is."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    label, links = np.arange(n), []
    sketches = np.stack([_sketch(s) for s in sets]) if n > 4 else None
    floor = HASHES * percent / 100 - 6 * np.sqrt(HASHES * percent / 100 * (1 - percent / 100))
    for i in np.argsort(sizes, kind="stable")[::-1] if n > 4 else range(n):
        other = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if cross is not None:
            other &= cross != cross[i]
        j = np.flatnonzero(other)
        if sketches is not None and len(j):
            near = (sketches[j] == sketches[i]).sum(1)
            order = np.argsort(-near, kind="stable")
            j = j[order][near[order] >= floor]
        for x in j:
            if label[x] != label[i] and similar(sets[i], sets[x], percent):
                links.append((int(ids[i]), int(ids[x])))
                label[label == label[x]] = label[i]
    return links


def likely(tasks: DataFrame, percent: int) -> DataFrame:
    """(component, id): the classes of each task that have a likely partner in it; component stands for the task. tasks: group, i, j, id, block, n_shingles, orders."""
    share, n = percent / 100, TREES * LONGEST
    least = n * share - 6 * np.sqrt(n * share * (1 - share))

    def run(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        hashes = np.frombuffer(b"".join(group["orders"].to_pylist()), np.uint16).reshape(-1, n)
        sizes, blocks, ids = (group[c].to_numpy() for c in ("n_shingles", "block", "id"))
        alone, has = group["i"][0] == group["j"][0], np.zeros(len(ids), bool)
        for x in range(1, len(ids)):
            fits = (100 * np.minimum(sizes[:x], sizes[x]) >= percent * np.maximum(sizes[:x], sizes[x])) & ~(has[:x] & has[x])
            if not alone:
                fits &= blocks[:x] != blocks[x]
            y = np.flatnonzero(fits)
            y = y[(hashes[y] == hashes[x]).sum(1) >= least]
            has[y] = True
            has[x] |= len(y) > 0
        if not has.any():
            return None
        name = hashlib.blake2b(f"{group['group'][0]} {group['i'][0]} {group['j'][0]}".encode(), digest_size=8).digest()
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(has.sum()), int.from_bytes(name, "little", signed=True))), pa.array(ids[has])], ["component", "id"])

    return by_runs(tasks, ["group", "i", "j"], run, "component long, id long")


def verified(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links confirmed on full sets; texts: group, i, j (the task), id, block, text."""

    def run(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        sets = list(shingle_sets(group["text"], k))
        alone = group["i"][0] == group["j"][0]
        links = confirm(group["id"].to_numpy(), sets, percent, None if alone else group["block"].to_numpy())
        if not links:
            return None
        a, b = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_runs(texts, ["group", "i", "j"], run, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links of similar shingle sets.

    Texts are linked with 100 * intersection >= percent * union of their sets of k lower-cased
    words (A-Z only). Texts with equal sets are linked. A text with fewer words is one shingle; a
    text without words, or null, is linked with nothing. Rows without a doc_id are left out, and
    rows that share one are one node; other columns are left out; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    docs = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = scratch.keep(signatures(docs, k))
    members = signed_docs.select("doc_id", "n_shingles", "set_id")
    # tables of their own, so that the joins back to hot sets can be split
    leads = scratch.keep(members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("lead")))
    classes = signed_docs.join(shuffled(leads.select(F.col("lead").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "n_shingles", "orders")
    classes = scratch.keep(classes)
    coarse = components(spark, candidates(classes, depth_for(percent), scratch), scratch)
    known = classes.select(F.col("doc_id").alias("id"), "n_shingles", "orders")
    alive = scratch.keep(likely(deal(coarse, None, BLOCK_ORDERS).join(shuffled(known), "id"), percent).distinct())
    dealt = deal(alive, classes.groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("weight")), BLOCK, SHINGLES)
    links = scratch.keep(verified(docs.withColumnRenamed("doc_id", "id").join(shuffled(dealt), "id"), k, percent))
    joined = components(spark, links, scratch)
    found = scratch.keep(leads.join(shuffled(joined), leads["lead"] == joined["id"], "left").select("set_id", F.coalesce("component", "lead").alias("component")))
    scratch.release(leads, classes, alive, links)
    return members.join(shuffled(found), "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
