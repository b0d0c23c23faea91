"""Nearest neighbours by inner product: inverted lists and adaptive dimension scans.

Vectors get one more component that brings all to the largest norm, so the largest inner product
is the smallest distance, and are turned by a fixed random rotation. Centroids of a bounded
sample make the lists; every vector is in one. A query probes a share of the lists, nearest
first. In each it reads its candidates block of columns by block: the distance over the columns
read so far, scaled up, is a test of whether the whole is within the query's limit, and a
candidate that fails it is abandoned. What is left is compared by its inner product in double
precision. The limit starts at the query's k-th best in the sample and falls as lists are read.

Lists are dealt to parts of about PART vectors, a large list to several, and queries to blocks of
at most QUERIES; a task holds one part and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlake.llm.work import by_runs

SAMPLE = 8192
LISTS = 2048
PROBED = 0.65
FEW_LISTS = 24
COLUMNS = 16
CONFIDENCE = 2.1
PART, QUERIES = 8192, 8192
MERGE_AFTER = 200_000


def usable(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v as doubles) of the rows that take part, and their dimension, the commonest (of equals the larger)."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows, 0) if sizes is None else (rows.where(F.size("v") == sizes["d"]), sizes["d"])


class Index:
    """The rotation, centroids and sample; a plain object of bounded size that is broadcast."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, norm: float, n: int, k: int):
        self.norm, self.k, self.sample, self.ids = norm, k, sample, ids
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))[0]
        lists = int(min(LISTS, max(1, round(np.sqrt(n))), len(sample)))
        x = self.turn(sample)
        self.centroids = x[np.random.default_rng(6).choice(len(x), lists, replace=False)]
        for _ in range(8):
            near = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, x)
            count = np.bincount(near, minlength=lists)
            self.centroids[count > 0] = sums[count > 0] / count[count > 0, None]
        self.probes = lists if lists <= FEW_LISTS else int(np.ceil(PROBED * lists))

    def turn(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def turn_query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        gap = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        if n == 1:
            return gap.argmin(1)[:, None]
        return np.sort(np.argpartition(gap, n - 1, axis=1)[:, :n], axis=1) if n < gap.shape[1] else np.tile(np.arange(n), (len(x), 1))

    def sampled(self, q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query in the sample: ids and inner products (-inf beyond a small sample), and what the k-th reaches."""
        s = q @ self.sample.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        k = min(self.k, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        exact = np.where(np.isinf(np.take_along_axis(s, top, 1)), -np.inf, (q[:, None, :] * self.sample[top]).sum(2))
        return self.ids[top], exact, exact.min(1) if k == self.k else np.full(len(q), -np.inf)


def scan(index: Index, lists: np.ndarray, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, probes: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, inner product) of the k best found for each query among the rows x, sorted by list."""
    turned, q_turned = index.turn(x), index.turn_query(q)
    d = turned.shape[1]
    q_norms = (q * q).sum(1)
    by_list: dict[int, list[int]] = {}
    for i, p in enumerate(probes):
        for one in p.tolist():
            by_list.setdefault(one, []).append(i)
    limit = q_norms + index.norm**2 - 2 * least  # the squared distance that stands for the inner product
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found, waiting = [], 0

    def merge():
        nonlocal best, found, waiting
        a, b, s = (np.concatenate(c) for c in zip(best, *found, strict=True))
        order = np.lexsort((ids[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        full = nth == index.k - 1
        limit[a[full]] = np.minimum(limit[a[full]], q_norms[a[full]] + index.norm**2 - 2 * s[full])
        best = (a[nth < index.k], b[nth < index.k], s[nth < index.k])
        found, waiting = [], 0

    cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
    for low, high in zip(cuts, np.r_[cuts[1:], len(lists)], strict=True):
        asking = np.array(by_list.get(int(lists[low]), []), np.int64)
        for a in range(low, high, 2048):
            b = min(a + 2048, high)
            for part in range(0, len(asking), 1024):
                rows = asking[part : part + 1024]
                left, right = q_turned[rows, :COLUMNS], turned[a:b, :COLUMNS]
                seen = min(COLUMNS, d)
                partial = np.maximum((left**2).sum(1)[:, None] + (right**2).sum(1) - 2 * left @ right.T, 0)
                bound = limit[rows] * (1 + CONFIDENCE / np.sqrt(seen)) ** 2 * seen / d if seen < d else limit[rows]
                qi, xi = np.nonzero(partial <= bound[:, None] + 1e-9)
                at, xi, partial = rows[qi], xi + a, partial[qi, xi]
                while seen < d and len(at):
                    stop = min(seen + COLUMNS, d)
                    gap = q_turned[at, seen:stop] - turned[xi, seen:stop]
                    partial = partial + (gap * gap).sum(1)
                    seen = stop
                    bound = limit[at] * ((1 + CONFIDENCE / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1)
                    stay = partial <= bound + 1e-9
                    at, xi, partial = at[stay], xi[stay], partial[stay]
                other = q_ids[at] != ids[xi]
                at, xi = at[other], xi[other]
                if len(at):
                    found.append((at, xi, (q[at] * x[xi]).sum(1)))
                    waiting += len(at)
                    if waiting > MERGE_AFTER:
                        merge()
    if found:
        merge()
    return best


def search(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, nearest first, ties to the smaller vec_id.

    is_query: a condition on the column `id`. Rows whose vector is null, empty, zero, of another
    dimension than most, or holds null or non-finite components take no part; nor do null ids. A
    vector is no neighbour of itself, by id; ids must be unique. With k or fewer candidates all
    are returned; an empty table gives an empty result; other columns are left out.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, d = usable(df, vec_id, vector)
    if not d:
        return spark.createDataFrame([], schema)
    n, asked, norm = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not asked:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id", F.lit(8)), "id").limit(SAMPLE).collect()  # at most SAMPLE vectors
    own = spark.sparkContext.broadcast(Index(np.array([r["v"] for r in sample], float), np.array([r["id"] for r in sample]), norm * (1 + 1e-12), n, k))
    parts, blocks = max(1, -(-n // PART)), max(1, -(-asked // QUERIES))

    def matrix(column) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(-1, d)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = own.value.nearest(own.value.turn(matrix(batch.column(1))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *batch.columns], ["list", "id", "v"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                piece = batch.slice(a, 1024)
                q, ids = matrix(piece.column(1)), piece.column(0).to_numpy()
                probes = own.value.nearest(own.value.turn_query(q), own.value.probes).astype(np.int32)
                near, scores, least = own.value.sampled(q, ids)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(list(probes), pa.list_(pa.int32())), pa.array(least), pa.array(list(near), pa.list_(pa.int64())), pa.array(list(scores), pa.list_(pa.float64()))],
                    ["id", "v", "probes", "least", "near", "scores"],
                )

    held = rows.mapInArrow(assign, "list int, id long, v array<double>")
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("pieces"))
    held = held.join(F.broadcast(sizes), "list")  # at most LISTS rows
    held = held.withColumn("part", F.pmod(F.xxhash64("list", F.pmod(F.xxhash64("id"), F.col("pieces"))), F.lit(parts)))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = F.lit(None)
    asked_rows = rows.where(is_query).mapInArrow(prepare, "id long, v array<double>, probes array<int>, least double, near array<long>, scores array<double>")
    asks = asked_rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    both = held.select("part", "block", "list", "id", "v", none.cast("array<int>").alias("probes"), none.cast("double").alias("least")).unionByName(
        asks.select("part", "block", F.lit(-1).alias("list"), "id", "v", "probes", "least")
    )

    def run(group: pa.Table) -> pa.RecordBatch | None:
        lists, ids, v = group["list"].to_numpy(), group["id"].to_numpy(), matrix(group["v"].combine_chunks())
        m = int((lists < 0).sum())  # queries come first
        if not m or m == len(lists):
            return None
        probes = [np.asarray(p.values) for p in group["probes"].combine_chunks()[:m]]
        a, b, s = scan(own.value, lists[m:], ids[m:], v[m:], ids[:m], v[:m], probes, group["least"].to_numpy()[:m].copy())
        return pa.RecordBatch.from_arrays([pa.array(ids[:m][a]), pa.array(ids[m:][b]), pa.array(s)], ["query_id", "vec_id", "score"])

    found = by_runs(both, ["part", "block"], run, "query_id long, vec_id long, score double", order=["list", "id"])
    first = asked_rows.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("s")).select("query_id", F.col("s.near").alias("vec_id"), F.col("s.scores").alias("score"))
    found = found.unionByName(first.where(F.col("score") > float("-inf"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
