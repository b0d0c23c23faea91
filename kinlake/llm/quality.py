"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic model on shapes of the text gives each document's own evidence. Grouped sums of it
estimate the share of good documents of each host and, within it, of each path. The spread
between groups, by the method of moments, says how far a sparse one is shrunk: a path toward its
host, a host toward all documents. A document's posterior odds are its own evidence times what
its path says without it. All statistics but the model's sample cover all documents; sums are
combined before the shuffle, and the join back is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import chunks, spans, word_hashes
from kinlake.llm.work import Scratch

SAMPLE = 4000
#: Characters of a training document's text are used whole; longer texts than this aren't sampled.
SAMPLE_LONGEST = 100_000
_KIND = np.full(256, 6, np.int64)  # beyond ASCII
_KIND[:128] = 5  # symbols
_KIND[[*range(97, 123)]], _KIND[[*range(65, 91)]], _KIND[[*range(48, 58)]] = 0, 1, 2
_KIND[[*b" \t\x0b\x0c\r"]], _KIND[10] = 3, 4
_KIND[[*b".,;:?'\"()-"]] = 7
SHAPES = 8 + 8


def shapes(column: pa.Array) -> np.ndarray:
    """For each text the shares of byte kinds, and of words by length, repetition and symbols."""
    out = []
    for _, data, offsets in chunks(column):
        n, m = len(offsets) - 1, np.diff(offsets)
        doc = np.repeat(np.arange(n), m)
        kinds = _KIND[data]
        share = np.bincount(doc * 8 + kinds, minlength=8 * n).reshape(n, 8) / np.maximum(m, 1)[:, None]
        starts, ends, first = spans(data, offsets)
        words = np.diff(first)
        owner = np.repeat(np.arange(n), words)
        size = ends - starts
        hashes = word_hashes(data, starts, ends, lower=True)
        per = lambda x: np.bincount(owner, x, minlength=n) / np.maximum(words, 1)  # noqa: E731, B023
        closes = kinds[np.maximum(ends - 1, 0)] == 5 if len(ends) else np.zeros(0, bool)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]) / np.maximum(words, 1)
        mean = per(size)
        out.append(
            np.column_stack([
                share, np.log1p(words), mean / 10, np.sqrt(np.maximum(per(size * size) - mean**2, 0)) / 10, per(size <= 3), per(closes), distinct, per(size == 1), per(size > 14),
            ])
        )
    return np.concatenate(out) if out else np.zeros((0, SHAPES))


class Model:
    """A logistic model on standardised shapes and their squares; its constant is the sample's log-odds until fitted."""

    def __init__(self, x: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        self.mean = x.mean(0) if len(x) else np.zeros(SHAPES)
        self.scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(SHAPES)
        self.w = np.zeros(1 + 2 * SHAPES)
        share = (good.sum() + 0.5) / (len(good) + 1)
        self.w[0] = np.log(share / (1 - share))
        if len(x) and good.any() and not good.all():
            z, y = self._expand(x), good.astype(float)
            penalty = np.full(z.shape[1], ridge)
            penalty[0] = 0
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
                step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * self.w)
                self.w += step / max(1.0, np.abs(step).max() / 3)

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.column_stack([np.ones(len(x)), z, z * z])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._expand(x) @ self.w, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most `sample` labelled documents, half of each label where there are enough, taken whole in an order by hash."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(10))
    half = sample // 2
    picked = known.where("quality = 1").orderBy(order).limit(half).unionByName(known.where("quality <> 1").orderBy(order).limit(half))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(f"text is null or length(text) <= {SAMPLE_LONGEST}")  # at most `sample` rows of two columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shapes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = found.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    good = rows["quality"].to_numpy() == 1
    model = Model(np.stack(rows["x"]) if len(rows) else np.zeros((0, SHAPES)), good)
    n, ok = known.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    if n and 0 < ok < n and good.any() and not good.all():  # the sample's halves back to the labels' shares
        model.w[0] += np.log(ok / (n - ok)) - np.log(good.mean() / (1 - good.mean()))
    return model


def evidence(docs: DataFrame, model, keys: list[str]) -> DataFrame:
    """keys and `evidence`, the log-odds that each whole text is good; model: a broadcast Model. A null text counts as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.evidence(shapes(batch.column(len(keys)))))], [*keys, "evidence"])

    return docs.select(*(F.col(f"`{k}`") for k in keys), F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{schema}, evidence double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: Column) -> Column:
    """How many documents the level above counts as: the moments' estimate of mean * (1 - mean) / variance - 1, from 2 to 10,000."""
    n = F.sum("n")
    between = F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - mean, 2))
    noise = F.sum((F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)))
    spread = F.greatest((between - noise) / n, F.lit(1e-9))
    return F.least(F.greatest(F.max(mean * (1 - mean)) / spread - 1, F.lit(2.0)), F.lit(10_000.0))


def posteriors(found: DataFrame, host: str, path: str) -> DataFrame:
    """found (with `evidence`) and the columns host_share, path_share and posterior.

    host_share and path_share are shrunk shares of good documents; the posterior combines a
    document's own evidence with the share of its path among the other documents. A null host or
    path is a group of its own.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    own_host, own_path = F.col(f"`{host}`"), F.col(f"`{path}`")
    sums = [F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(p * p).alias("squares")]
    paths = found.groupBy(own_host.alias("h"), own_path.alias("q")).agg(*sums)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    whole = hosts.agg((F.sum("total") / F.sum("n")).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(whole))  # one row
    levels = hosts.agg(_strength(F.col("mean")).alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(levels)).select(F.col("h").alias("hh"), "mean", ((F.col("total") + F.col("host_strength") * F.col("mean")) / (F.col("n") + F.col("host_strength"))).alias("host_share"))
    paths = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh")))
    inner = paths.agg(_strength(F.col("host_share")).alias("path_strength"))
    level = F.struct("h", "q", "n", "total", "mean", "host_share", "path_strength").alias("__level")  # one name, so that no column of found can clash
    paths = paths.crossJoin(F.broadcast(inner)).select(level)
    of = lambda c: F.col(f"__level.{c}")
    joined = found.join(paths, own_host.eqNullSafe(of("h")) & own_path.eqNullSafe(of("q")))
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    others = clip((of("total") - p + of("path_strength") * of("host_share")) / (of("n") - 1 + of("path_strength")))
    return joined.select(
        *(F.col(f"`{c}`") for c in found.columns),
        of("host_share").alias("host_share"),
        ((of("total") + of("path_strength") * of("host_share")) / (of("n") + of("path_strength"))).alias("path_share"),
        (1 / (1 + F.exp(-(F.col("evidence") + _logit(others) - _logit(clip(of("mean"))))))).alias("posterior"),
    )


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keys: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """keys, host, path, evidence, host_share, path_share and posterior of every document.

    A null or empty text is scored by the shape of an empty one; repeated rows count each; a table
    without usable labels gives every document even odds of its own; an empty table of documents
    gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    names = list(dict.fromkeys([*keys, host, path]))
    found = (scratch or Scratch(docs.sparkSession)).keep(evidence(docs, model, names))  # read three times below
    return posteriors(found, host, path)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs with a posterior of at least `least`, and their columns. Rows without a doc_id are judged too; rows that share doc_id and text are treated alike."""
    text_id = F.xxhash64(F.col("text").cast("string"))
    good = score(docs.withColumn("__text_id", text_id), labels, host, path, ("doc_id", "__text_id")).where(F.col("posterior") >= least)
    good = good.select(F.col("doc_id").alias("__id"), "__text_id").distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_id == F.col("__text_id")), "left_semi").select(*docs.columns)
