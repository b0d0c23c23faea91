"""Shared working folders, and connected components over a DataFrame of links."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="kinlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With this setting of the engine a query's shuffle files go when it ends. The tables of a Scratch are written once each, so none of them needs the files again.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor's tasks read them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/kinlake-{uuid.uuid4().hex}"
        self.count = 0
        self.numbers: dict[int, int] = {}

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """df as a table; for one of hashes, which hardly shrink, a faster compression is enough."""
        at, before = self.path(), self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", compression).parquet(at)
        finally:
            self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.numbers[id(out)] = self.count
        return out

    def release(self, *kept: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in kept:
            self.drop(self.numbers.pop(id(df)))

    def drop(self, number: int) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent to the driver.

    The engine takes a table's files for its size; of hashes and ids in narrow compressed columns
    these are a small part of what a broadcast of them holds there, which grows with the input."""
    return df.hint("merge")


#: Links that a task joins up at once.
LINKS_AT_ONCE = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some links, sorted, and the least id that each reaches over them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return ids, ids[label]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _stars(links: DataFrame) -> DataFrame:
    """(u, r): for each run of at most LINKS_AT_ONCE links, every id of it and the least that it reaches there."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= LINKS_AT_ONCE:
                yield _star(held)
                held, n = [], 0
        if n:
            yield _star(held)

    def _star(held):
        ids, least = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["u", "r"])

    return links.mapInArrow(run, "u long, r long")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches; ids without links are absent.

    links has two long columns a and b. Each round every task joins up the links it has, a bounded
    number at once, wherever they are; an id that is in several such runs then links the least
    ids that it reaches in them, and these links, between the least ids alone, go into the next
    round. Each round leaves at most half the ids that still have links, and one run is enough for
    what fits into it. An id has one row for each run, so a hub with any number of links is no
    single task, and the joins that lead labels back can be split. Every round is a table in the
    shared folder. Null ends and loops are left out; repeated links are harmless; an empty table
    gives an empty result.
    """
    scratch = scratch or Scratch(spark)
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    rounds = []
    while True:
        met = _stars(edges).groupBy("u").agg(F.min("r").alias("m"), F.collect_set("r").alias("rs"))
        met = scratch.keep(met.select("u", "m", F.array_remove("rs", F.col("m")).alias("rs")))
        rounds.append(met)
        edges = met.where("size(rs) > 0").select(F.explode("rs").alias("a"), F.col("m").alias("b"))
        if edges.isEmpty():
            break
    label = rounds.pop().select(F.col("u").alias("id"), F.col("m").alias("component"))
    while rounds:
        met = rounds.pop().select("u", "m")
        up = label.select(F.col("id").alias("m"), "component")
        label = scratch.keep(met.join(shuffled(up), "m", "left").select(F.col("u").alias("id"), F.coalesce("component", "m").alias("component")))
    return label


def deal(coarse: DataFrame, weights: DataFrame | None, most: int, heaviest: int = 0) -> DataFrame:
    """(id, group, block, i, j): where each member of each component is compared.

    A component of more than `most` members, or of more than `heaviest` weight, is split by a hash
    of the id into blocks within both; there is a task (i, j) for every two blocks and for each
    alone, so any two members meet once, and no task holds more than about two blocks.
    coarse: id, component; weights: id, weight (without them only members count).
    """
    weighed = coarse if weights is None else coarse.join(shuffled(weights), "id")
    blocks = F.ceil(F.count("*") / most)
    sizes = weighed.groupBy("component").agg((blocks if weights is None else F.greatest(blocks, F.ceil(F.sum("weight") / heaviest))).cast("int").alias("blocks"))
    placed = weighed.join(shuffled(sizes.where("blocks > 1")), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # few are split
    return in_blocks(placed)


def in_blocks(placed: DataFrame) -> DataFrame:
    """The tasks of deal() for members (id, component, blocks) whose component's number of blocks is known."""
    placed = placed.select("id", F.col("component").alias("group"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("id", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _starts(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Rows at which another key begins; the first one counts if it differs from that of the batch before."""
    changed = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        changed[1:] |= c[1:] != c[:-1]
        if last is not None:
            changed[0] |= last.column(last.schema.get_field_index(k))[-1].as_py() != c[0]
    return np.flatnonzero(changed)


def by_many_runs(df: DataFrame, keys: list[str], apply, schema: str) -> DataFrame:
    """Shuffles df by keys and calls apply(table) for whole runs of rows with one key, as many as came together; it returns a record batch or None."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys, held[-1] if held else None)
            if held and not len(starts):
                held.append(batch)
                continue
            cut = int(starts[-1]) if len(starts) else 0
            whole = [*held, batch.slice(0, cut)] if cut else held
            if whole and (out := apply(pa.Table.from_batches(whole))) is not None:
                yield out
            held = [batch.slice(cut)]
        if held and (out := apply(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def by_runs(df: DataFrame, keys: list[str], apply, schema: str, order: list[str] = ()) -> DataFrame:
    """Shuffles df by keys and calls apply(table) for the rows of each key, as an Arrow table; it returns a record batch or None.

    Unlike a grouped map it costs next to nothing for a group of two rows."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys, held[-1] if held else None).tolist()
            cuts = [0, *starts, batch.num_rows]
            first = set(starts)
            for a, b in zip(cuts, cuts[1:]):
                if a in first and held:
                    if (out := apply(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held and (out := apply(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
