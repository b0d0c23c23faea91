"""Similarities of the members of clusters to all other members of their tenant, as one pass of block products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds

#: Faces of a tenant in one block; a task holds two blocks and their product.
BLOCK = 2048


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _forest(rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> list[list[int]]:
    """For each row the columns that link it to what it is not linked to yet; rows and cols number the faces, near marks links."""
    label = {int(x): int(x) for x in np.concatenate([rows, cols])}
    names = np.array(sorted(label))
    lab, at = names.copy(), np.searchsorted(names, cols)
    out = []
    for r, hits in zip(np.searchsorted(names, rows), near, strict=True):
        found = np.flatnonzero(hits)
        kinds, first = np.unique(lab[at[found]], return_index=True)
        fresh = kinds != lab[r]
        out.append(found[first[fresh]].tolist())
        lab[np.isin(lab, kinds[fresh])] = lab[r]
    return out


def _task(t: Thresholds, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        mine = table.filter(pc.equal(table["side"], 0)).sort_by("cluster_id")
        all_ = table.filter(pc.equal(table["side"], 1)).sort_by("cluster_id")
        if not len(mine) or not len(all_):
            return schema.empty_table()
        sim = _matrix(mine["v"]) @ _matrix(all_["v"]).T
        sim /= mine["norm"].to_numpy()[:, None] * all_["norm"].to_numpy() + 1e-9
        code = pc.index_in(all_["cluster_id"], value_set=pc.unique(all_["cluster_id"])).to_numpy()
        own = pc.fill_null(pc.index_in(mine["cluster_id"], value_set=pc.unique(all_["cluster_id"])), -1).to_numpy()
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        n, k = len(mine), len(begin)
        hits = sim >= t.match
        best, support = np.maximum.reduceat(sim, begin, axis=1), np.add.reduceat(hits, begin, axis=1, dtype=np.int64)
        if ids := [c for c in np.unique(own).tolist() if c >= 0]:
            names = pc.unique(pa.chunked_array([*mine["face_id"].chunks, *all_["face_id"].chunks]))
            number = [pc.index_in(x["face_id"], value_set=names).to_numpy() for x in (mine, all_)]
            ends = np.append(begin[1:], len(all_))
            for c in ids:  # in a face's own cluster the links at the lower boundary, as a forest
                rows, cols = np.flatnonzero(own == c), np.arange(begin[c], ends[c])
                hits[np.ix_(rows, cols)] = False
                for r, found in zip(rows, _forest(number[0][rows], number[1][cols], sim[np.ix_(rows, cols)] >= t.lower), strict=True):
                    hits[r, cols[found]] = True
        listed = np.add.reduceat(hits, begin, axis=1, dtype=np.int64).ravel()
        offsets = pa.array(np.concatenate([[0], np.cumsum(listed)]).astype(np.int32))
        other = pa.array(np.nonzero(hits)[1])
        face = pa.array(np.repeat(np.arange(n), k))
        lists = [pa.ListArray.from_arrays(offsets, pc.take(all_[c], other).combine_chunks()) for c in ("face_id", "photo_id")]
        target = pc.take(all_["cluster_id"], pa.array(np.tile(begin, n)))
        columns = [*(pc.take(mine[c], face) for c in ("user_id", "cluster_id", "face_id")), target, pa.array(best.ravel()), pa.array(support.ravel()), *lists]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def similarity_rows(members: DataFrame, sources: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(user_id, source, face_id, target, best, support, others, photos) for every face of the source clusters and every cluster of its tenant.

    best is the largest similarity to a member of the target, support how many members match, and
    others and photos list those. Where target is the source itself, others holds links of its
    faces at the lower boundary, which make a spanning forest of each task's links. A tenant of
    more than BLOCK faces is dealt to tasks by pairs of blocks, each with a row of its own: best,
    support and the lists are to be combined (see combined()). sources: user_id, cluster_id.
    """
    narrow = members.select("user_id", "cluster_id", "face_id", "photo_id", "v", "norm")
    sizes = members.groupBy("user_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = narrow.join(sizes, "user_id").withColumn("own", F.pmod(F.xxhash64("face_id"), F.col("blocks")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = placed.join(sources.select("user_id", "cluster_id").distinct(), ["user_id", "cluster_id"], "left_semi").withColumn("j", spread).withColumn("i", F.col("own")).withColumn("side", F.lit(0))
    all_ = placed.withColumn("i", spread).withColumn("j", F.col("own")).withColumn("side", F.lit(1))
    both = mine.unionByName(all_).drop("own", "blocks")
    kind = {c: members.schema[c].dataType.simpleString() for c in ("user_id", "cluster_id", "face_id", "photo_id")}
    names = {"user_id": kind["user_id"], "source": kind["cluster_id"], "face_id": kind["face_id"], "target": kind["cluster_id"], "best": "double", "support": "bigint", "others": f"array<{kind['face_id']}>", "photos": f"array<{kind['photo_id']}>"}
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join(f"{n} {d}" for n, d in names.items())
    arrow = to_arrow_schema(members.sparkSession.createDataFrame([], schema).schema)
    return both.groupBy("user_id", "i", "j").applyInArrow(_task(t, arrow), schema)


def combined(rows: DataFrame) -> DataFrame:
    """The rows of similarity_rows() of other clusters, one for each face and target."""
    keys = ["user_id", "source", "face_id", "target"]
    both = rows.where("source <> target").groupBy(*keys).agg(F.max("best").alias("best"), F.sum("support").alias("support"), F.collect_list("others").alias("others"), F.collect_list("photos").alias("photos"))
    return both.withColumn("others", F.flatten("others")).withColumn("photos", F.flatten("photos"))


def _parts(x: np.ndarray, y: np.ndarray, n: int) -> int:
    """How many components links between x and y make of n numbered faces."""
    label = np.arange(n)
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return len(np.unique(label))
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _linked(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        names = pc.unique(pa.chunked_array([*table["x"].chunks, *table["y"].chunks]))
        x, y = (pc.index_in(table[c], value_set=names).to_numpy() for c in "xy")
        counts = [pa.array([len(names)]), pa.array([_parts(x, y, len(names))])]
        return pa.Table.from_arrays([*(table[c].slice(0, 1) for c in ("user_id", "source")), *counts], schema=schema)

    return run


def connected(rows: DataFrame, sizes: DataFrame, most_blocks: int) -> DataFrame:
    """(user_id, source, connected): whether each source's faces are one component at the lower boundary.

    A forest of n - 1 links spans n faces; where a tenant has several blocks the links of their
    forests, at most two for each face and block, are joined up for each source in one task. The
    plan is the same for any links, so nothing of it stays on the driver."""
    edges = rows.where("source = target").select("user_id", "source", F.col("face_id").alias("x"), F.explode("others").alias("y"))
    own = rows.where("source = target").select("user_id", "source").distinct().join(sizes.select("user_id", F.col("cluster_id").alias("source"), "size"), ["user_id", "source"])
    if most_blocks <= 1:
        counted = edges.groupBy("user_id", "source").agg(F.count("*").alias("links"))
        return own.join(counted, ["user_id", "source"], "left").select("user_id", "source", (F.coalesce("links", F.lit(0)) == F.col("size") - 1).alias("connected"))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("user_id", "source")) + ", linked bigint, parts bigint"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    counted = edges.groupBy("user_id", "source").applyInArrow(_linked(arrow), schema)
    alone = F.col("size") - F.coalesce("linked", F.lit(0))
    return own.join(counted, ["user_id", "source"], "left").select("user_id", "source", (alone + F.coalesce("parts", F.lit(0)) == 1).alias("connected"))


def most_blocks(members: DataFrame) -> int:
    """How many blocks the largest tenant has."""
    n = members.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    return -(-n // BLOCK)
