"""One-to-one association of detections and landmark meshes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds
from kinlake.functions.geometry import association, extent, mesh_ratio


def distinct_meshes(candidates: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """candidates (photo_id, cand_index, points) without those close to an earlier one that stays; an ordered fold within each photo."""
    row = F.struct("cand_index", "points")
    grouped = candidates.groupBy("photo_id").agg(F.array_sort(F.collect_list(row)).alias("all"))  # a photo's few meshes
    empty = F.slice("all", 1, 0)
    kept = F.aggregate("all", empty, lambda got, x: F.when(F.exists(got, lambda g: mesh_ratio(g["points"], x["points"]) <= t.duplicate_mesh), got).otherwise(F.concat(got, F.array(x))))
    return grouped.select("photo_id", F.explode(kept).alias("k")).select("photo_id", F.col("k.cand_index").alias("cand_index"), F.col("k.points").alias("points"))


def edges(detections: DataFrame, candidates: DataFrame, nose_index: int = 1, least_points: int = 292) -> DataFrame:
    """(photo_id, det_index, cand_index, score, area) of the pairs that pass the gate; detections: photo_id, det_index, box (x1, y1, x2, y2)."""
    met = detections.join(candidates.withColumn("extent", extent(F.col("points"))), "photo_id")
    score: Column = association(F.col("box"), F.col("extent"), F.get("points", F.lit(nose_index)), F.size("points") >= least_points)
    area = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1"))
    return met.select("photo_id", "det_index", "cand_index", score.alias("score"), area.alias("area")).where("score is not null")


def one_to_one(scored: DataFrame) -> DataFrame:
    """(photo_id, det_index, cand_index, score): best edges first, each end used once; of equals the smaller detection, then the smaller indices."""

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "area", "det_index", "cand_index"], ascending=[False, True, True, True])
        used_d, used_c, out = set(), set(), []
        for r in rows.itertuples(index=False):
            if r.det_index not in used_d and r.cand_index not in used_c:
                used_d.add(r.det_index)
                used_c.add(r.cand_index)
                out.append((key[0], r.det_index, r.cand_index, r.score))
        return pd.DataFrame(out, columns=["photo_id", "det_index", "cand_index", "score"])

    return scored.groupBy("photo_id").applyInPandas(take, "photo_id long, det_index long, cand_index long, score double")


def associate(detections: DataFrame, candidates: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Every detection with its mesh, or none."""
    matched = one_to_one(edges(detections, distinct_meshes(candidates, t)))
    return detections.join(matched, ["photo_id", "det_index"], "left")
