"""Bounded exemplar sets of a cluster (V5 to V8)."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds


def quality_exemplars(faces: DataFrame, t: Thresholds = DEFAULT, cluster: str = "home") -> DataFrame:
    """The best eligible faces of each cluster, as many as both buckets hold; the closed form of a rebuild without pose replacement."""
    eligible = faces.where((F.col("quality_score") >= t.exemplar_quality) & ~F.col("restricted") & F.col(cluster).isNotNull())
    order = Window.partitionBy("user_id", cluster).orderBy(F.desc("quality_score"), "face_id")
    ranked = eligible.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= t.quality_bucket + t.pose_bucket)
    return ranked.select(
        "user_id", F.col(cluster).alias("cluster_id"), F.when(F.col("ordinal") <= t.quality_bucket, "quality").otherwise("pose").alias("bucket"), "ordinal", "face_id", "quality_score", "yaw_ratio", "v", "norm"
    )


@dataclass
class ExemplarSet:
    """Two bounded buckets; items are (face_id, quality, yaw)."""

    most_quality: int = 3
    most_pose: int = 2
    quality: list[tuple] = field(default_factory=list)
    pose: list[tuple] = field(default_factory=list)

    def add(self, item: tuple) -> bool:
        """Takes a free quality slot or that of a weaker one, which is dropped; else tries the pose bucket."""
        if len(self.quality) >= self.most_quality:
            weakest = min(range(len(self.quality)), key=lambda i: self.quality[i][1])
            if item[1] <= self.quality[weakest][1]:
                return self._add_pose(item)
            del self.quality[weakest]
        self.quality.append(item)
        self.quality.sort(key=lambda x: -x[1])
        return True

    def _gap(self, yaw: float, skip: int = -1) -> float:
        """The least turn between a yaw and all exemplars but pose number `skip`."""
        others = [x[2] for x in self.quality] + [x[2] for i, x in enumerate(self.pose) if i != skip]
        return min((abs(yaw - y) for y in others), default=float("inf"))

    def _add_pose(self, item: tuple) -> bool:
        if len(self.pose) < self.most_pose:
            self.pose.append(item)
            return True
        if not self.pose:
            return False
        gaps = [self._gap(x[2], i) for i, x in enumerate(self.pose)]
        closest = gaps.index(min(gaps))
        if self._gap(item[2]) <= gaps[closest]:
            return False
        del self.pose[closest]
        self.pose.append(item)
        return True

    def remove(self, face_id) -> bool:
        for bucket in (self.quality, self.pose):
            for i, x in enumerate(bucket):
                if x[0] == face_id:
                    del bucket[i]
                    return True
        return False

    def __len__(self) -> int:
        return len(self.quality) + len(self.pose)


def fold_exemplars(faces: DataFrame, order: list[str], t: Thresholds = DEFAULT, cluster: str = "cluster_id") -> DataFrame:
    """(user_id, cluster_id, bucket, ordinal, face_id): the sets after adding each cluster's eligible faces in the given order.

    The order matters, so each cluster is one ordered fold, on four narrow columns of its faces."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = ExemplarSet(t.quality_bucket, t.pose_bucket)
        for x in rows.sort_values(order, kind="stable")[["face_id", "quality_score", "yaw_ratio"]].itertuples(index=False):
            own.add(tuple(x))
        out = [(key[0], key[1], b, i, x[0]) for b, bucket in (("quality", own.quality), ("pose", own.pose)) for i, x in enumerate(bucket, 1)]
        return pd.DataFrame(out, columns=["user_id", "cluster_id", "bucket", "ordinal", "face_id"])

    eligible = faces.where((F.col("quality_score") >= t.exemplar_quality) & ~F.col("restricted") & F.col(cluster).isNotNull())
    narrow = eligible.select("user_id", F.col(cluster).alias("cluster_id"), "face_id", "quality_score", "yaw_ratio", *[c for c in order if c not in ("face_id", "quality_score", "yaw_ratio")])
    return narrow.groupBy("user_id", "cluster_id").applyInPandas(fold, "user_id long, cluster_id long, bucket string, ordinal int, face_id long")


def rebuild(faces: DataFrame, t: Thresholds = DEFAULT, low_quality_seed: bool = False) -> DataFrame:
    """Exemplars of each cluster from its members, best first; with low_quality_seed a cluster without an eligible face gets its best member."""
    found = fold_exemplars(faces.where(F.col("assignment_state").isin("confirmed", "manual")).withColumn("minus", -F.col("quality_score")), ["minus", "face_id"], t)
    if not low_quality_seed:
        return found
    members = faces.where(F.col("assignment_state").isin("confirmed", "manual") & F.col("cluster_id").isNotNull())
    seed = members.groupBy("user_id", "cluster_id").agg(F.min_by("face_id", F.struct(-F.col("quality_score"), "face_id")).alias("face_id"))
    bare = seed.join(found.select("user_id", "cluster_id").distinct(), ["user_id", "cluster_id"], "left_anti")
    return found.unionByName(bare.select("user_id", "cluster_id", F.lit("quality").alias("bucket"), F.lit(1).alias("ordinal"), "face_id"))


def rebuilt(faces: DataFrame, t: Thresholds = DEFAULT, low_quality_seed: bool = False) -> DataFrame:
    """rebuild() with the columns of quality_exemplars(); the pose bucket is numbered on from the quality bucket."""
    ordinal = F.col("ordinal") + F.when(F.col("bucket") == "pose", t.quality_bucket).otherwise(0)
    found = rebuild(faces, t, low_quality_seed).withColumn("ordinal", ordinal)
    own = faces.select("user_id", "cluster_id", "face_id", "quality_score", "yaw_ratio", "v", "norm")
    return found.join(own, ["user_id", "cluster_id", "face_id"]).select("user_id", "cluster_id", "bucket", "ordinal", "face_id", "quality_score", "yaw_ratio", "v", "norm")
