"""Integrity checks (I1): each a query of its own; all have the columns check, user_id, entity_id and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.config import LEGACY_VERSION, MEMBER_STATES


def _member():
    return F.col("assignment_state").isin(*MEMBER_STATES)


def _row(df: DataFrame, check: str, entity, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), "user_id", F.col(entity).cast("string").alias("entity_id"), detail.cast("string").alias("detail"))


def member_counts(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Active clusters with their stored count and the actual one."""
    counted = faces.where(_member() & F.col("cluster_id").isNotNull()).groupBy("user_id", "cluster_id").agg(F.count("*").alias("actual"))
    return clusters.where("merged_into is null").join(counted, ["user_id", "cluster_id"], "left").select("user_id", "cluster_id", "face_count", F.coalesce("actual", F.lit(0)).cast("int").alias("actual"))


def count_drift(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    return _row(member_counts(clusters, faces).where("face_count <> actual"), "count_drift", "cluster_id", F.concat_ws("/", F.col("face_count").cast("string"), F.col("actual").cast("string")))


def photo_duplicates(faces: DataFrame) -> DataFrame:
    many = faces.where(_member() & F.col("photo_id").isNotNull() & F.col("cluster_id").isNotNull()).groupBy("user_id", "cluster_id", "photo_id").agg(F.count("*").alias("n")).where("n > 1")
    return _row(many, "same_photo_duplicate", "cluster_id", F.concat_ws(":", F.col("photo_id").cast("string"), F.col("n").cast("string")))


def state_mismatch(faces: DataFrame) -> DataFrame:
    wrong = (_member() & F.col("cluster_id").isNull()) | (~_member() & F.col("cluster_id").isNotNull())
    return _row(faces.where(wrong), "state_cluster_mismatch", "face_id", F.col("assignment_state"))


def invalid_exemplars(exemplars: DataFrame, faces: DataFrame) -> DataFrame:
    known = faces.select("user_id", "face_id", F.col("cluster_id").alias("face_cluster"), "assignment_state", "restricted")
    met = exemplars.select("user_id", "cluster_id", "face_id").join(known, ["user_id", "face_id"], "left")
    bad = F.col("face_id").isNull() | F.col("assignment_state").isNull() | (F.col("face_cluster") != F.col("cluster_id")) | ~_member() | F.col("restricted")
    return _row(met.where(bad), "invalid_exemplar", "face_id", F.col("cluster_id"))


def without_exemplar(clusters: DataFrame, exemplars: DataFrame) -> DataFrame:
    bare = clusters.where("merged_into is null").join(exemplars.select("user_id", "cluster_id").distinct(), ["user_id", "cluster_id"], "left_anti")
    return _row(bare, "cluster_without_exemplar", "cluster_id", F.lit(""))


def wrong_dimension(faces: DataFrame, dimension: int, vector: str = "v") -> DataFrame:
    return _row(faces.where(F.size(vector) != dimension), "embedding_dimension", "face_id", F.size(vector))


def mixed_versions(faces: DataFrame, version: str = "embedding_model_version") -> DataFrame:
    v = F.coalesce(F.nullif(F.col(version), F.lit("")), F.lit(LEGACY_VERSION))
    several = faces.where(v != LEGACY_VERSION).groupBy("user_id").agg(F.count_distinct(v).alias("n")).where("n > 1")
    return _row(several, "mixed_model_versions", "user_id", F.col("n"))


def validate(clusters: DataFrame, faces: DataFrame, exemplars: DataFrame, dimension: int) -> DataFrame:
    checks = [count_drift(clusters, faces), photo_duplicates(faces), state_mismatch(faces), invalid_exemplars(exemplars, faces), without_exemplar(clusters, exemplars), wrong_dimension(faces, dimension)]
    if "embedding_model_version" in faces.columns:
        checks.append(mixed_versions(faces))
    return reduce(DataFrame.unionByName, checks)
