"""Reads for the gallery and the lifecycle of clusters and tenants (Q2 to Q6, F12, D13 to D15, R3, R4, L*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds


def visibility(count: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(count >= t.visible_faces, "main_grid").when(count == t.visible_faces - 1, "possible_person").otherwise("hidden")


def people(clusters: DataFrame, exemplars: DataFrame, faces: DataFrame, include_hidden: bool = False, t: Thresholds = DEFAULT) -> DataFrame:
    """Active clusters with visibility and a representative face, largest first."""
    first = exemplars.groupBy("user_id", "cluster_id").agg(F.min_by("face_id", F.struct("ordinal", "face_id")).alias("representative"))
    photo = faces.select("user_id", F.col("face_id").alias("representative"), F.col("photo_id").alias("representative_photo"))
    out = clusters.where("merged_into is null").join(first, ["user_id", "cluster_id"], "left").join(photo, ["user_id", "representative"], "left")
    out = out.select("user_id", "cluster_id", "face_count", visibility(F.col("face_count"), t).alias("visibility"), "representative", "representative_photo")
    return (out if include_hidden else out.where("visibility <> 'hidden'")).orderBy("user_id", F.desc("face_count"), "cluster_id")


def person_photos(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(user_id, cluster_id, photo columns): photos with a member of each cluster, once each."""
    members = faces.where(F.col("assignment_state").isin("confirmed", "manual") & F.col("cluster_id").isNotNull()).select("user_id", "photo_id", "cluster_id").distinct()
    return photos.join(members, ["user_id", "photo_id"]).orderBy("user_id", "cluster_id", "processed_at", "photo_id")


def pending_suggestions(suggestions: DataFrame) -> DataFrame:
    return suggestions.where("status = 'pending'").orderBy("user_id", "created_at", "suggestion_id")


def face_view(faces: DataFrame) -> DataFrame:
    """Faces with their box as a struct, null if any corner is."""
    corners = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    whole = F.expr(" and ".join(f"{c} is not null" for c in corners))
    return faces.withColumn("bbox", F.when(whole, F.struct(*corners))).drop(*corners)


def prunable(clusters: DataFrame, now: Column, t: Thresholds = DEFAULT) -> DataFrame:
    return clusters.where(F.col("merged_into").isNull() & (F.col("face_count") < t.visible_faces) & (F.datediff(now, F.col("last_updated_at")) >= t.prune_days))


def consolidation_due(lifecycle: DataFrame, now: Column, t: Thresholds = DEFAULT) -> DataFrame:
    """lifecycle with due_reason and due_since; the photo count wins over the idle time."""
    n, last = F.col("photos_since_consolidation"), F.col("last_photo_completed_at")
    idle_at = last + F.expr(f"interval '{t.idle_hours}' hour")
    reason = F.when(n >= t.every_photos, "photo_count").when((n > 0) & (now >= idle_at), "idle_timeout")
    since = F.when(reason == "photo_count", F.coalesce("count_due_since", last)).when(reason == "idle_timeout", idle_at)
    return lifecycle.withColumn("due_reason", reason).withColumn("due_since", since)


def mark_due(lifecycle: DataFrame, now: Column, t: Thresholds = DEFAULT) -> DataFrame:
    """Keeps the first time at which the photo count was reached."""
    return lifecycle.withColumn("count_due_since", F.when(F.col("photos_since_consolidation") >= t.every_photos, F.coalesce("count_due_since", now)).otherwise(F.col("count_due_since")))


def claim(status: Column, started_at: Column, now: Column, lease_s: int) -> Column:
    """What a request for a lease gets: completed, in_progress or claimed."""
    age = F.unix_timestamp(now) - F.unix_timestamp(started_at)
    return F.when(status == "completed", "completed").when((status == "processing") & (age < lease_s), "in_progress").otherwise("claimed")


def photo_counters(events: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(user_id, photos, last_ts, triggers): completed photos of each tenant and how often the count trigger has fired."""
    return events.groupBy("user_id").agg(F.count("*").alias("photos"), F.max("ts").alias("last_ts"), F.expr(f"count(*) div {t.every_photos}").alias("triggers"))


def idle_sessions(events: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Runs of photos of a tenant without an idle gap, as the engine's session windows."""
    s = events.groupBy("user_id", F.session_window("ts", f"{t.idle_hours} hours").alias("w")).agg(F.count("*").alias("photos"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select("user_id", "first_ts", "last_ts", "photos")


def merge_survivor(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user_id, a, b, survivor): confirmed first, then larger, older, smaller id."""
    side = lambda s: clusters.select("user_id", F.col("cluster_id").alias(s), F.struct((~F.col("is_user_confirmed")).alias("c"), (-F.col("face_count")).alias("n"), "created_at", F.col("cluster_id").alias("id")).alias(f"key_{s}"))
    met = pairs.join(side("a"), ["user_id", "a"]).join(side("b"), ["user_id", "b"])
    return met.select("user_id", "a", "b", F.when(F.col("key_a") < F.col("key_b"), F.col("a")).otherwise(F.col("b")).alias("survivor"))


def ranked(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id", "face_id").orderBy(F.desc("score"), "cluster_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
