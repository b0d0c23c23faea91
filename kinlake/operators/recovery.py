"""Recovery of deferred faces against one immutable snapshot, and new groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds
from kinlake.functions.vector import cosine
from kinlake.operators.audit import medoids
from kinlake.operators.density import density_labels
from kinlake.operators.scores import authoritative, decide, decide_restricted, face_cluster_scores, restricted_winners


def deferred(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("assignment_state").isin("ambiguous", "unassigned") & ~F.col("is_manual") & ~F.col("restricted"))


def restricted(faces: DataFrame) -> DataFrame:
    """Deferred faces that only fail the pose floor, one row for each id: of several the last, by all their columns in order."""
    found = faces.where(F.col("assignment_state").isin("ambiguous", "unassigned") & F.col("restricted") & ~F.col("is_manual"))
    rest = [c for c in faces.columns if c not in ("user_id", "face_id")]
    last = found.groupBy("user_id", "face_id").agg(F.max(F.struct(*rest)).alias("r"))
    return last.select("user_id", "face_id", "r.*").select(*faces.columns)


def occupied(faces: DataFrame) -> DataFrame:
    """(user_id, photo_id, cluster_id): clusters that already have a member in a photo."""
    return faces.where(F.col("assignment_state").isin("confirmed", "manual") & F.col("cluster_id").isNotNull() & F.col("photo_id").isNotNull()).select("user_id", "photo_id", "cluster_id").distinct()


def recover_deferred(faces: DataFrame, exemplars: DataFrame, t: Thresholds = DEFAULT, strict: bool = False) -> DataFrame:
    """The decision on every deferred face. All see the same snapshot; strict keeps one face of a photo for a cluster."""
    waiting = deferred(faces)
    found = decide(waiting, face_cluster_scores(waiting, exemplars, t, occupied(faces)), F.lit(False), t)
    prefix = F.when(F.col("state") == "confirmed", "consolidation_recovery:").otherwise("consolidation_recheck:")
    out = found.withColumn("reason", F.concat(prefix, F.col("reason")))
    if not strict:
        return out
    rival = restricted_winners(out.withColumn("state", F.col("state"))).where("state = 'ambiguous'").select("user_id", "face_id", F.lit(True).alias("lost"))
    lost = F.col("lost").isNotNull()
    return out.join(rival, ["user_id", "face_id"], "left").withColumn("state", F.when(lost, "ambiguous").otherwise(F.col("state"))).withColumn("assigned_cluster", F.when(~lost, F.col("assigned_cluster"))).drop("lost")


def recover_restricted(faces: DataFrame, exemplars: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The decision on faces that only fail the pose floor, one winner for each photo and cluster."""
    waiting = restricted(faces)
    decided = decide_restricted(waiting, face_cluster_scores(waiting, exemplars, t, occupied(faces)), authoritative(faces), t)
    won = restricted_winners(decided).select("user_id", "face_id", F.col("state").alias("ws"), F.col("reason").alias("wr"))
    out = decided.join(won, ["user_id", "face_id"], "left").withColumn("state", F.coalesce("ws", "state")).withColumn("reason", F.coalesce("wr", "reason")).drop("ws", "wr")
    prefix = F.when(F.col("state") == "confirmed", "restricted_pose_recovery:").otherwise("restricted_pose_recheck:")
    return out.withColumn("reason", F.concat(prefix, F.col("reason")))


def unassigned(faces: DataFrame) -> DataFrame:
    return deferred(faces).where("assignment_state = 'unassigned'")


def unassigned_labels(faces: DataFrame) -> DataFrame:
    """(user_id, face_id, label): density clustering of each tenant's unassigned faces; -1 is noise."""
    return density_labels(unassigned(faces), ["user_id"], 2, allow_single=True)


def new_people(faces: DataFrame, t: Thresholds = DEFAULT, labels: DataFrame | None = None) -> DataFrame:
    """(user_id, face_id, seed, group_id): members of new groups among unassigned faces; labels: as from unassigned_labels().

    With exactly one label the group is all points. A group needs distinct photos, an eligible
    medoid, and every member close to it."""
    waiting = unassigned(faces)
    found = unassigned_labels(faces) if labels is None else labels
    labels = found.where("label >= 0").groupBy("user_id").agg(F.count_distinct("label").alias("labels"))
    grouped = found.join(labels, "user_id").withColumn("label", F.when(F.col("labels") == 1, 0).otherwise(F.col("label"))).where("label >= 0")
    m = waiting.join(grouped.select("user_id", "face_id", "label"), ["user_id", "face_id"])
    fine = m.groupBy("user_id", "label").agg(F.count("photo_id").alias("n"), F.count_distinct("photo_id").alias("photos"), F.count("*").alias("size")).where("n = photos and size >= 2")
    m = m.join(fine.select("user_id", "label"), ["user_id", "label"])
    seeds = medoids(m, "label", t).join(m.select("user_id", F.col("face_id").alias("medoid"), F.col("v").alias("mv"), F.col("norm").alias("mn")), ["user_id", "medoid"])
    near = m.join(seeds, ["user_id", "label"]).withColumn("sim", cosine(F.col("v"), F.col("mv"), F.col("norm"), F.col("mn")))
    tight = near.groupBy("user_id", "label").agg(F.min("sim").alias("least"), F.array_sort(F.collect_list("face_id")).alias("ids")).where(F.col("least") >= t.high_confidence)
    name = F.concat(F.lit("person_"), F.substring(F.sha1(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")), 1, 12))
    return near.join(tight.select("user_id", "label", name.alias("group_id")), ["user_id", "label"]).select("user_id", "face_id", F.col("medoid").alias("seed"), "group_id")
