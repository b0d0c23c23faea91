"""Scores of faces against clusters, and the decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds
from kinlake.functions.vector import cosine, top_average


def cluster_exemplars(exemplars: DataFrame) -> DataFrame:
    """A row for each cluster with its exemplars as an array; buckets bound it."""
    return exemplars.groupBy("user_id", "cluster_id").agg(F.collect_list(F.struct("face_id", "v", "norm")).alias("ex"))


def effective_threshold(count: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(count < t.top_k, t.match + t.sparse_margin).otherwise(F.lit(t.match))


def face_cluster_scores(faces: DataFrame, exemplars: DataFrame, t: Thresholds = DEFAULT, excluded: DataFrame | None = None) -> DataFrame:
    """(user_id, face_id, home, photo_id, cluster_id, score, n_exemplars, threshold) for every face and cluster of its tenant.

    A face's own exemplar doesn't count; a cluster without another is left out, as is one listed
    in excluded (user_id, photo_id, cluster_id). The join is on the tenant, against an array of at
    most five vectors a cluster, so no similarity is shuffled; adaptive execution splits a large
    tenant's faces.
    """
    met = faces.select("user_id", "face_id", "home", "photo_id", F.col("v").alias("fv"), F.col("norm").alias("fn")).join(cluster_exemplars(exemplars), "user_id")
    if excluded is not None:
        met = met.join(excluded, ["user_id", "photo_id", "cluster_id"], "left_anti")
    others = F.filter("ex", lambda e: e["face_id"] != F.col("face_id"))
    met = met.withColumn("sims", F.transform(others, lambda e: cosine(F.col("fv"), e["v"], F.col("fn"), e["norm"]))).where(F.size("sims") > 0)
    return met.select(
        "user_id", "face_id", "home", "photo_id", "cluster_id", top_average(F.col("sims"), t.top_k).alias("score"), F.size("sims").alias("n_exemplars"), effective_threshold(F.size("sims"), t).alias("threshold")
    )


def best_two(scores: DataFrame) -> DataFrame:
    """Each face's best cluster and runner-up; ties go to the smaller cluster id."""
    order = Window.partitionBy("user_id", "face_id").orderBy(F.desc("score"), "cluster_id")
    ranked = scores.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    return ranked.groupBy("user_id", "face_id").agg(
        pick("cluster_id", 1).alias("best_cluster"),
        pick("score", 1).alias("best_score"),
        pick("threshold", 1).alias("threshold"),
        pick("n_exemplars", 1).alias("n_exemplars"),
        pick("cluster_id", 2).alias("second_cluster"),
        pick("score", 2).alias("second_score"),
    )


def decide_match(score: Column, threshold: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(score >= threshold, "confident").when(score >= threshold - t.ambiguous_band, "ambiguous").otherwise("none")


def decide(faces: DataFrame, scores: DataFrame, eligible: Column, t: Thresholds = DEFAULT) -> DataFrame:
    """State, cluster and reason of every face, from its scores against one snapshot."""
    met = faces.select("user_id", "face_id", "photo_id", eligible.alias("eligible")).join(best_two(scores), ["user_id", "face_id"], "left")
    margin = F.col("best_score") - F.col("second_score")
    level = decide_match(F.col("best_score"), F.col("threshold"), t)
    none = F.col("best_cluster").isNull()
    close = margin < t.min_margin
    reason = (
        F.when(none & F.col("eligible"), "new_cluster_seed_no_existing_candidates")
        .when(none, "unassigned_no_existing_candidates_and_not_exemplar_eligible")
        .when((level == "confident") & close, "ambiguous_insufficient_margin_over_second_best")
        .when(level == "confident", "confirmed_score_and_margin_passed")
        .when(level == "ambiguous", "ambiguous_score_inside_threshold_band")
        .when(F.col("eligible"), "new_cluster_seed_no_candidate_above_ambiguous_band")
        .otherwise("unassigned_no_match_and_not_exemplar_eligible")
    )
    met = met.withColumn("reason", reason).withColumn("margin", margin)
    state = F.when(F.col("reason").startswith("confirmed") | F.col("reason").startswith("new_cluster"), "confirmed").when(F.col("reason").startswith("ambiguous"), "ambiguous").otherwise("unassigned")
    return met.select("*", state.alias("state"), F.when(F.col("reason").startswith("confirmed"), F.col("best_cluster")).alias("assigned_cluster"))


def authoritative(faces: DataFrame) -> DataFrame:
    """(user_id, cluster_id, authoritative): members that may establish an identity."""
    return faces.where(F.col("assignment_state").isin("confirmed", "manual") & F.col("cluster_id").isNotNull()).groupBy("user_id", "cluster_id").agg(F.count_if(~F.col("restricted")).alias("authoritative"))


def decide_restricted(faces: DataFrame, scores: DataFrame, counts: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The decision on faces that only fail the pose floor: never a new identity, only mature targets with a clear margin."""
    met = faces.select("user_id", "face_id", "photo_id").join(best_two(scores), ["user_id", "face_id"], "left")
    met = met.join(counts.withColumnRenamed("cluster_id", "best_cluster"), ["user_id", "best_cluster"], "left")
    floor = F.greatest(F.col("threshold"), F.lit(t.match + t.sparse_margin))
    margin = F.col("best_score") - F.col("second_score")
    mature = (F.coalesce("authoritative", F.lit(0)) >= t.restricted_mature) & (F.col("n_exemplars") >= t.top_k)
    reason = (
        F.when(F.col("best_cluster").isNull(), "restricted_pose_no_available_cluster")
        .when(F.col("best_score") < floor, "restricted_pose_score_below_high_confidence_floor")
        .when(~mature, "restricted_pose_best_cluster_not_mature")
        .when(margin < t.min_margin, "restricted_pose_insufficient_margin_over_second_best")
        .otherwise("restricted_pose_mature_cluster_high_confidence_match")
    )
    met = met.withColumn("reason", reason).withColumn("margin", margin)
    state = F.when(F.col("reason").endswith("match"), "confirmed").when(F.col("reason").endswith("mature") | F.col("reason").endswith("second_best"), "ambiguous").otherwise("unassigned")
    return met.withColumn("state", state)


def restricted_winners(decided: DataFrame) -> DataFrame:
    """Of confirmed faces of one photo and cluster the best stays (score, margin with none last, id); others become ambiguous."""
    order = Window.partitionBy("user_id", "photo_id", "best_cluster").orderBy(F.desc("best_score"), F.col("margin").desc_nulls_last(), "face_id")
    won = decided.where("state = 'confirmed'").withColumn("rn", F.row_number().over(order))
    lost = F.col("rn") > 1
    return won.select(
        "user_id", "face_id", "photo_id", "best_cluster", "best_score", F.when(lost, "ambiguous").otherwise("confirmed").alias("state"), F.when(lost, "restricted_pose_same_photo_deferred_conflict").otherwise(F.col("reason")).alias("reason")
    )


def suspicious(scores: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Faces that another cluster matches clearly better than their own without themselves."""
    own = scores.where("cluster_id = home").select("user_id", "face_id", F.col("score").alias("own_score"))
    other = scores.where((F.col("cluster_id") != F.col("home")) & (F.col("score") >= F.col("threshold")))
    best = other.groupBy("user_id", "face_id", "home").agg(F.max("score").alias("other_score"), F.min_by("cluster_id", F.struct(-F.col("score"), "cluster_id")).alias("other_cluster"))
    return best.join(own, ["user_id", "face_id"]).where(F.col("other_score") - F.col("own_score") >= t.min_margin)


def coverage(scores: DataFrame, sizes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """For cluster pairs (source, target): share of the source's faces that match the target with high confidence, and its strong anchors."""
    hits = scores.where(F.col("cluster_id") != F.col("home")).groupBy("user_id", F.col("home").alias("source"), F.col("cluster_id").alias("target")).agg(
        F.count_if(F.col("score") >= F.greatest(F.col("threshold"), F.lit(t.high_confidence))).alias("covered"), F.count_if(F.col("score") >= t.strong).alias("strong"), F.min("score").alias("min_score"), F.avg("score").alias("mean_score")
    )
    return hits.join(sizes.select("user_id", F.col("cluster_id").alias("source"), "size"), ["user_id", "source"]).withColumn("coverage", F.col("covered") / F.col("size"))


def competition(scores: DataFrame) -> DataFrame:
    """(user_id, face_id, home, target, margin): target score less the best of any third cluster; null where there is none.

    The best third cluster of a face is one of the two best besides its own, so only those meet its targets."""
    order = Window.partitionBy("user_id", "face_id").orderBy(F.desc("score"), "cluster_id")
    top = scores.where(F.col("cluster_id") != F.col("home")).withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    two = top.groupBy("user_id", "face_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("cluster_id"))).alias("c1"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2")
    )
    met = scores.where(F.col("cluster_id") != F.col("home")).join(two, ["user_id", "face_id"])
    rival = F.when(F.col("cluster_id") == F.col("c1"), F.col("s2")).otherwise(F.col("s1"))
    return met.select("user_id", "face_id", "home", F.col("cluster_id").alias("target"), "score", (F.col("score") - rival).alias("margin"))
