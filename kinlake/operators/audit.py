"""Audits of confirmed clusters: merges, bridges and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds
from kinlake.functions.vector import cosine
from kinlake.operators import evidence
from kinlake.operators.scores import competition, coverage


def audit_members(faces: DataFrame) -> DataFrame:
    """Members that automation may reason about: neither manual nor restricted."""
    return faces.where(F.col("assignment_state").isin("confirmed", "manual") & ~F.col("is_manual") & ~F.col("restricted") & F.col("cluster_id").isNotNull())


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("user_id", "cluster_id").agg(F.count("*").alias("size"))


def photo_conflicts(members: DataFrame) -> DataFrame:
    """Cluster pairs (a < b) with different faces in one photo; the join is on the photo, which holds few faces."""
    one = members.where("photo_id is not null").select("user_id", "photo_id", F.col("face_id").alias("fa"), F.col("cluster_id").alias("cluster_a_id"))
    two = members.select("user_id", "photo_id", F.col("face_id").alias("fb"), F.col("cluster_id").alias("cluster_b_id"))
    return one.join(two, ["user_id", "photo_id"]).where("fa <> fb and cluster_a_id < cluster_b_id").select("user_id", "cluster_a_id", "cluster_b_id").distinct()


def protected(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """(user_id, cluster_id) that automation leaves alone: confirmed by the user, corrected by hand, or with a manual face."""
    manual = faces.where("is_manual and cluster_id is not null").select("user_id", "cluster_id")
    return clusters.where("is_user_confirmed or has_manual_correction").select("user_id", "cluster_id").unionByName(manual).distinct()


def _blocked(pairs: DataFrame, a: str, b: str, shields: DataFrame, links: DataFrame, conflicts: DataFrame) -> DataFrame:
    """pairs with `blocker`, the first structural reason against touching source a and target b."""
    flag = lambda d, name: d.withColumn(name, F.lit(True))
    out = pairs.join(flag(shields.withColumnRenamed("cluster_id", a), "__sa"), ["user_id", a], "left").join(flag(shields.withColumnRenamed("cluster_id", b), "__sb"), ["user_id", b], "left")
    out = out.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    for name, d in (("__link", links), ("__photo", conflicts)):
        out = out.join(flag(d.select("user_id", F.col("cluster_a_id").alias("__lo"), F.col("cluster_b_id").alias("__hi")), name), ["user_id", "__lo", "__hi"], "left")
    blocker = F.when(F.col(a) == F.col(b), "same_cluster").when(F.col("__sa"), "source_user_protected").when(F.col("__sb"), "target_user_protected").when(F.col("__link"), "stored_cannot_link").when(F.col("__photo"), "same_photo_conflict")
    return out.withColumn("blocker", blocker).drop("__sa", "__sb", "__lo", "__hi", "__link", "__photo")


def _both_ways(scores: DataFrame, sizes: DataFrame, t: Thresholds) -> DataFrame:
    """Evidence of each unordered pair a < b in both directions, with the least margins against third clusters.

    Pairs that share no scored face are absent: they have no coverage."""
    found = coverage(scores, sizes, t)
    margins = competition(scores).groupBy("user_id", F.col("home").alias("source"), "target").agg(F.min("margin").alias("least_margin"))
    found = found.join(margins, ["user_id", "source", "target"], "left")
    cols = ["coverage", "strong", "size", "min_score", "mean_score", "least_margin"]
    ab = found.where("source < target").select("user_id", F.col("source").alias("a"), F.col("target").alias("b"), *[F.col(c).alias(f"{c}_ab") for c in cols])
    ba = found.where("source > target").select("user_id", F.col("target").alias("a"), F.col("source").alias("b"), *[F.col(c).alias(f"{c}_ba") for c in cols])
    return ab.join(ba, ["user_id", "a", "b"])


def mutual_suggestions(scores: DataFrame, sizes: DataFrame, links: DataFrame, conflicts: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pairs of clusters of two or more faces that cover each other, without a stored link or shared photo against it."""
    both = _both_ways(scores, sizes, t).where((F.col("size_ab") >= 2) & (F.col("size_ba") >= 2) & (F.col("coverage_ab") >= t.coverage) & (F.col("coverage_ba") >= t.coverage))
    bars = links.select("user_id", F.col("cluster_a_id").alias("a"), F.col("cluster_b_id").alias("b")).unionByName(conflicts.select("user_id", F.col("cluster_a_id").alias("a"), F.col("cluster_b_id").alias("b")))
    return both.join(bars, ["user_id", "a", "b"], "left_anti").select("user_id", "a", "b", "coverage_ab", "coverage_ba")


def mutual_merges(scores: DataFrame, sizes: DataFrame, shields: DataFrame, links: DataFrame, conflicts: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Every scored pair with the first reason against merging it (null: accepted), and source and target: the smaller (size, id) first."""
    both = _blocked(_both_ways(scores, sizes, t), "a", "b", shields, links, conflicts)
    need = lambda side: F.least(F.lit(t.mutual_strong), F.col(f"size_{side}"))
    reason = (
        F.when((F.col("size_ab") < 2) | (F.col("size_ba") < 2), "singleton_cluster_protected")
        .when(F.col("blocker").isNotNull(), F.col("blocker"))
        .when((F.col("coverage_ab") < 1) | (F.col("coverage_ba") < 1), "not_full_mutual_high_confidence_coverage")
        .when((F.col("strong_ab") < need("ab")) | (F.col("strong_ba") < need("ba")), "insufficient_strong_anchors_both_directions")
        .when(F.col("least_margin_ab") < t.min_margin, "third_person_competition_a_to_b")
        .when(F.col("least_margin_ba") < t.min_margin, "third_person_competition_b_to_a")
    )
    first = F.struct("size_ab", "a") <= F.struct(F.col("size_ba").alias("size_ab"), F.col("b").alias("a"))
    return both.select(
        "user_id", "a", "b", reason.alias("reason"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"),
        F.lit("mutual_full_coverage").alias("mode"), F.lit(1.0).alias("source_coverage"),
        F.when(first, F.col("strong_ab")).otherwise(F.col("strong_ba")).alias("strong"), F.when(first, F.col("min_score_ab")).otherwise(F.col("min_score_ba")).alias("min_score"),
        F.when(first, F.col("mean_score_ab")).otherwise(F.col("mean_score_ba")).alias("mean_score"), F.least("least_margin_ab", "least_margin_ba").alias("margin"),
    )


def fragments(sizes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Ordered pairs (source, target) of a tenant whose sizes let the source be a fragment of the target; the size test is a join condition."""
    s = sizes.select("user_id", F.col("cluster_id").alias("source"), F.col("size").alias("source_size")).where("source_size >= 2")
    g = sizes.select("user_id", F.col("cluster_id").alias("target"), F.col("size").alias("target_size")).where(F.col("target_size") >= t.mature_faces)
    return s.join(g, "user_id").where((F.col("source") != F.col("target")) & (F.col("source_size") < F.col("target_size")) & (F.col("source_size") <= t.fragment_ratio * F.col("target_size")))


def _rivals(faces: DataFrame) -> DataFrame:
    """(user_id, source, face_id, c1, s1, s2): each face's best other cluster, and the similarities of the two best; one of them is the best third cluster of any target."""
    order = Window.partitionBy("user_id", "source", "face_id").orderBy(F.desc("best"), "target")
    two = faces.select("user_id", "source", "face_id", "target", "best").withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    return two.groupBy("user_id", "source", "face_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("target"))).alias("c1"), F.max(F.when(F.col("rn") == 1, F.col("best"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("best"))).alias("s2")
    )


def _bridge_faces(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """The combined evidence of each pair's source faces, with the best similarity in any third cluster."""
    per = faces.join(pairs.select("user_id", "source", "target"), ["user_id", "source", "target"])
    rival = F.when(F.col("c1") == F.col("target"), F.col("s2")).otherwise(F.col("s1"))
    return per.join(_rivals(faces), ["user_id", "source", "face_id"], "left").withColumn("rival", rival).drop("c1", "s1", "s2")


def bridge_evidence(members: DataFrame, pairs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Per source face of each pair: support, best similarity and the best in any third cluster."""
    rows = evidence.similarity_rows(members, pairs.select("user_id", F.col("source").alias("cluster_id")), t)
    return _bridge_faces(evidence.combined(rows), pairs)


def fragment_bridges(members: DataFrame, sizes: DataFrame, shields: DataFrame, links: DataFrame, conflicts: DataFrame, t: Thresholds = DEFAULT, keep=None) -> DataFrame:
    """Every pair that sizes allow, with the first reason against merging the fragment (null: accepted) and its evidence.

    keep(df) writes a table and reads it again; with it the pass over the similarities is made once."""
    pairs = fragments(sizes, t)
    rows = evidence.similarity_rows(members, pairs.select("user_id", F.col("source").alias("cluster_id")), t)
    rows = keep(rows) if keep else rows
    faces = _bridge_faces(evidence.combined(rows), pairs)
    high, margin = F.col("best") >= t.high_confidence, F.col("best") - F.col("rival")
    agg = faces.groupBy("user_id", "source", "target").agg(
        (F.count_if(F.col("support") >= t.bridge_support) / F.count("*")).alias("source_coverage"), F.count_if(high).alias("high"), F.count_if(F.col("best") >= t.strong).alias("strong"),
        F.min("support").alias("min_support"), F.min("best").alias("min_score"), F.avg("best").alias("mean_score"), F.min(margin).alias("margin"),
        F.bool_or(F.coalesce(F.col("best") <= F.col("rival"), F.lit(False))).alias("beaten"), F.bool_or(F.coalesce(high & (margin < t.min_margin), F.lit(False))).alias("close"),
    )
    met = faces.where(F.col("support") >= t.bridge_support).select("user_id", "source", "target", F.explode(F.arrays_zip("others", "photos")).alias("o"))
    bridges = met.groupBy("user_id", "source", "target").agg(F.count_distinct("o.others").alias("bridge_faces"), F.count_distinct("o.photos").alias("bridge_photos"))
    out = _blocked(pairs, "source", "target", shields, links, conflicts).join(agg, ["user_id", "source", "target"]).join(bridges, ["user_id", "source", "target"], "left")
    out = out.join(evidence.connected(rows, sizes, evidence.most_blocks(members)), ["user_id", "source"], "left")
    few = lambda c, n: F.coalesce(F.col(c), F.lit(0)) < n
    reason = (
        F.when(F.col("blocker").isNotNull(), F.col("blocker"))
        .when(~F.col("connected"), "source_fragment_not_internally_connected")
        .when(F.col("beaten"), "target_not_best_member_level_alternative")
        .when(F.col("close"), "high_conf_bridge_has_third_person_competition")
        .when(F.col("source_coverage") < 1, "not_every_source_face_has_repeated_target_member_support")
        .when(F.col("high") < F.least(F.lit(t.bridge_high), F.col("source_size")), "insufficient_high_conf_bridge_source_faces")
        .when(F.col("strong") < F.least(F.lit(t.bridge_strong), F.col("source_size")), "insufficient_strong_bridge_source_faces")
        .when(few("bridge_faces", t.bridge_support), "bridge_depends_on_too_few_target_faces")
        .when(few("bridge_photos", t.bridge_support), "bridge_depends_on_too_few_target_photos")
    )
    return out.withColumn("reason", reason).withColumn("mode", F.lit("fragment_member_bridge"))


def merge_priority(mutual: DataFrame, bridges: DataFrame) -> DataFrame:
    """Accepted merges of both tiers, one for each unordered pair, in the order in which they would be taken."""
    cols = ["user_id", "mode", "source", "target", "source_coverage", "strong", "min_score", "mean_score", "margin"]
    both = mutual.where("reason is null").select(*cols).unionByName(bridges.where("reason is null").select(*cols))
    rank = F.when(F.col("mode") == "mutual_full_coverage", 0).otherwise(1)
    order = [rank, F.desc("source_coverage"), F.desc("strong"), F.desc("min_score"), F.desc("mean_score"), F.col("margin").desc_nulls_first(), F.col("source"), F.col("target")]
    once = Window.partitionBy("user_id", F.least("source", "target"), F.greatest("source", "target")).orderBy(*order)
    kept = both.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn")
    return kept.withColumn("priority", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def medoids(members: DataFrame, group: str = "cluster_id", t: Thresholds = DEFAULT) -> DataFrame:
    """(user_id, group, medoid, mean_sim): the eligible member with the largest mean similarity to its group, itself included."""
    a = members.select("user_id", group, "face_id", "quality_score", F.col("v").alias("av"), F.col("norm").alias("an"))
    b = members.select("user_id", group, F.col("v").alias("bv"), F.col("norm").alias("bn"))
    mean = a.join(b, ["user_id", group]).groupBy("user_id", group, "face_id", "quality_score").agg(F.avg(cosine(F.col("av"), F.col("bv"), F.col("an"), F.col("bn"))).alias("mean_sim"))
    return mean.where(F.col("quality_score") >= t.exemplar_quality).groupBy("user_id", group).agg(F.min_by("face_id", F.struct(-F.col("mean_sim"), "face_id")).alias("medoid"), F.max("mean_sim").alias("mean_sim"))


def cohesion(members: DataFrame, centre: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(user_id, group, cohesion): the least similarity of a member to its group's medoid."""
    m = centre.join(members.select("user_id", F.col("face_id").alias("medoid"), F.col("v").alias("mv"), F.col("norm").alias("mn")), ["user_id", "medoid"])
    met = members.select("user_id", group, "v", "norm").join(m, ["user_id", group])
    return met.groupBy("user_id", group).agg(F.min(cosine(F.col("v"), F.col("mv"), F.col("norm"), F.col("mn"))).alias("cohesion"))


def cross_maximum(members: DataFrame, group: str) -> DataFrame:
    """(user_id, cluster_id, a, b, cross_max): the largest similarity between two groups of one cluster."""
    one = members.select("user_id", "cluster_id", F.col(group).alias("a"), F.col("v").alias("av"), F.col("norm").alias("an"))
    two = members.select("user_id", "cluster_id", F.col(group).alias("b"), F.col("v").alias("bv"), F.col("norm").alias("bn"))
    return one.join(two, ["user_id", "cluster_id"]).where("a < b").groupBy("user_id", "cluster_id", "a", "b").agg(F.max(cosine(F.col("av"), F.col("bv"), F.col("an"), F.col("bn"))).alias("cross_max"))


def splits(members: DataFrame, labelled: DataFrame, shields: DataFrame, manual: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Clusters that fall into exactly two dense groups far apart, and whether the split is safe to make alone.

    labelled: user_id, cluster_id, face_id, label of a density clustering; clusters with noise or
    a manual face are left out."""
    m = members.join(labelled, ["user_id", "cluster_id", "face_id"]).withColumn("eligible", F.col("quality_score") >= t.exemplar_quality).withColumn("part", F.concat_ws(":", "cluster_id", "label"))
    shape = m.groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.count_distinct("label").alias("labels")).where("n >= 4 and least >= 0 and labels = 2")
    shape = shape.join(manual, ["user_id", "cluster_id"], "left_anti")
    groups = m.groupBy("user_id", "cluster_id", "label").agg(F.count("*").alias("size"), F.bool_or("eligible").alias("has_eligible"))
    fine = groups.groupBy("user_id", "cluster_id").agg(F.min("size").alias("smallest"), F.bool_and("has_eligible").alias("all_eligible")).where("smallest >= 2 and all_eligible")
    tight = cohesion(m, medoids(m, "part", t), "part").join(m.select("user_id", "part", "cluster_id").distinct(), ["user_id", "part"]).groupBy("user_id", "cluster_id").agg(F.min("cohesion").alias("cohesion"))
    apart = cross_maximum(m, "label").groupBy("user_id", "cluster_id").agg(F.max("cross_max").alias("cross_max"))
    out = shape.join(fine, ["user_id", "cluster_id"]).join(tight, ["user_id", "cluster_id"]).join(apart, ["user_id", "cluster_id"])
    out = out.where((F.col("cohesion") >= t.match) & (F.col("cross_max") < t.lower)).join(shields.withColumn("shield", F.lit(True)), ["user_id", "cluster_id"], "left")
    safe = F.col("shield").isNull() & (F.col("smallest") >= t.split_group) & (F.col("cohesion") >= t.high_confidence)
    return out.select("user_id", "cluster_id", "n", "smallest", "cohesion", "cross_max", safe.alias("auto_safe"))


def split_fractions(labelled: DataFrame) -> DataFrame:
    """(user_id, cluster_id, label, fraction): each group's share of its cluster's faces; labelled: user_id, cluster_id, face_id, label."""
    groups = labelled.groupBy("user_id", "cluster_id", "label").agg(F.count("*").alias("n"))
    return groups.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", "cluster_id"))).drop("n")


def state_counts(faces: DataFrame) -> DataFrame:
    """(user_id, assignment_state, faces): how many faces of each state an evaluation left."""
    return faces.groupBy("user_id", "assignment_state").agg(F.count("*").alias("faces"))
