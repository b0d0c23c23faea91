"""Leases, lifecycle rows and corrections as tables in, tables out.

Requests are a table of their own, at most one for each key in a call (later ones see what earlier
ones left, as they would in a queue). Spark has no compare-and-set: a caller that writes the
result does so under the one writer that snapshots assume, and tokens then tell a worker that lost
its lease from one that has it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, MEMBER_STATES, Thresholds
from kinlake.functions.keys import compatible, error_text, normal_path, retry_after
from kinlake.operators import gallery, mutations


def _age(started: Column, now: Column) -> Column:
    """Seconds since a lease began, 0 at least; null where none did."""
    return F.when(started.isNotNull(), F.greatest(F.lit(0.0), now.cast("double") - started.cast("double")))


def claim_photos(photos: DataFrame, asked: DataFrame, now: Column, lease_s: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """asked (user_id, photo_id, image_path, token) with status, retry_after_s and problem.

    A photo is bound to one path and a path to one photo; a request against that has a problem and
    no status. Completed photos are completed, a lease younger than lease_s is in_progress with
    the seconds to wait, anything else is claimed."""
    lease_s = t.photo_lease_s if lease_s is None else lease_s
    asked = asked.withColumn("image_path", normal_path(F.col("image_path")))
    row = photos.select("user_id", "photo_id", F.col("image_path").alias("__path"), F.col("processing_status").alias("__status"), F.col("processing_started_at").alias("__started"))
    bound = photos.select("user_id", "image_path", F.col("photo_id").alias("__photo"))
    met = asked.join(row, ["user_id", "photo_id"], "left").join(bound, ["user_id", "image_path"], "left")
    problem = F.when(F.col("__path") != F.col("image_path"), F.concat(F.lit("photo_id '"), "photo_id", F.lit("' is already bound to a different image path"))).when(
        F.col("__photo") != F.col("photo_id"), F.concat(F.lit("image path is already bound to photo_id '"), "__photo", F.lit("'"))
    )
    met = met.withColumn("problem", problem)
    status = F.when(F.col("problem").isNull(), gallery.claim(F.col("__status"), F.col("__started"), now, lease_s))
    met = met.withColumn("status", status).withColumn("retry_after_s", F.when(F.col("status") == "in_progress", retry_after(lease_s, _age(F.col("__started"), now))))
    return met.drop("__path", "__status", "__started", "__photo")


def apply_claims(photos: DataFrame, claims: DataFrame, now: Column, version: str, config: str) -> DataFrame:
    """photos with the claimed requests of claim_photos() taken in: a new token, one more attempt, old results cleared."""
    won = claims.where("status = 'claimed'").select("user_id", "photo_id", F.col("image_path").alias("__path"), F.col("token").alias("__token"))
    met = photos.join(won, ["user_id", "photo_id"], "full")
    took = F.col("__token").isNotNull()
    fresh = {
        "image_path": F.coalesce("image_path", "__path"),
        "image_width": F.coalesce("image_width", F.lit(0)),
        "image_height": F.coalesce("image_height", F.lit(0)),
        "processing_status": F.when(took, "processing").otherwise(F.col("processing_status")),
        "processed_at": F.when(~took, F.col("processed_at")),
        "error_message": F.when(~took, F.col("error_message")),
        "embedding_model_version": F.when(took, version).otherwise(F.col("embedding_model_version")),
        "config_version": F.when(took, config).otherwise(F.col("config_version")),
        "processing_started_at": F.when(took, now).otherwise(F.col("processing_started_at")),
        "processing_token": F.when(took, F.col("__token")).otherwise(F.col("processing_token")),
        "processing_attempts": (F.coalesce("processing_attempts", F.lit(0)) + F.when(took, 1).otherwise(0)).cast("int"),
    }
    return met.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in photos.columns])


def holds_photo(photos: DataFrame, asked: DataFrame, status: str = "processing") -> DataFrame:
    """asked (user_id, photo_id, token) with holds: whether that token has the photo in that status now."""
    row = photos.select("user_id", "photo_id", F.col("processing_status").alias("__s"), F.col("processing_token").alias("__t"))
    met = asked.join(row, ["user_id", "photo_id"], "left")
    return met.withColumn("holds", F.coalesce((F.col("__s") == status) & (F.col("__t") == F.col("token")), F.lit(False))).drop("__s", "__t")


def complete_photos(photos: DataFrame, lifecycle: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(photos, lifecycle, asked with holds): the leases of completed photos end, and each counts once for its tenant."""
    seen = holds_photo(photos, asked, "completed")
    won = seen.where("holds").select("user_id", "photo_id").distinct().withColumn("__won", F.lit(True))
    out = photos.join(won, ["user_id", "photo_id"], "left")
    for c in ("processing_started_at", "processing_token"):
        out = out.withColumn(c, F.when(F.col("__won").isNull(), F.col(c)))
    n = won.groupBy("user_id").agg(F.count("*").alias("__n"))
    life = with_lifecycle(lifecycle, n).join(n, "user_id", "left")
    life = life.withColumn("photos_since_consolidation", (F.coalesce("photos_since_consolidation", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("int")).withColumn("last_photo_completed_at", F.when(F.col("__n") > 0, now).otherwise(F.col("last_photo_completed_at")))
    return out.select(*photos.columns), life.select(*lifecycle.columns), seen


def fail_photos(photos: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(photos, asked with holds): photos whose owner failed, with the first 500 characters of its message; a worker that lost its lease changes nothing. asked: user_id, photo_id, token, message."""
    seen = holds_photo(photos, asked)
    won = seen.where("holds").select("user_id", "photo_id", error_text(F.col("message")).alias("__m"), F.lit(True).alias("__won"))
    met = photos.join(won, ["user_id", "photo_id"], "left")
    lost = F.col("__won").isNotNull()
    fresh = {"processing_status": F.lit("failed"), "processed_at": now, "error_message": F.col("__m"), "processing_started_at": F.lit(None), "processing_token": F.lit(None)}
    return met.select(*[F.when(lost, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in photos.columns]), seen


def with_lifecycle(lifecycle: DataFrame, tenants: DataFrame) -> DataFrame:
    """lifecycle with a row of zeros for each tenant that has none."""
    fresh = tenants.select("user_id").distinct().join(lifecycle.select("user_id"), "user_id", "left_anti")
    zero = {"photos_since_consolidation", "consolidation_attempts"}
    types = dict(lifecycle.dtypes)
    return lifecycle.unionByName(fresh.select("user_id", *[F.lit(0 if c in zero else None).cast(types[c]).alias(c) for c in lifecycle.columns if c != "user_id"]))


def claim_consolidation(lifecycle: DataFrame, asked: DataFrame, now: Column, lease_s: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """asked (user_id, force, token) with status (not_due, in_progress or claimed) and retry_after_s."""
    lease_s = t.consolidation_lease_s if lease_s is None else lease_s
    due = gallery.consolidation_due(with_lifecycle(lifecycle, asked), now, t).select("user_id", "due_reason", F.col("consolidation_started_at").alias("__started"))
    met = asked.join(due, "user_id")
    age = _age(F.col("__started"), now)
    status = F.when(~F.col("force") & F.col("due_reason").isNull(), "not_due").when(age < lease_s, "in_progress").otherwise("claimed")
    return met.withColumn("status", status).withColumn("retry_after_s", F.when(F.col("status") == "in_progress", retry_after(lease_s, age))).drop("due_reason", "__started")


def apply_consolidation_claims(lifecycle: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    won = claims.where("status = 'claimed'").select("user_id", F.col("token").alias("__t"))
    met = with_lifecycle(lifecycle, won).join(won, "user_id", "left")
    took = F.col("__t").isNotNull()
    fresh = {
        "consolidation_started_at": F.when(took, now).otherwise(F.col("consolidation_started_at")),
        "consolidation_token": F.when(took, F.col("__t")).otherwise(F.col("consolidation_token")),
        "consolidation_attempts": (F.coalesce("consolidation_attempts", F.lit(0)) + F.when(took, 1).otherwise(0)).cast("int"),
        "last_consolidation_error": F.when(~took, F.col("last_consolidation_error")),
        "last_consolidation_error_at": F.when(~took, F.col("last_consolidation_error_at")),
    }
    return met.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in lifecycle.columns])


def _owned(lifecycle: DataFrame, asked: DataFrame) -> DataFrame:
    """lifecycle with __own where a request (user_id, token[, message]) has the lease."""
    extra = [F.col("message").alias("__m")] if "message" in asked.columns else []
    met = lifecycle.join(asked.select("user_id", F.col("token").alias("__t"), *extra), "user_id", "left")
    return met.withColumn("__own", F.coalesce(F.col("consolidation_token") == F.col("__t"), F.lit(False)))


def holds_consolidation(lifecycle: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (user_id, token) with holds."""
    met = asked.join(lifecycle.select("user_id", F.col("consolidation_token").alias("__c")), "user_id", "left")
    return met.withColumn("holds", F.coalesce(F.col("__c") == F.col("token"), F.lit(False))).drop("__c")


def complete_consolidation(lifecycle: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The owners' leases end: the photo count is zero again and old errors go. asked: user_id, token."""
    met = _owned(lifecycle, asked)
    gone = ("count_due_since", "consolidation_started_at", "consolidation_token", "last_consolidation_error", "last_consolidation_error_at")
    fresh = {"photos_since_consolidation": F.lit(0), "last_consolidated_at": now, **{c: F.lit(None) for c in gone}}
    return met.select(*[F.when(F.col("__own"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in lifecycle.columns])


def fail_consolidation(lifecycle: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The owners' leases end with an error of 500 characters at most. asked: user_id, token, message."""
    met = _owned(lifecycle, asked)
    fresh = {"consolidation_started_at": F.lit(None), "consolidation_token": F.lit(None), "last_consolidation_error": error_text(F.col("__m")), "last_consolidation_error_at": now}
    return met.select(*[F.when(F.col("__own"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in lifecycle.columns])


def add_cannot_links(links: DataFrame, clusters: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(links, asked with problem): pairs put in order and in; a pair that is there takes the new reason and keeps its time.

    asked: user_id, a, b, reason. Both clusters must exist and differ."""
    known = clusters.select("user_id", "cluster_id")
    met = asked.withColumn("cluster_a_id", F.least("a", "b")).withColumn("cluster_b_id", F.greatest("a", "b"))
    for side in ("cluster_a_id", "cluster_b_id"):
        met = met.join(known.select("user_id", F.col("cluster_id").alias(side), F.lit(True).alias(f"__{side}")), ["user_id", side], "left")
    problem = F.when(F.col("a") == F.col("b"), "a cluster can't be linked to itself").when(F.col("__cluster_a_id").isNull() | F.col("__cluster_b_id").isNull(), "No cluster for a cannot-link")
    met = met.withColumn("problem", problem).drop("__cluster_a_id", "__cluster_b_id")
    keys = ["user_id", "cluster_a_id", "cluster_b_id"]
    fresh = met.where("problem is null").groupBy(*keys).agg(F.max("reason").alias("reason")).withColumn("created_at", now)
    return mutations.upsert(links, fresh, keys, keep=("created_at",)), met


def move_problems(state: mutations.State, moves: DataFrame) -> DataFrame:
    """moves (user_id, face_id, target[, source]) with problem, the first reason against a manual move; all moves to a target are one request."""
    own = state.faces.select("user_id", "face_id", F.col("cluster_id").alias("__now"), F.lit(True).alias("__face"), *([F.col("embedding_model_version").alias("__v")] if "embedding_model_version" in state.faces.columns else [F.lit(None).cast("string").alias("__v")]))
    live = state.clusters.where("merged_into is null").select("user_id", F.col("cluster_id").alias("target"), F.lit(True).alias("__live"))
    met = moves.join(own, ["user_id", "face_id"], "left").join(live, ["user_id", "target"], "left")
    clash = mutations.move_conflicts(state.faces, moves.select("user_id", "face_id", "target")).withColumn("__photo", F.lit(True))
    met = met.join(clash, ["user_id", "face_id", "target"], "left")
    source = F.col("source") if "source" in moves.columns else F.lit(None)
    if "embedding_model_version" in state.faces.columns:
        there = state.exemplars.join(state.faces.select("user_id", "face_id", "embedding_model_version"), ["user_id", "face_id"]).groupBy("user_id", F.col("cluster_id").alias("target")).agg(F.max("embedding_model_version").alias("__tv"))
        met = met.join(there, ["user_id", "target"], "left")
        mixed = ~compatible(F.col("__v"), F.col("__tv"))
    else:
        mixed = F.lit(False)
    problem = (
        F.when(F.col("__live").isNull(), "No active cluster")
        .when(F.col("__face").isNull(), "No face")
        .when(F.col("__now").isNull(), "face is not currently assigned")
        .when(source.isNotNull() & (F.col("__now") != source), "face is no longer in the source cluster")
        .when(mixed, "model versions differ")
        .when(F.col("__photo"), "same photo")
    )
    return met.withColumn("problem", problem).select(*moves.columns, "problem")


def move_faces(state: mutations.State, moves: DataFrame, now: Column, t: Thresholds = DEFAULT) -> tuple[mutations.State, DataFrame]:
    """(state, counts): manual moves of all requests without a problem, and how many faces each target took (user_id, target, moved).

    A request (all moves of a tenant to one target) runs whole or not at all. Faces that are in
    the target already stay as they are when the whole request is there."""
    checked = move_problems(state, moves.dropDuplicates(["user_id", "face_id", "target"]))
    bad = checked.where("problem is not null").select("user_id", "target").distinct()
    good = checked.join(bad, ["user_id", "target"], "left_anti").select("user_id", "face_id", "target")
    here = good.join(state.faces.select("user_id", "face_id", F.col("cluster_id").alias("__now")), ["user_id", "face_id"])
    idle = here.groupBy("user_id", "target").agg(F.bool_and(F.col("__now") == F.col("target")).alias("__idle")).where("__idle")
    good = good.join(idle, ["user_id", "target"], "left_anti")
    return mutations.move(state, good, t, now), good.groupBy("user_id", "target").agg(F.count("*").alias("moved"))


def move_photos(state: mutations.State, asked: DataFrame, now: Column, t: Thresholds = DEFAULT) -> tuple[mutations.State, DataFrame, DataFrame]:
    """(state, counts, problems) for asked (user_id, photo_id, source, target): the one face of each photo in the source moves; a request with a photo that has none or several there doesn't run."""
    found = mutations.photo_moves(state.faces, asked.dropDuplicates(["user_id", "photo_id", "source", "target"]))
    bad = found.where("n <> 1")
    good = found.join(bad.select("user_id", "source", "target").distinct(), ["user_id", "source", "target"], "left_anti")
    state, counts = move_faces(state, good.select("user_id", "face_id", "target", "source"), now, t)
    return state, counts, bad.select("user_id", "photo_id", "source", "target", F.concat(F.lit("Expected exactly one face; found "), F.col("n").cast("string")).alias("problem"))


def prune(state: mutations.State, now: Column, t: Thresholds = DEFAULT) -> tuple[mutations.State, DataFrame]:
    """(state, pruned): small clusters that nothing touched for long go, with their faces; photos stay."""
    gone = gallery.prunable(state.clusters, now, t).select("user_id", "cluster_id")
    return mutations.delete_clusters(state, gone), gone


def resolutions(suggestions: DataFrame, state: mutations.State, asked: DataFrame, now: Column) -> DataFrame:
    """What each answer (user_id, suggestion_id, answer) to a suggestion leads to: (.., suggestion_type, cluster_ids, action, new_status, problem).

    Actions are cannot_link, merge, split or none. An accepted merge or split whose clusters or
    members have changed makes the suggestion stale; one that a stored link or a shared photo
    forbids is a problem and leaves it pending. Splits need groups (array of two arrays of face
    ids) beside the suggestion; source_cluster_id is its only cluster."""
    met = asked.join(suggestions, ["user_id", "suggestion_id"], "left")
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    merge = F.col("suggestion_type") == "merge"
    pairs = met.where(pending & merge & (F.col("answer") == "accepted") & (F.size("cluster_ids") == 2))
    pairs = pairs.select("user_id", "suggestion_id", F.col("cluster_ids")[0].alias("source"), F.col("cluster_ids")[1].alias("target"))
    wrong = mutations.merge_conflicts(state, pairs.select("user_id", "source", "target").distinct())
    found = pairs.join(wrong, ["user_id", "source", "target"]).select("user_id", "suggestion_id", F.col("problem").alias("__problem"))
    if "groups" in suggestions.columns:
        plans = met.where(pending & ~merge & (F.col("answer") == "accepted")).where("groups is not null and size(groups) = 2")
        plans = plans.select("user_id", "suggestion_id", F.col("cluster_ids")[0].alias("cluster_id"), F.col("groups")[0].alias("group_a"), F.col("groups")[1].alias("group_b"))
        bad = mutations.split_problems(state.faces, plans).where("problem is not null")
        found = found.unionByName(bad.select("user_id", "suggestion_id", F.col("problem").alias("__problem")))
        no_groups = F.col("groups").isNull() | (F.size("groups") != 2)
    else:
        no_groups = F.lit(True)
    met = met.join(found, ["user_id", "suggestion_id"], "left")
    stale = (merge & (F.size("cluster_ids") != 2)) | (~merge & no_groups) | F.coalesce(F.col("__problem") == "STALE: cluster missing or merged", F.lit(False)) | F.coalesce(F.col("__problem").startswith("STALE: membership") | F.col("__problem").startswith("STALE: manual"), F.lit(False))
    accepted = F.col("answer") == "accepted"
    problem = F.when(~pending, "No pending suggestion").when(~F.col("answer").isin("accepted", "rejected", "uncertain"), "Unsupported resolution status").when(accepted & ~stale & F.col("__problem").isNotNull(), F.col("__problem"))
    met = met.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    action = F.when(~fine, "none").when((F.col("answer") == "rejected") & merge, "cannot_link").when(accepted & ~stale, F.col("suggestion_type")).otherwise("none")
    status = F.when(fine, F.when(accepted & stale, "stale").otherwise(F.col("answer")))
    return met.select("user_id", "suggestion_id", "answer", "suggestion_type", "cluster_ids", action.alias("action"), status.alias("new_status"), "problem", now.alias("resolved_at"))


def resolve(suggestions: DataFrame, state: mutations.State, asked: DataFrame, now: Column, keep, t: Thresholds = DEFAULT) -> tuple[DataFrame, mutations.State, DataFrame]:
    """(suggestions, state, outcomes): the answers taken into the tables. keep(df) writes a table and reads it again.

    Merges run with rank order of their survivors; pending suggestions that share a cluster with
    one that ran become stale. At most one accepted answer for a cluster in one call."""
    outcome = keep(resolutions(suggestions, state, asked, now))
    no = outcome.where("action = 'cannot_link'").select("user_id", F.col("cluster_ids")[0].alias("a"), F.col("cluster_ids")[1].alias("b"), F.lit("user_rejected_merge").alias("reason"))
    links = state.cannot_links
    edge = no.select("user_id", F.least("a", "b").alias("cluster_a_id"), F.greatest("a", "b").alias("cluster_b_id"))
    if "reason" in links.columns:
        links, _ = add_cannot_links(links, state.clusters, no, now)
    else:
        links = links.unionByName(edge).distinct()
    state = replace(state, cannot_links=links)
    pairs = outcome.where("action = 'merge'").select("user_id", F.col("cluster_ids")[0].alias("a"), F.col("cluster_ids")[1].alias("b"))
    chosen = gallery.merge_survivor(state.clusters, pairs)
    merges = keep(chosen.select("user_id", F.when(F.col("survivor") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), "survivor"))
    state = mutations.merge(state, merges, t, now)
    cut = outcome.where("action = 'split'").select("user_id", "suggestion_id", F.col("cluster_ids")[0].alias("cluster_id"))
    if "groups" in suggestions.columns:
        parts = cut.join(suggestions.select("user_id", "suggestion_id", "groups"), ["user_id", "suggestion_id"])
        plans = keep(parts.select("user_id", F.col("cluster_id").cast(state.clusters.schema["cluster_id"].dataType).alias("cluster_id"), F.col("groups")[0].alias("group_a"), F.col("groups")[1].alias("group_b"), mutations.fresh_id("user_id", "cluster_id", "groups").alias("new_cluster")))
        state = mutations.split(state, plans, t)
    out = mutations.resolve_suggestions(suggestions, outcome.where("new_status is not null").select("user_id", "suggestion_id", "new_status"), now)
    hit = merges.select("user_id", F.explode(F.array(F.col("loser").cast("string"), F.col("survivor").cast("string"))).alias("cluster_id")).unionByName(cut.select("user_id", F.col("cluster_id").cast("string")))
    out = mutations.invalidate(out, hit.distinct())
    return out, state, outcome


def members_of(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("assignment_state").isin(*MEMBER_STATES) & F.col("cluster_id").isNotNull())
