"""Changes of tables as DataFrames in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, MEMBER_STATES, Thresholds
from kinlake.functions.keys import suggestion_id
from kinlake.operators.exemplars import quality_exemplars, rebuilt


@dataclass(frozen=True)
class State:
    """One snapshot of the entity tables of all tenants."""

    faces: DataFrame
    clusters: DataFrame
    exemplars: DataFrame
    cannot_links: DataFrame


#: Evidence of a decision; a change by hand or by repair replaces it.
EVIDENCE = ("best_match_score", "second_best_cluster_id", "second_best_score", "score_margin", "decision_threshold")


def set_where(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """df with those of the columns that it has set to values where `when` holds."""
    return df.select(*[F.when(when, values[c]).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """table with rows put in by key; columns named in keep stay as they were where the key was there."""
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep]).withColumn("__was", F.lit(True))
    fresh = rows.join(old, keys, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.when(F.col("__was"), F.col(f"__{c}")).otherwise(F.col(c)))
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def insert_once(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows those whose key the table doesn't have; one for each key."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def delete(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns)


def with_counts(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    counted = faces.where(F.col("assignment_state").isin(*MEMBER_STATES) & F.col("cluster_id").isNotNull()).groupBy("user_id", "cluster_id").agg(F.count("*").cast("int").alias("__n"))
    out = clusters.join(counted, ["user_id", "cluster_id"], "left")
    return out.withColumn("face_count", F.coalesce("__n", F.lit(0))).select(*clusters.columns)


def repair(state: State, t: Thresholds = DEFAULT, reason: str = "cluster_lost_last_eligible_exemplar") -> State:
    """Drops exemplars without a member behind them, reseeds clusters that lost all from the best eligible member, and
    dissolves those without one: members become unassigned for `reason`, the cluster goes."""
    keys = ["user_id", "cluster_id"]
    members = state.faces.where(F.col("assignment_state").isin(*MEMBER_STATES) & F.col("cluster_id").isNotNull())
    kept = state.exemplars.join(members.select("user_id", "cluster_id", "face_id"), ["user_id", "cluster_id", "face_id"], "left_semi").select(*state.exemplars.columns)
    active = state.clusters.where("merged_into is null")
    bare = active.select(*keys).join(kept.select(*keys).distinct(), keys, "left_anti")
    best = quality_exemplars(members.join(bare, keys, "left_semi"), t, "cluster_id").where("ordinal = 1")
    gone = bare.join(best.select(*keys), keys, "left_anti").withColumn("__gone", F.lit(True))
    faces = state.faces.join(gone, keys, "left")
    lost = F.col("__gone").isNotNull()
    none = F.lit(None)
    faces = set_where(faces, lost, {"assignment_state": F.lit("unassigned"), "cluster_id": none, "candidate_cluster_id": none, "decision_reason": F.lit(reason), **dict.fromkeys(EVIDENCE, none)}).select(*state.faces.columns)
    clusters = with_counts(delete(state.clusters, gone, keys), faces)
    return replace(state, faces=faces, clusters=clusters, exemplars=kept.unionByName(best.select(*kept.columns)))


def repair_empty(state: State, t: Thresholds = DEFAULT) -> State:
    """repair() as a session begins: active clusters without an exemplar go."""
    return repair(state, t, "legacy_empty_cluster_repaired")


def delete_faces(state: State, ids: DataFrame, t: Thresholds = DEFAULT) -> State:
    """ids: user_id, face_id."""
    return repair(replace(state, faces=delete(state.faces, ids, ["user_id", "face_id"])), t)


def delete_photos(state: State, ids: DataFrame, t: Thresholds = DEFAULT) -> State:
    """ids: user_id, photo_id."""
    return repair(replace(state, faces=delete(state.faces, ids, ["user_id", "photo_id"])), t)


def delete_photo_rows(photos: DataFrame, state: State, ids: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, State]:
    """(photos, state) without the photos, their faces and what these alone held up. ids: user_id, photo_id."""
    return delete(photos, ids, ["user_id", "photo_id"]), delete_photos(state, ids, t)


def save_cluster(state: State, clusters: DataFrame, exemplars: DataFrame) -> State:
    """Puts clusters in by key with these exemplars instead of theirs. An exemplar's face that isn't there is filled in as a confirmed member.

    clusters: as the state's; exemplars: user_id, cluster_id, bucket, ordinal, face_id, quality_score, yaw_ratio, v, norm."""
    keys = ["user_id", "cluster_id"]
    kept = delete(state.exemplars, clusters, keys).unionByName(exemplars.join(clusters.select(*keys), keys, "left_semi").select(*state.exemplars.columns))
    fresh = exemplars.where("face_id is not null").dropDuplicates(["user_id", "face_id"]).join(state.faces.select("user_id", "face_id"), ["user_id", "face_id"], "left_anti")
    known = {"assignment_state": F.lit("confirmed"), "home": F.col("cluster_id"), "restricted": F.lit(False), "is_manual": F.lit(False), "decision_reason": F.lit("exemplar_face_backfill")}
    rows = fresh.select(*[(F.col(c) if c in exemplars.columns else known.get(c, F.lit(None)).cast(state.faces.schema[c].dataType)).alias(c) for c in state.faces.columns])
    faces = state.faces.unionByName(rows)
    return replace(state, faces=faces, clusters=with_counts(upsert(state.clusters, clusters, keys), faces), exemplars=kept)


def delete_clusters(state: State, ids: DataFrame) -> State:
    """Clusters with their faces, exemplars and links; photos stay. ids: user_id, cluster_id."""
    keys = ["user_id", "cluster_id"]
    links = state.cannot_links
    for side in ("cluster_a_id", "cluster_b_id"):
        links = delete(links, ids.withColumnRenamed("cluster_id", side), ["user_id", side])
    return State(delete(state.faces, ids, keys), delete(state.clusters, ids, keys), delete(state.exemplars, ids, keys), links)


def merge_conflicts(state: State, pairs: DataFrame) -> DataFrame:
    """(user_id, source, target, problem) of merges that must not run: a tombstone, a stored link, or a shared photo."""
    from kinlake.operators.audit import photo_conflicts

    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    met = pairs.withColumn("cluster_a_id", lo).withColumn("cluster_b_id", hi)
    members = state.faces.where(F.col("assignment_state").isin(*MEMBER_STATES) & F.col("cluster_id").isNotNull())
    edge = ["user_id", "cluster_a_id", "cluster_b_id"]
    out = met.join(state.cannot_links.select(*edge).withColumn("__link", F.lit(True)), edge, "left").join(photo_conflicts(members).withColumn("__photo", F.lit(True)), edge, "left")
    live = state.clusters.where("merged_into is null").select("user_id", "cluster_id", F.lit(True).alias("__l"))
    for side in ("source", "target"):
        out = out.join(live.select("user_id", F.col("cluster_id").alias(side), F.col("__l").alias(f"__{side}")), ["user_id", side], "left")
    problem = F.when(F.col("__source").isNull() | F.col("__target").isNull(), "STALE: cluster missing or merged").when(F.col("__link"), "STALE: cannot-link").when(F.col("__photo"), "STALE: same photo")
    return out.withColumn("problem", problem).where("problem is not null").select("user_id", "source", "target", "problem")


def inherit_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links with every retired cluster replaced by its survivor; loops and repeats go. merges: user_id, loser, survivor."""
    out = links.select("user_id", "cluster_a_id", "cluster_b_id")
    for side in ("cluster_a_id", "cluster_b_id"):
        met = out.join(merges.select("user_id", F.col("loser").alias(side), "survivor"), ["user_id", side], "left")
        out = met.withColumn(side, F.coalesce("survivor", side)).select("user_id", "cluster_a_id", "cluster_b_id")
    out = out.where("cluster_a_id <> cluster_b_id")
    return out.select("user_id", F.least("cluster_a_id", "cluster_b_id").alias("cluster_a_id"), F.greatest("cluster_a_id", "cluster_b_id").alias("cluster_b_id")).distinct()


def merge(state: State, merges: DataFrame, t: Thresholds = DEFAULT, now: Column | None = None) -> State:
    """Moves all rows of each loser to its survivor, leaves a tombstone, rebuilds exemplars and inherits links.

    merges: user_id, loser, survivor; one for a cluster. Flags of both are joined by or. The moved
    faces' candidate goes with them where it was the loser; both clusters are updated at `now`."""
    m = merges.select("user_id", F.col("loser").alias("cluster_id"), "survivor")
    faces = state.faces.join(m, ["user_id", "cluster_id"], "left")
    if "candidate_cluster_id" in state.faces.columns:
        was = F.col("survivor").isNotNull() & (F.col("candidate_cluster_id") == F.col("cluster_id"))
        faces = faces.withColumn("candidate_cluster_id", F.when(was, F.col("survivor")).otherwise(F.col("candidate_cluster_id")))
    faces = faces.withColumn("cluster_id", F.coalesce("survivor", "cluster_id")).select(*state.faces.columns)
    flags = state.clusters.join(m, ["user_id", "cluster_id"]).groupBy("user_id", F.col("survivor").alias("cluster_id")).agg(F.bool_or("is_user_confirmed").alias("__c"), F.bool_or("has_manual_correction").alias("__m"))
    clusters = state.clusters.join(m, ["user_id", "cluster_id"], "left").join(flags, ["user_id", "cluster_id"], "left")
    if now is not None:
        clusters = set_where(clusters, F.col("survivor").isNotNull() | F.col("__c").isNotNull(), {"last_updated_at": now})
    clusters = (
        clusters.withColumn("merged_into", F.coalesce("survivor", "merged_into"))
        .withColumn("is_user_confirmed", F.col("is_user_confirmed") | F.coalesce("__c", F.lit(False)))
        .withColumn("has_manual_correction", F.col("has_manual_correction") | F.coalesce("__m", F.lit(False)))
        .select(*state.clusters.columns)
    )
    touched = m.select("user_id", "cluster_id").unionByName(m.select("user_id", F.col("survivor").alias("cluster_id"))).distinct()
    members = faces.where(F.col("assignment_state").isin(*MEMBER_STATES))
    fresh = rebuilt(members.join(touched, ["user_id", "cluster_id"], "left_semi"), t)
    exemplars = delete(state.exemplars, touched, ["user_id", "cluster_id"]).unionByName(fresh.select(*state.exemplars.columns))
    return State(faces, with_counts(clusters, faces), exemplars, inherit_links(state.cannot_links, merges))


def split_problems(faces: DataFrame, plans: DataFrame) -> DataFrame:
    """plans (user_id, cluster_id, group_a, group_b: arrays of face ids) with `problem`, null where the split may run."""
    members = faces.where(F.col("assignment_state").isin(*MEMBER_STATES) & F.col("cluster_id").isNotNull())
    now = members.groupBy("user_id", "cluster_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("restricted"), F.col("face_id")))).alias("now"), F.bool_or("is_manual").alias("manual"), F.collect_list(F.when((F.col("quality_score") >= 0.7) & ~F.col("restricted"), F.col("face_id"))).alias("good")
    )
    both = F.concat("group_a", "group_b")
    met = plans.join(now, ["user_id", "cluster_id"], "left")
    problem = (
        F.when((F.size("group_a") < 2) | (F.size("group_b") < 2), "each group needs two faces")
        .when(F.size(F.array_distinct(both)) != F.size(both), "a face occurs twice")
        .when(F.col("now").isNull() | (F.array_sort(both) != F.col("now")), "STALE: membership changed")
        .when(F.col("manual"), "STALE: manual face")
        .when(~F.arrays_overlap("group_a", "good") | ~F.arrays_overlap("group_b", "good"), "each group needs an eligible face")
    )
    return met.select(*plans.columns, problem.alias("problem"))


def fresh_id(*parts: str) -> Column:
    """A cluster id that a hash of its tenant, parent and members gives, apart from ids that faces gave (those are below 2^40)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2).bitwiseOR(F.lit(1 << 61))


def split(state: State, plans: DataFrame, t: Thresholds = DEFAULT) -> State:
    """The larger group (of equals the one with the smaller ids) stays, the other becomes new_cluster; restricted faces are detached for a recheck; both are linked as different.

    plans: user_id, cluster_id, group_a, group_b, new_cluster; checked by split_problems()."""
    a_stays = (F.size("group_a") > F.size("group_b")) | ((F.size("group_a") == F.size("group_b")) & (F.array_sort("group_a") < F.array_sort("group_b")))
    moving = plans.select("user_id", "cluster_id", "new_cluster", F.explode(F.when(a_stays, F.col("group_b")).otherwise(F.col("group_a"))).alias("face_id"))
    touched = plans.select("user_id", "cluster_id", F.lit(True).alias("__t"))
    faces = state.faces.join(moving, ["user_id", "cluster_id", "face_id"], "left").join(touched, ["user_id", "cluster_id"], "left")
    detach = F.col("__t").isNotNull() & F.col("restricted")
    faces = faces.withColumn("cluster_id", F.coalesce("new_cluster", "cluster_id"))
    none = F.lit(None)
    detached = {"assignment_state": F.lit("unassigned"), "cluster_id": none, "candidate_cluster_id": none, "decision_reason": F.lit("restricted_pose_recheck_after_split"), **dict.fromkeys(EVIDENCE, none)}
    faces = set_where(faces, detach, detached).select(*state.faces.columns)
    born = state.clusters.join(plans.select("user_id", "cluster_id", "new_cluster"), ["user_id", "cluster_id"]).withColumn("cluster_id", F.col("new_cluster")).select(*state.clusters.columns)
    clusters = with_counts(state.clusters.unionByName(born), faces)
    ids = plans.select("user_id", "cluster_id").unionByName(plans.select("user_id", F.col("new_cluster").alias("cluster_id")))
    fresh = rebuilt(faces.where(F.col("assignment_state").isin(*MEMBER_STATES)).join(ids, ["user_id", "cluster_id"], "left_semi"), t)
    exemplars = delete(state.exemplars, ids, ["user_id", "cluster_id"]).unionByName(fresh.select(*state.exemplars.columns))
    edge = plans.select("user_id", F.least("cluster_id", "new_cluster").alias("cluster_a_id"), F.greatest("cluster_id", "new_cluster").alias("cluster_b_id"))
    return State(faces, clusters, exemplars, state.cannot_links.select(*edge.columns).unionByName(edge).distinct())


def move_conflicts(faces: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (user_id, face_id, target) that would put two faces of one photo into a cluster, the moving ones aside."""
    moving = moves.join(faces.select("user_id", "face_id", "photo_id"), ["user_id", "face_id"])
    still = faces.where(F.col("assignment_state").isin(*MEMBER_STATES)).join(moves.select("user_id", "face_id"), ["user_id", "face_id"], "left_anti").select("user_id", "photo_id", F.col("cluster_id").alias("target"))
    there = moving.join(still, ["user_id", "photo_id", "target"], "left_semi").select("user_id", "face_id", "target")
    twice = moving.groupBy("user_id", "photo_id", "target").agg(F.count("*").alias("n")).where("n > 1 and photo_id is not null")
    return there.unionByName(moving.join(twice, ["user_id", "photo_id", "target"], "left_semi").select("user_id", "face_id", "target")).distinct()


def move(state: State, moves: DataFrame, t: Thresholds = DEFAULT, now: Column | None = None) -> State:
    """Puts faces by hand into other clusters: they become manual with no evidence left, both clusters are flagged (and updated at `now`) and their exemplars rebuilt."""
    faces = state.faces.join(moves, ["user_id", "face_id"], "left")
    was = F.col("target").isNotNull()
    touched = faces.where(was & F.col("cluster_id").isNotNull()).select("user_id", "cluster_id").unionByName(moves.select("user_id", F.col("target").alias("cluster_id"))).distinct()
    by_hand = {"is_manual": F.lit(True), "assignment_state": F.lit("manual"), "cluster_id": F.col("target"), "candidate_cluster_id": F.col("target"), "decision_reason": F.lit("manual_correction"), **dict.fromkeys(EVIDENCE, F.lit(None))}
    faces = set_where(faces, was, by_hand).select(*state.faces.columns)
    clusters = state.clusters.join(touched.withColumn("__t", F.lit(True)), ["user_id", "cluster_id"], "left")
    clusters = set_where(clusters, F.col("__t").isNotNull(), {"has_manual_correction": F.lit(True)} | ({} if now is None else {"last_updated_at": now})).select(*state.clusters.columns)
    fresh = rebuilt(faces.where(F.col("assignment_state").isin(*MEMBER_STATES)).join(touched, ["user_id", "cluster_id"], "left_semi"), t, low_quality_seed=True)
    exemplars = delete(state.exemplars, touched, ["user_id", "cluster_id"]).unionByName(fresh.select(*state.exemplars.columns))
    return repair(replace(state, faces=faces, clusters=with_counts(clusters, faces), exemplars=exemplars), t)


def photo_moves(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(user_id, face_id, target, n): the source cluster's faces of each photo (user_id, photo_id, source, target); a move needs n = 1."""
    met = photos.join(faces.where(F.col("assignment_state").isin(*MEMBER_STATES)).select("user_id", "photo_id", F.col("cluster_id").alias("source"), "face_id"), ["user_id", "photo_id", "source"], "left")
    return met.groupBy("user_id", "photo_id", "source", "target").agg(F.min("face_id").alias("face_id"), F.count("face_id").alias("n"))


def build_suggestions(kind: str, ids: DataFrame, now: Column) -> DataFrame:
    """Pending suggestions with ids made from their content; ids: user_id, cluster_ids (array<string>)."""
    return ids.select("user_id", suggestion_id(kind, F.col("cluster_ids")).alias("suggestion_id"), F.lit(kind).alias("suggestion_type"), F.sort_array("cluster_ids").alias("cluster_ids"), F.lit("pending").alias("status"), now.alias("created_at"))


def _json_ids(ids: Column) -> Column:
    """An array of strings as JSON text with a space after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(ids, lambda x: F.concat(F.lit('"'), x, F.lit('"')))), F.lit("]"))


def _digest(kind: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(payload.cast("binary")), 1, 12))


def merge_suggestions(candidates: DataFrame, now: Column) -> DataFrame:
    """Suggestions with payload and evidence; candidates: user_id, a, b (strings), coverage_ab, coverage_ba, total_members. A pair with itself makes none."""
    ids = F.sort_array(F.array("a", "b"))
    payload = F.concat(F.lit('{"cluster_ids": '), _json_ids(F.col("cluster_ids")), F.lit("}"))
    found = candidates.where("a <> b").withColumn("cluster_ids", ids).withColumn("payload", payload)
    return found.select(
        "user_id", _digest("merge", F.col("payload")).alias("suggestion_id"), F.lit("merge").alias("suggestion_type"), "cluster_ids", F.lit("pending").alias("status"), now.alias("created_at"), "payload",
        F.create_map(F.concat("a", F.lit("->"), "b"), F.col("coverage_ab").cast("double"), F.concat("b", F.lit("->"), "a"), F.col("coverage_ba").cast("double"), F.lit("total_members"), F.col("total_members").cast("double")).alias("evidence"),
    ).dropDuplicates(["user_id", "suggestion_id"])


def split_suggestions(candidates: DataFrame, now: Column) -> DataFrame:
    """Suggestions with payload and evidence; candidates: user_id, cluster_id (string), groups (array of arrays of strings, in label order), fractions (map). Only two groups of two or more make one."""
    groups = F.transform("groups", lambda g: F.sort_array(g))
    listed = F.concat(F.lit("["), F.concat_ws(", ", F.transform("groups", _json_ids)), F.lit("]"))
    payload = F.concat(F.lit('{"groups": '), listed, F.lit(', "source_cluster_id": "'), F.col("cluster_id"), F.lit('"}'))
    found = candidates.where("size(groups) = 2 and size(groups[0]) >= 2 and size(groups[1]) >= 2").withColumn("groups", groups).withColumn("payload", payload)
    return found.select(
        "user_id", _digest("split", F.col("payload")).alias("suggestion_id"), F.lit("split").alias("suggestion_type"), F.array("cluster_id").alias("cluster_ids"), F.lit("pending").alias("status"), now.alias("created_at"), "payload",
        F.col("fractions").cast("map<string,double>").alias("evidence"),
    ).dropDuplicates(["user_id", "suggestion_id"])


def unknown_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (user_id, suggestion_id, ..) on suggestions that there are not; a caller must not apply those."""
    return decisions.join(suggestions.select("user_id", "suggestion_id"), ["user_id", "suggestion_id"], "left_anti")


def resolve_suggestions(suggestions: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """decisions: user_id, suggestion_id, new_status; resolved_at is set unless it stays pending."""
    met = suggestions.join(decisions.select("user_id", "suggestion_id", "new_status"), ["user_id", "suggestion_id"], "left")
    done = F.col("new_status").isNotNull() & (F.col("new_status") != "pending")
    before = F.col("resolved_at") if "resolved_at" in suggestions.columns else F.lit(None)
    return met.withColumn("resolved_at", F.when(done, now).otherwise(F.when(F.col("new_status").isNull(), before))).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def invalidate(suggestions: DataFrame, touched: DataFrame, but: str | None = None) -> DataFrame:
    """Pending suggestions that share a cluster with touched (user_id, cluster_id as string) become stale, but for one."""
    hit = suggestions.where("status = 'pending'").select("user_id", "suggestion_id", F.explode("cluster_ids").alias("cluster_id")).join(touched, ["user_id", "cluster_id"], "left_semi")
    hit = hit.where(F.col("suggestion_id") != F.lit(but or "")).select("user_id", "suggestion_id").distinct().withColumn("__h", F.lit(True))
    return suggestions.join(hit, ["user_id", "suggestion_id"], "left").withColumn("status", F.when(F.col("__h"), "stale").otherwise(F.col("status"))).drop("__h")


def user_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(user_id, table, rows): what deleting each tenant would remove."""
    parts = [d.groupBy("user_id").agg(F.count("*").alias("rows")).select("user_id", F.lit(n).alias("table"), "rows") for n, d in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
