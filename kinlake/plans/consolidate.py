"""Consolidation of all tenants as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds
from kinlake.operators import audit, mutations, recovery, scores
from kinlake.operators.density import density_labels


@dataclass(frozen=True)
class Audit:
    suspicious: DataFrame
    suggestions: DataFrame
    splits: DataFrame
    merges: DataFrame
    groups: DataFrame
    sizes: DataFrame


@dataclass(frozen=True)
class Run:
    """What one consolidation did: the decisions of each step, the actions taken, and the last audit, which is made when it is first asked for."""

    state: mutations.State
    last_audit: Callable[[], Audit]
    first: DataFrame
    labels: DataFrame
    born: DataFrame
    actions: list[dict]
    again: DataFrame | None
    turned: DataFrame

    @cached_property
    def audit(self) -> Audit:
        return self.last_audit()

    def summary(self) -> DataFrame:
        """(user_id, counter, value): the counters of the run for every tenant that has any."""
        yes = F.col("state") == "confirmed"
        again = self.again if self.again is not None else self.first.where("false")
        events = [(e["user_id"], e["kind"]) for e in self.actions]
        acted = self.first.sparkSession.createDataFrame(events, f"user_id {self.first.schema['user_id'].dataType.simpleString()}, kind string")
        left = self.state.faces
        rows = {
            "initial_deferred_checked": self.first,
            "post_correction_deferred_checked": again,
            "deferred_checked": self.first.unionByName(again),
            "initial_recovered_confirmed": self.first.where(yes),
            "post_correction_recovered_confirmed": again.where(yes),
            "recovered_confirmed": self.first.unionByName(again).where(yes),
            "clean_matches": self.first.unionByName(again).where(yes),
            "unassigned_hdbscan_points": self.labels,
            "new_person_labels": self.labels.where("label >= 0").select("user_id", "label").distinct(),
            "noise_labels": self.labels.where("label < 0"),
            "new_clusters": self.born.select("user_id", "target").distinct(),
            "new_cluster_faces": self.born,
            "restricted_pose_checked": self.turned,
            "restricted_pose_recovered_confirmed": self.turned.where(yes),
            "remaining_restricted_pose": self.turned.where(~yes),
            "auto_merges": acted.where("kind = 'merge'"),
            "auto_splits": acted.where("kind = 'split'"),
            "auto_correction_actions": acted,
            "merge_suggestions": self.audit.suggestions,
            "split_suggestions": self.audit.splits,
            "remaining_ambiguous": left.where("assignment_state = 'ambiguous'"),
            "remaining_unassigned": left.where("assignment_state = 'unassigned'"),
            "suspicious_faces": self.audit.suspicious,
        }
        parts = [d.groupBy("user_id").agg(F.count("*").alias("value")).select("user_id", F.lit(n).alias("counter"), "value") for n, d in rows.items()]
        return reduce(DataFrame.unionByName, parts)

    def suggestions(self, known: DataFrame, now) -> DataFrame:
        """Suggestions of the last audit that the table doesn't have, with payload and evidence; known: user_id, suggestion_id."""
        size = self.audit.sizes.select("user_id", F.col("cluster_id").alias("a"), F.col("size").alias("na"))
        other = self.audit.sizes.select("user_id", F.col("cluster_id").alias("b"), F.col("size").alias("nb"))
        pairs = self.audit.suggestions.join(size, ["user_id", "a"]).join(other, ["user_id", "b"])
        merges = mutations.merge_suggestions(pairs.select("user_id", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "coverage_ab", "coverage_ba", (F.col("na") + F.col("nb")).alias("total_members")), now)
        labelled = self.audit.groups.join(self.audit.splits.select("user_id", "cluster_id"), ["user_id", "cluster_id"], "left_semi")
        each = labelled.groupBy("user_id", "cluster_id", "label").agg(F.sort_array(F.collect_list(F.col("face_id").cast("string"))).alias("ids"))
        each = each.join(audit.split_fractions(labelled), ["user_id", "cluster_id", "label"])
        both = each.groupBy("user_id", F.col("cluster_id").cast("string").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct("label", "ids", "fraction"))).alias("g"))
        groups, fractions = F.transform("g", lambda x: x["ids"]), F.map_from_entries(F.transform("g", lambda x: F.struct(x["label"].cast("string"), x["fraction"])))
        splits = mutations.split_suggestions(both.select("user_id", "cluster_id", groups.alias("groups"), fractions.alias("fractions")), now)
        return mutations.insert_once(known, merges.unionByName(splits), ["user_id", "suggestion_id"])


def audit_state(state: mutations.State, t: Thresholds = DEFAULT, keep=None) -> Audit:
    """All audits over one score table. keep(df) writes a table and reads it again; with it each audit is made once, by a plan of its own, since the driver holds a plan whole."""
    keep = keep or (lambda df: df)
    members = keep(audit.audit_members(state.faces).withColumn("home", F.col("cluster_id")))
    found = keep(scores.face_cluster_scores(members, state.exemplars, t))
    sizes, conflicts, shields = keep(audit.cluster_sizes(members)), keep(audit.photo_conflicts(members)), keep(audit.protected(state.clusters, state.faces))
    mutual = keep(audit.mutual_merges(found, sizes, shields, state.cannot_links, conflicts, t))
    bridges = keep(audit.fragment_bridges(members, sizes, shields, state.cannot_links, conflicts, t, keep))
    groups = keep(density_labels(members, ["user_id", "cluster_id"]))
    manual = state.faces.where("is_manual and cluster_id is not null").select("user_id", "cluster_id").distinct()
    return Audit(
        scores.suspicious(found, t),
        audit.mutual_suggestions(found, sizes, state.cannot_links, conflicts, t),
        keep(audit.splits(members, groups, shields, manual, t)),
        audit.merge_priority(mutual, bridges),
        groups,
        sizes,
    )


def _settle(state: mutations.State, keep, was: mutations.State | None = None) -> mutations.State:
    """state with its tables kept, but for those that it has from `was`, which are kept already."""
    names = [f.name for f in fields(state)]
    return replace(state, **{n: keep(getattr(state, n)) for n in names if was is None or getattr(state, n) is not getattr(was, n)})


def auto_correct(state: mutations.State, keep, t: Thresholds = DEFAULT) -> tuple[mutations.State, list[dict]]:
    """Up to max_actions rounds of audit and one action for each tenant: its first merge, else its first safe split.

    keep(df) writes a table and reads it again, which cuts the lineage between rounds. Tenants act
    at the same time; a row for each action (at most max_actions of each tenant) comes to the driver."""
    log: list[dict] = []
    for number in range(t.max_actions):
        found = audit_state(state, t, keep)
        merges = keep(found.merges.where("priority = 1").select("user_id", F.col("source").alias("loser"), F.col("target").alias("survivor")))
        first = F.row_number().over(audit.Window.partitionBy("user_id").orderBy("cluster_id"))
        chosen = found.splits.where("auto_safe").join(merges.select("user_id"), "user_id", "left_anti").withColumn("rn", first).where("rn = 1")
        parts = found.groups.join(chosen.select("user_id", "cluster_id"), ["user_id", "cluster_id"]).groupBy("user_id", "cluster_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("label") == 0, F.col("face_id")))).alias("group_a"), F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.col("face_id")))).alias("group_b")
        )
        plans = keep(parts.withColumn("new_cluster", mutations.fresh_id("user_id", "cluster_id", "group_a", "group_b")))
        merged = [{"round": number, "kind": "merge", **r.asDict()} for r in merges.collect()]
        split = [{"round": number, "kind": "split", **r.asDict()} for r in plans.select("user_id", "cluster_id", "new_cluster").collect()]
        if not merged and not split:
            break
        log += merged + split
        after = mutations.merge(state, merges, t) if merged else state
        state = _settle(mutations.split(after, plans, t) if split else after, keep, state)
    return state, log


def _apply(faces: DataFrame, decisions: DataFrame) -> DataFrame:
    """Confirmed decisions (user_id, face_id, target) taken into the faces."""
    met = faces.join(decisions, ["user_id", "face_id"], "left")
    took = F.col("target").isNotNull()
    return met.withColumn("assignment_state", F.when(took, "confirmed").otherwise(F.col("assignment_state"))).withColumn("cluster_id", F.coalesce("target", "cluster_id")).select(*faces.columns)


#: Columns of a face that keep what a decision on it rested on, and the decision's columns.
EVIDENCE = {
    "candidate_cluster_id": "best_cluster",
    "best_match_score": "best_score",
    "second_best_cluster_id": "second_cluster",
    "second_best_score": "second_score",
    "score_margin": "margin",
    "decision_threshold": "threshold",
    "decision_reason": "reason",
}


def decided(faces: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (user_id, face_id, target, state, and those of EVIDENCE) taken into the faces: state, cluster and, where faces have such columns, evidence."""
    held = decisions.select("user_id", "face_id", F.struct("target", "state", *EVIDENCE.values()).alias("__d"))
    met = faces.join(held, ["user_id", "face_id"], "left")
    values = {"assignment_state": F.col("__d.state"), "cluster_id": F.when(F.col("__d.state") == "confirmed", F.col("__d.target")), **{c: F.col(f"__d.{d}") for c, d in EVIDENCE.items()}}
    return mutations.set_where(met, F.col("__d").isNotNull(), values).select(*faces.columns)


def consolidate(state: mutations.State, keep, t: Thresholds = DEFAULT) -> Run:
    """Recovery, new people, corrections, recovery again if anything was corrected, restricted faces, and a last audit."""

    def taken(s, decisions):
        faces = decided(s.faces, decisions)
        faces = keep(faces)
        return replace(s, faces=faces, clusters=keep(mutations.with_counts(s.clusters, faces)))

    def recover(s):
        done = keep(recovery.recover_deferred(s.faces, s.exemplars, t).select("user_id", "face_id", F.col("assigned_cluster").alias("target"), "state", *EVIDENCE.values()))
        return taken(s, done), done

    state, first = recover(_settle(state, keep))
    labels = keep(recovery.unassigned_labels(state.faces))
    born = keep(recovery.new_people(state.faces, t, labels).select("user_id", "face_id", mutations.fresh_id("user_id", "seed", "group_id").alias("target")))
    if not born.isEmpty():
        faces = keep(_apply(state.faces, born))
        head = born.groupBy("user_id", F.col("target").alias("cluster_id")).agg(F.count("*").cast("int").alias("face_count"))
        defaults = {"is_user_confirmed": F.lit(False), "has_manual_correction": F.lit(False), "created_at": F.current_date(), "last_updated_at": F.current_date(), "merged_into": F.lit(None).cast("long")}
        new = head.select(*[F.col(c) if c in head.columns else defaults[c].alias(c) for c in state.clusters.columns])
        members = faces.join(born.select("user_id", "face_id"), ["user_id", "face_id"], "left_semi")
        ex = mutations.rebuilt(members, t).select(*state.exemplars.columns)
        state = _settle(replace(state, faces=faces, clusters=state.clusters.unionByName(new), exemplars=state.exemplars.unionByName(ex)), keep, replace(state, faces=faces))
    state, log = auto_correct(state, keep, t)
    again = None
    if log:
        state, again = recover(state)
    turned = keep(recovery.recover_restricted(state.faces, state.exemplars, t).select("user_id", "face_id", F.col("best_cluster").alias("target"), "state", *EVIDENCE.values()))
    state = taken(state, turned)
    return Run(state, lambda: audit_state(state, t, keep), first, labels, born, log, again, turned)
