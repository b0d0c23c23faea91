"""The named queries over the derived tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.functions import geometry, keys
from kinlake.functions import quality as q
from kinlake.functions.vector import cosine, top_average
from kinlake.operators import audit, gallery, integrity, mutations, recovery, scores
from kinlake.operators.exemplars import quality_exemplars
from kinlake.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
anchors AS (SELECT label, arg_min(e, vec_id) AS a FROM e GROUP BY label),
raw AS (SELECT e.vec_id, e.label, e.e, a, 0.45::DOUBLE + 0.1::DOUBLE * (vec_id % 5) AS w FROM e JOIN anchors USING (label)),
f0 AS (SELECT (vec_id // 3) % 4 AS user_id, vec_id AS face_id, vec_id // 3 AS photo_id, vec_id % 3 AS face_index,
  (label * 2 + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS home,
  ((vec_id * 37) % 101) / 100.0::DOUBLE AS quality_score, (((vec_id * 53) % 141) - 70) / 100.0::DOUBLE AS yaw_ratio,
  CASE vec_id % 10 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unassigned' WHEN 2 THEN 'manual' ELSE 'confirmed' END AS assignment_state,
  list_transform(list_zip(a, e), lambda p: w * p[1] + sqrt(1 - w * w) * p[2]) AS v FROM raw),
faces AS (SELECT *, CASE WHEN assignment_state IN ('confirmed', 'manual') THEN home END AS cluster_id, abs(yaw_ratio) >= 0.6 AS restricted,
  assignment_state = 'manual' AS is_manual, sqrt(list_inner_product(v, v)) AS norm FROM f0),
members AS (SELECT * EXCLUDE (cluster_id), home AS cluster_id FROM faces WHERE NOT restricted),
ex0 AS (SELECT user_id, home AS cluster_id, face_id, quality_score, v, norm, row_number() OVER (PARTITION BY user_id, home ORDER BY quality_score DESC, face_id) AS ordinal
  FROM faces WHERE quality_score >= 0.7 AND NOT restricted),
ex AS (SELECT * FROM ex0 WHERE ordinal <= 5),
clusters AS (SELECT user_id, home AS cluster_id, (count(*) FILTER (cluster_id IS NOT NULL))::INT AS face_count, home % 5 = 0 AS is_user_confirmed, bool_or(is_manual) AS has_manual_correction,
  DATE '2024-01-01' + home::INT AS created_at, DATE '2024-01-01' + (home % 60)::INT AS last_updated_at FROM faces GROUP BY user_id, home),
links AS (SELECT DISTINCT user_id, (home // 2) * 2 AS a, (home // 2) * 2 + 1 AS b FROM faces WHERE (home // 2) % 3 = 0),
sims AS (SELECT f.user_id, f.face_id, f.home, f.photo_id, x.cluster_id, list_inner_product(f.v, x.v) / (f.norm * x.norm + 1e-9) AS sim
  FROM faces f JOIN ex x ON f.user_id = x.user_id AND f.face_id <> x.face_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, face_id, cluster_id ORDER BY sim DESC) AS rn, count(*) OVER (PARTITION BY user_id, face_id, cluster_id) AS n FROM sims),
scores AS (SELECT user_id, face_id, home, photo_id, cluster_id, avg(sim) AS score, max(n)::INT AS n_exemplars, CASE WHEN max(n) < 2 THEN 0.41::DOUBLE + 0.05::DOUBLE ELSE 0.41::DOUBLE END AS threshold
  FROM ranked WHERE rn <= 2 GROUP BY user_id, face_id, home, photo_id, cluster_id),
mscores AS (SELECT s.* FROM scores s JOIN members m USING (user_id, face_id)),
sizes AS (SELECT user_id, cluster_id, count(*) AS size FROM members GROUP BY user_id, cluster_id),
conflicts AS (SELECT DISTINCT x.user_id, x.cluster_id AS a, y.cluster_id AS b FROM members x JOIN members y ON x.user_id = y.user_id AND x.photo_id = y.photo_id AND x.face_id <> y.face_id AND x.cluster_id < y.cluster_id)
"""
DECIDE = """
, best AS (SELECT *, row_number() OVER (PARTITION BY user_id, face_id ORDER BY score DESC, cluster_id) AS rk FROM pool),
two AS (SELECT user_id, face_id, max(cluster_id) FILTER (rk = 1) AS c1, max(score) FILTER (rk = 1) AS s1, max(threshold) FILTER (rk = 1) AS th, max(n_exemplars) FILTER (rk = 1) AS nx,
  max(score) FILTER (rk = 2) AS s2 FROM best WHERE rk <= 2 GROUP BY user_id, face_id)
"""
REASON = """CASE WHEN c1 IS NULL AND eligible THEN 'new_cluster_seed_no_existing_candidates' WHEN c1 IS NULL THEN 'unassigned_no_existing_candidates_and_not_exemplar_eligible'
  WHEN s1 >= th AND s1 - s2 < 0.05 THEN 'ambiguous_insufficient_margin_over_second_best' WHEN s1 >= th THEN 'confirmed_score_and_margin_passed'
  WHEN s1 >= th - 0.08::DOUBLE THEN 'ambiguous_score_inside_threshold_band' WHEN eligible THEN 'new_cluster_seed_no_candidate_above_ambiguous_band' ELSE 'unassigned_no_match_and_not_exemplar_eligible' END"""


#: The same tables with members closer to their anchor and one face in a photo, so that merges are accepted.
TIGHT = BASE.replace("0.45::DOUBLE + 0.1::DOUBLE * (vec_id % 5)", "0.75::DOUBLE + 0.05::DOUBLE * (vec_id % 5)").replace("vec_id // 3 AS photo_id", "vec_id AS photo_id")


def query(sql: str | None = None, base: bool = True, start: str = BASE):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (start if base else "") + sql
        return f

    return put


def _r(c: str, alias: str | None = None):
    return F.round(c, 6).alias(alias or c)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_members(fx.all_members(fx.faces(spark, sf_dir)))


def _audit(spark: SparkSession, sf_dir: str, tight: bool = False):
    """(members, their scores, sizes, links, photo conflicts): what the audits share."""
    faces = _keep(spark)(fx.faces(spark, sf_dir, tight))  # the views are derived from vectors by formulas, and read many times
    members = audit.audit_members(fx.all_members(faces))
    found = scores.face_cluster_scores(members, fx.exemplars(faces))
    return members, found, audit.cluster_sizes(members), fx.cannot_links(faces), audit.photo_conflicts(members)


def _state(spark: SparkSession, sf_dir: str) -> mutations.State:
    faces = fx.faces(spark, sf_dir)
    members = faces.where("cluster_id is not null")
    return mutations.State(faces, fx.clusters(faces), quality_exemplars(members, cluster="cluster_id"), fx.cannot_links(faces))


@query("SELECT a.user_id, a.face_id AS a, b.face_id AS b, round(list_inner_product(a.v, b.v) / (a.norm * b.norm + 1e-9), 6) AS sim FROM faces a JOIN faces b ON a.user_id = b.user_id AND a.home = b.home AND a.face_id < b.face_id")
def cosine_pairs(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    a, b = (f.select("user_id", "home", F.col("face_id").alias(s), F.col("v").alias(f"v{s}"), F.col("norm").alias(f"n{s}")) for s in "ab")
    return a.join(b, ["user_id", "home"]).where("a < b").select("user_id", "a", "b", F.round(cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")), 6).alias("sim"))


@query("SELECT user_id, face_id, cluster_id, round(score, 6) AS score, n_exemplars, round(threshold, 6) AS threshold FROM scores")
def score_clusters(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return scores.face_cluster_scores(f, fx.exemplars(f)).select("user_id", "face_id", "cluster_id", _r("score"), "n_exemplars", _r("threshold"))


@query(", t AS (SELECT user_id, cluster_id, list_sort(list(quality_score), 'DESC') AS q FROM ex GROUP BY user_id, cluster_id) SELECT user_id, cluster_id, round(list_avg(q[1:2]), 6) AS top_quality FROM t")
def topk_average(spark, sf_dir):
    g = fx.exemplars(fx.faces(spark, sf_dir)).groupBy("user_id", "cluster_id").agg(F.collect_list("quality_score").alias("q"))
    return g.select("user_id", "cluster_id", F.round(top_average(F.col("q"), 2), 6).alias("top_quality"))


@query(f", pool AS (SELECT * FROM scores) {DECIDE} SELECT f.user_id, f.face_id, c1 AS best_cluster, round(s1, 6) AS best_score, round(s1 - s2, 6) AS margin, reason, CASE WHEN reason LIKE 'confirmed%' OR reason LIKE 'new%' THEN 'confirmed' WHEN reason LIKE 'amb%' THEN 'ambiguous' ELSE 'unassigned' END AS state FROM (SELECT f.user_id, f.face_id, c1, s1, s2, {REASON} AS reason FROM (SELECT *, quality_score >= 0.7 AND NOT restricted AS eligible FROM faces) f LEFT JOIN two USING (user_id, face_id)) f")
def assign_decision(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    d = scores.decide(f, scores.face_cluster_scores(f, fx.exemplars(f)), (F.col("quality_score") >= 0.7) & ~F.col("restricted"))
    return d.select("user_id", "face_id", "best_cluster", _r("best_score"), _r("margin"), "reason", "state")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_decision(spark, sf_dir).groupBy("state", "reason").agg(F.count("*").alias("n_faces"))


@query(f", pool AS (SELECT * FROM scores) {DECIDE} SELECT CASE WHEN reason LIKE 'confirmed%' OR reason LIKE 'new%' THEN 'confirmed' WHEN reason LIKE 'amb%' THEN 'ambiguous' ELSE 'unassigned' END AS state, reason, count(*) AS n_faces FROM (SELECT {REASON} AS reason FROM (SELECT *, quality_score >= 0.7 AND NOT restricted AS eligible FROM faces) f LEFT JOIN two USING (user_id, face_id)) GROUP BY ALL")
def assign_counts(spark, sf_dir):
    return flagship(spark, sf_dir)


OCCUPIED = ", occ AS (SELECT DISTINCT user_id, photo_id, cluster_id FROM faces WHERE cluster_id IS NOT NULL), "


@query(OCCUPIED + f"waiting AS (SELECT *, false AS eligible FROM faces WHERE cluster_id IS NULL AND NOT restricted), pool AS (SELECT s.* FROM scores s JOIN waiting USING (user_id, face_id) ANTI JOIN occ o ON s.user_id = o.user_id AND s.photo_id = o.photo_id AND s.cluster_id = o.cluster_id) {DECIDE} SELECT user_id, face_id, best_cluster, best_score, CASE WHEN r LIKE 'conf%' THEN 'consolidation_recovery:' ELSE 'consolidation_recheck:' END || r AS reason FROM (SELECT f.user_id, f.face_id, c1 AS best_cluster, round(s1, 6) AS best_score, {REASON} AS r FROM waiting f LEFT JOIN two USING (user_id, face_id))")
def recover_deferred(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return recovery.recover_deferred(f, fx.exemplars(f)).select("user_id", "face_id", "best_cluster", _r("best_score"), "reason")


RESTRICTED = OCCUPIED + f"""waiting AS (SELECT * FROM faces WHERE cluster_id IS NULL AND restricted), pool AS (SELECT s.* FROM scores s JOIN waiting USING (user_id, face_id) ANTI JOIN occ o ON s.user_id = o.user_id AND s.photo_id = o.photo_id AND s.cluster_id = o.cluster_id) {DECIDE},
 auth AS (SELECT user_id, cluster_id AS c1, count(*) FILTER (NOT restricted) AS n FROM faces WHERE cluster_id IS NOT NULL GROUP BY user_id, cluster_id),
 dec AS (SELECT w.user_id, w.face_id, w.photo_id, c1, s1, s1 - s2 AS margin, CASE WHEN c1 IS NULL THEN 'restricted_pose_no_available_cluster' WHEN s1 < greatest(th, 0.41::DOUBLE + 0.05::DOUBLE) THEN 'restricted_pose_score_below_high_confidence_floor'
  WHEN NOT (coalesce(n, 0) >= 8 AND nx >= 2) THEN 'restricted_pose_best_cluster_not_mature' WHEN s1 - s2 < 0.05 THEN 'restricted_pose_insufficient_margin_over_second_best' ELSE 'restricted_pose_mature_cluster_high_confidence_match' END AS reason FROM waiting w LEFT JOIN two USING (user_id, face_id) LEFT JOIN auth USING (user_id, c1)),
 win AS (SELECT *, row_number() OVER (PARTITION BY user_id, photo_id, c1 ORDER BY s1 DESC, margin DESC NULLS LAST, face_id) AS rn FROM dec WHERE reason LIKE '%match') """


@query(RESTRICTED + "SELECT d.user_id, d.face_id, d.c1 AS best_cluster, round(d.s1, 6) AS best_score, CASE WHEN rn = 1 THEN 'restricted_pose_recovery:' || d.reason WHEN rn > 1 THEN 'restricted_pose_recheck:restricted_pose_same_photo_deferred_conflict' ELSE 'restricted_pose_recheck:' || d.reason END AS reason FROM dec d LEFT JOIN win w USING (user_id, face_id)")
def restricted_pose(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return recovery.recover_restricted(f, fx.exemplars(f)).select("user_id", "face_id", "best_cluster", _r("best_score"), "reason")


@query(RESTRICTED + "SELECT user_id, face_id, photo_id, c1 AS best_cluster, CASE WHEN rn = 1 THEN 'confirmed' ELSE 'ambiguous' END AS state FROM win")
def restricted_winners(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    w = recovery.restricted(f)
    d = scores.decide_restricted(w, scores.face_cluster_scores(w, fx.exemplars(f), excluded=recovery.occupied(f)), scores.authoritative(f))
    return scores.restricted_winners(d).select("user_id", "face_id", "photo_id", "best_cluster", "state")


@query(", own AS (SELECT user_id, face_id, score AS own_score FROM mscores WHERE cluster_id = home), o AS (SELECT user_id, face_id, home, cluster_id, score, row_number() OVER (PARTITION BY user_id, face_id ORDER BY score DESC, cluster_id) AS rn FROM mscores WHERE cluster_id <> home AND score >= threshold) SELECT user_id, face_id, home, cluster_id AS other_cluster, round(score, 6) AS other_score, round(own_score, 6) AS own_score FROM o JOIN own USING (user_id, face_id) WHERE rn = 1 AND score - own_score >= 0.05")
def suspicious_faces(spark, sf_dir):
    _, s, *_ = _audit(spark, sf_dir)
    return scores.suspicious(s).select("user_id", "face_id", "home", "other_cluster", _r("other_score"), _r("own_score"))


COVER = """, cov AS (SELECT user_id, home AS source, cluster_id AS target, count(*) FILTER (score >= greatest(threshold, 0.41::DOUBLE + 0.05::DOUBLE)) AS covered, count(*) FILTER (score >= 0.41::DOUBLE + 0.1::DOUBLE) AS strong, min(score) AS min_score, avg(score) AS mean_score FROM mscores WHERE cluster_id <> home GROUP BY ALL),
 cover AS (SELECT c.*, size, covered / size::DOUBLE AS coverage FROM cov c JOIN sizes s ON c.user_id = s.user_id AND c.source = s.cluster_id),
 third AS (SELECT a.user_id, a.face_id, a.home, a.cluster_id AS target, a.score, min(a.score - b.score) AS margin FROM mscores a LEFT JOIN mscores b ON a.user_id = b.user_id AND a.face_id = b.face_id AND b.cluster_id <> a.cluster_id AND b.cluster_id <> b.home WHERE a.cluster_id <> a.home GROUP BY ALL),
 mg AS (SELECT user_id, home AS source, target, min(margin) AS least FROM third GROUP BY ALL),
 full_ AS (SELECT c.*, least FROM cover c LEFT JOIN mg USING (user_id, source, target)),
 both_ AS (SELECT x.user_id, x.source AS a, x.target AS b, x.coverage AS ca, y.coverage AS cb, x.strong AS sa, y.strong AS sb, x.size AS na, y.size AS nb, x.least AS la, y.least AS lb FROM full_ x JOIN full_ y ON x.user_id = y.user_id AND x.source = y.target AND x.target = y.source WHERE x.source < x.target) """


@query(COVER + "SELECT user_id, source, target, covered, strong, round(coverage, 6) AS coverage, round(mean_score, 6) AS mean_score FROM cover")
def coverage_matrix(spark, sf_dir):
    _, s, sizes, *_ = _audit(spark, sf_dir)
    return scores.coverage(s, sizes).select("user_id", "source", "target", "covered", "strong", _r("coverage"), _r("mean_score"))


@query(COVER + "SELECT user_id, source, target, strong FROM cover WHERE strong >= least(2, size)")
def strong_anchors(spark, sf_dir):
    _, s, sizes, *_ = _audit(spark, sf_dir)
    return scores.coverage(s, sizes).where("strong >= least(2, size)").select("user_id", "source", "target", "strong")


@query(COVER + "SELECT user_id, face_id, target, round(margin, 6) AS margin FROM third")
def competition_margin(spark, sf_dir):
    _, s, *_ = _audit(spark, sf_dir)
    return scores.competition(s).select("user_id", "face_id", "target", _r("margin"))


@query(COVER + "SELECT user_id, a, b, round(ca, 6) AS coverage_ab, round(cb, 6) AS coverage_ba FROM both_ ANTI JOIN links USING (user_id, a, b) ANTI JOIN conflicts USING (user_id, a, b) WHERE na >= 2 AND nb >= 2 AND ca >= 0.9 AND cb >= 0.9")
def mutual_merge_candidates(spark, sf_dir):
    _, s, sizes, links, conflicts = _audit(spark, sf_dir)
    return audit.mutual_suggestions(s, sizes, links, conflicts).select("user_id", "a", "b", _r("coverage_ab"), _r("coverage_ba"))


SHIELD = ", shield AS (SELECT DISTINCT user_id, cluster_id FROM clusters WHERE is_user_confirmed) "
BLOCK = "CASE WHEN {a} IN (SELECT cluster_id FROM shield s WHERE s.user_id = x.user_id) THEN 'source_user_protected' WHEN {b} IN (SELECT cluster_id FROM shield s WHERE s.user_id = x.user_id) THEN 'target_user_protected' WHEN EXISTS (SELECT 1 FROM links l WHERE l.user_id = x.user_id AND l.a = least({a}, {b}) AND l.b = greatest({a}, {b})) THEN 'stored_cannot_link' WHEN EXISTS (SELECT 1 FROM conflicts l WHERE l.user_id = x.user_id AND l.a = least({a}, {b}) AND l.b = greatest({a}, {b})) THEN 'same_photo_conflict' END"


def _shields(spark, sf_dir, tight=False):
    f = fx.faces(spark, sf_dir, tight)
    return audit.protected(fx.clusters(f).withColumn("has_manual_correction", F.lit(False)), fx.all_members(f))


MUTUAL = f"CASE WHEN na < 2 OR nb < 2 THEN 'singleton_cluster_protected' WHEN blocker IS NOT NULL THEN blocker WHEN ca < 1 OR cb < 1 THEN 'not_full_mutual_high_confidence_coverage' WHEN sa < least(2, na) OR sb < least(2, nb) THEN 'insufficient_strong_anchors_both_directions' WHEN la < 0.05 THEN 'third_person_competition_a_to_b' WHEN lb < 0.05 THEN 'third_person_competition_b_to_a' END AS reason, CASE WHEN (na, a) <= (nb, b) THEN a ELSE b END AS source FROM (SELECT x.*, {BLOCK.format(a='x.a', b='x.b')} AS blocker FROM both_ x)"


@query(COVER + SHIELD + f"SELECT user_id, a, b, {MUTUAL}")
def mutual_auto_merge(spark, sf_dir):
    _, s, sizes, links, conflicts = _audit(spark, sf_dir)
    return audit.mutual_merges(s, sizes, _shields(spark, sf_dir), links, conflicts).select("user_id", "a", "b", "reason", "source")


FRAGMENT = """, pairs AS (SELECT s.user_id, s.cluster_id AS source, t.cluster_id AS target, s.size AS ns, t.size AS nt FROM sizes s JOIN sizes t ON s.user_id = t.user_id AND s.cluster_id <> t.cluster_id WHERE s.size >= 2 AND t.size >= 8 AND s.size < t.size AND s.size <= 0.35::DOUBLE * t.size),
 ms AS (SELECT x.user_id, x.cluster_id AS c, x.face_id, y.cluster_id AS d, y.face_id AS other_id, y.photo_id AS other_photo, list_inner_product(x.v, y.v) / (x.norm * y.norm + 1e-9) AS sim FROM members x JOIN members y ON x.user_id = y.user_id),
 per AS (SELECT p.user_id, p.source, p.target, m.face_id, count(*) FILTER (sim >= 0.41) AS support, max(sim) AS best FROM pairs p JOIN ms m ON p.user_id = m.user_id AND p.source = m.c AND p.target = m.d GROUP BY ALL),
 bestof AS (SELECT user_id, c, face_id, d, max(sim) AS sim FROM ms WHERE c <> d GROUP BY ALL),
 ev AS (SELECT p.user_id, p.source, p.target, p.face_id, p.support, p.best, max(b.sim) AS rival FROM per p LEFT JOIN bestof b ON p.user_id = b.user_id AND p.source = b.c AND p.face_id = b.face_id AND b.d <> p.target GROUP BY ALL) """


@query(FRAGMENT + "SELECT user_id, source, target, face_id, support, round(best, 6) AS best, round(rival, 6) AS rival FROM ev")
def fragment_bridge_support(spark, sf_dir):
    m = _members(spark, sf_dir)
    return audit.bridge_evidence(m, audit.fragments(audit.cluster_sizes(m))).select("user_id", "source", "target", "face_id", "support", _r("best"), _r("rival"))




BRIDGED = """, lk AS (SELECT user_id, c, face_id, other_id FROM ms WHERE c = d AND sim >= 0.41::DOUBLE - 0.08::DOUBLE),
 r AS (SELECT * FROM (WITH RECURSIVE reach(user_id, c, face_id) AS (SELECT user_id, c, min(face_id) FROM ms GROUP BY user_id, c UNION SELECT l.user_id, l.c, l.other_id FROM reach q JOIN lk l ON l.user_id = q.user_id AND l.c = q.c AND l.face_id = q.face_id) SELECT user_id, c AS source, count(*) AS n FROM reach GROUP BY user_id, c)),
 ag AS (SELECT user_id, source, target, avg((support >= 2)::INT) AS cov, count(*) FILTER (best >= 0.41::DOUBLE + 0.05::DOUBLE) AS high, count(*) FILTER (best >= 0.41::DOUBLE + 0.1::DOUBLE) AS strong, min(best) AS min_score, avg(best) AS mean_score, min(best - rival) AS margin, coalesce(bool_or(best <= rival), false) AS beaten, coalesce(bool_or(best >= 0.41::DOUBLE + 0.05::DOUBLE AND best - rival < 0.05), false) AS close FROM ev GROUP BY ALL),
 br AS (SELECT p.user_id, p.source, p.target, count(DISTINCT other_id) AS bf, count(DISTINCT other_photo) AS bp FROM per p JOIN ms m ON p.user_id = m.user_id AND p.source = m.c AND p.target = m.d AND p.face_id = m.face_id WHERE p.support >= 2 AND sim >= 0.41 GROUP BY ALL)
"""
BRIDGE = f"""CASE WHEN blocker IS NOT NULL THEN blocker WHEN n < ns THEN 'source_fragment_not_internally_connected' WHEN beaten THEN 'target_not_best_member_level_alternative' WHEN close THEN 'high_conf_bridge_has_third_person_competition' WHEN cov < 1 THEN 'not_every_source_face_has_repeated_target_member_support'
  WHEN high < least(2, ns) THEN 'insufficient_high_conf_bridge_source_faces' WHEN strong < least(2, ns) THEN 'insufficient_strong_bridge_source_faces' WHEN coalesce(bf, 0) < 2 THEN 'bridge_depends_on_too_few_target_faces' WHEN coalesce(bp, 0) < 2 THEN 'bridge_depends_on_too_few_target_photos' END AS reason
 FROM (SELECT x.*, {BLOCK.format(a='x.source', b='x.target')} AS blocker FROM pairs x) x JOIN ag USING (user_id, source, target) LEFT JOIN br USING (user_id, source, target) LEFT JOIN r USING (user_id, source)"""


@query(FRAGMENT + SHIELD + BRIDGED + f" SELECT user_id, source, target, {BRIDGE}")
def fragment_bridges(spark, sf_dir):
    m, _, sizes, links, conflicts = _audit(spark, sf_dir)
    return audit.fragment_bridges(m, sizes, _shields(spark, sf_dir), links, conflicts, keep=_keep(spark)).select("user_id", "source", "target", "reason")


@query(FRAGMENT + SHIELD + BRIDGED + f" SELECT user_id, source, target, {BRIDGE}", start=TIGHT)
def tight_fragment_bridges(spark, sf_dir):
    m, _, sizes, links, conflicts = _audit(spark, sf_dir, True)
    return audit.fragment_bridges(m, sizes, _shields(spark, sf_dir, True), links, conflicts).select("user_id", "source", "target", "reason")


@query(COVER + "SELECT user_id, a, b, round(ca, 6) AS coverage_ab, round(cb, 6) AS coverage_ba FROM both_ ANTI JOIN links USING (user_id, a, b) ANTI JOIN conflicts USING (user_id, a, b) WHERE na >= 2 AND nb >= 2 AND ca >= 0.9 AND cb >= 0.9", start=TIGHT)
def tight_merge_candidates(spark, sf_dir):
    _, s, sizes, links, conflicts = _audit(spark, sf_dir, True)
    return audit.mutual_suggestions(s, sizes, links, conflicts).select("user_id", "a", "b", _r("coverage_ab"), _r("coverage_ba"))


@query(COVER + SHIELD + f"SELECT user_id, a, b, {MUTUAL}", start=TIGHT)
def tight_auto_merge(spark, sf_dir):
    _, s, sizes, links, conflicts = _audit(spark, sf_dir, True)
    return audit.mutual_merges(s, sizes, _shields(spark, sf_dir, True), links, conflicts).select("user_id", "a", "b", "reason", "source")


PRIORITY = COVER + SHIELD + FRAGMENT + BRIDGED + f""", mu AS (SELECT user_id, a, b, la, lb, {MUTUAL}), m2 AS (SELECT mu.user_id, 0 AS tier, mu.source, CASE WHEN mu.source = a THEN b ELSE a END AS target, 1.0::DOUBLE AS source_coverage, least(la, lb) AS margin FROM mu WHERE reason IS NULL),
 m3 AS (SELECT m2.user_id, tier, m2.source, m2.target, source_coverage, f.strong, f.min_score, f.mean_score, m2.margin FROM m2 JOIN full_ f ON f.user_id = m2.user_id AND f.source = m2.source AND f.target = m2.target),
 fr AS (SELECT user_id, source, target, cov, strong, min_score, mean_score, margin, {BRIDGE}),
 every AS (SELECT * FROM m3 UNION ALL SELECT user_id, 1, source, target, cov, strong, min_score, mean_score, margin FROM fr WHERE reason IS NULL),
 once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY user_id, least(source, target), greatest(source, target) ORDER BY tier, source_coverage DESC, strong DESC, min_score DESC, mean_score DESC, margin DESC NULLS FIRST, source, target) = 1)
 SELECT user_id, CASE tier WHEN 0 THEN 'mutual_full_coverage' ELSE 'fragment_member_bridge' END AS mode, source, target, round(min_score, 6) AS min_score, (row_number() OVER (PARTITION BY user_id ORDER BY tier, source_coverage DESC, strong DESC, min_score DESC, mean_score DESC, margin DESC NULLS FIRST, source, target))::INT AS priority FROM once"""


def _priority(spark, sf_dir, tight):
    m, s, sizes, links, conflicts = _audit(spark, sf_dir, tight)
    shields = _shields(spark, sf_dir, tight)
    found = audit.merge_priority(audit.mutual_merges(s, sizes, shields, links, conflicts), audit.fragment_bridges(m, sizes, shields, links, conflicts, keep=_keep(spark)))
    return found.select("user_id", "mode", "source", "target", _r("min_score"), "priority")


@query(PRIORITY)
def merge_priority(spark, sf_dir):
    return _priority(spark, sf_dir, False)


@query(PRIORITY, start=TIGHT)
def tight_merge_priority(spark, sf_dir):
    return _priority(spark, sf_dir, True)


@query(", mm AS (SELECT x.user_id, x.cluster_id, x.face_id, x.quality_score, avg(list_inner_product(x.v, y.v) / (x.norm * y.norm + 1e-9)) AS s FROM members x JOIN members y ON x.user_id = y.user_id AND x.cluster_id = y.cluster_id GROUP BY ALL) SELECT user_id, cluster_id, arg_min(face_id, (-s, face_id)) AS medoid, round(max(s), 6) AS mean_sim FROM mm WHERE quality_score >= 0.7 GROUP BY ALL")
def medoid(spark, sf_dir):
    return audit.medoids(_members(spark, sf_dir)).select("user_id", "cluster_id", "medoid", _r("mean_sim"))


@query(", mm AS (SELECT x.user_id, x.cluster_id, x.face_id, x.quality_score, avg(list_inner_product(x.v, y.v) / (x.norm * y.norm + 1e-9)) AS s FROM members x JOIN members y ON x.user_id = y.user_id AND x.cluster_id = y.cluster_id GROUP BY ALL), md AS (SELECT user_id, cluster_id, arg_min(face_id, (-s, face_id)) AS face_id FROM mm WHERE quality_score >= 0.7 GROUP BY ALL), mv AS (SELECT md.user_id, md.cluster_id, v AS mv, norm AS mn FROM md JOIN members m ON md.user_id = m.user_id AND md.face_id = m.face_id) SELECT m.user_id, m.cluster_id, round(min(list_inner_product(v, mv) / (norm * mn + 1e-9)), 6) AS cohesion FROM members m JOIN mv ON m.user_id = mv.user_id AND m.cluster_id = mv.cluster_id GROUP BY ALL")
def group_cohesion(spark, sf_dir):
    m = _members(spark, sf_dir)
    return audit.cohesion(m, audit.medoids(m)).select("user_id", "cluster_id", _r("cohesion"))


@query("SELECT x.user_id, x.cluster_id, x.face_index AS a, y.face_index AS b, round(max(list_inner_product(x.v, y.v) / (x.norm * y.norm + 1e-9)), 6) AS cross_max FROM members x JOIN members y ON x.user_id = y.user_id AND x.cluster_id = y.cluster_id AND x.face_index < y.face_index GROUP BY ALL")
def cross_group_max(spark, sf_dir):
    return audit.cross_maximum(_members(spark, sf_dir), "face_index").select("user_id", "cluster_id", "a", "b", _r("cross_max"))


@query("SELECT user_id, cluster_id, ordinal::INT AS ordinal, face_id, CASE WHEN ordinal <= 3 THEN 'quality' ELSE 'pose' END AS bucket FROM ex")
def exemplar_topk(spark, sf_dir):
    return fx.exemplars(fx.faces(spark, sf_dir)).select("user_id", "cluster_id", "ordinal", "face_id", "bucket")


QI = """WITH qi AS (SELECT vec_id AS face_id, 30.0::DOUBLE + vec_id % 150 AS h, (vec_id * 7 % 400)::DOUBLE AS blur, (((vec_id * 53) % 141) - 70) / 100.0::DOUBLE AS yaw, 0.10::DOUBLE + (vec_id % 30) / 100.0::DOUBLE AS ear FROM embeddings),
 qs AS (SELECT *, CASE WHEN h <= 40 THEN 0 WHEN h >= 150 THEN 1 ELSE (h - 40) / 110 END AS s, greatest(0, least(1, blur / 300)) AS b, greatest(0, least(1, 1 - abs(yaw) / 0.6::DOUBLE)) AS p, greatest(0, least(1, (ear - 0.15::DOUBLE) / (0.35::DOUBLE - 0.15::DOUBLE))) AS e FROM qi),
 qq AS (SELECT *, 0.35::DOUBLE * s + 0.35::DOUBLE * b + 0.2::DOUBLE * p + 0.1::DOUBLE * e AS q FROM qs) """


def _quality_inputs(spark, sf_dir):
    i = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        i.alias("face_id"), (F.lit(30.0) + i % 150).alias("h"), (i * 7 % 400).cast("double").alias("blur"), ((i * 53 % 141 - 70) / F.lit(100.0)).alias("yaw"), (F.lit(0.10) + (i % 30) / F.lit(100.0)).alias("ear")
    )


@query(QI + "SELECT face_id, round(s, 6) AS size_score, round(b, 6) AS blur_score, round(p, 6) AS pose_score, round(e, 6) AS eye_score, round(q, 6) AS quality FROM qq", base=False)
def quality_scores(spark, sf_dir):
    d = _quality_inputs(spark, sf_dir)
    h, b, y, e = map(F.col, ("h", "blur", "yaw", "ear"))
    named = {"size_score": q.size_score(h), "blur_score": q.blur_score(b), "pose_score": q.pose_score(y), "eye_score": q.eye_score(e), "quality": q.quality_score(h, b, y, e)}
    return d.select("face_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


@query(QI + "SELECT face_id, q < 0.3 OR h <= 40 OR abs(yaw) >= 0.6 AS hard_excluded, CASE WHEN q < 0.3 THEN 'quality' WHEN h <= 40 THEN 'size' WHEN abs(yaw) >= 0.6 THEN 'pose' END AS exclusion_kind, abs(yaw) >= 0.6 AND q >= 0.3 AND h > 40 AS restricted, CASE WHEN abs(yaw) >= 0.6 AND q >= 0.3 AND h > 40 THEN 'pose_floor_only' END AS restriction_reason, q >= 0.7 AND h > 40 AND abs(yaw) < 0.6 AS exemplar_eligible FROM qq", base=False)
def quality_gates(spark, sf_dir):
    d = _quality_inputs(spark, sf_dir)
    h, b, y, e = map(F.col, ("h", "blur", "yaw", "ear"))
    gates = q.gate_columns(h, y, q.quality_score(h, b, y, e))
    return d.select("face_id", *[c.alias(n) for n, c in gates.items() if n != "exclusion_reason"])


VIS = "CASE WHEN face_count >= 3 THEN 'main_grid' WHEN face_count = 2 THEN 'possible_person' ELSE 'hidden' END"


@query(f"SELECT user_id, {VIS} AS visibility, count(*) AS n FROM clusters GROUP BY ALL")
def visibility(spark, sf_dir):
    c = fx.clusters(fx.faces(spark, sf_dir))
    return c.groupBy("user_id", gallery.visibility(F.col("face_count")).alias("visibility")).agg(F.count("*").alias("n"))


@query(f"SELECT c.user_id, c.cluster_id, face_count, {VIS} AS visibility, x.face_id AS representative, x.face_id // 3 AS representative_photo FROM clusters c LEFT JOIN ex x ON c.user_id = x.user_id AND c.cluster_id = x.cluster_id AND x.ordinal = 1 WHERE face_count >= 2")
def people(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return gallery.people(fx.clusters(f), fx.exemplars(f), f)


@query("SELECT DISTINCT user_id, cluster_id, photo_id FROM faces WHERE cluster_id IS NOT NULL")
def person_photos(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    photos = f.groupBy("user_id", "photo_id").agg(F.min("face_id").alias("processed_at"))
    return gallery.person_photos(photos, f).select("user_id", "cluster_id", "photo_id")


@query("SELECT user_id, a AS cluster_a_id, b AS cluster_b_id FROM conflicts")
def photo_conflicts(spark, sf_dir):
    return audit.photo_conflicts(_members(spark, sf_dir))


@query("SELECT user_id, cluster_id, face_count, (face_count + 0)::INT AS actual FROM clusters")
def face_counts(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return integrity.member_counts(fx.clusters(f), f)


def _drifted(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return fx.clusters(f).withColumn("face_count", F.col("face_count") + (F.col("cluster_id") % 4 == 0).cast("int")), f


@query("SELECT 'count_drift' AS \"check\", user_id, cluster_id::VARCHAR AS entity_id, (face_count + 1)::VARCHAR || '/' || face_count::VARCHAR AS detail FROM clusters WHERE cluster_id % 4 = 0")
def integrity_counts(spark, sf_dir):
    return integrity.count_drift(*_drifted(spark, sf_dir))


@query("SELECT 'same_photo_duplicate' AS \"check\", user_id, cluster_id::VARCHAR AS entity_id, photo_id::VARCHAR || ':' || count(*)::VARCHAR AS detail FROM faces WHERE cluster_id IS NOT NULL GROUP BY user_id, cluster_id, photo_id HAVING count(*) > 1")
def integrity_photos(spark, sf_dir):
    return integrity.photo_duplicates(fx.faces(spark, sf_dir))


@query("SELECT 'state_cluster_mismatch' AS \"check\", user_id, face_id::VARCHAR AS entity_id, assignment_state AS detail FROM faces WHERE face_id % 11 = 0")
def integrity_states(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    swapped = F.when(F.col("face_id") % 11 == 0, F.when(F.col("cluster_id").isNull(), F.col("home"))).otherwise(F.col("cluster_id"))
    return integrity.state_mismatch(f.withColumn("cluster_id", swapped))


@query("SELECT 'invalid_exemplar' AS \"check\", x.user_id, x.face_id::VARCHAR AS entity_id, x.cluster_id::VARCHAR AS detail FROM ex x JOIN faces f USING (user_id, face_id) WHERE f.cluster_id IS NULL OR f.cluster_id <> x.cluster_id OR restricted")
def integrity_exemplars(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return integrity.invalid_exemplars(fx.exemplars(f), f)


@query("SELECT 'cluster_without_exemplar' AS \"check\", user_id, cluster_id::VARCHAR AS entity_id, '' AS detail FROM clusters ANTI JOIN ex USING (user_id, cluster_id)")
def integrity_bare(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return integrity.without_exemplar(fx.clusters(f), fx.exemplars(f))


@query("SELECT 'embedding_dimension' AS \"check\", user_id, face_id::VARCHAR AS entity_id, '63' AS detail FROM faces WHERE face_id % 13 = 0")
def integrity_dimension(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return integrity.wrong_dimension(f.withColumn("v", F.when(F.col("face_id") % 13 == 0, F.slice("v", 1, 63)).otherwise(F.col("v"))), 64)


@query("SELECT 'mixed_model_versions' AS \"check\", user_id, user_id::VARCHAR AS entity_id, count(DISTINCT 'm' || (face_id % 2))::VARCHAR AS detail FROM faces WHERE user_id <> 3 GROUP BY user_id HAVING count(DISTINCT face_id % 2) > 1")
def integrity_versions(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return integrity.mixed_versions(f.withColumn("embedding_model_version", F.when(F.col("user_id") == 3, F.lit("")).otherwise(F.concat(F.lit("m"), (F.col("face_id") % 2).cast("string")))))


@query("SELECT user_id, cluster_id FROM clusters WHERE face_count < 3 AND DATE '2024-02-15' - last_updated_at >= 30")
def prune(spark, sf_dir):
    return gallery.prunable(fx.clusters(fx.faces(spark, sf_dir)), F.lit("2024-02-15").cast("date")).select("user_id", "cluster_id")


@query("WITH l AS (SELECT user_id, count(*) % 60 AS n, max(ts) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, n AS photos_since_consolidation, CASE WHEN n >= 50 THEN 'photo_count' WHEN n > 0 AND now >= last + INTERVAL 24 HOUR THEN 'idle_timeout' END AS due_reason FROM l, m", base=False)
def lifecycle_due(spark, sf_dir):
    e = fx.photo_events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    state = e.groupBy("user_id").agg((F.count("*") % 60).alias("photos_since_consolidation"), F.max("ts").alias("last_photo_completed_at")).withColumn("count_due_since", F.lit(None).cast("timestamp"))
    return gallery.consolidation_due(state.crossJoin(F.broadcast(now)), F.col("now")).select("user_id", "photos_since_consolidation", "due_reason")  # now is one row


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS photos FROM g GROUP BY user_id, g", base=False)
def idle_sessions(spark, sf_dir):
    return gallery.idle_sessions(fx.photo_events(spark, sf_dir)).select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "photos")


@query("SELECT user_id, count(*) AS photos, count(*) // 50 AS triggers FROM events GROUP BY user_id", base=False)
def photo_counters(spark, sf_dir):
    return gallery.photo_counters(fx.photo_events(spark, sf_dir)).select("user_id", "photos", "triggers")


PAIRS = ", pr AS (SELECT a.user_id, a.cluster_id AS a, b.cluster_id AS b FROM clusters a JOIN clusters b ON a.user_id = b.user_id AND b.cluster_id = a.cluster_id + 1 AND a.cluster_id % 2 = 0) "
SURVIVOR = PAIRS + ", sv AS (SELECT p.user_id, p.a, p.b, CASE WHEN (NOT x.is_user_confirmed, -x.face_count, x.created_at, p.a) < (NOT y.is_user_confirmed, -y.face_count, y.created_at, p.b) THEN p.a ELSE p.b END AS survivor FROM pr p JOIN clusters x ON p.user_id = x.user_id AND p.a = x.cluster_id JOIN clusters y ON p.user_id = y.user_id AND p.b = y.cluster_id) "


def _pairs(clusters):
    return clusters.where("cluster_id % 2 = 0").select("user_id", F.col("cluster_id").alias("a")).join(clusters.select("user_id", F.col("cluster_id").alias("b"), (F.col("cluster_id") - 1).alias("a")), ["user_id", "a"])


@query(SURVIVOR + "SELECT * FROM sv")
def merge_survivor(spark, sf_dir):
    c = fx.clusters(fx.faces(spark, sf_dir))
    return gallery.merge_survivor(c, _pairs(c))


@query(SURVIVOR + ", z AS (SELECT user_id, CASE WHEN survivor = a THEN b ELSE a END AS loser, survivor FROM sv), f2 AS (SELECT f.user_id, f.face_id, coalesce(z.survivor, f.cluster_id) AS c FROM faces f LEFT JOIN z ON f.user_id = z.user_id AND f.cluster_id = z.loser) SELECT c.user_id, c.cluster_id, count(f2.face_id)::INT AS face_count, z.survivor AS merged_into FROM clusters c LEFT JOIN f2 ON c.user_id = f2.user_id AND c.cluster_id = f2.c LEFT JOIN z ON c.user_id = z.user_id AND c.cluster_id = z.loser GROUP BY ALL")
def merge_apply(spark, sf_dir):
    s = _state(spark, sf_dir)
    m = gallery.merge_survivor(s.clusters, _pairs(s.clusters)).select("user_id", F.when(F.col("survivor") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), "survivor")
    return mutations.merge(s, m).clusters.select("user_id", "cluster_id", "face_count", "merged_into")


@query(", m AS (SELECT user_id, a AS loser, a + 2 AS survivor FROM links WHERE a % 4 = 0), l AS (SELECT l.user_id, coalesce(m1.survivor, l.a) AS a, coalesce(m2.survivor, l.b) AS b FROM links l LEFT JOIN m m1 ON l.user_id = m1.user_id AND l.a = m1.loser LEFT JOIN m m2 ON l.user_id = m2.user_id AND l.b = m2.loser) SELECT DISTINCT user_id, least(a, b) AS cluster_a_id, greatest(a, b) AS cluster_b_id FROM l WHERE a <> b")
def cannot_link_inherit(spark, sf_dir):
    links = fx.cannot_links(fx.faces(spark, sf_dir))
    m = links.where("cluster_a_id % 4 = 0").select("user_id", F.col("cluster_a_id").alias("loser"), (F.col("cluster_a_id") + 2).alias("survivor"))
    return mutations.inherit_links(links, m)


def _ids(spark, sf_dir):
    links = fx.cannot_links(fx.faces(spark, sf_dir))
    return links.select("user_id", F.array(F.col("cluster_b_id").cast("string"), F.col("cluster_a_id").cast("string")).alias("cluster_ids"))


SUG = ", ids AS (SELECT user_id, list_sort([b::VARCHAR, a::VARCHAR]) AS ids FROM links), sg AS (SELECT user_id, 'merge_' || substr(sha1('[\"' || ids[1] || '\", \"' || ids[2] || '\"]'), 1, 12) AS suggestion_id, ids FROM ids) "


@query(SUG + "SELECT user_id, suggestion_id FROM sg")
def suggestion_ids(spark, sf_dir):
    return mutations.build_suggestions("merge", _ids(spark, sf_dir), F.lit("2024-01-01").cast("timestamp")).select("user_id", "suggestion_id")


@query(SUG + "SELECT user_id, suggestion_id FROM sg WHERE user_id >= 2")
def suggestion_insert_once(spark, sf_dir):
    s = mutations.build_suggestions("merge", _ids(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))
    return mutations.insert_once(s.where("user_id < 2"), s.unionByName(s), ["user_id", "suggestion_id"]).select("user_id", "suggestion_id")


@query(SUG + "SELECT user_id, suggestion_id, CASE WHEN list_contains(ids, '6') OR list_contains(ids, '1') THEN 'stale' ELSE 'pending' END AS status FROM sg")
def stale_suggestions(spark, sf_dir):
    s = mutations.build_suggestions("merge", _ids(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))
    touched = s.select("user_id", F.explode(F.array(F.lit("6"), F.lit("1"))).alias("cluster_id")).distinct()
    return mutations.invalidate(s, touched).select("user_id", "suggestion_id", "status")


@query(", g AS (SELECT user_id, cluster_id, list_sort(list(face_id) FILTER (face_index = 0)) AS ga, list_sort(list(face_id) FILTER (face_index > 0 AND NOT (face_id % 17 = 0))) AS gb, list_sort(list(face_id)) AS now, bool_or(is_manual) AS man FROM faces WHERE cluster_id IS NOT NULL AND NOT restricted GROUP BY ALL), mn AS (SELECT user_id, cluster_id, bool_or(is_manual) AS manual, list(face_id) FILTER (quality_score >= 0.7 AND NOT restricted) AS good FROM faces WHERE cluster_id IS NOT NULL GROUP BY ALL) SELECT user_id, cluster_id, CASE WHEN coalesce(len(ga), 0) < 2 OR coalesce(len(gb), 0) < 2 THEN 'each group needs two faces' WHEN list_sort(list_concat(ga, gb)) <> now THEN 'STALE: membership changed' WHEN manual THEN 'STALE: manual face' WHEN NOT coalesce(list_has_any(ga, good), false) OR NOT coalesce(list_has_any(gb, good), false) THEN 'each group needs an eligible face' END AS problem FROM g JOIN mn USING (user_id, cluster_id)")
def split_validate(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    plans = f.where("cluster_id is not null and not restricted").groupBy("user_id", "cluster_id").agg(
        F.collect_list(F.when(F.col("face_index") == 0, F.col("face_id"))).alias("group_a"), F.collect_list(F.when((F.col("face_index") > 0) & (F.col("face_id") % 17 != 0), F.col("face_id"))).alias("group_b")
    )
    return mutations.split_problems(f, plans).select("user_id", "cluster_id", "problem")


@query(", mv AS (SELECT user_id, face_id, photo_id, (home + 2) % 20 AS target FROM faces WHERE face_id % 6 = 0), st AS (SELECT user_id, photo_id, cluster_id FROM faces WHERE cluster_id IS NOT NULL AND face_id % 6 <> 0) SELECT DISTINCT mv.user_id, face_id, target FROM mv JOIN st ON mv.user_id = st.user_id AND mv.photo_id = st.photo_id AND mv.target = st.cluster_id")
def manual_move_guard(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return mutations.move_conflicts(f, f.where("face_id % 6 = 0").select("user_id", "face_id", ((F.col("home") + 2) % 20).alias("target")))


@query(", bare AS (SELECT user_id, cluster_id FROM clusters ANTI JOIN (SELECT DISTINCT user_id, cluster_id FROM faces WHERE cluster_id IS NOT NULL AND quality_score >= 0.7 AND NOT restricted) g USING (user_id, cluster_id)) SELECT user_id, face_id, CASE WHEN EXISTS (SELECT 1 FROM bare b WHERE b.user_id = f.user_id AND b.cluster_id = f.cluster_id) THEN 'unassigned' ELSE assignment_state END AS assignment_state FROM faces f")
def repair_empty(spark, sf_dir):
    return mutations.repair(_state(spark, sf_dir)).faces.select("user_id", "face_id", "assignment_state")


@query("SELECT user_id, 'clusters' AS \"table\", count(*) AS rows FROM clusters GROUP BY ALL UNION ALL SELECT user_id, 'faces', count(*) FROM faces GROUP BY ALL UNION ALL SELECT user_id, 'links', count(*) FROM links GROUP BY ALL")
def delete_user_counts(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    return mutations.user_counts({"faces": f, "clusters": fx.clusters(f), "links": fx.cannot_links(f)})


BOX = """WITH d AS (SELECT vec_id, vec_id // 3 AS photo_id, (vec_id * 13 % 200)::DOUBLE AS x1, (vec_id * 7 % 150)::DOUBLE AS y1, 40.0::DOUBLE + vec_id % 60 AS w, 50.0::DOUBLE + vec_id % 40 AS h FROM embeddings),
 b AS (SELECT *, x1 + w AS x2, y1 + h AS y2, x1 + w * 0.1::DOUBLE AS cx1, y1 + h * 0.05::DOUBLE AS cy1, x1 + w * 0.95::DOUBLE AS cx2, y1 + h * 1.02::DOUBLE AS cy2 FROM d),
 p AS (SELECT a.photo_id, a.vec_id AS det, c.vec_id AS cand, a.x1, a.y1, a.x2, a.y2, c.cx1, c.cy1, c.cx2, c.cy2, greatest(0, least(a.x2, c.cx2) - greatest(a.x1, c.cx1)) * greatest(0, least(a.y2, c.cy2) - greatest(a.y1, c.cy1)) AS i FROM b a JOIN b c USING (photo_id)),
 u AS (SELECT *, i / greatest((x2 - x1) * (y2 - y1) + (cx2 - cx1) * (cy2 - cy1) - i, 1) AS iou FROM p) """


def _boxes(spark, sf_dir):
    i = F.col("vec_id")
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(i, F.expr("vec_id div 3").alias("photo_id"), (i * 13 % 200).cast("double").alias("x1"), (i * 7 % 150).cast("double").alias("y1"), (F.lit(40.0) + i % 60).alias("w"), (F.lit(50.0) + i % 40).alias("h"))
    x, y, w, h = map(F.col, ("x1", "y1", "w", "h"))
    box = lambda a, b, c, e: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"))
    det = d.select("photo_id", i.alias("det"), box(x, y, x + w, y + h).alias("d"))
    cand = d.select("photo_id", i.alias("cand"), box(x + w * 0.1, y + h * 0.05, x + w * 0.95, y + h * 1.02).alias("c"))
    return det.join(cand, "photo_id")


@query(BOX + "SELECT photo_id, det, cand, round(iou, 6) AS iou FROM u", base=False)
def detection_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("photo_id", "det", "cand", F.round(geometry.iou(F.col("d"), F.col("c")), 6).alias("iou"))


@query(BOX + """, s AS (SELECT *, (cx1 + cx2) / 2 AS cx, (cy1 + cy2) / 2 AS cy FROM u) SELECT photo_id, det, cand, CASE WHEN cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2 THEN round(0.55::DOUBLE * iou + 0.25::DOUBLE * sqrt(least(x2 - x1, cx2 - cx1) / greatest(x2 - x1, cx2 - cx1) * (least(y2 - y1, cy2 - cy1) / greatest(y2 - y1, cy2 - cy1))) + 0.2::DOUBLE / (1 + sqrt(((cx - (x1 + x2) / 2) / (x2 - x1)) ** 2 + ((cy - (y1 + y2) / 2) / (y2 - y1)) ** 2)), 6) END AS score FROM s""", base=False)
def association_scores(spark, sf_dir):
    d, c = F.col("d"), F.col("c")
    nose = F.struct(((c["x1"] + c["x2"]) / 2).alias("x"), ((c["y1"] + c["y2"]) / 2).alias("y"))
    return _boxes(spark, sf_dir).select("photo_id", "det", "cand", F.round(geometry.association(d, c, nose, F.lit(True)), 6).alias("score"))


@query("SELECT user_id, face_id, '/' || user_id::VARCHAR || '/' || photo_id::VARCHAR AS path, (face_id % 3 <> 0) AS tenant_ok, (face_id % 2 = 0 OR face_id % 4 = 1) AS compatible FROM faces")
def request_predicates(spark, sf_dir):
    f = fx.faces(spark, sf_dir)
    tenant = F.when(F.col("face_id") % 3 == 0, F.lit("__legacy__")).otherwise(F.concat(F.lit(" t"), F.col("face_id").cast("string")))
    version = F.when(F.col("face_id") % 4 == 1, F.lit("")).when(F.col("face_id") % 2 == 1, F.lit("m2")).otherwise(F.lit("m1"))
    path = keys.normal_path(F.concat_ws("//", F.col("user_id").cast("string"), F.col("photo_id").cast("string")))
    return f.select("user_id", "face_id", path.alias("path"), keys.valid_tenant(tenant).alias("tenant_ok"), keys.compatible(version, F.lit("m1")).alias("compatible"))


def _keep(spark: SparkSession):
    """Writes a table under the shared folder, or the warehouse where none is named, and reads it again."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")

    def keep(df: DataFrame) -> DataFrame:
        at = f"{root.rstrip('/')}/kinlake-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return keep


@query()
def exemplar_fold(spark, sf_dir):
    from kinlake.operators.exemplars import fold_exemplars

    return fold_exemplars(fx.all_members(fx.faces(spark, sf_dir)), ["face_id"])


@query()
def hdbscan_labels(spark, sf_dir):
    from kinlake.operators.density import density_labels

    return density_labels(_members(spark, sf_dir), ["user_id", "cluster_id"])


@query()
def split_candidates(spark, sf_dir):
    from kinlake.operators.density import density_labels

    m = _members(spark, sf_dir)
    return audit.splits(m, density_labels(m, ["user_id", "cluster_id"]), _shields(spark, sf_dir), m.where("false").select("user_id", "cluster_id"))


@query()
def new_people(spark, sf_dir):
    return recovery.new_people(fx.faces(spark, sf_dir))


@query()
def incremental_replay(spark, sf_dir):
    from kinlake.streaming.incremental import replay

    return replay(fx.faces(spark, sf_dir))


@query()
def one_to_one_association(spark, sf_dir):
    from kinlake.operators.association import one_to_one

    d, c = F.col("d"), F.col("c")
    nose = F.struct(((c["x1"] + c["x2"]) / 2).alias("x"), ((c["y1"] + c["y2"]) / 2).alias("y"))
    scored = _boxes(spark, sf_dir).select("photo_id", F.col("det").alias("det_index"), F.col("cand").alias("cand_index"), geometry.association(d, c, nose, F.lit(True)).alias("score"), ((d["x2"] - d["x1"]) * (d["y2"] - d["y1"])).alias("area"))
    return one_to_one(scored.where("score is not null"))


@query()
def run_consolidation(spark, sf_dir):
    from kinlake.plans.consolidate import consolidate

    state = consolidate(_state(spark, sf_dir), _keep(spark)).state
    return state.faces.select("user_id", "face_id", "cluster_id", "assignment_state")


from kinlake.plans import control_queries  # noqa: E402, F401  registers its queries here
