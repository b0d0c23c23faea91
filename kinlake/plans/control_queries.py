"""Named queries over photos, suggestions, leases and corrections, and SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlake.functions import geometry, keys, quality
from kinlake.functions.vector import unit
from kinlake.operators import audit, control, gallery, mutations, scans
from kinlake.plans import queries as base
from kinlake.plans.queries import _r, _state, query
from kinlake.sources import fixtures as fx

PHOTOS = """, photos AS (SELECT DISTINCT user_id, photo_id, '/u' || user_id || '/p' || photo_id || '.jpg' AS image_path, CASE photo_id % 4 WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
  TIMESTAMP '2024-01-01' + to_seconds(photo_id) AS began FROM faces) """
SUGGESTED = """, sug AS (SELECT user_id, CASE WHEN a % 9 = 0 THEN 'merge_' ELSE 'merge_x' END || a AS suggestion_id, list_sort([a::VARCHAR, b::VARCHAR]) AS ids, a, b, CASE WHEN user_id % 3 = 2 THEN 'rejected' ELSE 'pending' END AS status FROM links) """
LIFE = """, life AS (SELECT user_id, count(DISTINCT photo_id)::INT AS n, TIMESTAMP '2024-01-01' + to_hours(user_id) AS h, user_id % 2 = 1 AS odd FROM faces WHERE user_id > 0 GROUP BY user_id) """
NOW = "2024-01-01 00:05:00"
LATER = "2024-01-02 02:00:00"


def _now(text: str = NOW):
    return F.lit(text).cast("timestamp")


def _faces(spark, sf_dir):
    return fx.faces(spark, sf_dir)


@query(PHOTOS + "SELECT user_id, photo_id, image_path, status AS processing_status FROM photos WHERE photo_id % 5 = 0")
def photo_rows(spark, sf_dir):
    p = fx.photos(_faces(spark, sf_dir))
    return scans.photos_by_id(p, p.where("photo_id % 5 = 0")).select("user_id", "photo_id", "image_path", "processing_status")


@query(PHOTOS + "SELECT user_id, photo_id, image_path FROM photos WHERE photo_id % 7 = 0")
def photo_by_path(spark, sf_dir):
    p = fx.photos(_faces(spark, sf_dir))
    asked = p.where("photo_id % 7 = 0").select("user_id", F.concat(F.lit("  "), F.regexp_replace("image_path", "/p", "//./x/../p"), F.lit(" ")).alias("image_path"))
    return scans.photos_by_path(p, asked).select("user_id", "photo_id", "image_path")


@query(PHOTOS + "SELECT user_id, photo_id FROM photos WHERE user_id IN (0, 2)")
def tenant_photos(spark, sf_dir):
    p = fx.photos(_faces(spark, sf_dir))
    return scans.all_photos(p, spark.createDataFrame([(0,), (2,), (2,), (99,)], "user_id long")).select("user_id", "photo_id")


@query("SELECT user_id, face_id, assignment_state FROM faces WHERE face_id % 4 = 0")
def face_rows(spark, sf_dir):
    f = _faces(spark, sf_dir)
    return scans.faces_by_id(f, f.where("face_id % 4 = 0")).select("user_id", "face_id", "assignment_state")


@query("SELECT user_id, cluster_id, face_id FROM faces WHERE cluster_id % 3 = 0")
def cluster_members(spark, sf_dir):
    f = _faces(spark, sf_dir)
    return scans.faces_by_cluster(f, f.where("cluster_id % 3 = 0").select("user_id", "cluster_id")).select("user_id", "cluster_id", "face_id")


@query("SELECT user_id, photo_id, face_index, face_id, row_number() OVER (PARTITION BY user_id, photo_id ORDER BY face_index, face_id)::INT AS place FROM faces WHERE photo_id % 2 = 0")
def photo_faces(spark, sf_dir):
    f = _faces(spark, sf_dir)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", "photo_id").orderBy("face_index", "face_id"))
    return scans.faces_by_photo(f, f.where("photo_id % 2 = 0")).select("user_id", "photo_id", "face_index", "face_id", place.alias("place"))


@query("SELECT user_id, face_id, assignment_state FROM faces WHERE (user_id = 0 AND assignment_state = 'manual') OR (user_id = 1 AND assignment_state = 'ambiguous')")
def state_faces(spark, sf_dir):
    asked = spark.createDataFrame([(0, "manual"), (1, "ambiguous")], "user_id long, assignment_state string")
    return scans.faces_by_state(_faces(spark, sf_dir), asked).select("user_id", "face_id", "assignment_state")


def _merged(spark, sf_dir):
    return fx.clusters(_faces(spark, sf_dir)).withColumn("merged_into", F.when(F.col("cluster_id") % 6 == 1, F.col("cluster_id") - 1))


@query("SELECT user_id, cluster_id, face_count, CASE WHEN cluster_id % 6 = 1 THEN cluster_id - 1 END AS merged_into FROM clusters WHERE cluster_id % 2 = 1")
def cluster_rows(spark, sf_dir):
    c = _merged(spark, sf_dir)
    return scans.clusters_by_id(c, c.where("cluster_id % 2 = 1")).select("user_id", "cluster_id", "face_count", "merged_into")


@query("SELECT user_id, cluster_id FROM clusters WHERE cluster_id % 6 <> 1")
def active_clusters(spark, sf_dir):
    return scans.all_clusters(_merged(spark, sf_dir)).select("user_id", "cluster_id")


@query(SUGGESTED + "SELECT user_id, suggestion_id, status FROM sug WHERE a % 2 = 0 AND user_id < 2")
def suggestion_rows(spark, sf_dir):
    s = fx.suggestions(_faces(spark, sf_dir))
    return scans.suggestions_by_id(s, s.where("user_id < 2")).select("user_id", "suggestion_id", "status")


@query(SUGGESTED + "SELECT user_id, suggestion_id, (row_number() OVER (PARTITION BY user_id ORDER BY a, suggestion_id))::INT AS place FROM sug WHERE status = 'pending'")
def pending_suggestions(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "suggestion_id"))
    return gallery.pending_suggestions(fx.suggestions(_faces(spark, sf_dir))).select("user_id", "suggestion_id", place.alias("place"))


@query(SUGGESTED + "SELECT user_id, suggestion_id FROM sug WHERE status = 'pending' AND regexp_full_match(suggestion_id, '(merge|split)_[0-9]+')")
def legacy_suggestions(spark, sf_dir):
    s = fx.suggestions(_faces(spark, sf_dir))
    return s.where((F.col("status") == "pending") & keys.legacy_suggestion(F.col("suggestion_id"))).select("user_id", "suggestion_id")


@query("SELECT user_id, face_id, face_id % 5 <> 0 AS has_box, CASE WHEN face_id % 5 <> 0 THEN face_id + 10.0::DOUBLE END AS x2 FROM faces")
def face_views(spark, sf_dir):
    i = F.col("face_id").cast("double")
    f = _faces(spark, sf_dir).select("user_id", "face_id", i.alias("bbox_x1"), i.alias("bbox_y1"), (i + 10).alias("bbox_x2"), F.when(F.col("face_id") % 5 != 0, i + 10).alias("bbox_y2"))
    return gallery.face_view(f).select("user_id", "face_id", F.col("bbox").isNotNull().alias("has_box"), F.col("bbox.bbox_x2").alias("x2"))


DUE = "CASE WHEN n >= 50 THEN 'photo_count' WHEN n > 0 AND TIMESTAMP '2024-01-02 02:00:00' >= h + INTERVAL 24 HOUR THEN 'idle_timeout' END"


@query(LIFE + f"SELECT user_id, n AS photos_since_consolidation, strftime(h, '%Y-%m-%dT%H:%M:%S') AS last_photo_completed_at, {DUE} IS NOT NULL AS consolidation_due, {DUE} AS due_reason, CASE {DUE} WHEN 'photo_count' THEN strftime(h, '%Y-%m-%dT%H:%M:%S') WHEN 'idle_timeout' THEN strftime(h + INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S') END AS due_since, odd AS consolidation_in_progress FROM life")
def lifecycle_views(spark, sf_dir):
    due = gallery.consolidation_due(fx.lifecycle(_faces(spark, sf_dir)), _now(LATER))
    return scans.lifecycle_view(due).drop("last_consolidated_at", "last_consolidation_error")


@query(LIFE + "SELECT user_id, n AS photos_since_consolidation, CASE WHEN odd THEN h WHEN n >= 50 THEN TIMESTAMP '2024-01-02 02:00:00' END AS count_due_since FROM life")
def count_due_marks(spark, sf_dir):
    out = gallery.mark_due(fx.lifecycle(_faces(spark, sf_dir)), _now(LATER))
    return out.select("user_id", "photos_since_consolidation", F.col("count_due_since").cast("timestamp_ntz").alias("count_due_since"))


@query("SELECT user_id, cluster_id, count(f.face_id) AS faces FROM (SELECT DISTINCT user_id, cluster_id + 1 AS cluster_id FROM clusters) LEFT JOIN faces f USING (user_id, cluster_id) GROUP BY ALL")
def cluster_face_counts(spark, sf_dir):
    f = _faces(spark, sf_dir)
    return scans.cluster_faces(f, fx.clusters(f).select("user_id", (F.col("cluster_id") + 1).alias("cluster_id")))


@query(PHOTOS + SUGGESTED + LIFE + """, t AS (SELECT unnest(range(5)) AS user_id), n AS (SELECT 'cannot_links' AS "table", user_id, count(*) AS c FROM links GROUP BY ALL UNION ALL SELECT 'clusters', user_id, count(*) FROM clusters GROUP BY ALL UNION ALL SELECT 'exemplars', user_id, count(*) FROM ex GROUP BY ALL
 UNION ALL SELECT 'faces', user_id, count(*) FROM faces GROUP BY ALL UNION ALL SELECT 'photos', user_id, count(*) FROM photos GROUP BY ALL UNION ALL SELECT 'suggestions', user_id, count(*) FROM sug GROUP BY ALL UNION ALL SELECT 'user_lifecycle', user_id, count(*) FROM life GROUP BY ALL)
 SELECT t.user_id::BIGINT AS user_id, k."table", coalesce(c, 0)::BIGINT AS rows FROM t CROSS JOIN (SELECT unnest(['cannot_links', 'clusters', 'exemplars', 'faces', 'photos', 'suggestions', 'user_lifecycle']) AS "table") k LEFT JOIN n ON n.user_id = t.user_id AND n."table" = k."table" """)
def tenant_table_counts(spark, sf_dir):
    f = _faces(spark, sf_dir)
    tables = {"photos": fx.photos(f), "faces": f, "clusters": fx.clusters(f), "exemplars": fx.exemplars(f), "suggestions": fx.suggestions(f), "cannot_links": fx.cannot_links(f), "user_lifecycle": fx.lifecycle(f)}
    return scans.table_counts(tables, spark.range(5).withColumnRenamed("id", "user_id"))


def _claims(spark, sf_dir):
    p = fx.photos(_faces(spark, sf_dir))
    i = F.col("photo_id")
    known = p.select("user_id", i, F.when(i % 11 == 0, F.lit("/other.jpg")).otherwise(F.col("image_path")).alias("image_path"), F.concat(F.lit("n"), i.cast("string")).alias("token"))
    new = p.where(i % 13 == 0).select("user_id", (i + 1_000_000).alias("photo_id"), F.when(i % 2 == 0, F.concat(F.lit("/new"), i.cast("string"))).otherwise(F.col("image_path")).alias("image_path"), F.lit("n").alias("token"))
    return p, control.claim_photos(p, known.unionByName(new), _now())


CLAIMS = PHOTOS + """, asked AS (SELECT user_id, photo_id, CASE WHEN photo_id % 11 = 0 THEN 'the photo has another path' END AS problem, CASE WHEN photo_id % 11 = 0 THEN NULL WHEN status = 'completed' THEN 'completed' WHEN status = 'processing' AND greatest(0, epoch(TIMESTAMP '2024-01-01 00:05:00' - began)) < 300 THEN 'in_progress' ELSE 'claimed' END AS st,
  greatest(1, floor(300 - greatest(0, epoch(TIMESTAMP '2024-01-01 00:05:00' - began)) + 0.999))::INT AS wait FROM photos
 UNION ALL SELECT user_id, photo_id + 1000000, CASE WHEN photo_id % 2 = 1 THEN 'the path has another photo' END, CASE WHEN photo_id % 2 = 0 THEN 'claimed' END, NULL FROM photos WHERE photo_id % 13 = 0) """


@query(CLAIMS + "SELECT user_id, photo_id, st AS status, CASE WHEN st = 'in_progress' THEN wait END AS retry_after_s, problem FROM asked")
def photo_claims(spark, sf_dir):
    _, c = _claims(spark, sf_dir)
    told = F.when(F.col("problem").contains("different image path"), "the photo has another path").when(F.col("problem").contains("already bound to photo_id"), "the path has another photo")
    return c.select("user_id", "photo_id", "status", "retry_after_s", told.alias("problem"))


@query(CLAIMS + ", won AS (SELECT user_id, photo_id FROM asked WHERE st = 'claimed') SELECT coalesce(p.user_id, w.user_id) AS user_id, coalesce(p.photo_id, w.photo_id) AS photo_id, CASE WHEN w.photo_id IS NOT NULL THEN 'processing' ELSE p.status END AS processing_status, CASE WHEN w.photo_id IS NOT NULL THEN 'n' || CASE WHEN w.photo_id < 1000000 THEN w.photo_id::VARCHAR ELSE '' END WHEN p.status <> 'failed' THEN 't' || p.photo_id END AS processing_token, (CASE WHEN p.photo_id IS NULL THEN 0 ELSE 1 END + CASE WHEN w.photo_id IS NULL THEN 0 ELSE 1 END)::INT AS processing_attempts FROM photos p FULL JOIN won w ON p.user_id = w.user_id AND p.photo_id = w.photo_id")
def photo_claims_applied(spark, sf_dir):
    p, c = _claims(spark, sf_dir)
    return control.apply_claims(p, c, _now(), "m2", "c2").select("user_id", "photo_id", "processing_status", "processing_token", "processing_attempts")


def _tokens(p, wrong: int = 5):
    i = F.col("photo_id")
    return p.select("user_id", "photo_id", F.concat(F.when(i % wrong == 0, "x").otherwise("t"), i.cast("string")).alias("token"), F.repeat(F.lit("ab"), 300).alias("message"))


@query(PHOTOS + LIFE + ", w AS (SELECT user_id, count(*) AS k FROM photos WHERE status = 'completed' AND photo_id % 5 <> 0 GROUP BY user_id) SELECT user_id, (coalesce(n, 0) + coalesce(k, 0))::INT AS photos_since_consolidation, CASE WHEN k > 0 THEN TIMESTAMP '2024-01-01 00:05:00' ELSE h END AS last_photo_completed_at FROM life FULL JOIN w USING (user_id)")
def photo_completions(spark, sf_dir):
    f = _faces(spark, sf_dir)
    p = fx.photos(f)
    _, life, _ = control.complete_photos(p, fx.lifecycle(f), _tokens(p), _now())
    return life.select("user_id", "photos_since_consolidation", F.col("last_photo_completed_at").cast("timestamp_ntz").alias("last_photo_completed_at"))


@query(PHOTOS + "SELECT user_id, photo_id, CASE WHEN status = 'processing' AND photo_id % 5 <> 0 THEN 'failed' ELSE status END AS processing_status, CASE WHEN status = 'processing' AND photo_id % 5 <> 0 THEN 500 WHEN status = 'failed' THEN 7 END AS error_chars FROM photos")
def photo_failures(spark, sf_dir):
    p = fx.photos(_faces(spark, sf_dir))
    out, _ = control.fail_photos(p, _tokens(p), _now())
    return out.select("user_id", "photo_id", "processing_status", F.length("error_message").alias("error_chars"))


def _consolidation_claims(spark, sf_dir):
    life = fx.lifecycle(_faces(spark, sf_dir))
    asked = spark.range(4).select(F.col("id").alias("user_id"), (F.col("id") == 3).alias("force"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("token"))
    return life, control.claim_consolidation(life, asked, _now("2024-01-01 03:10:00"))


CONSOLIDATION = LIFE + """, all_ AS (SELECT u::BIGINT AS user_id, coalesce(n, 0) AS n, h, coalesce(odd, false) AS odd FROM range(4) t(u) LEFT JOIN life ON life.user_id = u),
 cl AS (SELECT *, CASE WHEN user_id <> 3 AND NOT (n >= 50) THEN 'not_due' WHEN odd AND greatest(0, epoch(TIMESTAMP '2024-01-01 03:10:00' - h)) < 1800 THEN 'in_progress' ELSE 'claimed' END AS st FROM all_) """


@query(CONSOLIDATION + "SELECT user_id, st AS status, CASE WHEN st = 'in_progress' THEN greatest(1, floor(1800 - greatest(0, epoch(TIMESTAMP '2024-01-01 03:10:00' - h)) + 0.999))::INT END AS retry_after_s FROM cl")
def consolidation_claims(spark, sf_dir):
    _, c = _consolidation_claims(spark, sf_dir)
    return c.select("user_id", "status", "retry_after_s")


@query(CONSOLIDATION + "SELECT user_id, CASE WHEN st = 'claimed' THEN 'k' || user_id WHEN odd THEN 'c' || user_id END AS consolidation_token, (odd::INT + (st = 'claimed')::INT)::INT AS consolidation_attempts, CASE WHEN st <> 'claimed' THEN 'old' END AS last_consolidation_error FROM cl WHERE user_id > 0 OR st = 'claimed'")
def consolidation_claims_applied(spark, sf_dir):
    life, c = _consolidation_claims(spark, sf_dir)
    return control.apply_consolidation_claims(life, c, _now()).select("user_id", "consolidation_token", "consolidation_attempts", "last_consolidation_error")


@query(LIFE + "SELECT user_id, CASE WHEN user_id = 1 THEN 0 ELSE n END AS photos_since_consolidation, CASE WHEN odd AND user_id <> 1 THEN 'c' || user_id END AS consolidation_token, CASE WHEN user_id <> 1 THEN 'old' END AS last_consolidation_error FROM life")
def consolidation_completions(spark, sf_dir):
    asked = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "lost")], "user_id long, token string")
    return control.complete_consolidation(fx.lifecycle(_faces(spark, sf_dir)), asked, _now()).select("user_id", "photos_since_consolidation", "consolidation_token", "last_consolidation_error")


@query(LIFE + "SELECT user_id, CASE WHEN odd AND user_id <> 1 THEN 'c' || user_id END AS consolidation_token, CASE WHEN user_id = 1 THEN 'boom' ELSE 'old' END AS last_consolidation_error FROM life")
def consolidation_failures(spark, sf_dir):
    asked = spark.createDataFrame([(1, "c1", "boom"), (2, "c2", "no"), (3, "lost", "no")], "user_id long, token string, message string")
    return control.fail_consolidation(fx.lifecycle(_faces(spark, sf_dir)), asked, _now()).select("user_id", "consolidation_token", "last_consolidation_error")


@query(", asked AS (SELECT user_id, cluster_id AS x, CASE WHEN cluster_id % 5 = 0 THEN cluster_id WHEN cluster_id % 7 = 0 THEN cluster_id + 1000 ELSE cluster_id - 1 END AS y FROM clusters WHERE cluster_id > 0), ok AS (SELECT DISTINCT user_id, least(x, y) AS a, greatest(x, y) AS b FROM asked q WHERE x <> y AND EXISTS (SELECT 1 FROM clusters c WHERE c.user_id = q.user_id AND c.cluster_id = q.y)) SELECT user_id, a AS cluster_a_id, b AS cluster_b_id, CASE WHEN k.user_id IS NULL THEN 'old' ELSE 'new' END AS reason FROM links l FULL JOIN (SELECT user_id, a, b, true AS t FROM ok) k USING (user_id, a, b)".replace("CASE WHEN k.user_id IS NULL", "CASE WHEN t IS NULL"))
def cannot_link_upsert(spark, sf_dir):
    f = _faces(spark, sf_dir)
    i, c = F.col("cluster_id"), fx.clusters(f)
    asked = c.where("cluster_id > 0").select("user_id", i.alias("a"), F.when(i % 5 == 0, i).when(i % 7 == 0, i + 1000).otherwise(i - 1).alias("b"), F.lit("new").alias("reason"))
    links = fx.cannot_links(f).withColumns({"reason": F.lit("old"), "created_at": _now()})
    return control.add_cannot_links(links, c, asked, _now(LATER))[0].select("user_id", "cluster_a_id", "cluster_b_id", "reason")


@query(", gone AS (SELECT user_id, cluster_id FROM clusters WHERE face_count < 3 AND DATE '2024-02-15' - last_updated_at >= 30) SELECT user_id, face_id FROM faces f ANTI JOIN gone g ON f.user_id = g.user_id AND f.cluster_id = g.cluster_id")
def prune_applied(spark, sf_dir):
    state, _ = control.prune(_state(spark, sf_dir), F.lit("2024-02-15").cast("date"))
    return state.faces.select("user_id", "face_id")


MOVES = """, asked AS (SELECT user_id, face_id, photo_id, cluster_id, (home + 2) % 20 AS target FROM faces WHERE face_id % 30 = 3),
 still AS (SELECT user_id, photo_id, cluster_id FROM faces WHERE cluster_id IS NOT NULL AND face_id % 30 <> 3),
 bad AS (SELECT user_id, target FROM asked a WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE c.user_id = a.user_id AND c.cluster_id = a.target) OR a.cluster_id IS NULL OR EXISTS (SELECT 1 FROM still s WHERE s.user_id = a.user_id AND s.photo_id = a.photo_id AND s.cluster_id = a.target) UNION SELECT user_id, target FROM asked GROUP BY user_id, target, photo_id HAVING count(*) > 1),
 ok AS (SELECT * FROM asked ANTI JOIN bad USING (user_id, target)) """


def _moves(spark, sf_dir):
    s = _state(spark, sf_dir)
    return s, s.faces.where("face_id % 30 = 3").select("user_id", "face_id", ((F.col("home") + 2) % 20).alias("target"))


@query(MOVES + "SELECT user_id, target, count(*) AS moved FROM ok GROUP BY ALL")
def manual_moves(spark, sf_dir):
    s, m = _moves(spark, sf_dir)
    return control.move_faces(s, m, _now())[1]


@query(MOVES + ", now_ AS (SELECT f.user_id, f.face_id, coalesce(o.target, f.cluster_id) AS c, f.quality_score >= 0.7 AND NOT f.restricted AS good, o.target IS NOT NULL AS moved FROM faces f LEFT JOIN ok o USING (user_id, face_id)), touched AS (SELECT user_id, cluster_id AS c FROM ok UNION SELECT user_id, target FROM ok), bare AS (SELECT user_id, cluster_id AS c FROM clusters ANTI JOIN (SELECT DISTINCT user_id, c FROM now_ WHERE good) g ON clusters.user_id = g.user_id AND clusters.cluster_id = g.c), lost AS (SELECT b.user_id, b.c FROM bare b ANTI JOIN touched t ON b.user_id = t.user_id AND b.c = t.c) SELECT n.user_id, n.face_id, CASE WHEN l.c IS NULL THEN n.c END AS cluster_id, n.moved FROM now_ n LEFT JOIN lost l ON n.user_id = l.user_id AND n.c = l.c")
def manual_moves_applied(spark, sf_dir):
    s, m = _moves(spark, sf_dir)
    state, _ = control.move_faces(s, m, _now())
    before = s.faces.select("user_id", "face_id", F.col("cluster_id").alias("was"), F.col("is_manual").alias("by_hand"))
    met = state.faces.join(before, ["user_id", "face_id"])
    return met.select("user_id", "face_id", "cluster_id", (F.coalesce("cluster_id", F.lit(-1)) != F.coalesce("was", F.lit(-1))).alias("other"), "is_manual", "by_hand").select("user_id", "face_id", "cluster_id", (F.col("other") & F.col("is_manual") & F.col("cluster_id").isNotNull()).alias("moved"))


@query(", n AS (SELECT user_id, photo_id, home AS source, count(*) FILTER (cluster_id IS NOT NULL) AS n, min(face_id) FILTER (cluster_id IS NOT NULL) AS face_id FROM faces WHERE photo_id % 3 = 0 GROUP BY ALL) SELECT user_id, photo_id, source, n, face_id FROM n")
def photo_move_faces(spark, sf_dir):
    f = _faces(spark, sf_dir)
    asked = f.where("photo_id % 3 = 0").select("user_id", "photo_id", F.col("home").alias("source"), F.lit(1).alias("target")).distinct()
    return mutations.photo_moves(f, asked).select("user_id", "photo_id", "source", "n", "face_id")


ANSWERS = SUGGESTED + """, ans AS (SELECT *, CASE a % 4 WHEN 0 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'uncertain' END AS answer FROM sug),
 out_ AS (SELECT user_id, suggestion_id, answer, (SELECT count(*) FROM clusters c WHERE c.user_id = ans.user_id AND c.cluster_id IN (a, b)) < 2 AS gone, status <> 'pending' AS done FROM ans) """


def _answers(spark, sf_dir):
    s = _state(spark, sf_dir)
    sug = fx.suggestions(s.faces)
    a = F.regexp_extract("suggestion_id", "([0-9]+)$", 1).cast("long")
    return sug, s, sug.select("user_id", "suggestion_id", F.when(a % 4 == 0, "accepted").when(a % 4 == 2, "rejected").otherwise("uncertain").alias("answer"))


@query(ANSWERS + "SELECT user_id, suggestion_id, CASE WHEN done THEN 'No pending suggestion' WHEN answer = 'accepted' AND NOT gone THEN 'STALE: cannot-link' END AS problem, CASE WHEN NOT done AND answer = 'rejected' THEN 'cannot_link' ELSE 'none' END AS action, CASE WHEN done THEN NULL WHEN answer <> 'accepted' THEN answer WHEN gone THEN 'stale' END AS new_status FROM out_")
def suggestion_resolutions(spark, sf_dir):
    sug, s, asked = _answers(spark, sf_dir)
    return control.resolutions(sug, s, asked, _now()).select("user_id", "suggestion_id", "problem", "action", "new_status")


FREE = ", free AS (SELECT user_id, cluster_id AS a, cluster_id + 1 AS b FROM clusters c WHERE cluster_id % 2 = 0 AND EXISTS (SELECT 1 FROM clusters d WHERE d.user_id = c.user_id AND d.cluster_id = c.cluster_id + 1)) "


@query(FREE + """, m AS (SELECT DISTINCT x.user_id, x.cluster_id AS a, y.cluster_id AS b FROM faces x JOIN faces y ON x.user_id = y.user_id AND x.photo_id = y.photo_id AND x.face_id <> y.face_id WHERE x.cluster_id < y.cluster_id)
 SELECT f.user_id, f.a AS source, f.b AS target, CASE WHEN l.a IS NOT NULL THEN 'STALE: cannot-link' ELSE 'STALE: same photo' END AS problem FROM free f LEFT JOIN links l ON f.user_id = l.user_id AND f.a = l.a AND f.b = l.b LEFT JOIN m ON f.user_id = m.user_id AND f.a = m.a AND f.b = m.b WHERE l.a IS NOT NULL OR m.a IS NOT NULL""")
def merge_guards(spark, sf_dir):
    s = _state(spark, sf_dir)
    return mutations.merge_conflicts(s, base._pairs(s.clusters).select("user_id", F.col("a").alias("source"), F.col("b").alias("target")))


@query("SELECT DISTINCT user_id, 'merge_' || substr(sha1('{\"cluster_ids\": [\"' || list_sort([a::VARCHAR, b::VARCHAR])[1] || '\", \"' || list_sort([a::VARCHAR, b::VARCHAR])[2] || '\"]}'), 1, 12) AS suggestion_id, '{\"cluster_ids\": [\"' || list_sort([a::VARCHAR, b::VARCHAR])[1] || '\", \"' || list_sort([a::VARCHAR, b::VARCHAR])[2] || '\"]}' AS payload FROM links")
def merge_suggestion_payloads(spark, sf_dir):
    pairs = fx.cannot_links(_faces(spark, sf_dir)).select("user_id", F.col("cluster_a_id").cast("string").alias("a"), F.col("cluster_b_id").cast("string").alias("b"), F.lit(0.9).alias("coverage_ab"), F.lit(1.0).alias("coverage_ba"), F.lit(5).alias("total_members"))
    return mutations.merge_suggestions(pairs, _now()).select("user_id", "suggestion_id", "payload")


@query(", g AS (SELECT user_id, home, face_index AS label, count(*) AS n FROM members m JOIN faces USING (user_id, face_id) GROUP BY ALL) SELECT user_id, home AS cluster_id, label, round(n / sum(n) OVER (PARTITION BY user_id, home), 6) AS fraction FROM g".replace("members m JOIN faces USING (user_id, face_id)", "faces WHERE NOT restricted"))
def split_fractions(spark, sf_dir):
    m = base._members(spark, sf_dir)
    return audit.split_fractions(m.select("user_id", "cluster_id", "face_id", F.col("face_index").alias("label"))).select("user_id", "cluster_id", "label", _r("fraction"))


@query("SELECT user_id, assignment_state, count(*) AS faces FROM faces WHERE assignment_state IN ('ambiguous', 'unassigned') AND NOT restricted GROUP BY ALL")
def evaluated_states(spark, sf_dir):
    from kinlake.operators import recovery

    return audit.state_counts(recovery.deferred(_faces(spark, sf_dir)))


EYES = "WITH p AS (SELECT vec_id AS face_id, embedding::DOUBLE[] AS e FROM embeddings) "


def _points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("face_id"), F.col("embedding").cast("array<double>").alias("e"))
    ring = lambda at: F.array(*(F.struct(F.col("e")[at + 2 * k].alias("x"), F.col("e")[at + 2 * k + 1].alias("y")) for k in range(6)))
    return e.withColumn("left", ring(0)).withColumn("right", ring(12))


def _ear(at: int) -> str:
    far = lambda i, j: f"sqrt((e[{at + 2 * i + 1}] - e[{at + 2 * j + 1}]) ** 2 + (e[{at + 2 * i + 2}] - e[{at + 2 * j + 2}]) ** 2)"
    return f"(({far(1, 5)} + {far(2, 4)}) / (2 * ({far(0, 3)} + 1e-6)))"


@query(EYES + f"SELECT face_id, round({_ear(0)}, 6) AS left_ear, round(greatest(0, least(1, (({_ear(0)} + {_ear(12)}) / 2 - 0.15::DOUBLE) / (0.35::DOUBLE - 0.15::DOUBLE))), 6) AS openness FROM p", base=False)
def eye_openness(spark, sf_dir):
    d = _points(spark, sf_dir)
    return d.select("face_id", F.round(quality.eye_aspect(F.col("left")), 6).alias("left_ear"), F.round(quality.eye_openness(F.col("left"), F.col("right")), 6).alias("openness"))


@query(EYES + "SELECT face_id, round((e[5] - (e[1] + e[3]) / 2) / (sqrt((e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2) + 1e-6), 6) AS yaw, round((e[6] - (e[2] + e[4]) / 2) / (sqrt((e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2) + 1e-6), 6) AS pitch FROM p", base=False)
def turn_ratios(spark, sf_dir):
    d = _points(spark, sf_dir)
    yaw, pitch = quality.turn_ratios(F.col("left")[0], F.col("left")[1], F.col("left")[2])
    return d.select("face_id", F.round(yaw, 6).alias("yaw"), F.round(pitch, 6).alias("pitch"))


@query(EYES + "SELECT face_id, round(list_max(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 6) AS top FROM p", base=False)
def unit_vectors(spark, sf_dir):
    return _points(spark, sf_dir).select("face_id", F.round(F.array_max(unit(F.col("e"))), 6).alias("top"))


@query("WITH b AS (SELECT vec_id AS face_id, vec_id % 400 AS x, vec_id * 7 % 300 AS y, 30 + vec_id % 90 AS w, 40 + vec_id % 70 AS h FROM embeddings) SELECT face_id, greatest(0, x - (w * 0.3::DOUBLE)::INT) AS x1, greatest(0, y - floor(h * 0.3::DOUBLE)::INT) AS y1, least(420, x + w + floor(w * 0.3::DOUBLE)::INT) AS x2, least(330, y + h + floor(h * 0.3::DOUBLE)::INT) AS y2 FROM b".replace("(w * 0.3::DOUBLE)::INT", "floor(w * 0.3::DOUBLE)::INT", 1), base=False)
def crops(spark, sf_dir):
    i = F.col("vec_id")
    box = F.struct((i % 400).alias("x"), (i * 7 % 300).alias("y"), (30 + i % 90).alias("width"), (40 + i % 70).alias("height"))
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(i.alias("face_id"), geometry.crop(box, F.lit(420).cast("long"), F.lit(330).cast("long")).alias("c"))
    return d.select("face_id", "c.x1", "c.y1", "c.x2", "c.y2")


@query(EYES + ", q AS (SELECT face_id, list_transform(range(6), lambda k: e[2 * k + 1]) AS xs, list_transform(range(6), lambda k: e[2 * k + 2]) AS ys FROM p) SELECT face_id, round(list_min(xs), 6) AS x1, round(list_max(ys), 6) AS y2, round((list_min(xs) + list_max(xs)) / 2, 6) AS cx, round(sqrt(greatest(list_max(xs) - list_min(xs), 1) ** 2 + greatest(list_max(ys) - list_min(ys), 1) ** 2), 6) AS diagonal FROM q", base=False)
def landmark_extents(spark, sf_dir):
    d = _points(spark, sf_dir).select("face_id", geometry.extent(F.col("left")).alias("g"))
    return d.select("face_id", F.round("g.x1", 6).alias("x1"), F.round("g.y2", 6).alias("y2"), F.round("g.cx", 6).alias("cx"), F.round("g.diagonal", 6).alias("diagonal"))


@query(EYES + ", m AS (SELECT face_id, list_transform(range(6), lambda k: sqrt((e[2 * k + 1] - e[2 * k + 13]) ** 2 + (e[2 * k + 2] - e[2 * k + 14]) ** 2)) AS d, list_transform(range(6), lambda k: e[2 * k + 1]) AS xa, list_transform(range(6), lambda k: e[2 * k + 2]) AS ya, list_transform(range(6), lambda k: e[2 * k + 13]) AS xb, list_transform(range(6), lambda k: e[2 * k + 14]) AS yb FROM p) SELECT face_id, round(list_median(d) / greatest(least(sqrt(greatest(list_max(xa) - list_min(xa), 1) ** 2 + greatest(list_max(ya) - list_min(ya), 1) ** 2), sqrt(greatest(list_max(xb) - list_min(xb), 1) ** 2 + greatest(list_max(yb) - list_min(yb), 1) ** 2)), 1), 6) AS ratio FROM m", base=False)
def mesh_ratios(spark, sf_dir):
    return _points(spark, sf_dir).select("face_id", F.round(geometry.mesh_ratio(F.col("left"), F.col("right")), 6).alias("ratio"))


@query("SELECT user_id, face_id, least(home, face_id) AS a, greatest(home, face_id) AS b, length(repeat('é', (face_id % 700)::INT)[1:500]) AS chars, greatest(1, floor(300 - face_id % 400 + 0.999))::INT AS wait FROM faces WHERE home <> face_id")
def request_functions(spark, sf_dir):
    f = _faces(spark, sf_dir).where("home <> face_id")
    a, b = keys.pair(F.col("home"), F.col("face_id"))
    text = keys.error_text(F.expr("repeat('é', cast(face_id % 700 as int))"))
    return f.select("user_id", "face_id", a.cast("long").alias("a"), b.alias("b"), F.length(text).alias("chars"), keys.retry_after(300, (F.col("face_id") % 400).cast("double")).alias("wait"))


STATUS = "CASE face_id % 8 WHEN 0 THEN 409 WHEN 1 THEN 503 WHEN 2 THEN 422 WHEN 3 THEN 404 WHEN 4 THEN 409 WHEN 5 THEN 400 WHEN 6 THEN 409 END"


@query(f"SELECT user_id, face_id, {STATUS} AS status FROM faces")
def error_statuses(spark, sf_dir):
    kinds = ["in_progress", "storage", "file_not_found", "value", "value", "value", "lease_lost", "other"]
    texts = ["busy", "database is LOCKED", "gone", "Unknown face", "x is already bound to y", "bad", "lost", "?"]
    i = (F.col("face_id") % 8 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), i)
    return _faces(spark, sf_dir).select("user_id", "face_id", keys.error_status(pick(kinds), pick(texts)).alias("status"))


@query("SELECT user_id, list_sort(list_distinct(list(cluster_id))) AS touched, list_sort(list_filter(list_distinct(list(cluster_id)), lambda x: x <> 0)) AS sources FROM faces WHERE cluster_id IS NOT NULL AND home < 4 GROUP BY user_id".replace("list_sort(list_distinct(list(cluster_id))) AS touched", "list_sort(list_distinct(list_append(list(cluster_id), 0))) AS touched"))
def touched_clusters(spark, sf_dir):
    g = _faces(spark, sf_dir).where("cluster_id is not null and home < 4").groupBy("user_id").agg(F.collect_list("cluster_id").alias("ids"))
    both, sources = scans.touched(scans.once(F.col("ids")), F.lit(0).cast("long"))
    return g.select("user_id", both.alias("touched"), sources.alias("sources"))
