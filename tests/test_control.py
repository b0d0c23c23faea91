"""Reads, leases, corrections and suggestions on rows made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake.config import DEFAULT
from kinlake.functions import keys
from kinlake.operators import control, mutations, scans
from kinlake.plans import consolidate
from kinlake.sources import codec
from tests.test_consolidation import state_of

PHOTO = "user_id long, photo_id long, image_path string, image_width int, image_height int, processing_status string, processed_at timestamp, embedding_model_version string, config_version string, error_message string, processing_started_at timestamp, processing_token string, processing_attempts int"
keep = lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)


def now():
    return F.lit("2024-01-01 00:05:00").cast("timestamp")


def photos(spark):
    rows = [
        (1, 1, "/a", "completed", None, "t1"), (1, 2, "/b", "processing", "2024-01-01 00:04:00", "t2"), (1, 3, "/c", "processing", "2023-12-31 00:00:00", "t3"), (1, 4, "/d", "failed", None, None), (2, 1, "/a", "processing", None, "x"),
    ]
    full = [(u, p, path, 1, 1, s, None, "m", "c", "old" if s == "failed" else None, None, t, 1) for u, p, path, s, _, t in rows]
    began = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "user_id long, photo_id long, b string")
    return spark.createDataFrame(full, PHOTO).join(began, ["user_id", "photo_id"]).withColumn("processing_started_at", F.col("b").cast("timestamp")).drop("b")


def test_photo_leases(spark):
    p = photos(spark)
    asked = spark.createDataFrame([(1, 1, " /a "), (1, 2, "/x/../b"), (1, 3, "/c"), (1, 4, "/other"), (1, 9, "/a"), (1, 8, "new/./file"), (2, 1, "/a"), (1, 7, "s3://bucket//k")], "user_id long, photo_id long, image_path string").withColumn("token", F.lit("n"))
    claims = keep(control.claim_photos(p, asked, now()))
    got = {(r["user_id"], r["photo_id"]): r for r in claims.collect()}
    assert {k: r["status"] for k, r in got.items()} == {(1, 1): "completed", (1, 2): "in_progress", (1, 3): "claimed", (1, 4): None, (1, 9): None, (1, 8): "claimed", (2, 1): "claimed", (1, 7): "claimed"}
    assert got[1, 2]["retry_after_s"] == 240 and "different image path" in got[1, 4]["problem"] and "photo_id '1'" in got[1, 9]["problem"]
    assert got[1, 8]["image_path"] == "/new/file" and got[1, 7]["image_path"] == "s3://bucket//k"
    after = keep(control.apply_claims(p, claims, now(), "m2", "c2"))
    state = {(r["user_id"], r["photo_id"]): r for r in after.collect()}
    assert len(state) == 7 and state[1, 3]["processing_attempts"] == 2 and state[1, 3]["processing_token"] == "n" and state[1, 8]["image_width"] == 0
    assert state[1, 2]["processing_token"] == "t2" and state[1, 4]["error_message"] == "old"
    worker = spark.createDataFrame([(1, 3, "n", "m" * 600), (1, 2, "lost", "x"), (5, 5, "n", "x")], "user_id long, photo_id long, token string, message string")
    assert {r["photo_id"]: r["holds"] for r in control.holds_photo(after, worker).collect()} == {3: True, 2: False, 5: False}
    failed, _ = control.fail_photos(after, worker, now())
    assert {r["photo_id"]: (r["processing_status"], len(r["error_message"] or "")) for r in failed.where("user_id = 1").collect()} == {1: ("completed", 0), 2: ("processing", 0), 3: ("failed", 500), 4: ("failed", 3), 7: ("processing", 0), 8: ("processing", 0)}


LIFE = "user_id long, photos_since_consolidation int, last_photo_completed_at timestamp, last_consolidated_at timestamp, count_due_since timestamp, consolidation_started_at timestamp, consolidation_token string, consolidation_attempts int, last_consolidation_error string, last_consolidation_error_at timestamp"


def test_completions_count_once_for_each_tenant(spark):
    life = spark.createDataFrame([], LIFE)
    p = photos(spark)
    done = spark.createDataFrame([(1, 1, "t1"), (1, 1, "t1"), (1, 4, "zz")], "user_id long, photo_id long, token string")
    after, counted, seen = control.complete_photos(p, life, done, now())
    assert [(r["user_id"], r["photos_since_consolidation"]) for r in counted.collect()] == [(1, 1)]
    assert after.where("user_id = 1 and photo_id = 1").first()["processing_token"] is None and seen.where("holds").count() == 2
    assert control.complete_photos(after, counted, done, now())[1].first()["photos_since_consolidation"] == 1


def test_consolidation_leases(spark):
    life = spark.createDataFrame([], LIFE)
    asked = spark.createDataFrame([(1, False, "a"), (2, True, "b")], "user_id long, force boolean, token string")
    claims = keep(control.claim_consolidation(life, asked, now()))
    assert {r["user_id"]: r["status"] for r in claims.collect()} == {1: "not_due", 2: "claimed"}
    held = keep(control.apply_consolidation_claims(life, claims, now()))
    again = control.claim_consolidation(held, asked, F.lit("2024-01-01 00:05:10").cast("timestamp"))
    assert {r["user_id"]: (r["status"], r["retry_after_s"]) for r in again.collect()}[2] == ("in_progress", 1790)
    late = control.claim_consolidation(held, asked, F.lit("2024-01-01 02:00:00").cast("timestamp"))
    assert {r["user_id"]: r["status"] for r in late.collect()}[2] == "claimed"
    owner = spark.createDataFrame([(2, "b", "boom")], "user_id long, token string, message string")
    assert control.holds_consolidation(held, owner).first()["holds"]
    assert control.complete_consolidation(held, owner, now()).where("user_id = 2").first()["consolidation_token"] is None
    failed = control.fail_consolidation(held, owner.withColumn("token", F.lit("z")), now()).where("user_id = 2").first()
    assert failed["consolidation_token"] == "b" and failed["last_consolidation_error"] is None


def test_reads(spark):
    s = state_of(spark, [(1, 10, [1, 0]), (2, 10, [1, 0], {"photo_id": 1, "face_index": 1}), (3, None, [0, 1]), (4, 20, [0, 1], {"user_id": 2})])
    one = spark.createDataFrame([(1, 10), (1, 10), (1, 99)], "user_id long, cluster_id long")
    assert {r["face_id"] for r in scans.faces_by_cluster(s.faces, one).collect()} == {1, 2}
    assert {(r["cluster_id"], r["faces"]) for r in scans.cluster_faces(s.faces, one).collect()} == {(10, 2), (99, 0)}
    assert [r["face_id"] for r in scans.faces_by_photo(s.faces, spark.createDataFrame([(1, 1)], "user_id long, photo_id long")).collect()] == [1, 2]
    t = spark.sql("select timestamp'2024-01-02 03:04:05' a, timestamp'2024-01-02 03:04:05.000120' b, cast(null as timestamp) c")
    assert t.select(*(scans.iso(F.col(c)) for c in "abc")).first()[:] == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000120", None)
    assert spark.range(1).select(scans.parsed(F.lit("2024-01-02T03:04:05")).cast("string"), scans.parsed(F.lit(" "))).first()[:] == ("2024-01-02 03:04:05", None)


def test_paths_and_pairs(spark):
    paths = {" a//b/./c ": "/r/a/b/c", "/x/../y/": "/y", "/../z": "/z", "http://h//p": "http://h//p"}
    df = spark.createDataFrame(list(paths.items()), "p string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", keys.normal_path(F.col("p"), "/r")).collect())
    with pytest.raises(Exception, match="paired with itself"):
        spark.range(1).select(keys.pair(F.lit("a"), F.lit("a"))[0]).collect()


def test_codec_and_files(spark, tmp_path):
    df = spark.createDataFrame([([0.5, -1.25],), ([],), (None,)], "v array<float>")
    back = df.select("v", codec.encoded(F.col("v")).alias("b")).select("v", "b", codec.decoded(F.col("b")).alias("w")).collect()
    assert [r["w"] for r in back] == [r["v"] for r in back] and bytes(back[0]["b"]) == np.array([0.5, -1.25], "<f4").tobytes()
    (tmp_path / "t.yaml").write_text("# comment\nmatching:\n  match: 0.5  # higher\n  top_k: 3\n")
    t = codec.thresholds(str(tmp_path / "t.yaml"))
    assert (t.match, t.top_k, t.min_margin) == (0.5, 3, DEFAULT.min_margin)
    (tmp_path / "u.yaml").write_text("nothing_like_it: 1\n")
    with pytest.raises(ValueError):
        codec.thresholds(str(tmp_path / "u.yaml"))
    assert codec.model_paths({"a": "m/x", "b": "/y"}, "/root_") == {"a": "/root_/m/x", "b": "/y"}


def test_manual_moves_run_whole_or_not_at_all(spark):
    s = state_of(spark, [(1, 10, [1, 0]), (2, 10, [1, 0]), (3, 20, [0, 1]), (4, None, [0, 1]), (5, 30, [0, 1], {"photo_id": 1}), (6, 20, [0, 1])])
    s = mutations.State(s.faces.withColumn("candidate_cluster_id", F.lit(10)).withColumn("best_match_score", F.lit(0.5)).withColumn("decision_reason", F.lit("x")), s.clusters, s.exemplars, s.cannot_links)
    moves = spark.createDataFrame([(1, 2, 20), (1, 4, 30), (1, 3, 30), (1, 1, 10)], "user_id long, face_id long, target long")
    problems = {(r["face_id"], r["target"]): r["problem"] for r in control.move_problems(s, moves).collect()}
    assert problems == {(2, 20): None, (4, 30): "face is not currently assigned", (3, 30): None, (1, 10): None}
    after, counts = control.move_faces(s, moves, F.current_date())
    assert [(r["target"], r["moved"]) for r in counts.collect()] == [(20, 1)]
    got = {r["face_id"]: r for r in after.faces.collect()}
    assert got[2]["cluster_id"] == 20 and got[2]["assignment_state"] == "manual" and got[2]["best_match_score"] is None and got[2]["decision_reason"] == "manual_correction" and got[2]["candidate_cluster_id"] == 20
    assert got[3]["cluster_id"] == 20 and got[3]["best_match_score"] == 0.5 and got[1]["assignment_state"] == "confirmed"
    clash = control.move_problems(s, spark.createDataFrame([(1, 5, 10), (1, 6, 99), (1, 77, 10)], "user_id long, face_id long, target long")).collect()
    assert {r["face_id"]: r["problem"] for r in clash} == {5: "same photo", 6: "No active cluster", 77: "No face"}
    stale = control.move_problems(s, spark.createDataFrame([(1, 2, 20, 30)], "user_id long, face_id long, target long, source long")).first()
    assert stale["problem"] == "face is no longer in the source cluster"
    asked = spark.createDataFrame([(1, 3, 20, 10), (1, 2, 20, 10), (1, 6, 20, 30)], "user_id long, photo_id long, source long, target long")
    _, counts, bad = control.move_photos(s, asked, F.current_date())
    assert {(r["target"], r["moved"]) for r in counts.collect()} == {(30, 1)} and [(r["photo_id"], r["problem"]) for r in bad.collect()] == [(2, "Expected exactly one face; found 0")]


def test_saving_a_cluster_fills_in_missing_faces(spark):
    s = state_of(spark, [(1, 10, [1, 0]), (2, 10, [1, 0])])
    ex = s.exemplars.where("face_id = 1").unionByName(s.exemplars.where("face_id = 2").withColumn("face_id", F.lit(9).cast("long")))
    saved = mutations.save_cluster(s, s.clusters.withColumn("is_user_confirmed", F.lit(True)), ex)
    assert {r["face_id"]: r["assignment_state"] for r in saved.faces.collect()} == {1: "confirmed", 2: "confirmed", 9: "confirmed"}
    assert {r["face_id"] for r in saved.exemplars.collect()} == {1, 9} and saved.clusters.first()["face_count"] == 3 and saved.clusters.first()["is_user_confirmed"]


def test_deleting_photos_and_repairing(spark):
    s = state_of(spark, [(1, 10, [1, 0]), (2, 10, [1, 0], {"quality_score": 0.4}), (3, 20, [0, 1])])
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "user_id long, photo_id long")
    left, after = mutations.delete_photo_rows(rows, s, spark.createDataFrame([(1, 1)], "user_id long, photo_id long"))
    assert {r["photo_id"] for r in left.collect()} == {2, 3}
    assert {r["face_id"]: (r["cluster_id"], r["assignment_state"]) for r in after.faces.collect()} == {2: (None, "unassigned"), 3: (20, "confirmed")} and {r["cluster_id"] for r in after.clusters.collect()} == {20}
    reasons = mutations.State(s.faces.withColumn("decision_reason", F.lit("x")), s.clusters, s.exemplars.where("cluster_id = 20"), s.cannot_links)
    low = mutations.State(reasons.faces.withColumn("quality_score", F.lit(0.4)), reasons.clusters, reasons.exemplars, reasons.cannot_links)
    assert {r["face_id"]: r["decision_reason"] for r in mutations.repair_empty(low).faces.collect()} == {1: "legacy_empty_cluster_repaired", 2: "legacy_empty_cluster_repaired", 3: "x"}


def test_suggestions_are_resolved(spark):
    s = state_of(spark, [(1, 10, [1, 0]), (2, 20, [1, 0]), (3, 30, [0, 1]), (4, 40, [0, 1], {"photo_id": 3})] + [(i, 50, [1, 0]) for i in (5, 6)] + [(i, 50, [0, 1]) for i in (7, 8)])
    rows = [("m1", "merge", ["10", "20"], "pending", None), ("m2", "merge", ["30", "40"], "pending", None), ("m3", "merge", ["10", "99"], "pending", None), ("m4", "merge", ["20", "30"], "pending", None), ("s1", "split", ["50"], "pending", [[5, 6], [7, 8]]), ("old", "merge", ["10", "20"], "rejected", None), ("m5", "merge", ["10", "40"], "pending", None)]
    sug = spark.createDataFrame([(1, *r) for r in rows], "user_id long, suggestion_id string, suggestion_type string, cluster_ids array<string>, status string, groups array<array<long>>")
    sug = sug.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame([(1, "m1", "accepted"), (1, "m2", "accepted"), (1, "m3", "accepted"), (1, "m4", "rejected"), (1, "s1", "accepted"), (1, "old", "accepted"), (1, "none", "accepted")], "user_id long, suggestion_id string, answer string")
    out, after, outcome = control.resolve(sug, s, asked, now(), keep)
    told = {r["suggestion_id"]: (r["action"], r["new_status"], r["problem"]) for r in outcome.collect()}
    assert told == {
        "m1": ("merge", "accepted", None), "m2": ("none", None, "STALE: same photo"), "m3": ("none", "stale", None), "m4": ("cannot_link", "rejected", None),
        "s1": ("split", "accepted", None), "old": ("none", None, "No pending suggestion"), "none": ("none", None, "No pending suggestion"),
    }
    assert {r["suggestion_id"]: r["status"] for r in out.collect()} == {"m1": "accepted", "m2": "pending", "m3": "stale", "m4": "rejected", "s1": "accepted", "old": "rejected", "m5": "stale"}
    clusters = {r["face_id"]: r["cluster_id"] for r in after.faces.collect()}
    assert clusters[1] == clusters[2] == 10 and clusters[5] == clusters[6] == 50 and clusters[7] == clusters[8] not in (50, None)
    assert (1, 10, 30) in {(r["user_id"], r["cluster_a_id"], r["cluster_b_id"]) for r in after.cannot_links.collect()}
    assert mutations.unknown_suggestions(sug, asked).first()["suggestion_id"] == "none"


def test_split_suggestions_name_their_groups(spark):
    found = spark.createDataFrame([(1, "c", [["b", "a"], ["d", "c"]], {"0": 0.5}), (1, "x", [["a"], ["b", "c"]], {"0": 0.5})], "user_id long, cluster_id string, groups array<array<string>>, fractions map<string,double>")
    import hashlib
    import json

    payload = json.dumps({"source_cluster_id": "c", "groups": [["a", "b"], ["c", "d"]]}, sort_keys=True)
    (row,) = mutations.split_suggestions(found, now()).collect()
    assert row["payload"] == payload and row["suggestion_id"] == "split_" + hashlib.sha1(payload.encode()).hexdigest()[:12] and row["evidence"] == {"0": 0.5}


def test_a_whole_run_and_its_summary(spark):
    rows = [(i, 10, [1, 0.01 * i]) for i in range(1, 4)] + [(i, 20, [1, 0.01 * i]) for i in range(4, 7)] + [(7, None, [1, 0.02]), (8, None, [0, 1]), (9, None, [0.01, 1])]
    start = state_of(spark, rows)
    start = mutations.State(start.faces.withColumns({"decision_reason": F.lit("old"), "best_match_score": F.lit(0.1)}), start.clusters, start.exemplars, start.cannot_links)
    run = consolidate.consolidate(start, keep)
    seven = run.state.faces.where("face_id = 7").first()
    assert seven["decision_reason"].startswith("consolidation_recovery:") and seven["best_match_score"] > 0.9 and seven["assignment_state"] == "confirmed"
    assert run.state.faces.where("face_id = 1").first()["decision_reason"] == "old"
    found = {r["counter"]: r["value"] for r in run.summary().collect()}
    # face 7 is near both clusters until they are one
    assert found["initial_deferred_checked"] == 3 and found["post_correction_recovered_confirmed"] == 1 and found["unassigned_hdbscan_points"] == 2 and found["auto_merges"] == 1
    assert found.get("new_cluster_faces", 0) + found.get("remaining_unassigned", 0) == 2 and [a["kind"] for a in run.actions] == ["merge"]
    assert {r["cluster_id"] for r in run.state.faces.where("face_id < 8").collect()} == {run.actions[0]["survivor"]}
    assert run.suggestions(spark.createDataFrame([], "user_id long, suggestion_id string"), now()).count() == 0
