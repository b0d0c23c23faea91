"""Decision branches, folds and mutations on rows made by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake.functions import geometry, keys, quality, vector
from kinlake.operators import association, audit, density, evidence, exemplars, gallery, integrity, mutations, recovery, scores
from kinlake.sources import images, snapshot
from kinlake.streaming.incremental import Gallery, replay, stream

FACE = "user_id long, face_id long, photo_id long, face_index int, home long, cluster_id long, assignment_state string, quality_score double, yaw_ratio double, restricted boolean, is_manual boolean, v array<double>"


def at(cosine):
    return [cosine, math.sqrt(1 - cosine * cosine)]


def faces(spark, rows):
    """rows: (face_id, cluster, vector) and what differs from a confirmed, eligible face of user 1."""
    out = []
    for face_id, cluster, v, *more in rows:
        x = {"user_id": 1, "photo_id": face_id, "face_index": 0, "home": cluster, "cluster_id": cluster, "assignment_state": "confirmed" if cluster is not None else "unassigned", "quality_score": 0.9, "yaw_ratio": 0.0, "restricted": False, "is_manual": False}
        x |= more[0] if more else {}
        out.append((x["user_id"], face_id, x["photo_id"], x["face_index"], x["home"], x["cluster_id"], x["assignment_state"], x["quality_score"], x["yaw_ratio"], x["restricted"], x["is_manual"], [float(c) for c in v]))
    return spark.createDataFrame(out, FACE).withColumn("norm", vector.norm(F.col("v")))


def decided(spark, known, asked, eligible=False):
    f, k = faces(spark, asked), faces(spark, known)
    return {r["face_id"]: r for r in scores.decide(f, scores.face_cluster_scores(f, exemplars.quality_exemplars(k)), F.lit(eligible)).collect()}


def test_decisions(spark):
    known = [(1, 10, [1, 0]), (2, 10, [1, 0])]
    asked = [(100, None, at(0.42)), (101, None, at(0.40)), (102, None, at(0.30)), (103, None, at(0.34)), (104, None, at(0.9), {"user_id": 2})]
    got = decided(spark, known, asked)
    assert {i: r["state"] for i, r in got.items()} == {100: "confirmed", 101: "ambiguous", 102: "unassigned", 103: "ambiguous", 104: "unassigned"}
    assert got[100]["margin"] is None and got[104]["reason"] == "unassigned_no_existing_candidates_and_not_exemplar_eligible"
    seeds = decided(spark, known, asked, True)
    assert seeds[102]["reason"] == "new_cluster_seed_no_candidate_above_ambiguous_band" and seeds[104]["reason"] == "new_cluster_seed_no_existing_candidates"
    rivals = decided(spark, known + [(3, 20, at(0.99)), (4, 20, at(0.99))], [(100, None, [1, 0])])
    assert rivals[100]["reason"] == "ambiguous_insufficient_margin_over_second_best"
    sparse = decided(spark, known[:1], [(100, None, at(0.44)), (101, None, at(0.47))])
    assert [sparse[i]["state"] for i in (100, 101)] == ["ambiguous", "confirmed"]


def test_restricted_pose_needs_a_mature_target(spark):
    r = {"restricted": True}
    for n, state in ((7, "ambiguous"), (8, "confirmed")):
        f = faces(spark, [(i, 10, [1, 0]) for i in range(n)] + [(100, None, at(0.9), r), (101, None, at(0.8), r | {"photo_id": 100}), (102, None, at(0.45), r)])
        got = {x["face_id"]: x for x in recovery.recover_restricted(f, exemplars.quality_exemplars(f)).collect()}
        assert got[100]["state"] == state and got[102]["state"] == "unassigned"
    assert got[101]["reason"] == "restricted_pose_recheck:restricted_pose_same_photo_deferred_conflict"


def test_recovery_uses_one_snapshot_and_skips_taken_photos(spark):
    f = faces(spark, [(1, 10, [1, 0]), (2, 10, [1, 0]), (100, None, at(0.9), {"photo_id": 1}), (101, None, at(0.9), {"photo_id": 50}), (102, None, at(0.8), {"photo_id": 50}), (103, None, at(0.9), {"is_manual": True})])
    ex = exemplars.quality_exemplars(f)
    got = {r["face_id"]: r["state"] for r in recovery.recover_deferred(f, ex).collect()}
    assert got == {100: "unassigned", 101: "confirmed", 102: "confirmed"}
    assert {r["face_id"]: r["state"] for r in recovery.recover_deferred(f, ex, strict=True).collect()} == {100: "unassigned", 101: "confirmed", 102: "ambiguous"}


def plain_fold(items):
    """The two buckets by their rules, written apart."""
    q, p = [], []
    for item in items:
        if len(q) < 3:
            q = sorted([*q, item], key=lambda x: -x[1])
        elif item[1] > min(x[1] for x in q):
            weak = min(q, key=lambda x: x[1])
            q = sorted([x for x in q if x is not weak] + [item], key=lambda x: -x[1])
        elif len(p) < 2:
            p.append(item)
        else:
            gap = lambda y, no: min(abs(y[2] - x[2]) for x in q + p if x is not no)
            weak = min(p, key=lambda x: gap(x, x))
            if gap(item, None) > gap(weak, weak):
                p = [x for x in p if x is not weak] + [item]
    return [x[0] for x in q], [x[0] for x in p]


def test_exemplar_folds(spark):
    rng = random.Random(1)
    for _ in range(200):
        items = [(i, rng.choice([0.7, 0.75, 0.8, 0.9]), rng.choice([-0.4, -0.1, 0, 0.2, 0.5])) for i in range(rng.randint(0, 12))]
        own = exemplars.ExemplarSet()
        for x in items:
            own.add(x)
        assert ([x[0] for x in own.quality], [x[0] for x in own.pose]) == plain_fold(items)
    assert exemplars.ExemplarSet(quality=[(1, 0.9, 0)]).remove(1) and not exemplars.ExemplarSet().remove(1)
    f = faces(spark, [(1, 10, [1, 0], {"quality_score": 0.5}), (2, 10, [1, 0], {"quality_score": 0.6}), (3, 11, [1, 0])])
    assert {(r["cluster_id"], r["face_id"]) for r in exemplars.rebuild(f).collect()} == {(11, 3)}
    assert {(r["cluster_id"], r["face_id"]) for r in exemplars.rebuild(f, low_quality_seed=True).collect()} == {(10, 2), (11, 3)}


def test_density_labels():
    a, b = np.tile(at(1.0), (3, 1)) + [[0, 0], [0, 0.01], [0, 0.02]], np.tile(at(0.0), (3, 1)) + [[0, 0], [0.01, 0], [0.02, 0]]
    assert density.labels(np.vstack([a, b])).tolist() == [0, 0, 0, 1, 1, 1]
    assert density.labels(np.vstack([a[:1]])).tolist() == [-1]
    assert density.labels(np.zeros((0, 2))).tolist() == []
    assert set(density.labels(np.vstack([a]), allow_single=True).tolist()) <= {0, -1}


def test_connected(spark, monkeypatch):
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    f = faces(spark, [(i, 10, turn(60 * i)) for i in range(4)] + [(10, 20, turn(0)), (11, 20, turn(120)), (12, 30, turn(5))])
    for block in (evidence.BLOCK, 2):
        monkeypatch.setattr(evidence, "BLOCK", block)
        rows = evidence.similarity_rows(f, f.select("user_id", "cluster_id"))
        got = evidence.connected(rows, audit.cluster_sizes(f), evidence.most_blocks(f)).collect()
        assert {r["source"]: r["connected"] for r in got} == {10: True, 20: False, 30: True}


def test_similarity_rows_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors, homes = rng.normal(size=(40, 3)), rng.integers(0, 5, 40)
    f = faces(spark, [(i, int(homes[i]), vectors[i], {"photo_id": i // 2 if i % 5 else None}) for i in range(40)])
    sources = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, cluster_id long")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sim = unit @ unit.T
    want = {}
    for i in range(40):
        for c in set(homes.tolist()) - {homes[i]} if homes[i] in (1, 3) else ():
            own = np.flatnonzero(homes == c)
            near = own[sim[i, own] >= 0.41]
            want[i, c] = (round(float(sim[i, own].max()), 6), len(near), sorted(near.tolist()), sorted(str(x // 2 if x % 5 else None) for x in near.tolist()))
    for block in (evidence.BLOCK, 7):
        monkeypatch.setattr(evidence, "BLOCK", block)
        got = evidence.combined(evidence.similarity_rows(f, sources)).collect()
        assert {(r["face_id"], r["target"]): (round(r["best"], 6), r["support"], sorted(r["others"]), sorted(map(str, r["photos"]))) for r in got} == want


def test_integrity_and_mutations(spark):
    f = faces(spark, [(1, 10, [1, 0]), (2, 10, [1, 0], {"photo_id": 1}), (3, 20, [0, 1], {"quality_score": 0.5}), (4, None, [0, 1]), (5, 30, [0, 1])])
    clusters = f.groupBy("user_id", "cluster_id").agg(F.count("*").cast("int").alias("face_count")).where("cluster_id is not null").selectExpr(
        "user_id", "cluster_id", "face_count", "false is_user_confirmed", "false has_manual_correction", "current_date() created_at", "current_date() last_updated_at", "cast(null as long) merged_into"
    )
    state = mutations.State(f, clusters, exemplars.quality_exemplars(f, cluster="cluster_id"), spark.createDataFrame([(1, 20, 30)], "user_id long, cluster_a_id long, cluster_b_id long"))
    assert {(r["check"], r["entity_id"]) for r in integrity.validate(clusters, f, state.exemplars, 2).collect()} == {("same_photo_duplicate", "10"), ("cluster_without_exemplar", "20")}
    fixed = mutations.repair(state)
    assert {r["face_id"]: r["cluster_id"] for r in fixed.faces.collect()} == {1: 10, 2: 10, 3: None, 4: None, 5: 30}
    assert {r["cluster_id"] for r in fixed.clusters.collect()} == {10, 30}
    merged = mutations.merge(fixed, spark.createDataFrame([(1, 30, 10)], "user_id long, loser long, survivor long"))
    assert {(r["cluster_id"], r["face_count"], r["merged_into"]) for r in merged.clusters.collect()} == {(10, 3, None), (30, 0, 10)}
    assert [(r["cluster_a_id"], r["cluster_b_id"]) for r in merged.cannot_links.collect()] == [(10, 20)]
    gone = mutations.delete_photos(merged, spark.createDataFrame([(1, 1)], "user_id long, photo_id long"))
    assert {r["face_id"] for r in gone.faces.collect()} == {3, 4, 5}
    moved = mutations.move(merged, spark.createDataFrame([(1, 4, 10)], "user_id long, face_id long, target long"))
    assert [(r["assignment_state"], r["cluster_id"]) for r in moved.faces.where("face_id = 4").collect()] == [("manual", 10)]
    assert mutations.move_conflicts(f, spark.createDataFrame([(1, 1, 30)], "user_id long, face_id long, target long")).count() == 0
    bad = mutations.merge_conflicts(fixed, spark.createDataFrame([(1, 10, 99), (1, 10, 30)], "user_id long, source long, target long")).collect()
    assert [(r["target"], r["problem"]) for r in bad] == [(99, "STALE: cluster missing or merged")]


def test_split(spark):
    f = faces(spark, [(i, 10, [1, 0]) for i in (1, 2, 3)] + [(i, 10, [0, 1]) for i in (4, 5)] + [(6, 10, [0, 1], {"restricted": True})])
    plan = "user_id long, cluster_id long, group_a array<long>, group_b array<long>, new_cluster long"
    plans = spark.createDataFrame([(1, 10, [1, 2, 3], [4, 5], 77)], plan)
    assert [r["problem"] for r in mutations.split_problems(f, plans).collect()] == [None]
    stale = spark.createDataFrame([(1, 10, [1, 2], [4, 5], 77)], plan)
    assert [r["problem"] for r in mutations.split_problems(f, stale).collect()] == ["STALE: membership changed"]
    clusters = spark.sql("select 1L user_id, 10L cluster_id, 6 face_count, false is_user_confirmed, false has_manual_correction, current_date() created_at, current_date() last_updated_at, cast(null as long) merged_into")
    done = mutations.split(mutations.State(f, clusters, exemplars.quality_exemplars(f), spark.createDataFrame([], "user_id long, cluster_a_id long, cluster_b_id long")), plans)
    assert {r["face_id"]: r["cluster_id"] for r in done.faces.collect()} == {1: 10, 2: 10, 3: 10, 4: 77, 5: 77, 6: None}
    assert {(r["cluster_id"], r["face_count"]) for r in done.clusters.collect()} == {(10, 3), (77, 2)}
    assert done.cannot_links.count() == 1


def test_incremental_assignment(spark, tmp_path):
    f = faces(spark, [(1, None, [1, 0]), (2, None, [1, 0.01], {"photo_id": 1, "face_index": 1}), (3, None, [1, 0.02]), (4, None, [0, 1], {"quality_score": 0.5}), (5, None, [1, 0], {"user_id": 2})])
    got = {r["face_id"]: (r["cluster_id"], r["state"]) for r in replay(f).collect()}
    assert got[1] == (1, "confirmed") and got[2] == (2, "confirmed") and got[4] == (None, "unassigned") and got[5] == (5, "confirmed")
    assert got[3][1] == "ambiguous"
    f.where("photo_id < 3").write.parquet(str(tmp_path / "in" / "a"))
    f.where("photo_id >= 3").write.parquet(str(tmp_path / "in" / "b"))
    q = stream(spark.readStream.schema(f.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("assigned").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["face_id"]: (r["cluster_id"], r["state"]) for r in spark.table("assigned").collect()} == got
    assert len(Gallery().fold(f.where("false").toPandas())) == 0


def test_functions(spark):
    row = spark.range(1).select(
        *[c.alias(n) for n, c in quality.gate_columns(F.lit(39.0), F.lit(0.1), F.lit(0.8)).items()],
        keys.suggestion_id("merge", F.array(F.lit("b"), F.lit("a"))).alias("sid"),
        keys.valid_tenant(F.lit(" ")).alias("t"),
        keys.retry_after(300, F.lit(299.5)).alias("retry"),
        keys.error_status(F.lit("value"), F.lit("Unknown x")).alias("status"),
        geometry.iou(F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (0, 0, 10, 10))]), F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (5, 0, 15, 10))])).alias("iou"),
        gallery.claim(F.lit("processing"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:04:00").cast("timestamp"), 300).alias("claim"),
    ).first()
    assert row["exclusion_kind"] == "size" and not row["restricted"] and row["exclusion_reason"].startswith("face_height 39.0")
    import hashlib

    assert row["sid"] == "merge_" + hashlib.sha1(b'["a", "b"]').hexdigest()[:12]
    assert (row["t"], row["retry"], row["status"], row["claim"]) == (False, 1, 404, "in_progress") and row["iou"] == pytest.approx(1 / 3)
    m = images.similarity_transform(images.TEMPLATE * 2 + 5)
    assert np.allclose(np.column_stack([images.TEMPLATE * 2 + 5, np.ones(5)]) @ m.T, images.TEMPLATE)
    assert images.laplacian_variance(np.ones((8, 8))) == 0 and images.network_input(np.full((2, 2, 3), 255, np.uint8)).max() == 1


def test_association(spark):
    mesh = [(float(x), float(y)) for x in range(0, 20) for y in range(0, 15)]
    shift = lambda d: [(x + d, y) for x, y in mesh]
    cand = spark.createDataFrame([(1, 0, mesh), (1, 1, shift(0.1)), (1, 2, shift(100))], "photo_id long, cand_index long, points array<struct<x double, y double>>")
    det = spark.createDataFrame([(1, 0, (-1.0, -1.0, 20.0, 15.0)), (1, 1, (99.0, -1.0, 120.0, 15.0)), (1, 2, (500.0, 500.0, 510.0, 510.0))], "photo_id long, det_index long, box struct<x1 double, y1 double, x2 double, y2 double>")
    assert sorted(r["cand_index"] for r in association.distinct_meshes(cand).collect()) == [0, 2]
    assert {r["det_index"]: r["cand_index"] for r in association.associate(det, cand).collect()} == {0: 0, 1: 2, 2: None}


def test_snapshots(spark, tmp_path):
    s = snapshot.Snapshots(spark, f"file://{tmp_path}/store")
    s.create()
    rows = spark.sql("select 'u' user_id, 'c' cluster_id, 1 face_count, false is_user_confirmed, false has_manual_correction, timestamp'2024-01-01' created_at, timestamp'2024-01-01' last_updated_at, cast(null as string) merged_into")
    first = s.write({"clusters": rows})
    assert s.read("clusters").count() == 1 and s.read("faces").count() == 0 and s.manifest()["snapshot"] == first
    assert s.delete_user("u")["clusters"] == 1 and s.read("clusters").count() == 0 and s.manifest()["before"] == first
    old = snapshot.migrate({n: rows.drop("user_id") for n in ("photos", "faces", "clusters", "exemplars", "suggestions", "cannot_links")}, 5)
    assert old["faces"].first()["user_id"] == "__legacy__" and "recognition_restricted" in old["faces"].columns
    assert snapshot.duplicate_keys("clusters", rows.unionByName(rows)).count() == 1


def test_splits_of_two_far_groups(spark):
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    f = faces(spark, [(i, 10, turn(i)) for i in (1, 2, 3)] + [(i, 10, turn(85 + i)) for i in (4, 5, 6)] + [(i, 20, turn(i)) for i in (7, 8)] + [(i, 20, turn(85 + i)) for i in (9, 10)] + [(i, 30, turn(20 * i)) for i in (11, 12, 13, 14)])
    labelled = spark.createDataFrame([(1, c, i, k) for c, ids in ((10, (1, 2, 3, 4, 5, 6)), (20, (7, 8, 9, 10)), (30, (11, 12, 13, 14))) for k, half in enumerate((ids[: len(ids) // 2], ids[len(ids) // 2 :])) for i in half], "user_id long, cluster_id long, face_id long, label int")
    none = spark.createDataFrame([], "user_id long, cluster_id long")
    got = {r["cluster_id"]: r for r in audit.splits(f, labelled, none, none).collect()}
    assert set(got) == {10, 20}  # the third one's groups are near each other
    assert got[10]["auto_safe"] and not got[20]["auto_safe"]  # groups of two are for people to decide
    assert got[10]["cross_max"] == pytest.approx(math.cos(math.radians(86)), abs=1e-6) and got[10]["cohesion"] == pytest.approx(math.cos(math.radians(1)), abs=1e-6)
    assert {r["cluster_id"] for r in audit.splits(f, labelled, spark.createDataFrame([(1, 10)], none.schema), none).where("auto_safe").collect()} == set()
    assert {r["cluster_id"] for r in audit.splits(f, labelled, none, spark.createDataFrame([(1, 10)], none.schema)).collect()} == {20}


def test_new_people_need_a_seed_and_distinct_photos(spark):
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [(1, None, turn(0)), (2, None, turn(5)), (3, None, turn(90), {"quality_score": 0.5}), (4, None, turn(95), {"quality_score": 0.5}), (5, None, turn(180)), (6, None, turn(181), {"photo_id": 5}), (7, None, turn(270)), (8, None, turn(355))]
    f = faces(spark, rows)
    labels = spark.createDataFrame([(1, i, k) for i, k in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 3))], "user_id long, face_id long, label int")
    got = recovery.new_people(f, labels=labels).collect()
    assert {r["face_id"] for r in got} == {1, 2} and len({r["group_id"] for r in got}) == 1
    one = recovery.new_people(f.where("face_id in (1, 2, 8)"), labels=spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 8, -1)], labels.schema)).collect()
    assert {r["face_id"] for r in one} == {1, 2, 8}  # with one label the group is all points


def test_connected_of_a_long_chain_keeps_a_short_plan(spark, monkeypatch):
    """Faces a step of 4 degrees apart are a chain over many blocks; the plan holds no rounds, which nested in each other on the driver."""
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    f = faces(spark, [(i, 10, turn(4 * i)) for i in range(40)] + [(100, 20, turn(0)), (101, 20, turn(180)), (102, 20, turn(5))])
    monkeypatch.setattr(evidence, "BLOCK", 4)
    rows = evidence.similarity_rows(f, f.select("user_id", "cluster_id"))
    found = evidence.connected(rows, audit.cluster_sizes(f), evidence.most_blocks(f))
    assert {r["source"]: r["connected"] for r in found.collect()} == {10: True, 20: False}
    assert "InMemoryTableScan" not in found._jdf.queryExecution().executedPlan().toString()
