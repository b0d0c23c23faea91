"""The registered consolidation against what the reference allows and rebuilds."""

from pyspark.sql import functions as F

from kinlake.config import DEFAULT
from kinlake.operators import exemplars, mutations
from kinlake.plans import consolidate, queries
from tests.test_operators import faces


def test_query_allows_as_many_corrections_as_the_default(monkeypatch):
    seen = []

    def stop(state, keep, t=DEFAULT):
        seen.append(t)
        raise StopIteration

    monkeypatch.setattr(consolidate, "consolidate", stop)
    monkeypatch.setattr(queries, "_state", lambda *_: None)
    monkeypatch.setattr(queries, "_keep", lambda *_: None)
    try:
        queries.QUERIES["run_consolidation"](None, "")
    except StopIteration:
        pass
    assert [t.max_actions for t in seen] == [12]


def state_of(spark, rows):
    f = faces(spark, rows)
    clusters = f.where("cluster_id is not null").groupBy("user_id", "cluster_id").agg(F.count("*").cast("int").alias("face_count")).selectExpr(
        "user_id", "cluster_id", "face_count", "false is_user_confirmed", "false has_manual_correction", "current_date() created_at", "current_date() last_updated_at", "cast(null as long) merged_into"
    )
    links = spark.createDataFrame([], "user_id long, cluster_a_id long, cluster_b_id long")
    return mutations.State(f, clusters, exemplars.quality_exemplars(f, cluster="cluster_id"), links)


def test_a_merge_rebuilds_with_pose_replacement(spark):
    yaws = (0.0, 0.01, 0.02, 0.03, 0.2, 0.5)  # the sixth turns further than the fourth, which it replaces
    rows = [(i + 1, 10 if i % 2 else 20, [1, 0], {"quality_score": 0.95 - i / 100, "yaw_ratio": y}) for i, y in enumerate(yaws)]
    merged = mutations.merge(state_of(spark, rows), spark.createDataFrame([(1, 20, 10)], "user_id long, loser long, survivor long"))
    assert {(r["bucket"], r["face_id"]) for r in merged.exemplars.collect()} == {("quality", 1), ("quality", 2), ("quality", 3), ("pose", 5), ("pose", 6)}
    assert sorted(r["ordinal"] for r in merged.exemplars.collect()) == [1, 2, 3, 4, 5]


def test_a_move_seeds_clusters_without_an_eligible_face(spark):
    rows = [(1, 10, [1, 0]), (2, 10, [1, 0], {"quality_score": 0.4}), (3, 10, [1, 0], {"quality_score": 0.5}), (4, 20, [0, 1])]
    moved = mutations.move(state_of(spark, rows), spark.createDataFrame([(1, 1, 20)], "user_id long, face_id long, target long"))
    assert {r["face_id"]: r["cluster_id"] for r in moved.faces.collect()} == {1: 20, 2: 10, 3: 10, 4: 20}
    assert {(r["cluster_id"], r["face_id"]) for r in moved.exemplars.collect()} == {(10, 3), (20, 1), (20, 4)}
