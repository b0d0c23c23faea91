"""Trees of minhashes: independence, orders and neighbours."""

import random

import numpy as np

from kinlake.llm import neardup


def test_pairs_at_the_threshold_are_lost_no_more_often_than_stated():
    rng = np.random.default_rng(41)
    lost, n, depth = 0, 200_000, neardup.depth_for(85)
    for _ in range(10):
        agree = rng.random((n, neardup.TREES, depth)) < 0.85
        lost += int((~agree.all(2).any(1)).sum())
    assert lost <= 2 + 10 * n * (1 - 0.85**depth) ** neardup.TREES
    assert (1 - 0.85**depth) ** neardup.TREES <= 1e-6


def test_neighbours_of_all_orders_join_every_region(spark):
    rng = random.Random(42)
    rows = []
    for tree in range(3):
        for doc in range(300):
            row = [rng.randrange(2) for _ in range(neardup.LONGEST)]
            rows.append((tree, np.array(row, ">u2").tobytes(), doc))
    rows += [(0, bytes(neardup.SEQUENCE), 1000 + i) for i in range(200)]  # a crowded sequence
    df = spark.createDataFrame(rows, "tree int, sequence binary, doc_id long")
    depth = 5
    for parts in (1, 7):
        ranged = df.repartitionByRange(parts, "tree", "sequence", "doc_id").sortWithinPartitions("tree", "sequence", "doc_id")
        got = neardup.neighbours(ranged, depth).cache()
        edges = got.where("tree is not null").selectExpr("tree", "sequence", "a as doc_id").repartition(1).sortWithinPartitions("tree", "sequence", "doc_id")
        links = {(r["a"], r["b"]) for x in (got, neardup.neighbours(edges, depth)) for r in x.where("tree is null").collect()}
        root = {r[2]: r[2] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        regions = {}
        for tree, sequence, doc in rows:
            regions.setdefault((tree, sequence[: 2 * depth]), set()).add(find(doc))
        assert all(len(r) == 1 for r in regions.values())
        assert len(links) <= len(rows)


def test_depth_adapts_to_sparse_regions():
    deep = neardup.deep_enough
    assert deep(np.array([6, 4, 2, 5, 3]), 0, 6).tolist() == [True, False, False, True, False]
    assert deep(np.array([4, 4]), 0, 6).tolist() == [False, False]  # neither is the other's nearest
    assert deep(np.array([4]), 5, 6).tolist() == [False] and deep(np.array([3]), 0, 6).tolist() == [False]
    assert deep(np.array([4, 2, 3]), 0, 4).tolist() == [True, False, False]
    a = np.array([[1, 2], [1, 2], [1, 3], [0, 3]])
    assert neardup.shared_prefix(np.array([0, 0, 0, 1]), a).tolist() == [2, 1, 0]
