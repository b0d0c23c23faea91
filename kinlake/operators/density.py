"""Density clustering of small groups of unit vectors (V9): single linkage, condensed tree, excess of mass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels(x: np.ndarray, least: int = 2, allow_single: bool = False) -> np.ndarray:
    """HDBSCAN labels with min_samples=1: core distances are 0, so reachability is the distance itself. -1 is noise."""
    n = len(x)
    out = np.full(n, -1)
    if n < least:
        return out
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    gaps = np.sqrt(np.maximum(2 - 2 * np.clip(x @ x.T, -1, 1), 0))
    # Prim's tree, then its edges by length
    reach, source, left = gaps[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    edges = []
    for _ in range(n - 1):
        j = int(np.where(left, reach, np.inf).argmin())
        edges.append((float(reach[j]), int(source[j]), j))
        left[j] = False
        nearer = gaps[j] < reach
        reach, source = np.where(nearer, gaps[j], reach), np.where(nearer, j, source)
    edges.sort(key=lambda e: e[0])
    size, children, height = [1] * n, {}, {}
    root = list(range(2 * n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (d, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + k
        children[new], height[new] = (a, b), d
        size.append(size[a] + size[b])
        root[a] = root[b] = new

    def leaves(i):
        stack, got = [i], []
        while stack:
            i = stack.pop()
            if i < n:
                got.append(i)
            else:
                stack.extend(children[i])
        return got

    # condensed tree: a cluster lives until it splits into two of at least `least`
    clusters = [{"node": 2 * n - 2, "birth": 0.0, "kids": [], "mass": 0.0}]
    work = [(0, 2 * n - 2)]
    while work:
        c, i = work.pop()
        own = clusters[c]
        while True:
            if i < n:
                break
            level = 1 / height[i] if height[i] > 0 else 1e12
            a, b = children[i]
            big = [s for s in (a, b) if size[s] >= least]
            if len(big) == 2:
                own["mass"] += size[i] * (level - own["birth"])
                for s in (a, b):
                    clusters.append({"node": s, "birth": level, "kids": [], "mass": 0.0})
                    own["kids"].append(len(clusters) - 1)
                    work.append((len(clusters) - 1, s))
                break
            lost = sum(size[s] for s in (a, b) if size[s] < least)
            own["mass"] += lost * (level - own["birth"])
            if not big:
                break
            i = big[0]
    chosen = [True] * len(clusters)
    best = [c["mass"] for c in clusters]
    for c in range(len(clusters) - 1, -1, -1):
        kids = clusters[c]["kids"]
        if not kids:
            continue
        below = sum(best[k] for k in kids)
        if (c == 0 and not allow_single) or below > best[c]:
            chosen[c], best[c] = False, below
        else:
            stack = list(kids)
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack.extend(clusters[k]["kids"])
    if not allow_single:
        chosen[0] = False
    picked = sorted((min(leaves(c["node"])), leaves(c["node"])) for c, keep in zip(clusters, chosen, strict=True) if keep)
    for k, (_, members) in enumerate(picked):
        out[members] = k
    return out


def density_labels(faces: DataFrame, group: list[str], least: int = 2, allow_single: bool = False) -> DataFrame:
    """(group..., face_id, label): each group of faces is clustered apart; ids must be unique in it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("face_id")
        if rows["face_id"].duplicated().any():
            raise ValueError("face ids of a group must be unique")
        found = labels(np.stack(rows["v"]), least, allow_single)
        return pd.DataFrame({**dict(zip(group, key, strict=True)), "face_id": rows["face_id"].to_numpy(), "label": found})

    types = ", ".join(f"{c} {faces.schema[c].dataType.simpleString()}" for c in group)
    return faces.select(*group, "face_id", F.col("v")).groupBy(*group).applyInPandas(run, f"{types}, face_id long, label int")
