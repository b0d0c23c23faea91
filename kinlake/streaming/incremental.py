"""Incremental assignment: an ordered fold over each tenant's photos (ST1, M22, M23), as a replay or as a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinlake.config import DEFAULT, Thresholds
from kinlake.operators.exemplars import ExemplarSet

OUT = "user_id long, face_id long, photo_id long, cluster_id long, state string, reason string, best_score double, margin double"
COLUMNS = ["user_id", "face_id", "photo_id", "cluster_id", "state", "reason", "best_score", "margin"]


class Gallery:
    """The clusters of one tenant as they stand; a new one is named by its seed face."""

    def __init__(self, t: Thresholds = DEFAULT):
        self.t, self.sets, self.vectors, self.in_photo = t, {}, {}, {}

    def _scores(self, v: np.ndarray, without: set) -> list[tuple[float, int, float]]:
        out = []
        for c, own in self.sets.items():
            if c in without or not len(own):
                continue
            sims = sorted((float(v @ self.vectors[i]) / (np.linalg.norm(v) * np.linalg.norm(self.vectors[i]) + 1e-9) for i, *_ in own.quality + own.pose), reverse=True)
            top = sims[: self.t.top_k]
            out.append((-sum(top) / len(top), c, self.t.match + (self.t.sparse_margin if len(own) < self.t.top_k else 0)))
        return sorted(out)

    def _admit(self, c: int, face) -> None:
        own = self.sets[c]
        if own.add((face.face_id, face.quality_score, face.yaw_ratio)):
            self.vectors[face.face_id] = np.asarray(face.v, float)
            live = {i for s in self.sets.values() for i, *_ in s.quality + s.pose}
            self.vectors = {i: v for i, v in self.vectors.items() if i in live}

    def assign(self, face) -> tuple:
        """Decides on one face and takes it in; faces of one photo never share a cluster."""
        eligible = face.quality_score >= self.t.exemplar_quality and not face.restricted
        taken = self.in_photo.setdefault(face.photo_id, set())
        if face.restricted:
            return (None, "unassigned", "recognition_restricted", None, None)
        ranked = self._scores(np.asarray(face.v, float), taken)
        best = -ranked[0][0] if ranked else None
        margin = best + ranked[1][0] if len(ranked) > 1 else None
        cluster = None
        if ranked and best >= ranked[0][2]:
            if margin is not None and margin < self.t.min_margin:
                state, reason = "ambiguous", "ambiguous_insufficient_margin_over_second_best"
            else:
                state, reason, cluster = "confirmed", "confirmed_score_and_margin_passed", ranked[0][1]
                if eligible and best >= ranked[0][2] + self.t.admission_margin:
                    self._admit(cluster, face)
        elif ranked and best >= ranked[0][2] - self.t.ambiguous_band:
            state, reason = "ambiguous", "ambiguous_score_inside_threshold_band"
        elif eligible:
            state, cluster = "confirmed", int(face.face_id)
            reason = "new_cluster_seed_no_candidate_above_ambiguous_band" if ranked else "new_cluster_seed_no_existing_candidates"
            self.sets[cluster] = ExemplarSet(self.t.quality_bucket, self.t.pose_bucket)
            self._admit(cluster, face)
        else:
            state = "unassigned"
            reason = "unassigned_no_match_and_not_exemplar_eligible" if ranked else "unassigned_no_existing_candidates_and_not_exemplar_eligible"
        if cluster is not None:
            taken.add(cluster)
        return (cluster, state, reason, best, margin)

    def fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(f.user_id, f.face_id, f.photo_id, *self.assign(f)) for f in rows.sort_values(["photo_id", "face_index", "face_id"]).itertuples(index=False)]
        return pd.DataFrame(out, columns=COLUMNS).astype({"cluster_id": "Int64", "best_score": "float64", "margin": "float64"})


def _narrow(faces: DataFrame) -> DataFrame:
    return faces.select("user_id", "face_id", "photo_id", "face_index", "quality_score", "yaw_ratio", "restricted", "v")


def replay(faces: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """All photos of each tenant in order, from an empty gallery. The order is the operator, so a tenant is one fold."""
    return _narrow(faces).groupBy("user_id").applyInPandas(lambda rows: Gallery(t).fold(rows), OUT)


def stream(faces: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The same over a stream: a tenant's gallery is its state, so each batch goes on where the last one ended."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Gallery(t)
        if state.exists:
            own.__dict__.update(pickle.loads(state.get[0]))
        rows = pd.concat(list(batches))
        out = own.fold(rows)
        state.update((pickle.dumps({"sets": own.sets, "vectors": own.vectors, "in_photo": own.in_photo}),))
        yield out

    return _narrow(faces).groupBy("user_id").applyInPandasWithState(step, OUT, "gallery binary", "append", "NoTimeout")
