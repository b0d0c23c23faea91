"""Thresholds; every operator takes them as a parameter, with these as its defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Results depend on each of them.
    detection_confidence: float = 0.5
    weight_size: float = 0.35
    weight_blur: float = 0.35
    weight_pose: float = 0.20
    weight_eye: float = 0.10
    size_floor: float = 40.0
    size_reference: float = 150.0
    blur_reference: float = 300.0
    max_yaw: float = 0.6
    ear_closed: float = 0.15
    ear_open: float = 0.35
    hard_exclusion: float = 0.3
    exemplar_quality: float = 0.7
    top_k: int = 2
    quality_bucket: int = 3
    pose_bucket: int = 2
    match: float = 0.41
    ambiguous_band: float = 0.08
    sparse_margin: float = 0.05
    min_margin: float = 0.05
    admission_margin: float = 0.10
    restricted_mature: int = 8
    max_actions: int = 12
    mature_faces: int = 8
    fragment_ratio: float = 0.35
    bridge_support: int = 2
    bridge_high: int = 2
    bridge_strong: int = 2
    mutual_strong: int = 2
    split_group: int = 3
    coverage: float = 0.90
    every_photos: int = 50
    idle_hours: int = 24
    photo_lease_s: int = 300
    consolidation_lease_s: int = 1800
    visible_faces: int = 3
    prune_days: int = 30
    duplicate_mesh: float = 0.15

    @property
    def high_confidence(self) -> float:
        return self.match + self.min_margin

    @property
    def strong(self) -> float:
        return self.match + self.admission_margin

    @property
    def lower(self) -> float:
        return self.match - self.ambiguous_band


DEFAULT = Thresholds()
MEMBER_STATES = ("confirmed", "manual")
LEGACY_TENANT = "__legacy__"
BOOTSTRAP_TENANT = "__service_bootstrap__"
LEGACY_VERSION = "legacy_unknown"
