"""Quality scores and gates of a detected face (F1 to F11), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def size_score(height: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(height <= t.size_floor, 0.0).when(height >= t.size_reference, 1.0).otherwise((height - t.size_floor) / (t.size_reference - t.size_floor))


def blur_score(variance: Column, t: Thresholds = DEFAULT) -> Column:
    return clip01(variance / t.blur_reference)


def pose_score(yaw: Column, t: Thresholds = DEFAULT) -> Column:
    return clip01(1 - F.abs(yaw) / t.max_yaw)


def eye_aspect(p: Column) -> Column:
    """p: six points (x, y) around an eye, from its outer corner."""
    far = lambda i, j: F.hypot(p[i]["x"] - p[j]["x"], p[i]["y"] - p[j]["y"])
    return (far(1, 5) + far(2, 4)) / (2 * (far(0, 3) + 1e-6))


def eye_score(aspect: Column, t: Thresholds = DEFAULT) -> Column:
    return clip01((aspect - t.ear_closed) / (t.ear_open - t.ear_closed))


def eye_openness(left: Column, right: Column, t: Thresholds = DEFAULT) -> Column:
    """The score of the mean aspect of both eyes, each six points as for eye_aspect()."""
    return eye_score((eye_aspect(left) + eye_aspect(right)) / 2, t)


def turn_ratios(left_eye: Column, right_eye: Column, nose: Column) -> tuple[Column, Column]:
    """Yaw and pitch: how far the nose is off the middle of the eyes, in eye distances."""
    apart = F.hypot(right_eye["x"] - left_eye["x"], right_eye["y"] - left_eye["y"]) + 1e-6
    return (nose["x"] - (left_eye["x"] + right_eye["x"]) / 2) / apart, (nose["y"] - (left_eye["y"] + right_eye["y"]) / 2) / apart


def quality_score(height: Column, variance: Column, yaw: Column, aspect: Column, t: Thresholds = DEFAULT) -> Column:
    return t.weight_size * size_score(height, t) + t.weight_blur * blur_score(variance, t) + t.weight_pose * pose_score(yaw, t) + t.weight_eye * eye_score(aspect, t)


def gate_columns(height: Column, yaw: Column, quality: Column, t: Thresholds = DEFAULT) -> dict[str, Column]:
    """hard_excluded, exclusion_kind, restricted and exemplar_eligible; a face that only fails the pose floor is restricted."""
    low, small, turned = quality < t.hard_exclusion, height <= t.size_floor, F.abs(yaw) >= t.max_yaw
    excluded = low | small | turned
    return {
        "hard_excluded": excluded,
        "exclusion_kind": F.when(low, "quality").when(small, "size").when(turned, "pose"),
        "exclusion_reason": F.when(low, F.format_string(f"quality_score %.3f < {t.hard_exclusion}", quality))
        .when(small, F.format_string(f"face_height %.1f <= {t.size_floor}", height))
        .when(turned, F.format_string(f"abs(yaw_ratio) %.3f >= {t.max_yaw}", F.abs(yaw))),
        "restricted": turned & ~low & ~small,
        "restriction_reason": F.when(turned & ~low & ~small, "pose_floor_only"),
        "exemplar_eligible": ~excluded & (quality >= t.exemplar_quality),
    }
