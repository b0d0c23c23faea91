"""Boxes and landmarks (F23 to F34), as column expressions on structs and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlake.functions.quality import turn_ratios


def crop(box: Column, width: Column, height: Column, pad: float = 0.3) -> Column:
    """box (x, y, width, height) with padding, kept within the image."""
    px, py = (box["width"] * pad).cast("int"), (box["height"] * pad).cast("int")
    return F.struct(
        F.greatest(F.lit(0), box["x"] - px).alias("x1"),
        F.greatest(F.lit(0), box["y"] - py).alias("y1"),
        F.least(width, box["x"] + box["width"] + px).alias("x2"),
        F.least(height, box["y"] + box["height"] + py).alias("y2"),
    )


def to_original(points: Column, crop_box: Column) -> Column:
    return F.transform(
        points,
        lambda p: F.struct(
            (p["x"] * (crop_box["x2"] - crop_box["x1"]) + crop_box["x1"]).alias("x"), (p["y"] * (crop_box["y2"] - crop_box["y1"]) + crop_box["y1"]).alias("y")
        ),
    )


def extent(points: Column) -> Column:
    """Bounding box, centre, floored size and diagonal of landmarks."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    w, h = F.greatest(x2 - x1, F.lit(1.0)), F.greatest(y2 - y1, F.lit(1.0))
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), w.alias("w"), h.alias("h"), F.hypot(w, h).alias("diagonal")
    )


def inside(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def iou(a: Column, b: Column) -> Column:
    over = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    both = over("x1", "x2") * over("y1", "y2")
    return both / F.greatest(area(a) + area(b) - both, F.lit(1.0))


def centre_distance(a: Column, b: Column) -> Column:
    """Distance of the centres of a and b (x1, y1, x2, y2), each axis in sizes of a."""
    w, h = F.greatest(a["x2"] - a["x1"], F.lit(1.0)), F.greatest(a["y2"] - a["y1"], F.lit(1.0))
    return F.hypot((b["x1"] + b["x2"] - a["x1"] - a["x2"]) / 2 / w, (b["y1"] + b["y2"] - a["y1"] - a["y2"]) / 2 / h)


def size_match(a: Column, b: Column) -> Column:
    side = lambda lo, hi: (F.greatest(a[hi] - a[lo], F.lit(1.0)), F.greatest(b[hi] - b[lo], F.lit(1.0)))
    (wa, wb), (ha, hb) = side("x1", "x2"), side("y1", "y2")
    return F.sqrt(F.least(wa, wb) / F.greatest(wa, wb) * F.least(ha, hb) / F.greatest(ha, hb))


def association(detection: Column, candidate: Column, nose: Column, well_formed: Column) -> Column:
    """0.55 IoU + 0.25 size + 0.20 / (1 + distance) where the candidate's centre and nose are in the detection; else null."""
    centre = inside((candidate["x1"] + candidate["x2"]) / 2, (candidate["y1"] + candidate["y2"]) / 2, detection)
    fits = well_formed & centre & inside(nose["x"], nose["y"], detection)
    return F.when(fits, 0.55 * iou(detection, candidate) + 0.25 * size_match(detection, candidate) + 0.20 / (1 + centre_distance(detection, candidate)))


def mesh_ratio(a: Column, b: Column) -> Column:
    """Median displacement of landmarks over the smaller diagonal; infinite for meshes of unlike size."""
    moved = F.sort_array(F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))
    n = F.size(moved)
    middle = (F.get(moved, F.floor((n - 1) / 2).cast("int")) + F.get(moved, F.floor(n / 2).cast("int"))) / 2
    smaller = F.greatest(F.least(extent(a)["diagonal"], extent(b)["diagonal"]), F.lit(1.0))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(middle / smaller)


# Landmark indices of eye corners, nose tip and mouth corners in a 478-point mesh.
LEFT_EYE, RIGHT_EYE, NOSE, LEFT_MOUTH, RIGHT_MOUTH = (33, 133), (362, 263), 1, 61, 291


def five_points(points: Column) -> Column:
    middle = lambda i, j: F.struct(((points[i]["x"] + points[j]["x"]) / 2).alias("x"), ((points[i]["y"] + points[j]["y"]) / 2).alias("y"))
    whole = lambda i: F.struct(points[i]["x"].cast("double").alias("x"), points[i]["y"].cast("double").alias("y"))
    return F.array(middle(*LEFT_EYE), middle(*RIGHT_EYE), whole(NOSE), whole(LEFT_MOUTH), whole(RIGHT_MOUTH))


def yaw_estimate(five: Column) -> Column:
    return turn_ratios(five[0], five[1], five[2])[0]


# The six points around each eye, from the outer corner, in the same mesh.
RIGHT_EYE_RING = (33, 159, 158, 133, 153, 145)
LEFT_EYE_RING = (362, 380, 374, 263, 386, 385)


def eye_rings(points: Column) -> tuple[Column, Column]:
    return tuple(F.array(*(points[i] for i in ring)) for ring in (RIGHT_EYE_RING, LEFT_EYE_RING))
