"""Image files, and the boundary at which models are plugged in (IO7, F3, F35, X1 to X4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, path: str, most_bytes: int = 25_000_000) -> DataFrame:
    """(path, length, content) of files that are neither empty nor too large."""
    return spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= most_bytes)).select("path", "length", "content")


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian of a grey image, its border mirrored without the edge."""
    x = np.pad(grey.astype(float), 1, mode="reflect")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def network_input(pixels: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes to 3 x height x width values from -1 to 1."""
    return ((pixels.astype(np.float32) / 255 - 0.5) / 0.5).transpose(2, 0, 1)


# The five-point template of a 112 x 112 aligned face.
TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def similarity_transform(points: np.ndarray, target: np.ndarray = TEMPLATE) -> np.ndarray:
    """The 2 x 3 scale, turn and shift that brings points nearest to the template (least squares)."""
    mean_p, mean_t = points.mean(0), target.mean(0)
    p, t = points - mean_p, target - mean_t
    u, s, vt = np.linalg.svd(t.T @ p)
    sign = np.array([1.0, np.sign(np.linalg.det(u @ vt))])
    turn = (u * sign) @ vt
    scale = (s * sign).sum() / max((p * p).sum(), 1e-12)
    return np.column_stack([scale * turn, mean_t - scale * turn @ mean_p])


def infer(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], schema: str) -> DataFrame:
    """Runs a model over images: load() is called once in each task and gives a function from an image's bytes to rows of schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [{"path": p, **found} for p, c in zip(batch["path"], batch["content"], strict=True) for found in model(bytes(c))]
            if rows:
                yield pd.DataFrame(rows)

    return images.select("path", "content").mapInPandas(run, f"path string, {schema}")
