"""Forms in which vectors and thresholds are kept elsewhere (IO9 to IO11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from kinlake.config import DEFAULT, Thresholds


def _vectors(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in content:
        yield part.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))


def _bytes(vector: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in vector:
        yield part.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decoded(content: Column) -> Column:
    """The vector that little-endian 32-bit floats stand for; null for null, and an error where bytes are left over."""
    return pandas_udf(_vectors, ArrayType(FloatType()))(content)


def encoded(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats; null for null."""
    return pandas_udf(_bytes, BinaryType())(vector)


def thresholds(path: str, base: Thresholds = DEFAULT) -> Thresholds:
    """Thresholds from a file of `name: value` lines; sections (a name without a value), comments and blank lines are passed over, and an unknown name is an error."""
    kinds, found = {f.name: type(f.default) for f in fields(Thresholds)}, {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, colon, value = line.split("#")[0].partition(":")
        if not colon or not value.strip():
            continue
        if name.strip() not in kinds:
            raise ValueError(f"unknown threshold {name.strip()!r} in {path}")
        found[name.strip()] = kinds[name.strip()](float(value))
    return replace(base, **found)


def model_paths(named: dict[str, str], root: str) -> dict[str, str]:
    """Model files by name: relative paths are taken from root, absolute ones and URLs stay."""
    return {k: v if "://" in v or v.startswith("/") else str(Path(root) / v) for k, v in named.items()}
