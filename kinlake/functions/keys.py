"""Identifiers, versions, pairs and request predicates."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlake.config import BOOTSTRAP_TENANT, LEGACY_TENANT, LEGACY_VERSION


def version_of(v: Column) -> Column:
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(LEGACY_VERSION))


def compatible(a: Column, b: Column) -> Column:
    a, b = version_of(a), version_of(b)
    return (a == LEGACY_VERSION) | (b == LEGACY_VERSION) | (a == b)


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ids in order; equal ids raise."""
    check = F.when(a == b, F.raise_error(F.lit("a cluster can't be paired with itself")))
    return F.coalesce(check.cast("string"), F.least(a, b)), F.greatest(a, b)


def suggestion_id(kind: str, cluster_ids: Column) -> Column:
    """kind_ and 12 hex digits of the SHA-1 of the sorted ids as JSON."""
    listed = F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.sort_array(cluster_ids), lambda x: F.concat(F.lit('"'), x, F.lit('"')))), F.lit("]"))
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(listed.cast("binary")), 1, 12))


def legacy_suggestion(suggestion_id_: Column) -> Column:
    return suggestion_id_.rlike("^(merge|split)_[0-9]+$")


def config_version(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()[:12]


def normal_path(path: Column, root: str = "/") -> Column:
    """Trimmed; URLs as they are, a local path absolute (from root) without empty, . and .. steps; null for null."""
    trimmed = F.trim(path)
    whole = F.when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), trimmed))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    up = lambda done, s: F.when(s != "..", F.concat(done, F.array(s))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    local = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))
    return F.when(F.instr(trimmed, "://") > 0, trimmed).otherwise(local)


def valid_tenant(user_id: Column) -> Column:
    t = F.trim(user_id)
    return (F.length(t) > 0) & (F.length(t) <= 256) & ~t.rlike("[\\x00-\\x1f\\x7f]") & ~t.isin(LEGACY_TENANT, BOOTSTRAP_TENANT)


def retry_after(lease_s: int, age_s: Column) -> Column:
    return F.greatest(F.lit(1), (F.lit(lease_s) - age_s + 0.999).cast("int"))


def error_text(message: Column) -> Column:
    return F.substring(message, 1, 500)


def error_status(kind: Column, message: Column) -> Column:
    """HTTP status of a failure, by its kind and message."""
    return (
        F.when(kind.isin("in_progress", "lease_lost"), 409)
        .when((kind == "storage") & F.lower(message).contains("locked"), 503)
        .when(kind == "file_not_found", 422)
        .when(kind == "value", F.when(message.startswith("Unknown "), 404).when(message.contains("already bound"), 409).otherwise(400))
    )
