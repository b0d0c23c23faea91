"""Snapshots of the entity tables: parquet per table and tenant, and a manifest that names the current one.

A new snapshot is written beside the old one and becomes current when its manifest appears, which
is one rename to a name that nothing has yet: manifests are numbered and the highest is the
current one. Readers see all tables of one snapshot or of the other, and a writer that stops half
way leaves the last one current. Of two writers of one number the second fails. One writer at a
time is assumed all the same, since nothing else keeps one from building on an old snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.config import LEGACY_TENANT
from kinlake.model import KEYS, SCHEMA_VERSION, TABLES


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self) -> dict | None:
        found = self._numbers()
        if not found:
            return None
        path = f"{self.root}/manifests/{found[-1]:012d}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path).collect()))  # a few lines

    def create(self) -> None:
        """Empty tables, if there is no snapshot yet."""
        if self.manifest() is None:
            self.write({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def read(self, name: str) -> DataFrame:
        m = self.manifest()
        if m is None:
            raise ValueError("there is no snapshot")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{m['snapshot']}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Writes tables as the next snapshot; those not given are carried over."""
        old = self.manifest()
        name = f"snapshot-{uuid.uuid4().hex}"
        for t in TABLES:
            df = tables[t] if t in tables else self.read(t) if old else self.spark.createDataFrame([], TABLES[t])
            df.select(*self.spark.createDataFrame([], TABLES[t]).columns).write.partitionBy("user_id").parquet(f"{self.root}/{name}/{t}")
        text = json.dumps({"snapshot": name, "schema_version": SCHEMA_VERSION, "before": old and old["snapshot"]})
        number = (self._numbers() or [0])[-1] + 1
        p, fs = self._fs(f"{self.root}/manifests/{number:012d}.json")
        fs.mkdirs(p.getParent())
        fresh, _ = self._fs(f"{self.root}/manifests/.{name}")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(fresh, p):
            raise OSError(f"the manifest of {name} couldn't be put in place: another writer was there first")
        return name

    def delete_user(self, user_id: str) -> dict[str, int]:
        """Drops one tenant from all tables; returns how many rows each had."""
        now = {n: self.read(n) for n in TABLES}
        counts = {n: d.where(F.col("user_id") == user_id).count() for n, d in now.items()}
        self.write({n: d.where(F.col("user_id") != user_id) for n, d in now.items()})
        return counts


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Older tables in today's schema: version 5 had one tenant, version 6 lacked three columns of faces."""
    if version not in (5, 6, SCHEMA_VERSION):
        raise ValueError(f"Unknown schema version {version}")
    out = dict(tables)
    if version == 5:
        missing = {"photos", "faces", "clusters", "exemplars", "suggestions", "cannot_links"} - tables.keys()
        if missing:
            raise ValueError(f"tables are missing: {sorted(missing)}")
        out = {n: d.select(F.lit(LEGACY_TENANT).alias("user_id"), "*") for n, d in out.items()}
    if version < SCHEMA_VERSION and "faces" in out:
        added = {"detection_score": F.lit(None).cast("double"), "recognition_restricted": F.lit(False), "recognition_restriction_reason": F.lit(None).cast("string")}
        out["faces"] = out["faces"].select("*", *[c.alias(n) for n, c in added.items() if n not in out["faces"].columns])
    return out


def duplicate_keys(name: str, df: DataFrame) -> DataFrame:
    """Keys of a table that occur more than once."""
    return df.groupBy(*KEYS[name]).count().where("count > 1")
