"""Plain reads of the entity tables, for any number of requests at once (SC1 to SC12, SC20, A5, A6, U3, U5, IO12).

A request table holds what one caller would pass (user_id and a key), so one job answers all
callers of all tenants; each read is an equi-join on the tenant and the key, never a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.functions.keys import normal_path


def _asked(table: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    return table.join(asked.select("user_id", *keys).distinct(), ["user_id", *keys], "left_semi")


def photos_by_id(photos: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: user_id, photo_id."""
    return _asked(photos, asked, "photo_id")


def photos_by_path(photos: DataFrame, asked: DataFrame) -> DataFrame:
    """Photos whose path is a request's path once that is normalised; asked: user_id, image_path."""
    return _asked(photos, asked.withColumn("image_path", normal_path(F.col("image_path"))), "image_path")


def all_photos(photos: DataFrame, tenants: DataFrame) -> DataFrame:
    """asked: user_id."""
    return _asked(photos, tenants)


def faces_by_id(faces: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: user_id, face_id."""
    return _asked(faces, asked, "face_id")


def faces_by_cluster(faces: DataFrame, asked: DataFrame) -> DataFrame:
    """Faces of clusters, whatever their state; asked: user_id, cluster_id."""
    return _asked(faces.where("cluster_id is not null"), asked, "cluster_id")


def faces_by_photo(faces: DataFrame, asked: DataFrame) -> DataFrame:
    """Faces of photos, each photo's by their place in it; asked: user_id, photo_id."""
    return _asked(faces, asked, "photo_id").orderBy("user_id", "photo_id", "face_index", "face_id")


def faces_by_state(faces: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: user_id, assignment_state."""
    return _asked(faces, asked, "assignment_state")


def clusters_by_id(clusters: DataFrame, asked: DataFrame) -> DataFrame:
    """Clusters, tombstones included; asked: user_id, cluster_id."""
    return _asked(clusters, asked, "cluster_id")


def all_clusters(clusters: DataFrame, include_merged: bool = False) -> DataFrame:
    return clusters if include_merged else clusters.where("merged_into is null")


def suggestions_by_id(suggestions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: user_id, suggestion_id."""
    return _asked(suggestions, asked, "suggestion_id")


def cluster_faces(faces: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, cluster_id, faces): how many faces of any state each asked cluster has, 0 where there are none."""
    counted = faces.where("cluster_id is not null").groupBy("user_id", "cluster_id").agg(F.count("*").alias("faces"))
    return asked.select("user_id", "cluster_id").distinct().join(counted, ["user_id", "cluster_id"], "left").select("user_id", "cluster_id", F.coalesce("faces", F.lit(0)).alias("faces"))


def iso(t: Column) -> Column:
    """A timestamp as ISO text: without a fraction of a second where it is zero, else with six digits."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.date_format(t, "SSSSSS")))


def parsed(text: Column) -> Column:
    """ISO text as a timestamp; null or empty text is null, and text of another form is an error."""
    return F.to_timestamp(F.nullif(F.trim(text), F.lit("")))


def lifecycle_view(lifecycle: DataFrame) -> DataFrame:
    """A tenant's lifecycle as callers see it: times as text, and whether a consolidation is due or under way. lifecycle: as from consolidation_due()."""
    return lifecycle.select(
        "user_id",
        "photos_since_consolidation",
        iso(F.col("last_photo_completed_at")).alias("last_photo_completed_at"),
        iso(F.col("last_consolidated_at")).alias("last_consolidated_at"),
        F.col("due_reason").isNotNull().alias("consolidation_due"),
        "due_reason",
        iso(F.col("due_since")).alias("due_since"),
        F.col("consolidation_started_at").isNotNull().alias("consolidation_in_progress"),
        "last_consolidation_error",
    )


def table_counts(tables: dict[str, DataFrame], tenants: DataFrame) -> DataFrame:
    """(user_id, table, rows) for every tenant and table, zeros included."""
    out = None
    for name in sorted(tables):
        counted = tables[name].groupBy("user_id").agg(F.count("*").alias("rows"))
        one = tenants.select("user_id").distinct().join(counted, "user_id", "left").select("user_id", F.lit(name).alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def once(ids: Column) -> Column:
    """An array without repeats, in the order of first occurrence."""
    return F.array_distinct(ids)


def touched(sources: Column, target: Column) -> tuple[Column, Column]:
    """(all clusters that a move touches, the sources other than its target), each without repeats and in order."""
    return F.sort_array(F.array_union(sources, F.array(target))), F.sort_array(F.array_except(sources, F.array(target)))
