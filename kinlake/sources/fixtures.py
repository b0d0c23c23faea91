"""Entity tables derived from the `embeddings` and `events` test tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.functions.vector import norm
from kinlake.operators.exemplars import quality_exemplars

BASE_DATE = "2024-01-01"


def faces(spark: SparkSession, sf_dir: str, tight: bool = False) -> DataFrame:
    """A mixture of each vector with its label's first one, so that groups exist; all operands are doubles. tight: closer groups, and one face in a photo."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    anchors = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("a"))  # a row for each label
    low, step = (0.75, 0.05) if tight else (0.45, 0.1)
    w = F.lit(low) + F.lit(step) * F.pmod("vec_id", F.lit(5))
    digit = F.pmod("vec_id", F.lit(10))
    found = e.join(anchors, "label").withColumn("w", w)
    photo = F.expr("vec_id div 3")
    found = found.select(
        (photo % 4).alias("user_id"),
        F.col("vec_id").alias("face_id"),
        (F.col("vec_id") if tight else photo).alias("photo_id"),
        (F.col("vec_id") % 3).alias("face_index"),
        (F.col("label") * 2 + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("home"),
        (F.col("vec_id") * 37 % 101 / F.lit(100.0)).alias("quality_score"),
        ((F.col("vec_id") * 53 % 141 - 70) / F.lit(100.0)).alias("yaw_ratio"),
        F.when(digit == 0, "ambiguous").when(digit == 1, "unassigned").when(digit == 2, "manual").otherwise("confirmed").alias("assignment_state"),
        F.zip_with("a", "e", lambda a, b: F.col("w") * a + F.sqrt(1 - F.col("w") * F.col("w")) * b).alias("v"),
    )
    member = F.col("assignment_state").isin("confirmed", "manual")
    return found.select(
        "*",
        F.when(member, F.col("home")).alias("cluster_id"),
        (F.abs("yaw_ratio") >= 0.6).alias("restricted"),
        (F.col("assignment_state") == "manual").alias("is_manual"),
        norm(F.col("v")).alias("norm"),
    )


def all_members(found: DataFrame) -> DataFrame:
    """The same faces, each a confirmed member of its home cluster."""
    return found.withColumn("cluster_id", F.col("home")).withColumn("assignment_state", F.lit("confirmed")).withColumn("is_manual", F.lit(False))


def exemplars(found: DataFrame) -> DataFrame:
    return quality_exemplars(found)


def clusters(found: DataFrame) -> DataFrame:
    """A row for each home cluster, with its member count and dates counted from BASE_DATE."""
    counts = found.groupBy("user_id", F.col("home").alias("cluster_id")).agg(F.count_if(F.col("cluster_id").isNotNull()).cast("int").alias("face_count"), F.bool_or("is_manual").alias("has_manual_correction"))
    return counts.select(
        "user_id",
        "cluster_id",
        "face_count",
        (F.col("cluster_id") % 5 == 0).alias("is_user_confirmed"),
        "has_manual_correction",
        F.date_add(F.lit(BASE_DATE).cast("date"), F.col("cluster_id").cast("int")).alias("created_at"),
        F.date_add(F.lit(BASE_DATE).cast("date"), (F.col("cluster_id") % 60).cast("int")).alias("last_updated_at"),
        F.lit(None).cast("long").alias("merged_into"),
    )


def cannot_links(found: DataFrame) -> DataFrame:
    pairs = found.select("user_id", F.expr("home div 2").alias("label")).distinct().where("label % 3 = 0")
    return pairs.select("user_id", (F.col("label") * 2).alias("cluster_a_id"), (F.col("label") * 2 + 1).alias("cluster_b_id"))


def photo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a completed photo."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


STARTED = "2024-01-01 00:00:00"


def photos(found: DataFrame) -> DataFrame:
    """A row for each photo: a quarter each failed and under way (begun photo_id seconds after STARTED), the rest completed."""
    i = F.col("photo_id")
    rows = found.select("user_id", "photo_id").distinct()
    state = F.when(i % 4 == 1, "processing").when(i % 4 == 2, "failed").otherwise("completed")
    began = F.timestamp_seconds(F.unix_timestamp(F.lit(STARTED)) + i)
    return rows.select(
        "user_id",
        "photo_id",
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/p"), i.cast("string"), F.lit(".jpg")).alias("image_path"),
        (800 + i % 100).cast("int").alias("image_width"),
        (600 + i % 50).cast("int").alias("image_height"),
        state.alias("processing_status"),
        F.when(state != "processing", began).alias("processed_at"),
        F.lit("m1").alias("embedding_model_version"),
        F.lit("c1").alias("config_version"),
        F.when(state == "failed", F.lit("no face")).alias("error_message"),
        F.when(state == "processing", began).alias("processing_started_at"),
        F.when(state != "failed", F.concat(F.lit("t"), i.cast("string"))).alias("processing_token"),
        F.lit(1).alias("processing_attempts"),
    )


def suggestions(found: DataFrame) -> DataFrame:
    """A merge suggestion for each stored pair of clusters; every third tenant's are resolved already, and clusters that 9 divides give ids of the old form."""
    pairs = cannot_links(found)
    a, b = F.col("cluster_a_id").cast("string"), F.col("cluster_b_id").cast("string")
    old = F.concat(F.lit("merge_"), a)
    return pairs.select(
        "user_id",
        F.when(F.col("cluster_a_id") % 9 == 0, old).otherwise(F.concat(F.lit("merge_x"), a)).alias("suggestion_id"),
        F.lit("merge").alias("suggestion_type"),
        F.sort_array(F.array(a, b)).alias("cluster_ids"),
        F.when(F.col("user_id") % 3 == 2, "rejected").otherwise("pending").alias("status"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(STARTED)) + F.col("cluster_a_id")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def lifecycle(found: DataFrame) -> DataFrame:
    """A row for all tenants but the first: as many photos as it has, and for odd ones a consolidation that began user_id hours after STARTED."""
    rows = found.where("user_id > 0").groupBy("user_id").agg(F.count_distinct("photo_id").alias("n"))
    hours = F.timestamp_seconds(F.unix_timestamp(F.lit(STARTED)) + F.col("user_id") * 3600)
    odd = F.col("user_id") % 2 == 1
    return rows.select(
        "user_id",
        F.col("n").cast("int").alias("photos_since_consolidation"),
        hours.alias("last_photo_completed_at"),
        F.lit(None).cast("timestamp").alias("last_consolidated_at"),
        F.when(odd, hours).alias("count_due_since"),
        F.when(odd, hours).alias("consolidation_started_at"),
        F.when(odd, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("consolidation_token"),
        F.when(odd, 1).otherwise(0).alias("consolidation_attempts"),
        F.lit("old").alias("last_consolidation_error"),
        hours.alias("last_consolidation_error_at"),
    )
