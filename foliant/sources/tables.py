"""Tables of the given folder, and the catalogue's relations as views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the relations' clocks start, and the moment queries with a clock look from.
EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `ts` as a zoned timestamp and `k` out of props."""
    raw = table(spark, sf_dir, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers; created a minute apart."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.col("text").alias("ocr_text"),
        "lang",
        "source",
        (F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.col("doc_id") * 60)).alias("created_at"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as metadata records: quality stands for a finished layout, toxic for a flag of its own."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), "quality", "toxic")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the pages of a paper."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("page_text"), F.col("role").alias("model_name"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing jobs: an error failed, a view still runs, the rest are completed."""
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").otherwise("completed")
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("step"), status.alias("status"),
        F.col("ts").alias("created_at"), F.col("value").alias("duration"), F.col("k").alias("size_mb"), "props",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of duplicate checks."""
    e = events(spark, sf_dir)
    result = F.when(F.col("event_type").isin("click", "purchase"), "duplicate_found").when(F.col("event_type") == "error", "error").otherwise("no_duplicate")
    layer = F.when(F.col("event_type") == "click", "Level_0_File_Hash").when(F.col("event_type") == "purchase", "Level_1_Content_Hash").when(F.col("event_type") == "error", "Error").otherwise("No_Duplicate")
    return e.select(
        F.col("event_id").alias("detection_id"), (F.col("k") * 100_000).alias("file_size"), result.alias("detection_result"), layer.alias("detection_layer"),
        F.when(F.col("event_type").isin("click", "purchase"), F.col("user_id")).alias("duplicate_paper_id"), F.col("value").alias("total_processing_time"),
        F.when(F.col("k") % 2 == 0, F.col("value") / 2).alias("layer_0_time"), F.col("ts").alias("created_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
