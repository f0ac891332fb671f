"""Seed groups with documents, shaped for the ingest job."""

from pyspark.sql import DataFrame, functions as F

from paperloom import constants as C


def seed_documents(seed: DataFrame) -> DataFrame:
    """``seed(group_id, group_name, path, title, source, body)`` to ingestible documents."""
    content = F.format_string(C.SEED_CONTENT, "title", "group_name", "source", "body")
    return seed.select(
        F.concat_ws(":", "group_id", "path").alias("doc_id"), F.col("path").alias("doc_path"),
        "group_id", "title", content.alias("content"),
    )


def seed_groups(seed: DataFrame) -> DataFrame:
    return seed.groupBy("group_id").agg(F.any_value("group_name").alias("group_name")).select(
        "group_id", "group_name",
        F.format_string(C.SEED_SUMMARY, "group_name").alias("group_summary"),
        F.lit(0).cast("long").alias("doc_count"), F.lit(0).cast("long").alias("proto_count"),
    )
