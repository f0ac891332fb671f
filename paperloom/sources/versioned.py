"""Tables as folders of row versions: a batch adds its rows and rewrites nothing.

``root/batch=N`` holds the rows of batch N, marked with their ``version``.  A row is
current when no later batch wrote its key, so replacing a row costs as much as the
batch, not the table.  Repeating a batch overwrites its own folder.  For tables that grow with
their history (results of a stream); tables that a stream reads back are ``sources.buckets``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.sources.snapshots import versions


def append_version(df: DataFrame, root: str, version: int) -> None:
    marked = df.withColumn("version", F.lit(version))
    marked.write.mode("overwrite").parquet(f"{root}/batch={version}")


def all_versions(
    spark: SparkSession, root: str, schema: str, before: int | None = None
) -> DataFrame:
    """Rows of every batch (before one), with ``version``."""
    paths = [f"{root}/batch={v}" for v in versions(spark, root, "batch") if before is None or v < before]
    typed = f"{schema}, version int"
    if not paths:
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).parquet(*paths)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """(key, version) of the last batch that wrote each key."""
    return rows.groupBy(key).agg(F.max("version").alias("version"))


def current(rows: DataFrame, key: str, marks: DataFrame | None = None) -> DataFrame:
    """Rows written by the last batch of their key; ``marks`` may come from a parent table."""
    return rows.join(newest(rows, key) if marks is None else marks, [key, "version"])
