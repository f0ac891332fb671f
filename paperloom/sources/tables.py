"""Stored tables as DataFrames."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions.vector import as_vector, parse_vector


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of an input that has fewer splits than there are cores.

    Text analysis costs far more than moving a small input; a table with enough splits
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def vector_table(
    df: DataFrame, groups: list[str] | None = None, *, group: str = "group_id",
    vector: str = "embedding",
) -> DataFrame:
    """Vectors as ``array<double>``; the group filter reaches the scan and its partitions."""
    chosen = df if groups is None else df.where(F.col(group).isin(*groups))
    text = dict(df.dtypes)[vector] == "string"
    read = parse_vector(F.col(vector)) if text else as_vector(F.col(vector))
    return chosen.withColumn(vector, read)
