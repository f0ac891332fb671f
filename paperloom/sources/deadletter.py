"""Failed rows go to a quarantine table and can be run again later."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, failed rows)."""
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())


def with_destination(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "destination", F.when(F.col("error").isNull(), "normalized").otherwise("quarantine")
    )


def replay(quarantined: DataFrame, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run ``step`` again on quarantined input rows: (repaired rows, still failing rows)."""
    return split_errors(step(quarantined.drop("error")))
