"""Neighbour lookups within a key, split so that one hot key fills many tasks.

A window over a whole key would put a third of a skewed table into one task.
Here the caller names a ``bucket`` that grows with the order (an hour, a block of
version numbers): the window runs per (key, bucket), and the one value needed from
the neighbouring bucket comes from a table with one row per (key, bucket).
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_neighbour(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
    *, bucket: Column,
) -> DataFrame:
    """Add ``out``: ``value`` of the previous row of the same key.

    A null key is a key of its own.  Rows whose order, and so whose bucket, is null come
    before all others of their key.
    """
    local = df.withColumn("_bucket", bucket)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = local.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("_edge")
    )
    places = [*keys, "_bucket"]
    carried = edges.select(
        *(F.col(c).alias(f"_of_{c}") for c in places), F.lag("_edge").over(across).alias("_carried")
    )
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in places))
    return (
        local.withColumn("_place", F.row_number().over(within))
        .withColumn("_near", F.lag(value).over(within))
        .join(carried, same)
        .withColumn(
            out, F.when(F.col("_place") == 1, F.col(f"_carried.{value}")).otherwise(F.col("_near"))
        )
        .drop("_bucket", "_place", "_near", "_carried", *(f"_of_{c}" for c in places))
    )



def with_late_neighbour(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, bucket: Column
) -> DataFrame:
    """Add ``out``, the text ``value`` of the previous row of the same key, and ``{out}_order``, its order columns.

    Like ``with_neighbour`` for long texts: one row per (key, bucket) carries the digest and the order of the bucket's last row.
    A bucket's first row whose digest differs then looks the text up; no other text leaves its bucket. Rows of a key differ
    in order; ``df`` is read again for the look-up.
    """
    def same(columns: list[str], marked: str) -> Column:
        return reduce(and_, (F.col(c).eqNullSafe(F.col(f"{marked}{c}")) for c in columns))

    places = [*keys, "_bucket"]
    local = df.withColumn("_bucket", bucket).withColumn("_digest", F.sha2(F.col(value).cast("binary"), 256))
    within = Window.partitionBy(*places).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    marks = local.select(*places, "_digest", *order)
    edges = marks.groupBy(*places).agg(
        F.max_by(F.struct("_digest", *order), F.struct(*order)).alias("_last"),
        F.min_by("_digest", F.struct(*order)).alias("_first"))
    carried = edges.select(*places, "_first", F.lag("_last").over(across).alias("_before")).where(F.col("_before").isNotNull())
    carried = carried.withColumn("_differs", ~F.col("_first").eqNullSafe(F.col("_before._digest")))
    wanted = carried.where("_differs").select(
        *(F.col(k).alias(f"_w_{k}") for k in keys), F.col("_bucket").alias("_w__bucket"),
        *(F.col(f"_before.{c}").alias(f"_w_{c}") for c in order if c not in keys))
    fetched = df.select(*keys, *(c for c in order if c not in keys), value).join(
        wanted, same([*keys, *(c for c in order if c not in keys)], "_w_"))
    fetched = fetched.groupBy(*(f"_w_{c}" for c in places)).agg(F.first(value).alias("_fetched"))
    borders = carried.select(*(F.col(c).alias(f"_of_{c}") for c in places), "_before", "_differs")
    first = F.col("_place") == 1
    own = F.when(~F.col("_differs"), F.col(value)).otherwise(F.col("_fetched"))
    return (
        local.withColumn("_place", F.row_number().over(within)).withColumn("_near", F.lag(value).over(within))
        .withColumn("_near_order", F.lag(F.struct(*order)).over(within))
        .join(borders, same(places, "_of_") & first, "left").join(fetched, same(places, "_w_") & first, "left")
        .withColumn(out, F.when(first, own).otherwise(F.col("_near")))
        .withColumn(f"{out}_order", F.when(
            first, F.when(F.col("_before").isNotNull(), F.struct(*(F.col(f"_before.{c}").alias(c) for c in order))))
            .otherwise(F.col("_near_order")))
        .drop("_bucket", "_digest", "_place", "_near", "_near_order", "_before", "_differs", "_fetched",
              *(f"_of_{c}" for c in places), *(f"_w_{c}" for c in places))
    )
