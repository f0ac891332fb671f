"""Debounce over a stored table: the last payload of every burst of a key."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom import constants as C


def debounce(
    df: DataFrame, key: str, ts: str, payload: str, *, tie: str, bucket: Column,
    gap: str = C.DEBOUNCE_GAP,
) -> DataFrame:
    """One row per burst: (key, started_at, sent_at, payload, n).

    A silence of exactly ``gap`` ends the burst.  Rows are ordered per (key, bucket), so a
    hot key fills many tasks; what crosses a bucket border comes from a table with one row
    per (key, bucket): whether its first event opens a burst, and else which burst is open.
    """
    silence = F.expr(f"INTERVAL {gap}")
    within = Window.partitionBy(key, "_bucket").orderBy(ts, tie)
    local = df.withColumn("_bucket", bucket).withColumn("_before", F.lag(ts).over(within))
    local = local.withColumn("_start", F.when(F.col(ts) >= F.col("_before") + silence, F.col(ts)))

    across = Window.partitionBy(key).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        local.groupBy(key, "_bucket")
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_start").alias("_inner"))
        .withColumn("_gone", F.lag("_last").over(across))
        .withColumn(
            "_opens",
            F.when(F.col("_gone").isNull() | (F.col("_first") >= F.col("_gone") + silence), F.col("_first")),
        )
        .withColumn("_open", F.max(F.greatest("_inner", "_opens")).over(earlier))
        .select(key, "_bucket", F.coalesce("_opens", "_open").alias("_open"))
    )
    running = F.max("_start").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        local.withColumn("_running", running).join(edges, [key, "_bucket"])
        .withColumn("started_at", F.coalesce("_running", "_open"))
    )
    return placed.groupBy(key, "started_at").agg(
        F.max(ts).alias("sent_at"),
        F.max_by(payload, F.struct(ts, tie)).alias(payload),
        F.count("*").alias("n"),
    )
