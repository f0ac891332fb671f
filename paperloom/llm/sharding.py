"""Shards of near equal bytes: longest processing time first, over groups that stay together."""

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from paperloom.llm.common import free_name, numbered_rows
from paperloom.session import write_through

#: bundles and large groups together are at most about twice this many per shard
ITEMS_PER_SHARD = 256
#: rows numbered by one task
SLOT_ROWS = 100_000


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item -> shard: by falling size (ties: smaller item first), each to the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, item in sorted(((size, item) for item, size in items), key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def assign_shards(
    df: DataFrame, shards: int, *, size: str, group: str, order: str,
    items_per_shard: int = ITEMS_PER_SHARD, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add ``shard`` and ``slot`` (0, 1, ... without gaps in each shard) to every row.

    Rows with equal ``group`` share a shard; a null group is one group. Groups above
    total / (shards * items_per_shard) bytes are items of their own, at most that many; smaller
    ones join one of shards * items_per_shard bundles by hash, so that the heap on the driver
    sees a number of items that doesn't depend on the rows. Two runs give the same shards.
    An empty table stays empty. Slots follow a hash of the group, then ``order``.
    """
    spark, bundles = df.sparkSession, shards * items_per_shard
    bundle, shard, slot = (free_name(df, c) for c in ("bundle", "shard", "slot"))
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    rows = write_through(
        df.withColumn(bundle, F.pmod(F.xxhash64(key), F.lit(bundles)).cast("int"))
    )
    sizes = rows.groupBy(F.col(bundle).alias("bundle"), key.alias("member")).agg(F.sum(F.col(size)).alias("size"))
    sizes = write_through(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    single = F.col("size") * bundles > total
    big = sizes.where(single).select("member", "size").collect()
    rest = sizes.where(~single).groupBy("bundle").agg(F.sum("size").alias("size")).collect()
    big.sort(key=lambda row: row["member"])
    items = [(row["bundle"], row["size"]) for row in rest]
    items += [(bundles + k, row["size"]) for k, row in enumerate(big)]
    placed = schedule(items, shards)
    by_bundle = _table(spark, [(b, s) for b, s in placed.items() if b < bundles], "b__ int, s__ int")
    by_member = _table(
        spark, [(row["member"], placed[bundles + k]) for k, row in enumerate(big)], "m__ string, o__ int"
    )
    # both tables have at most shards * items_per_shard rows
    put = (
        rows.join(F.broadcast(by_member), key == F.col("m__"), "left")
        .join(F.broadcast(by_bundle), F.col(bundle) == F.col("b__"), "left")
        .withColumn(shard, F.coalesce("o__", "s__"))
    )
    n_rows = rows.count()
    parts = max(1, n_rows // (shards * slot_rows) + 1)
    part = F.pmod(F.xxhash64(F.col(order), key), F.lit(parts)).cast("int")
    put = put.drop("m__", "o__", "b__", "s__", bundle).withColumn("p__", part)
    counts = put.groupBy(F.col(shard).alias("of__"), F.col("p__").alias("op__")).agg(F.count("*").alias("n__"))
    # shards * parts rows, that is rows / slot_rows at most
    ahead = Window.partitionBy("of__").orderBy("op__").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("st__", F.coalesce(F.sum("n__").over(ahead), F.lit(0))).drop("n__")
    within = Window.partitionBy(shard, "p__").orderBy(F.col(order), key)
    return (
        put.withColumn("r__", F.row_number().over(within) - 1)
        .join(starts, (F.col(shard) == F.col("of__")) & (F.col("p__") == F.col("op__")))
        .withColumn(slot, F.col("st__") + F.col("r__"))
        .drop("of__", "op__", "p__", "r__", "st__")
    )


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes; equal texts stay together.

    Returns id, size (UTF-8 bytes of the text plus 16; a null text has none and counts as equal
    to an empty one), text_crc32, text_key, shard and slot. Repeated rows stay rows of one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("text_key"),
    )
    return assign_shards(digest, shards, size="size", group="text_key", order=id_col)


def write_shards(
    docs: DataFrame, path: str, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 100_000,
) -> None:
    """Write the documents, with their ``slot``, to one folder per ``shard`` (further underscores where names are taken).

    A shard's rows are written ``file_rows`` slots to a task, in order of their slots. Rows are joined with their place by a number of their own, so a
    text that fills a table meets no single task.
    """
    key = free_name(docs, "row_id")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    numbered = numbered_rows(docs, key)
    plain = numbered.select(F.col(key).alias("row_key"), F.col(text_col).alias("row_text"))
    placed = shard_documents(plain, shards, id_col="row_key", text_col="row_text").select(
        F.col("row_key").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = numbered.join(placed, key).drop(key)
    part = F.floor(F.col(slot) / file_rows)
    joined.repartition(shard, part).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
