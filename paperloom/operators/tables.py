"""Maintenance of the stored tables: replace, upsert, cascade, buffer and counters.

Each function takes table snapshots and returns the next snapshot.
"""

from pyspark.sql import DataFrame, Window, functions as F

from paperloom import constants as C


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key does not occur in ``new``."""
    touched = new.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(new)


def replace_documents(state: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Documents upserted; their chunks and segments deleted and written anew."""
    ids = batch["documents"].select("doc_id").distinct()
    result = {"documents": replace_by(state["documents"], batch["documents"], ["doc_id"])}
    for name in ("chunks", "segments"):
        kept = state[name].join(ids, "doc_id", "left_anti")
        result[name] = kept.unionByName(batch[name])
    return result


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the greatest version; a task sends one row per key at most."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in version))
    ranked = df.withColumn("_r", F.row_number().over(newest))
    return ranked.where(F.col("_r") == 1).select(*df.columns)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def update_documents(
    state: dict[str, DataFrame], updates: DataFrame, children: tuple = ("chunks", "segments", "buffer")
) -> dict[str, DataFrame]:
    """Optional-field update: null leaves a value; a new group is copied to the children."""
    fields = [c for c in updates.columns if c != "doc_id"]
    renamed = updates.select("doc_id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    documents = state["documents"]
    merged = documents.join(renamed, "doc_id", "left")
    result = {
        "documents": merged.select(
            *[
                F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c)
                for c in documents.columns
            ]
        )
    }
    if "group_id" in fields:
        moved = updates.where(F.col("group_id").isNotNull()).select(
            "doc_id", F.col("group_id").alias("_new_group")
        )
        for name in children:
            child = state[name]
            joined = child.join(moved, "doc_id", "left")
            joined = joined.withColumn("group_id", F.coalesce("_new_group", "group_id"))
            result[name] = joined.select(*child.columns)
    return result


def delete_documents(state: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete documents and everything that refers to them."""
    gone = ids.select("doc_id").distinct()
    return {name: table.join(gone, "doc_id", "left_anti") for name, table in state.items()}


def refresh_buffer(buffer: DataFrame, segments: DataFrame) -> DataFrame:
    """The documents' old buffer rows, of any group, give way to their new segments."""
    return replace_by(buffer, segments.select(*buffer.columns), ["doc_id"])


def buffered_documents(buffer: DataFrame) -> DataFrame:
    return buffer.groupBy("group_id").agg(F.countDistinct("doc_id").alias("n_buffered"))


def refresh_doc_count(groups: DataFrame, documents: DataFrame) -> DataFrame:
    counts = documents.groupBy("group_id").agg(F.count("*").alias("_n"))
    return (
        groups.drop("doc_count").join(counts, "group_id", "left")
        .withColumn("doc_count", F.coalesce("_n", F.lit(0))).drop("_n")
    )


def update_proto_count(groups: DataFrame, prototypes: DataFrame) -> DataFrame:
    counts = prototypes.groupBy("group_id").agg(F.count("*").alias("_n"))
    return (
        groups.drop("proto_count").join(counts, "group_id", "left")
        .withColumn("proto_count", F.coalesce("_n", F.lit(0))).drop("_n")
    )


def recompute_policy(
    groups: DataFrame, buffer: DataFrame, prototypes: DataFrame, segments: DataFrame,
    min_docs: int = C.BUFFER_TRIGGER,
) -> DataFrame:
    """(group_id, n_buffered, has_prototypes, has_segments, needs_recompute)."""
    asked = groups.select("group_id").distinct()

    def of_groups(table: DataFrame) -> DataFrame:
        return table.join(asked, "group_id", "left_semi")

    def present(table: DataFrame, name: str) -> DataFrame:
        return of_groups(table).select("group_id").distinct().withColumn(name, F.lit(True))

    joined = (
        asked.join(buffered_documents(of_groups(buffer)), "group_id", "left")
        .join(present(prototypes, "has_prototypes"), "group_id", "left")
        .join(present(segments, "has_segments"), "group_id", "left")
        .na.fill(0, ["n_buffered"])
        .na.fill(False, ["has_prototypes", "has_segments"])
    )
    due = (F.col("n_buffered") >= min_docs) | ~F.col("has_prototypes")
    return joined.withColumn("needs_recompute", due & F.col("has_segments"))


def replace_prototypes(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by(old, new.select(*old.columns), ["group_id"])


def clear_buffer(buffer: DataFrame, groups: DataFrame) -> DataFrame:
    return buffer.join(groups.select("group_id").distinct(), "group_id", "left_anti")


def regrouped(old_documents: DataFrame, new_documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Groups that lost a document to another one: (group_id, n_moved, has_segments).

    ``segments`` is the table after the move; a group without any loses its prototypes.
    """
    now = new_documents.select("doc_id", F.col("group_id").alias("_now"))
    moved = old_documents.join(now, "doc_id").where(
        F.col("group_id").isNotNull() & ~F.col("group_id").eqNullSafe(F.col("_now"))
    )
    losers = moved.groupBy("group_id").agg(F.count("*").alias("n_moved"))
    left = segments.join(losers, "group_id", "left_semi").select("group_id").distinct()
    left = left.withColumn("has_segments", F.lit(True))
    return losers.join(left, "group_id", "left").na.fill(False, ["has_segments"])


def cached_vectors(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached query vector per document, null when there is none."""
    return documents.join(cache.select("doc_id", "embedding"), "doc_id", "left")
