"""Exact nearest vectors with most of the stored side skipped.

Stored vectors are laid out by their nearest centroid, and within a cluster by rings of about equal size around it. The angle
between a query and a stored vector is at least the difference of their angles to the same centroid, so a block (a ring of a
cluster) whose best possible similarity is below a query's k-th best so far can't change the answer. Every query first searches the
few blocks that may be nearest, which gives that floor, then whatever blocks the floor leaves. Both passes are
scoped searches with blocks as groups, so hot blocks and many queries are spread as there.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from paperloom.functions.vector import as_vector, l2_normalize
from paperloom.operators.clustering import kmeans, start_order
from paperloom.operators.pooling import sum_vectors
from paperloom.operators.similarity import nearest
from paperloom.session import write_through

#: more than rounding to six decimals and the error of the angles can hide
SLACK = 2e-6


@dataclass(frozen=True)
class Layout:
    """``rows`` with their ``_block``; per block its cluster, least and greatest angle to the centroid, and row count."""

    rows: DataFrame
    centroids: np.ndarray
    blocks: np.ndarray
    cluster: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def best(self, vectors: np.ndarray) -> np.ndarray:
        """Best similarity that a row of each block can have with each vector."""
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(vectors @ self.centroids.T / length, -1, 1))[:, self.cluster]
        return np.cos(np.maximum(0, np.maximum(self.low - angle, angle - self.high)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lay_out(
    corpus: DataFrame, identity: str, dim: int, *, clusters: int = 256, rings: int = 8, sample_rows: int = 20_000, vector: str = "embedding",
) -> Layout:
    """The stored side, written once in order of its blocks. Vectors without a direction (null, zero) are left out: nothing finds them.

    The centroids come from ``sample_rows`` vectors at most, those with the smallest hash of their identity; every
    vector is assigned and measured. Centroids and block bounds are ``clusters`` times ``rings`` rows on the driver.
    """
    rows = corpus.withColumn("_v", as_vector(F.col(vector)))
    rows = rows.where(F.col("_v").isNotNull() & (F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x) > 0))
    unit = rows.select(F.lit(0).alias("_all"), identity, l2_normalize(F.col("_v")).alias("_u"))
    sample = write_through(unit.orderBy(*start_order(identity)).limit(sample_rows))
    assigned = kmeans(sample, ["_all"], identity, k=F.lit(clusters), vector="_u", dim=dim)
    means = sum_vectors(sample.join(assigned.drop("_all"), identity), ["cluster"], dim, "_u")
    found = [np.array(r["_sum"]) for r in means.orderBy("cluster").collect()]
    centroids = np.array([c / np.linalg.norm(c) if np.linalg.norm(c) else np.eye(dim)[0] for c in found]) if found else np.eye(dim)[:1]
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)
    columns = corpus.columns
    schema = StructType([*corpus.schema.fields, StructField("_c", IntegerType()), StructField("_angle", DoubleType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("_v"))
            cosine = v @ shared.value.T / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            own = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(own, pa.int32()), pa.array(angle)], [*columns, "_c", "_angle"])

    measured = write_through(rows.select(*columns, "_v").mapInArrow(placed, schema))
    steps = [k / rings for k in range(1, rings)]
    cuts = measured.groupBy("_c").agg(F.percentile_approx("_angle", steps).alias("_cuts")) if steps else measured.select(
        "_c", F.array().cast("array<double>").alias("_cuts")).distinct()
    ring = F.size(F.filter("_cuts", lambda cut: cut < F.col("_angle")))
    blocked = measured.join(F.broadcast(cuts.withColumnRenamed("_c", "_of")), F.col("_c") == F.col("_of")).withColumn(
        "_block", (F.col("_c") * rings + ring).cast("int"))
    stored = write_through(
        blocked.select(*columns, "_block", "_angle").repartitionByRange("_block", identity).sortWithinPartitions("_block", identity))
    bounds = stored.groupBy("_block").agg(
        F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("n")).orderBy("_block").collect()
    blocks = np.array([r["_block"] for r in bounds], int)
    return Layout(
        stored.drop("_angle"), centroids, blocks, blocks // rings,
        *(np.array([r[c] for r in bounds], float) for c in ("low", "high", "n")))


def _with_blocks(asked: DataFrame, key: str, layout: Layout, near: int, floor: float | None, later: bool) -> DataFrame:
    """Queries with the blocks to search: the ``near`` best at first, then all others that ``_floor`` leaves."""
    bounds = (layout.centroids, layout.blocks, layout.cluster, layout.low, layout.high, layout.count)
    shared = asked.sparkSession.sparkContext.broadcast(bounds)
    least = -np.inf if floor is None else floor
    schema = StructType([
        asked.schema[key], asked.schema["_v"], StructField("_blocks", ArrayType(IntegerType())), StructField("_rows", LongType())])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Layout(None, *shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            best = known.best(_matrix(batch.column("_v")))
            first = np.argsort(-best, axis=1, kind="stable")[:, :near]
            wanted = np.zeros(best.shape, bool)
            np.put_along_axis(wanted, first, True, axis=1)
            if later:
                floors = np.array(batch.column("_floor").to_pylist(), float)[:, None]
                wanted = ~wanted & (best + SLACK >= np.where(np.isnan(floors), least, floors))
            wanted &= best + SLACK >= least
            lists = [known.blocks[row].tolist() for row in wanted]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("_v"), pa.array(lists, pa.list_(pa.int32())), pa.array((wanted @ known.count).astype(np.int64))],
                [key, "_v", "_blocks", "_rows"])

    return asked.mapInArrow(chosen, schema)


def pruned_nearest(
    queries: DataFrame, layout: Layout, *, k: int, keys: list[str], min_similarity: float | None = None, near: int = 4,
    query_key: str = "query_id", vector: str = "embedding", **options,
) -> tuple[DataFrame, DataFrame]:
    """What ``nearest`` finds for distinct query keys, and ``compared``: per query, how many stored rows were looked at."""
    asked = queries.select(query_key, as_vector(F.col(vector)).alias("_v")).where(F.col("_v").isNotNull())
    asked = write_through(asked.where(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x) > 0))
    how = {"k": k, "keys": keys, "min_similarity": min_similarity, "vector": vector, "group": "_block", "scope": "_blocks", **options}

    def searched(scoped: DataFrame) -> DataFrame:
        return nearest(scoped.withColumnRenamed("_v", vector).drop("_rows"), layout.rows, **how).drop("rank")

    first = write_through(_with_blocks(asked, query_key, layout, near, min_similarity, False))
    hits = write_through(searched(first))
    floors = hits.groupBy(F.col(query_key).alias("_of")).agg(
        F.when(F.count("*") >= k, F.min("similarity")).cast("double").alias("_floor"))
    known = asked.join(floors, F.col(query_key) == F.col("_of"), "left").drop("_of")
    second = write_through(_with_blocks(known, query_key, layout, near, min_similarity, True))
    more = searched(second.where(F.size("_blocks") > 0))
    rank = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *keys)
    best = hits.unionByName(more).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    compared = first.select(query_key, "_rows").unionByName(second.select(query_key, "_rows")).groupBy(query_key).agg(
        F.sum("_rows").alias("n_rows"))
    return best, compared
