"""Spherical k-means and medoids for many keys at once.

A key with up to ``task_rows`` vectors (a checked bound) is clustered inside one task,
all rounds in one pass.  A larger key is cut into blocks of ``block_rows`` vectors; each
round broadcasts the centroids, adds up one partial sum per task and cluster and brings the
new centroids back, so no task ever sees the whole key and the driver holds centroids only,
at most about ``CENTROID_BYTES`` at a time: more keys go in batches.  Both ways start from
the same members and apply the same rule, so they give the same clusters.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from paperloom import constants as C
from paperloom.functions.vector import dot
from paperloom.operators.pooling import plan_segments, pool_segments, sum_vectors
from paperloom.session import write_through

#: centroids are rounded before they are compared, so that sums added in another order agree
CENTROID_DIGITS = 12
CENTROID_BYTES = 32 << 20         # centroids of large keys that are moved together


def prototype_count(n: Column) -> Column:
    return F.least(F.lit(C.MAX_PROTOTYPES), F.greatest(F.lit(2), F.floor(n / C.PROTOTYPE_RATIO))).cast("int")


def segment_count(n: Column) -> Column:
    return F.least(F.lit(C.CLUSTERED_SEGMENTS), F.greatest(F.lit(2), F.floor(n / 5))).cast("int")


def _rows(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the most similar centroid; the first wins ties and nothing beats -1."""
    return np.argmax(np.maximum(points @ centroids.T, -1.0), axis=1)


def _moved(sums: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Unit sums; an empty or cancelled cluster keeps its centroid."""
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.where(length > 0, np.round(sums / np.where(length > 0, length, 1.0), CENTROID_DIGITS), old)


def _cluster_sums(points: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    dim = points.shape[1]
    cells = (chosen[:, None] * dim + np.arange(dim)).ravel()
    return np.bincount(cells, points.ravel(), k * dim).reshape(k, dim)


def start_order(*identity: str) -> list[Column]:
    """Fixed order in which members become first centroids."""
    return [F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in identity])), *map(F.col, identity)]


def kmeans(
    points: DataFrame, keys: list[str], identity: str, *, k: Column, vector: str = "embedding",
    iterations: int = C.KMEANS_ITERATIONS, dim: int, task_rows: int = 20_000,
    block_rows: int = 4_096, count: DataFrame | None = None,
) -> DataFrame:
    """(keys, identity, cluster) after at most ``iterations`` rounds.

    ``k`` is an expression over the key's row count ``n``.  The rounds stop early when
    nothing moves any more, which later rounds could not change.
    """
    plain = points.select(*keys, identity, F.col(vector).alias("_v"))
    sizes = count if count is not None else plain.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.select(*keys, "n", F.least(k, F.col("n")).cast("int").alias("_k"))
    fields = [plain.schema[c] for c in [*keys, identity]]
    schema = StructType([*fields, StructField("cluster", IntegerType())])

    hashed, *_ = start_order(*keys, identity)
    small = plain.join(sizes.where(F.col("n") <= task_rows), keys).withColumn("_h", hashed)

    def in_task(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), (identity, "ascending")])
        vectors, size = _rows(group.column("_v")), group.column("_k")[0].as_py()
        centroids = vectors[:size].copy()
        for _ in range(iterations):
            moved = _moved(_cluster_sums(vectors, _closest(vectors, centroids), size), centroids)
            if np.array_equal(moved, centroids):
                break
            centroids = moved
        cluster = pa.array(_closest(vectors, centroids), pa.int32())
        return group.select([*keys, identity]).append_column("cluster", cluster)

    done = small.groupBy(*keys).applyInArrow(in_task, schema)
    large = sizes.where(F.col("n") > task_rows)
    if large.isEmpty():
        return done
    spread = _kmeans_in_blocks(plain, large, keys, identity, iterations, dim, block_rows, schema)
    return done.unionByName(spread)


def _kmeans_in_blocks(plain, large, keys, identity, iterations, dim, block_rows, schema):
    large = write_through(large.withColumn("_kid", F.monotonically_increasing_id()))
    total, most = large.agg(F.sum("_k"), F.max("_k")).first()  # as a constant, the latter limits the window before the shuffle
    batches = max(1, math.ceil(total * dim * 8 / CENTROID_BYTES))
    dealt = F.pmod(F.xxhash64("_kid"), F.lit(batches)).cast("int").alias("_b")
    members = plain.join(large, keys)
    order = Window.partitionBy(*keys).orderBy(*start_order(*keys, identity))
    first = (
        members.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= most).where(F.col("_r") <= F.col("_k"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_r", "_v")))
    start = write_through(first.groupBy("_kid").agg(F.transform(ordered, lambda c: c["_v"]).alias("_c")).select("_kid", "_c", dealt))

    blocks = members.withColumn(
        "_block", F.pmod(F.xxhash64(identity), F.ceil(F.col("n") / block_rows).cast("long"))
    )
    packed_schema = StructType(
        [plain.schema[c] for c in keys]
        + [StructField("_kid", LongType()), StructField("_ids", ArrayType(plain.schema[identity].dataType)),
           StructField("_m", BinaryType())]
    )

    def pack(group: pa.Table) -> pa.Table:
        head = group.slice(0, 1).select([*keys, "_kid"])
        members = group.column(identity).combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
        matrix = pa.array([_rows(group.column("_v")).tobytes()], pa.binary())
        return head.append_column("_ids", ids).append_column("_m", matrix)

    packed = blocks.groupBy(*keys, "_block").applyInArrow(pack, packed_schema)
    packed = write_through(packed.select("*", dealt))
    clustered = []
    for b in range(batches):
        part, known = packed.where(F.col("_b") == b), _matrices(start.where(F.col("_b") == b).toArrow(), dim)
        if known:
            clustered.append(_assigned(part, _settled(part, known, iterations, dim), keys, identity, dim, schema))
    return reduce(DataFrame.unionByName, clustered)


def _matrices(table: pa.Table, dim: int) -> dict[int, np.ndarray]:
    """Centroids per key number, from rows that hold them as a list of vectors."""
    lists = table.column("_c").combine_chunks()
    return {
        kid: lists[row].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for row, kid in enumerate(table.column("_kid").to_pylist())
    }


def _settled(packed: DataFrame, known: dict, iterations: int, dim: int) -> dict[int, np.ndarray]:
    """Centroids after the rounds. A round is one job: a task adds up all its blocks, and only keys that moved go on."""
    schema = StructType([
        StructField("_kid", LongType()), StructField("cluster", IntegerType()), StructField("_s", ArrayType(DoubleType()))])
    context, moving = packed.sparkSession.sparkContext, dict(known)
    for _ in range(iterations):
        shared = context.broadcast(moving)

        def partial_sums(batches, shared=shared):
            sums = {}
            for batch in batches:
                for row, kid in enumerate(batch.column("_kid").to_pylist()):
                    centroids = shared.value.get(kid)
                    if centroids is not None:
                        vectors = np.frombuffer(batch.column("_m")[row].as_buffer()).reshape(-1, dim)
                        added = _cluster_sums(vectors, _closest(vectors, centroids), len(centroids))
                        sums[kid] = sums[kid] + added if kid in sums else added
            for kid, total in sums.items():
                used = np.flatnonzero((total != 0).any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), kid)), pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))],
                    ["_kid", "cluster", "_s"])

        parts = packed.select("_kid", "_m").mapInArrow(partial_sums, schema)
        summed = sum_vectors(parts, ["_kid", "cluster"], dim, "_s").select("_kid", "cluster", "_sum").toArrow()
        shared.destroy()
        sums = {kid: np.zeros_like(c) for kid, c in moving.items()}
        vectors = _rows(summed.column("_sum")) if summed.num_rows else ()
        for kid, cluster, vector in zip(summed.column("_kid").to_pylist(), summed.column("cluster").to_pylist(), vectors):
            sums[kid][cluster] = vector
        moved = {kid: _moved(sums[kid], c) for kid, c in moving.items()}
        moving = {kid: c for kid, c in moved.items() if not np.array_equal(c, moving[kid])}
        known = {**known, **moving}
        if not moving:
            break
    return known


def _assigned(packed: DataFrame, known: dict, keys: list[str], identity: str, dim: int, schema: StructType) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(known)

    def assign(batches):
        for batch in batches:
            for row, kid in enumerate(batch.column("_kid").to_pylist()):
                vectors = np.frombuffer(batch.column("_m")[row].as_buffer()).reshape(-1, dim)
                ids = batch.column("_ids")[row].values
                head = pa.Table.from_batches([batch]).select(keys).take([row] * len(ids))
                head = head.append_column(identity, ids)
                chosen = pa.array(_closest(vectors, shared.value[kid]), pa.int32())
                yield from head.append_column("cluster", chosen).to_batches()

    return packed.mapInArrow(assign, schema)


def nearest_centroid(
    points: DataFrame, centroids: DataFrame, keys: list[str], identity: str, *,
    vector: str = "embedding", cluster: str = "cluster",
) -> DataFrame:
    """Most similar centroid of the point's own key; the smaller cluster wins ties.

    Every key has a handful of centroids, so they travel as one array per key and each
    point is compared without a row per pair.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col(vector).alias("v"))))
    known = centroids.groupBy(*keys).agg(listed.alias("_known"))
    scored = points.join(known, keys).withColumn(
        "_best",
        F.array_min(
            F.transform(
                "_known",
                lambda k: F.struct(
                    (-F.greatest(dot(F.col(vector), k["v"]), F.lit(-1.0))).alias("s"), k["c"].alias("c")
                ),
            )
        ),
    )
    return scored.select(
        *keys, identity, F.col("_best.c").alias(cluster), (-F.col("_best.s")).alias("similarity")
    )


def medoids(
    points: DataFrame, keys: list[str], identity: str, dim: int, vector: str = "embedding", sums: DataFrame | None = None,
) -> DataFrame:
    """Member with the largest summed similarity to the other members of its key.

    The sum over all others is x . S - x . x with S the key's vector sum, so the cost is
    linear.  The first member wins ties, and sums up to -1 all count as ties.  ``sums``, if kept, are those of the keys.
    """
    totals = (sum_vectors(points, keys, dim, vector) if sums is None else sums).select(*keys, F.col("_n").alias("n_members"), "_sum")
    v = F.col(vector)
    scored = points.join(totals, keys).withColumn(
        "_score", F.round(dot(v, F.col("_sum")) - dot(v, v), 9)
    )
    rank = F.struct(-F.greatest(F.col("_score"), F.lit(-1.0)), F.col(identity))
    best = F.min_by(F.struct(identity, vector, "_score"), rank).alias("_best")
    return scored.groupBy(*keys).agg(best, F.any_value("n_members").alias("n_members")).select(
        *keys, F.col(f"_best.{identity}"), F.col(f"_best.{vector}"),
        F.col("_best._score").alias("score"), "n_members",
    )


def group_prototypes(
    segments: DataFrame, identity: str, dim: int, *, group: str = "group_id", **options
) -> DataFrame:
    """(group, proto_index, identity, embedding): up to 20 medoids per group.

    A group of up to three segments keeps them all.
    """
    sizes = segments.groupBy(group).agg(F.count("*").alias("n"))
    few = segments.join(sizes.where(F.col("n") <= 3), group).select(group, identity, "embedding")
    few = few.withColumn("cluster", F.lit(None).cast("int"))
    many_sizes = sizes.where(F.col("n") > 3)
    many = segments.join(many_sizes, group, "left_semi").select(group, identity, "embedding")
    clusters = kmeans(
        many, [group], identity, k=prototype_count(F.col("n")), dim=dim, count=many_sizes, **options
    )
    chosen = medoids(many.join(clusters, [group, identity]), [group, "cluster"], identity, dim)
    found = few.unionByName(chosen.select(group, identity, "embedding", "cluster"))
    place = Window.partitionBy(group).orderBy("cluster", identity)
    return found.withColumn("proto_index", F.row_number().over(place) - 1).select(
        group, "proto_index", identity, "embedding"
    )


def build_segments(chunks: DataFrame, dim: int, **options) -> DataFrame:
    """(doc_id, segment_index, chunk_indices, embedding) for every document.

    Contiguous runs up to 24 chunks, clusters beyond; clusters are numbered densely.
    """
    planned = plan_segments(chunks.where(F.col("embedding").isNotNull()))
    runs = pool_segments(planned.where(F.col("segment_index").isNotNull()), ["doc_id"], dim)
    big = planned.where(F.col("segment_index").isNull()).drop("segment_index")
    clusters = kmeans(
        big, ["doc_id"], "chunk_index", k=segment_count(F.col("n")), dim=dim, **options
    ).withColumnRenamed("cluster", "segment_index")
    pooled = pool_segments(big.join(clusters, ["doc_id", "chunk_index"]), ["doc_id"], dim)
    dense = Window.partitionBy("doc_id").orderBy("segment_index")
    pooled = pooled.withColumn("segment_index", F.row_number().over(dense) - 1)
    return runs.unionByName(pooled)
