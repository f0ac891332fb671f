"""Vectors pooled per key: means, weighted means and document segments.

Vectors are added as matrices in Arrow batches: a batch sends one partial sum per key, so
the cost per row grows with the width as the data does, and a hot key sends one row per batch.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from paperloom import constants as C
from paperloom.functions.vector import l2_normalize


def vector_sum(vector: str, dim: int, weight: str | None = None) -> Column:
    """Element-wise sum as an aggregate expression, for narrow vectors; ``weight`` is a SQL expression."""
    factor = f" * ({weight})" if weight else ""
    return F.expr("array(" + ", ".join(f"sum({vector}[{i}]{factor})" for i in range(dim)) + ")")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; a null vector adds nothing."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    if np.any((lengths != dim) & (lengths >= 0)):
        raise ValueError(f"Expected {dim}-dimensional embedding, got {lengths[(lengths != dim) & (lengths >= 0)][0]}.")
    rows = np.zeros((len(lengths), dim))
    rows[lengths == dim] = np.asarray(column.flatten().fill_null(0.0), float).reshape(-1, dim)
    return rows


def _lists(values: np.ndarray, kind: pa.DataType, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array, order: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Elements of lists in the given order of rows, and the length of each row's list."""
    taken = column.take(pa.array(order))
    return taken.flatten(), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(taken), 0))


def _summed(keys: pa.RecordBatch, n: np.ndarray, rows: np.ndarray, members: pa.Array, schema: pa.Schema):
    """One row per key of a batch: row count, sum, members of all its rows."""
    codes = pd.DataFrame({str(k): c.to_pandas() for k, c in enumerate(keys.columns)})
    codes = codes.groupby(list(codes.columns), dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
    flat, lengths = _flat(members, order)
    sums = np.add.reduceat(rows[order], starts, axis=0)
    offsets = np.append(0, np.cumsum(np.add.reduceat(lengths, starts)))
    dim = rows.shape[1]
    columns = [c.take(pa.array(order[starts])) for c in keys.columns]
    columns += [
        pa.array(np.add.reduceat(n[order], starts)),
        _lists(sums.ravel(), pa.float64(), np.arange(len(starts) + 1) * dim),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sum_vectors(
    df: DataFrame, keys: list[str], dim: int, vector: str = "embedding", *, weight: Column | None = None,
    members: str | None = None,
) -> DataFrame:
    """keys, ``_n`` rows, ``_sum`` of the (weighted) vectors, and the array ``_members`` of a column if one is named.

    Null keys are keys; null vectors count as rows and add nothing; a vector of another width is an error.
    """
    listed = F.array(F.col(members)) if members else F.array().cast("array<int>")
    given = df.select(
        *keys, F.col(vector).cast("array<double>").alias("_v"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"), listed.alias("_members"),
    )
    schema = StructType([
        *(given.schema[k] for k in keys), StructField("_n", LongType()), StructField("_sum", ArrayType(DoubleType())),
        StructField("_members", given.schema["_members"].dataType),
    ])
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("_v"), dim) * np.asarray(batch.column("_w"))[:, None]
                yield _summed(batch.select(keys), np.ones(len(rows), np.int64), rows, batch.column("_members"), arrow)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next one."""
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch.cast(arrow)]).combine_chunks().to_batches()[0]
            done = _summed(
                batch.select(keys), np.asarray(batch.column("_n")), _matrix(batch.column("_sum"), dim),
                batch.column("_members"), arrow)
            yield done.slice(0, done.num_rows - 1)
            waiting = done.slice(done.num_rows - 1)
        if waiting is not None:
            yield waiting

    parts = given.mapInArrow(partial, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def changed_sums(
    sums: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str], dim: int, vector: str = "embedding"
) -> DataFrame:
    """``sums(keys, _n, _sum)`` after rows went and others came: the work follows the change, not the stored rows.

    Only keys that still have rows are returned. Keys aren't null. Sums by difference carry the rounding of
    all changes so far (about 1e-16 of the largest sum each), so a rebuild now and then, at a recompute, is in order.
    """
    def part(rows: DataFrame, v: str, n, weight: float) -> DataFrame:
        return rows.select(*keys, F.col(v).alias("_v"), n.cast("long").alias("_k"), F.lit(weight).alias("_w"))

    parts = part(sums, "_sum", F.col("_n"), 1.0).unionByName(part(removed, vector, F.lit(-1), -1.0)).unionByName(
        part(added, vector, F.lit(1), 1.0))
    counts = parts.groupBy(*keys).agg(F.sum("_k").alias("_n")).where(F.col("_n") > 0)
    total = sum_vectors(parts, keys, dim, "_v", weight=F.col("_w"))
    return counts.join(total.select(*keys, "_sum"), keys)


def mean_vectors(df: DataFrame, keys: list[str], dim: int, vector: str = "embedding") -> DataFrame:
    """Unit vector in the direction of the mean, with the row count ``n``."""
    sums = sum_vectors(df, keys, dim, vector)
    return sums.select(*keys, F.col("_n").alias("n"), l2_normalize(F.col("_sum")).alias(vector))


def weighted_pool(
    df: DataFrame, keys: list[str], weight: str, dim: int, vector: str = "embedding", members: str | None = None,
) -> DataFrame:
    """Unit vector of the weighted mean; a weight below one, or none, counts as one."""
    effective = F.greatest(F.expr(weight), F.lit(1))
    sums = sum_vectors(df, keys, dim, vector, weight=effective, members=members)
    listed = [F.array_sort("_members").alias("members")] if members else []
    return sums.select(*keys, *listed, l2_normalize(F.col("_sum")).alias(vector))


def plan_segments(chunks: DataFrame) -> DataFrame:
    """Add ``n_segments`` and, up to 24 chunks, the contiguous ``segment_index``.

    Larger documents are clustered; their index is null here.
    """
    n = F.col("total_chunks")
    count = None
    for limit, segments in C.SEGMENT_STEPS:
        count = (F if count is None else count).when(n <= limit, segments)
    planned = chunks.withColumn("n_segments", count.otherwise(C.CLUSTERED_SEGMENTS))
    length = F.ceil(n / F.col("n_segments"))
    largest = C.SEGMENT_STEPS[-1][0]
    return planned.withColumn(
        "segment_index", F.when(n <= largest, F.floor(F.col("chunk_index") / length).cast("int"))
    )


def pool_segments(chunks: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Segment rows from chunks that carry ``segment_index``."""
    pooled = weighted_pool(chunks, [*keys, "segment_index"], "word_count", dim, "embedding", "chunk_index")
    return pooled.withColumnRenamed("members", "chunk_indices")
