"""Texts to unit vectors.

The default embedder counts hashed terms.  Any ``Column -> Column`` function with an
``array<double>`` result can take its place, e.g. a pandas UDF around a model.
"""

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from paperloom import constants as C

Embedder = Callable[[Column], Column]
SLICE_TEXTS = 512                # texts whose terms a worker holds at once
_BETWEEN = r"[^\p{L}\p{N}]+"
_ROUNDS = [int(2**32 * abs(np.sin(i + 1.0))) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]


def _term_hash(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16)


def _md5_heads(terms: pa.Array) -> np.ndarray:
    """``_term_hash`` of all terms at once."""
    terms = terms.cast(pa.large_string())
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    heads = np.zeros(len(terms), np.int64)
    long = np.flatnonzero(lengths > 55)  # more than a block of md5
    heads[long] = [_term_hash(term) for term in terms.take(pa.array(long)).to_pylist()]
    short = np.flatnonzero(lengths <= 55)
    if not len(short):
        return heads
    lengths = lengths[short].astype(np.int64)
    some = terms.take(pa.array(short))
    data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[: lengths.sum()]
    block = np.zeros((len(short), 64), np.uint8)
    row = np.repeat(np.arange(len(short)), lengths)
    block[row, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = data
    block[np.arange(len(short)), lengths] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = lengths * 8
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(short), x) for x in start)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed = mixed + a + words[at] + np.uint32(_ROUNDS[i])
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (mixed << np.uint32(turn) | mixed >> np.uint32(32 - turn))
    heads[short] = (a + start[0]).byteswap()
    return heads


def hashed_terms(dim: int) -> Embedder:
    """Term counts in ``dim`` buckets (first 32 bits of the term's md5), unit length.

    A text without terms has no vector: the result is null.
    """

    def embed(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # in slices, so that a worker's memory doesn't follow the size of Spark's batches
        parts = [counted(texts.slice(start, SLICE_TEXTS)) for start in range(0, max(1, len(texts)), SLICE_TEXTS)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def counted(texts: pa.Array) -> pa.Array:
        # all terms of the slice at once; every distinct term is hashed once
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BETWEEN)
        owner, coded = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
        known = coded.dictionary
        bucket = np.where(pc.equal(known, "").to_numpy(zero_copy_only=False), -1, _md5_heads(known) % dim)
        places = bucket[coded.indices.to_numpy()]
        real = places >= 0
        rows = np.bincount(owner[real] * dim + places[real], minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
        length = np.sqrt((rows * rows).sum(axis=1))
        empty = length == 0
        rows /= np.where(empty, 1.0, length)[:, None]
        offsets = pa.array(np.arange(len(texts) + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(
            offsets, pa.array(rows.ravel()), mask=pa.array(empty)
        )

    return F.arrow_udf(embed, ArrayType(DoubleType()))


def embed_chunks(chunks: DataFrame, embedder: Embedder, prefix: str = C.DOC_PREFIX) -> DataFrame:
    return chunks.withColumn("embedding", embedder(F.concat(F.lit(prefix), F.col("chunk_text"))))


def embed_queries(queries: DataFrame, embedder: Embedder, prefix: str = "", text: str = "text"):
    """Query vectors; the router passes ``QUERY_PREFIX``, the query service no prefix."""
    return queries.withColumn("embedding", embedder(F.concat(F.lit(prefix), F.col(text))))


def split_by_dim(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Add ``vector_error``: why a vector cannot be stored, null for a good one."""
    size = F.size(F.col(vector))
    return df.withColumn(
        "vector_error",
        F.when(F.col(vector).isNull(), "no vector").when(
            size != dim,
            F.concat(F.lit(f"Expected {dim}-dimensional embedding, got "), size.cast("string"), F.lit(".")),
        ).when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "vector has missing values")
        .when(F.exists(vector, lambda x: F.abs(x) == float("inf")), "vector has infinite values"),
    )
