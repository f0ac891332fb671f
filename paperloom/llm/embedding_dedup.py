"""Near-duplicate embeddings: sign hashes in several tables, exact cosines, connected components."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.llm.components import components
from paperloom.llm.simhash import spanning
from paperloom.session import write_through

#: chance to find a pair that lies just at the threshold; closer pairs are surer
RECALL = 0.9999
#: classes of copies that a bucket should hold on average; larger buckets are cut into blocks of at most about so many
BUCKET_ROWS = 1024
LEAST_BITS, MOST_BITS = 6, 24


def plan_tables(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table, so that ``rows`` spread over buckets, and tables, so that the recall is met.

    Two vectors at angle a agree in a random bit with probability 1 - a / pi.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _clean(vector: str) -> Column:
    """No nulls, nothing non-finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def signed(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Add ``codes``: the signs of ``bits`` projections in each of ``tables`` tables. Planes depend on seed and width only."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.asarray(pa.compute.list_value_length(vectors))
            codes = np.zeros((len(sizes), tables), np.int32)
            for width in np.unique(sizes):
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, int(width)]).standard_normal((int(width), bits * tables))
                mine = np.flatnonzero(sizes == width)
                values = np.asarray(vectors.take(pa.array(mine)).flatten()).reshape(-1, width)
                up = (values @ planes[width] > 0).reshape(-1, tables, bits)
                codes[mine] = up @ weights
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    return rows.mapInArrow(
        hashed, T.StructType([*rows.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))]))


def _matches(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one bucket, or of one pair of its blocks: per class the number of vectors found here
    for the first time, and the least class of its tree."""
    frame = frame.sort_values(["block", "rep"], kind="stable")
    blocks = frame["block"].to_numpy()
    table = int(frame["table"].iloc[0])
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    codes = np.stack(frame["codes"].to_numpy())[:, :table]
    reps, counts = frame["rep"].to_numpy(), frame["n"].to_numpy()
    n = len(frame)
    low, high = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
    cut = n if low == high else int((blocks == low).sum())
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, cut, BUCKET_ROWS):
        a_end = min(a + BUCKET_ROWS, cut)
        for b in range(a if low == high else cut, n, BUCKET_ROWS):
            b_end = min(b + BUCKET_ROWS, n)
            cosine = vectors[a:a_end] @ vectors[b:b_end].T / (length[a:a_end, None] * length[None, b:b_end])
            i, j = np.nonzero(cosine >= threshold)
            i, j = i + a, j + b
            if low == high:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 18):
                x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                first = ~(codes[x] == codes[y]).any(axis=1)
                np.add.at(links, x[first], counts[y[first]])
                np.add.at(links, y[first], counts[x[first]])
                spanning(parent, x, y)
    found = (links > 0) | (parent != np.arange(n))
    return pd.DataFrame({"rep": reps[found], "links": links[found], "root": reps[parent[found]]})


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = 0.93, recall: float = RECALL, seed: int = 7,
) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Vectors are linked if their labels are equal and their cosine, in doubles, is at least the
    threshold. Candidates share the bucket of one table at least; the number of bits follows the rows of
    the largest label, the number of tables meets ``recall`` for pairs at the threshold. Equal
    vectors are one class, linked without comparison, so copies never make pairs. A bucket is
    compared in one task up to ``BUCKET_ROWS`` classes, a larger one as pairs of blocks; tasks return
    counts and a spanning forest, not pairs. A pair found in several tables counts in the first.

    Rows without an id, a label or a clean vector (null, zero, null or non-finite components) link with
    nothing; without an id they are kept and have no component. Vectors of different width don't
    link. A repeated row is a vector of its own, linked with its copy; rows that repeat an id with
    other vectors share that id's component and the sum of its links.
    """
    label = F.lit(0) if label_col is None else F.col(label_col)
    text = F.array_join(F.transform(F.col(vector_col), lambda x: (x + F.lit(0)).cast("string")), ",")
    usable = F.col(id_col).isNotNull() & label.isNotNull() & _clean(vector_col)
    narrow = rows.select(
        F.col(id_col).alias("id"), label.alias("label"), usable.alias("usable"),
        F.when(usable, F.md5(text)).alias("key"), F.col(vector_col).alias("vector"))
    groups = write_through(
        narrow.where("usable").groupBy("label", "key").agg(
            F.min(F.col("id").cast("long")).alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    most = groups.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    bits, tables = plan_tables(most, threshold, recall)
    coded = write_through(signed(groups, bits, tables, seed))
    place = ["label", "width", "table", "code"]
    dealt = coded.select(
        "label", F.size("vector").alias("width"), "rep", "n", "codes", F.posexplode("codes").alias("table", "code"), "vector")
    crowds = (
        coded.select("label", F.size("vector").alias("width"), F.posexplode("codes").alias("table", "code"))
        .groupBy(*place).agg(F.count("*").alias("c")).where(F.col("c") > 1)
        .select(*place, F.ceil(F.col("c") / BUCKET_ROWS).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("rep", "vector"), F.col("blocks")).cast("int")
    # a bucket of b blocks sends each row to b block pairs; most buckets have one
    paired = (
        dealt.join(crowds, place).withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    found = write_through(
        paired.groupBy(*place, "lo", "hi").applyInPandas(
            lambda frame: _matches(frame, threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("rep") != F.col("root")).select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        groups.select("label", "key", "rep", "n").join(links, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("of"), F.col("key").alias("of_key"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    kind = rows.schema[id_col].dataType
    whole = narrow.drop("vector").join(known, (F.col("label") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    component = F.coalesce(F.col("component").cast(kind), F.col("id"))
    return whole.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
