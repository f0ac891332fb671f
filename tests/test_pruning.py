"""Search that skips blocks: the answers of a full scan, on given tables and on odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators.pruning import lay_out, pruned_nearest
from paperloom.operators.similarity import nearest
from paperloom.plans import bindings as B
from paperloom.session import write_through


def _rows(found):
    return sorted((r.query_id, r["rank"], r.doc_id, r.similarity) for r in found.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_equal_to_the_full_scan(spark, folder):
    stored = write_through(B.segments(spark, folder).select("doc_id", "embedding"))
    asked = stored.select(F.col("doc_id").alias("query_id"), "embedding")
    layout = lay_out(stored, "doc_id", B.VECTOR_DIM, clusters=64, rings=4)
    found, compared = pruned_nearest(asked, layout, k=10, keys=["doc_id"])
    assert _rows(found) == _rows(nearest(asked, stored, k=10, keys=["doc_id"]))
    # these vectors have no clusters, so the bound leaves nearly all pairs; see below for some that have
    n = stored.count()
    assert compared.count() == n and compared.agg(F.max("n_rows")).first()[0] <= n


def test_clustered_vectors_skip_most(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.15 * rng.normal(size=32)]) for i in range(3000)]
    stored = write_through(spark.createDataFrame(rows, "doc_id int, embedding array<double>"))
    asked = stored.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    layout = lay_out(stored, "doc_id", 32, clusters=60, rings=4)
    found, compared = pruned_nearest(asked, layout, k=10, keys=["doc_id"])
    assert _rows(found) == _rows(nearest(asked, stored, k=10, keys=["doc_id"]))
    share = 1 - compared.agg(F.sum("n_rows")).first()[0] / 3000 / 600
    print(f"skipped {share:.3f}")
    assert share > 0.8


@pytest.mark.parametrize("k, near, floor", [(3, 1, None), (5, 2, 0.9), (40, 1, None)])
def test_odd_vectors(spark, k, near, floor):
    """Copies, ties, opposite, zero and missing vectors; more hits wanted than a block holds."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=6) * (i % 4) * 0.1]) for i in range(300)]
    rows += [(400 + i, [1.0] + [0.0] * 5) for i in range(60)] + [(500, [-1.0] + [0.0] * 5), (501, [0.0] * 6), (502, None)]
    stored = spark.createDataFrame(rows, "doc_id int, embedding array<double>").repartition(4)
    asked = stored.where("doc_id % 7 = 0 OR doc_id >= 500").select(F.col("doc_id").alias("query_id"), "embedding")
    layout = lay_out(stored, "doc_id", 6, clusters=9, rings=3, sample_rows=50)
    found, _ = pruned_nearest(asked, layout, k=k, keys=["doc_id"], near=near, min_similarity=floor)
    assert _rows(found) == _rows(nearest(asked, stored, k=k, keys=["doc_id"], min_similarity=floor))


def test_many_queries_and_empty_sides(spark):
    stored = spark.range(2000).selectExpr("cast(id as int) AS doc_id", "array(sin(id), cos(id), sin(id * 0.37)) AS embedding")
    asked = stored.select(F.col("doc_id").alias("query_id"), "embedding")
    layout = lay_out(stored, "doc_id", 3, clusters=20, rings=4)
    found, compared = pruned_nearest(asked, layout, k=4, keys=["doc_id"], broadcast_rows=16, batch_bytes=24 * 200)
    assert _rows(found) == _rows(nearest(asked, stored, k=4, keys=["doc_id"]))
    assert compared.agg(F.sum("n_rows")).first()[0] < 0.3 * 2000**2
    none = lay_out(stored.limit(0), "doc_id", 3)
    assert pruned_nearest(asked, none, k=4, keys=["doc_id"])[0].count() == 0
    assert pruned_nearest(asked.limit(0), layout, k=4, keys=["doc_id"])[0].count() == 0
