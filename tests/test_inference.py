"""Batch models: loaded once per worker, called with batches; vectors that can't be stored."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.operators import embedding, retrieval
from paperloom.operators.inference import batch_embedder, batch_scorer


def test_models_load_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def noted(kind):
        import os
        import uuid
        open(f"{folder}/{kind}-{os.getpid()}-{uuid.uuid4()}", "w").close()

    def encoder():
        noted("load")

        def run(texts):
            noted("call")
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return run

    rows = spark.range(4000).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("ab"), (F.col("id") % 5).cast("int"))).alias("t"))
    found = rows.repartition(16).withColumn("v", batch_embedder(encoder, 50)("t")).collect()
    assert all(list(r.v) == ([2.0 * (r.id % 5), r.id % 5, 1.0] if r.id % 9 else [0, 0, 1]) for r in found)
    files = [p.name for p in tmp_path.iterdir()]
    loads, calls = ([f for f in files if f.startswith(k)] for k in ("load", "call"))
    assert len(loads) == len({f.split("-")[1] for f in loads}) <= 16 and len(calls) >= 80


def test_rerank_by_a_batch_model(spark):
    hits = spark.createDataFrame(
        [(1, d, 0, d + 1, "q", "x" * d) for d in range(6)], "query_id int, doc_id int, chunk_index int, rank int, query_text string, chunk_text string")
    scorer = batch_scorer(lambda: lambda queries, texts: np.array([len(t) - 3.0 for t in texts]))
    ranked = retrieval.rerank(hits, scorer).orderBy("rerank_rank").collect()
    assert [r.doc_id for r in ranked] == [5, 4, 3, 2, 1, 0] and ranked[2].rerank_score == 0.5


def test_vectors_that_cannot_be_stored(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("inf")]), (5, [float("nan"), 1.0]), (6, [-float("inf"), 1.0])]
    df = embedding.split_by_dim(spark.createDataFrame(rows, "id int, embedding array<double>"), 2)
    errors = {r.id: r.vector_error for r in df.collect()}
    assert errors[1] is None and "2-dimensional" in errors[2] and errors[3] == "no vector" and "missing" in errors[5]
    assert "infinite" in errors[4] and "infinite" in errors[6]


def test_hashed_terms(spark):
    rows = spark.createDataFrame([("Äpfel, äpfel 12_x!",), ("",), (None,), ("--",), ("a b a",)], "t string")
    vectors = [r.v for r in rows.select(embedding.hashed_terms(16)(F.col("t")).alias("v")).collect()]
    assert vectors[1] is vectors[2] is vectors[3] is None
    want = np.zeros(16)
    for t in ("äpfel", "äpfel", "12", "x"):
        want[embedding._term_hash(t) % 16] += 1
    assert np.allclose(vectors[0], want / np.linalg.norm(want)) and np.isclose(np.linalg.norm(vectors[4]), 1)


def test_terms_are_counted_in_slices(spark, monkeypatch):
    """A worker holds the terms of few texts at once, whatever a batch of Spark's holds; the vectors are the same."""
    texts = [None if i % 50 == 0 else "" if i % 60 == 0 else f"Word{i % 7} word{i} a b a" for i in range(1300)]
    embed = embedding.hashed_terms(16).func
    held, own = [], embedding.pc.split_pattern_regex
    monkeypatch.setattr(embedding.pc, "split_pattern_regex", lambda a, *b: held.append(len(a)) or own(a, *b))
    whole = embed(pa.array(texts, pa.string()))
    assert max(held) < 1300 and sum(held) == 1300
    assert whole.to_pylist() == [embed(pa.array([t], pa.string()))[0].as_py() for t in texts]
    assert len(embed(pa.array([], pa.string()))) == 0
