import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.operators import clustering as K, pooling as P

DIM = 4


def _points(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in sizes.items():
        v = rng.normal(size=(n, DIM))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(key, i, x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "group_id string, id int, embedding array<double>")


def _sets(df):
    return {(r.group_id, r.id, r.cluster) for r in df.collect()}


def test_blocks_and_tasks_agree(spark):
    points = _points(spark, {"hot": 900, "b": 60, "c": 5, "d": 1})
    k = K.prototype_count(F.col("n"))
    local = _sets(K.kmeans(points, ["group_id"], "id", k=k, dim=DIM))
    blocks = _sets(K.kmeans(points, ["group_id"], "id", k=k, dim=DIM, task_rows=30, block_rows=64))
    assert local == blocks
    assert len(local) == 966
    assert {c for g, _, c in local if g == "hot"} <= set(range(20))


def test_kmeans_does_not_depend_on_partitioning(spark):
    points = _points(spark, {"a": 120, "b": 30})
    k = K.segment_count(F.col("n"))
    once = _sets(K.kmeans(points, ["group_id"], "id", k=k, dim=DIM))
    assert once == _sets(K.kmeans(points.repartition(7, "id"), ["group_id"], "id", k=k, dim=DIM))


def _brute_medoid(vectors):
    best, best_score = 0, -1.0
    for i, x in enumerate(vectors):
        score = round(sum(float(x @ y) for j, y in enumerate(vectors) if j != i), 9)
        if score > best_score:
            best, best_score = i, score
    return best


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=DIM, max_size=DIM).filter(any), min_size=1, max_size=12))
def test_medoid_equals_pairwise(spark, rows):
    vectors = np.array(rows, float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame(
        [("g", i, v.tolist()) for i, v in enumerate(vectors)], "group_id string, id int, embedding array<double>"
    )
    assert K.medoids(df, ["group_id"], "id", DIM).first().id == _brute_medoid(vectors)


def test_medoid_of_opposites_is_the_first(spark):
    rows = [("g", 3, [1.0, 0.0, 0.0, 0.0]), ("g", 5, [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "group_id string, id int, embedding array<double>")
    assert K.medoids(df, ["group_id"], "id", DIM).first().id == 3


def test_small_groups_keep_all_segments(spark):
    points = _points(spark, {"one": 1, "two": 2, "three": 3, "four": 4, "big": 100})
    found = K.group_prototypes(points, "id", DIM).groupBy("group_id").agg(
        F.count("*").alias("n"), F.max("proto_index").alias("last")
    )
    n = {r.group_id: (r.n, r.last) for r in found.collect()}
    assert n["one"] == (1, 0) and n["two"] == (2, 1) and n["three"] == (3, 2)
    assert n["four"][0] <= 2 and n["big"][0] <= 5


@pytest.mark.parametrize("n, expected", [(4, 1), (5, 2), (12, 2), (13, 3), (24, 3), (25, 5)])
def test_segment_counts(spark, n, expected):
    rng = np.random.default_rng(n)
    rows = [("d", i, n, 10, rng.normal(size=DIM).tolist()) for i in range(n)]
    chunks = spark.createDataFrame(
        rows, "doc_id string, chunk_index int, total_chunks int, word_count int, embedding array<double>"
    )
    segments = K.build_segments(chunks, DIM).collect()
    assert len(segments) <= expected and (n > 24 or len(segments) == expected)
    assert sorted(i for s in segments for i in s.chunk_indices) == list(range(n))
    assert sorted(s.segment_index for s in segments) == list(range(len(segments)))
    assert all(abs(sum(x * x for x in s.embedding) - 1) < 1e-9 for s in segments)


def test_weighted_pool_counts_zero_weight_as_one(spark):
    rows = [("k", 0, [1.0, 0.0, 0.0, 0.0]), ("k", 3, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, w int, embedding array<double>")
    v = P.weighted_pool(df, ["key"], "w", DIM).first().embedding
    assert v[:2] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])


def test_mean_of_opposites_has_no_direction(spark):
    rows = [("k", [1.0, 0.0, 0.0, 0.0]), ("k", [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, embedding array<double>")
    assert P.mean_vectors(df, ["key"], DIM).first().embedding is None


def test_nearest_centroid_ties_go_to_the_first(spark):
    points = spark.createDataFrame([("k", 1, [1.0, 0.0, 0.0, 0.0])], "g string, id int, embedding array<double>")
    centroids = spark.createDataFrame(
        [("k", 2, [1.0, 0.0, 0.0, 0.0]), ("k", 0, [1.0, 0.0, 0.0, 0.0]), ("k", 1, [0.0, 1.0, 0.0, 0.0])],
        "g string, cluster int, embedding array<double>",
    )
    assert K.nearest_centroid(points, centroids, ["g"], "id").first().cluster == 0


def test_sums_by_difference_equal_a_rebuild(spark):
    """After many random batches that add, move and remove."""
    from paperloom.operators.pooling import changed_sums, sum_vectors

    rng = np.random.default_rng(12)
    held, frame = {}, lambda rows: spark.createDataFrame(rows, "g string, d int, embedding array<double>")
    sums = sum_vectors(frame([]), ["g"], 4)
    for _ in range(6):
        gone = [(g, d, v) for d, (g, v) in held.items() if rng.random() < 0.3]
        came = [(f"g{rng.integers(4)}", int(d), [float(x) for x in rng.normal(size=4)]) for d in rng.integers(0, 60, 25)]
        came = list({d: (g, d, v) for g, d, v in came}.values())
        gone += [(*held[d][:1], d, held[d][1]) for _, d, _ in came if d in held and d not in {x[1] for x in gone}]
        for _, d, _ in gone:
            del held[d]
        held |= {d: (g, v) for g, d, v in came}
        rows = changed_sums(sums, frame(gone), frame(came), ["g"], 4).collect()
        sums = spark.createDataFrame([(r.g, r._n, r._sum) for r in rows], "g string, _n long, _sum array<double>")
    want = {r.g: (r._n, r._sum) for r in sum_vectors(frame([(g, d, v) for d, (g, v) in held.items()]), ["g"], 4).collect()}
    got = {r.g: (r._n, r._sum) for r in rows}
    assert set(got) == set(want) and all(got[g][0] == want[g][0] and np.allclose(got[g][1], want[g][1], atol=1e-12) for g in want)


def test_a_round_of_blocks_is_one_short_job(spark, monkeypatch):
    """No joins or broadcast relations per round; keys whose centroids don't fit together go in batches."""
    points = _points(spark, {"hot": 400, "b": 90, "c": 70})
    k = K.prototype_count(F.col("n"))
    local = _sets(K.kmeans(points, ["group_id"], "id", k=k, dim=DIM))
    context = spark.sparkContext

    def jobs(iterations):
        group = f"rounds-{iterations}"
        context.setJobGroup(group, group)
        try:
            K.kmeans(points, ["group_id"], "id", k=k, dim=DIM, task_rows=30, block_rows=64, iterations=iterations)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(group))

    assert jobs(4) - jobs(1) <= 3 * 3
    monkeypatch.setattr(K, "CENTROID_BYTES", 8 * DIM * 8, raising=False)
    assert local == _sets(K.kmeans(points, ["group_id"], "id", k=k, dim=DIM, task_rows=30, block_rows=64))
