import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import similarity
from paperloom.operators.similarity import QuestionSet, nearest

DIM = 8


def _unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _tables(spark, n_query=30, n_stored=400, seed=5):
    """Stored vectors with many exact copies; one group holds more than a third."""
    rng = np.random.default_rng(seed)
    stored = rng.normal(size=(n_stored, DIM))
    stored[n_stored // 2:] = stored[0]
    groups = ["hot" if i % 5 < 2 else f"g{i % 7}" for i in range(n_stored)]
    queries = rng.normal(size=(n_query, DIM))
    q = spark.createDataFrame(
        [(i, v.tolist(), [f"g{i % 7}", "hot"] if i % 3 else None) for i, v in enumerate(queries)],
        "query_id int, embedding array<double>, groups array<string>",
    )
    c = spark.createDataFrame(
        [(i, g, v.tolist()) for i, (g, v) in enumerate(zip(groups, stored))],
        "row_id int, group_id string, embedding array<double>",
    )
    return q, c, np.round(_unit(queries) @ _unit(stored).T, 6), groups


MODES = [{}, {"broadcast_rows": 7}]


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("floor", [None, 0.4])
def test_topk(spark, mode, floor):
    q, c, sims, _ = _tables(spark)
    found = nearest(q, c.repartition(5), k=6, keys=["row_id"], min_similarity=floor, **mode)
    got = {(r.query_id, r["rank"]): (r.row_id, r.similarity) for r in found.collect()}
    expected = {}
    for i, row in enumerate(sims):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))
        order = [j for j in order if floor is None or row[j] >= floor][:6]
        expected.update({(i, r + 1): (j, float(row[j])) for r, j in enumerate(order)})
    assert got == expected


@pytest.mark.parametrize("mode", MODES)
def test_best_of_group(spark, mode):
    q, c, sims, groups = _tables(spark)
    found = nearest(
        q, c.repartition(4), k=3, keys=["group_id"], group="group_id", best_of_group=True, **mode,
    )
    got = {(r.query_id, r["rank"]): (r.group_id, round(r.similarity, 6)) for r in found.collect()}
    for i, row in enumerate(sims):
        best = {}
        for g, s in zip(groups, row):
            best[g] = max(best.get(g, -2), s)
        for r, g in enumerate(sorted(best, key=lambda g: (-best[g], g))[:3]):
            assert got[(i, r + 1)] == (g, round(best[g], 6))


@pytest.mark.parametrize("mode", MODES)
def test_scope(spark, mode):
    q, c, sims, groups = _tables(spark)
    found = nearest(q, c, k=4, keys=["row_id"], group="group_id", scope="groups", **mode).collect()
    for i, row in enumerate(sims):
        allowed = {f"g{i % 7}", "hot"} if i % 3 else set(groups)
        order = sorted((j for j in range(len(row)) if groups[j] in allowed), key=lambda j: (-row[j], j))
        got = [r.row_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i]
        assert got == order[:4]


def test_empty_sides(spark):
    q, c, _, _ = _tables(spark, 2, 10)
    assert nearest(q.where("false"), c, k=2, keys=["row_id"]).count() == 0
    assert nearest(q, c.where("false"), k=2, keys=["row_id"]).count() == 0
    empty_scope = q.withColumn("groups", F.array().cast("array<string>"))
    assert nearest(empty_scope, c, k=2, keys=["row_id"], group="group_id", scope="groups").count() == 0


def test_zero_and_null_vectors_are_not_found(spark):
    q, c, _, _ = _tables(spark, 1, 4)
    odd = spark.createDataFrame(
        [(100, "z", [0.0] * DIM), (101, "n", None)], "row_id int, group_id string, embedding array<double>"
    )
    ids = {r.row_id for r in nearest(q, c.unionByName(odd), k=10, keys=["row_id"]).collect()}
    assert ids == {0, 1, 2, 3}


def test_batches_scan_the_stored_side_in_place(spark):
    """Many queries add scans, not copies of stored rows."""
    q, c, _, _ = _tables(spark)
    found = nearest(q, c, k=2, keys=["row_id"], broadcast_rows=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert plan.count("MapInArrow") >= 5 and "Exchange" in above and "Exchange" not in below.partition("Union")[0].split("MapInArrow")[0]
    assert "CoGroup" not in plan and "Generate" not in plan


def _ranked(found):
    return sorted((r.query_id, r["rank"], *r[1:-2], r.similarity) for r in found.collect())


@pytest.mark.parametrize("held", [None, 20])
@pytest.mark.parametrize("options", [
    {"keys": ["row_id"]}, {"keys": ["row_id"], "group": "group_id", "scope": "groups", "min_similarity": 0.1},
    {"keys": ["group_id"], "group": "group_id", "best_of_group": True},
])
def test_many_queries_stay_in_spark(spark, monkeypatch, held, options):
    """Beyond a few batches no query is collected, whether the stored side is small (held: None) or not."""
    q, c, _, _ = _tables(spark)
    c = c.repartition(5)
    expected = _ranked(nearest(q, c, k=4, **options))
    if held:
        monkeypatch.setattr(similarity, "BATCH_BYTES", 8 * DIM * held)
    asked = QuestionSet(q, scope=options.get("scope"), broadcast_rows=2)
    assert asked.batches == [] and asked.table.count() == 30
    found = nearest(asked, c, k=4, **options)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Union" in plan) == (bool(held) and "scope" in options) and ("CoGroup" in plan) == bool(held)
    assert _ranked(found) == expected


@pytest.mark.parametrize("rows", [4, 40, 5000])
def test_scoped_search_is_a_join_on_the_group(spark, monkeypatch, rows):
    """Hot and small groups, a group nobody may see, queries without a scope, scopes that name unknown groups or none."""
    rng = np.random.default_rng(8)
    count = [400, 60, 1, 7, 300]  # group g4 is seen by nobody
    corpus, at = [], 0
    for g, n in enumerate(count):
        for _ in range(n):
            corpus.append((at, f"g{g}", [float(x) for x in rng.normal(size=DIM)]))
            at += 1
    scopes = [["g0"], ["g0", "g1"], ["g2", "g0", "g0"], ["g3", "unknown"], [], None]
    asked = [(k, [float(x) for x in rng.normal(size=DIM)], scopes[k % (6 if k < 60 else 5)]) for k in range(200)]
    c = spark.createDataFrame(corpus, "row_id int, group_id string, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>, groups array<string>").repartition(3)
    monkeypatch.setattr(similarity, "BATCH_BYTES", 8 * DIM * rows)
    queries = QuestionSet(q, scope="groups", broadcast_rows=2)
    found = nearest(queries, c, k=3, keys=["row_id"], group="group_id", scope="groups", min_similarity=0.0)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for k, v, scope in asked:
        hits = [(-round(float(unit(v) @ unit(e)), 6), r) for r, g, e in corpus if scope is None or g in scope]
        want[k] = [r for s, r in sorted(hits) if s <= 0][:3]
    got = {k: [] for k in want}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.row_id)
    assert got == want
    if rows < 100:
        units = similarity.group_units(
            queries.table.where("groups IS NOT NULL").withColumn("_g", F.explode(F.array_distinct("groups"))), c, "group_id", rows, rows)
        cut = {r["_g"]: (r["_qb"], r["_sb"]) for r in units.collect()}
        assert set(cut) == {"g0", "g1", "g2", "g3"} and cut["g0"][1] > cut["g1"][1] >= 1


def test_a_group_nobody_may_see_is_never_shuffled(spark, monkeypatch):
    """The stored side meets the visible groups in a broadcast join, below the exchange that deals it to tasks."""
    rows = spark.range(3000).selectExpr("cast(id as int) AS row_id", "concat('g', id % 3) AS group_id", "array(1.0D, id + 1.0D) AS embedding")
    asked = rows.where("row_id < 300").selectExpr("row_id AS query_id", "embedding", "array('g1') AS groups")
    monkeypatch.setattr(similarity, "BATCH_BYTES", 8 * 2 * 100)
    found = nearest(asked, rows, k=2, keys=["row_id"], group="group_id", scope="groups", broadcast_rows=2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.rindex("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in right.split("Scan parquet")[0].replace("BroadcastExchange", "")
    assert {r.row_id % 3 for r in found.collect()} == {1}


def _spied(monkeypatch, name):
    calls, own = [], getattr(similarity, name)
    monkeypatch.setattr(similarity, name, lambda *a: calls.append(own(*a)) or calls[-1])
    return calls


def test_copies_do_not_follow_the_batches(spark, monkeypatch):
    """Small broadcast batches make many queries stay in Spark, but rows are sent once per block of a task's memory."""
    q, c, _, _ = _tables(spark)
    how = {"k": 3, "keys": ["row_id"], "group": "group_id", "scope": "groups"}
    q = q.where("groups IS NOT NULL")
    expected, units = _ranked(nearest(q, c, **how)), _spied(monkeypatch, "group_units")
    assert _ranked(nearest(q, c, broadcast_rows=2, batch_bytes=8 * DIM * 10, **how)) == expected
    assert {(r["_qb"], r["_sb"]) for r in units[0].collect()} == {(1, 1)}


def test_queries_that_see_many_groups_are_not_copied_per_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i % 40}", [float(x) for x in rng.normal(size=DIM)]) for i in range(400)]
    c = spark.createDataFrame(rows, "row_id int, group_id string, embedding array<double>").repartition(4)
    q = c.select(F.col("row_id").alias("query_id"), "embedding", F.array(*[F.lit(f"g{g}") for g in range(1, 40)]).alias("groups"))
    how = {"k": 3, "keys": ["row_id"], "group": "group_id", "scope": "groups"}
    expected, units = _ranked(nearest(q, c, **how)), _spied(monkeypatch, "group_units")
    monkeypatch.setattr(similarity, "BATCH_BYTES", 8 * DIM * 200)
    assert _ranked(nearest(q, c, broadcast_rows=2, **how)) == expected
    assert not units


def test_rough_scores_lose_no_row(spark):
    """Similarities that differ by less than single precision tells, around the k-th and at a floor."""
    base = np.random.default_rng(4).normal(size=DIM)
    rows = [(i, (base + 1e-4 * np.random.default_rng(i).normal(size=DIM)).tolist()) for i in range(3000)]
    rows += [(5000, [0.0] * DIM), (5001, [float("nan")] * DIM), (5002, [1e-200] * DIM)]
    c = spark.createDataFrame(rows, "row_id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(0, base.tolist()), (1, rows[7][1]), (2, [0.0] * DIM)], "query_id int, embedding array<double>")
    for floor in (None, 1.0):
        got = [(r.query_id, r["rank"], r.row_id) for r in nearest(q, c, k=50, keys=["row_id"], min_similarity=floor).collect()]
        want = []
        for i, v in enumerate([base, np.array(rows[7][1])]):
            sims = np.round(_unit(np.array([r[1] for r in rows[:3000]])) @ (v / np.linalg.norm(v)), 6)
            order = [j for j in sorted(range(3000), key=lambda j: (-sims[j], j)) if floor is None or sims[j] >= floor]
            want += [(i, n + 1, j) for n, j in enumerate(order[:50])]
        assert sorted(got) == want
