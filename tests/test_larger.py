"""Cases that only tables beyond the given ones reach, made small."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import clustering, embedding, similarity
from paperloom.session import cut_lineage, write_through


@pytest.mark.parametrize("groups", [3, 20, 90])
def test_best_of_group_over_many_parts(monkeypatch, groups):
    """A task that cuts its hits several times, at equal scores too, keeps every group's best vector."""
    rng = np.random.default_rng(groups)
    rows = [(f"g{i % groups}", np.round(rng.normal(size=2), 1).tolist()) for i in range(2000)]
    c = pa.table({"group_id": [g for g, _ in rows], "_v": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    asked = [rng.normal(size=2).tolist() for _ in range(7)]
    questions = similarity._Questions(pa.table({"query_id": pa.array(range(7)), "_v": pa.array(asked, pa.list_(pa.float64()))}), "query_id", None)
    monkeypatch.setattr(similarity, "SLICE_ROWS", 50)
    cuts, shrink = [], similarity._shrink
    monkeypatch.setattr(similarity, "_shrink", lambda *a: cuts.append(shrink(*a)) or cuts[-1])
    found = similarity._search([c.slice(0, 1100), c.slice(1100)], questions, ["group_id"], "group_id", True, 5, None)
    assert len(cuts) > 3
    for q, v in enumerate(asked):
        best = {}
        for g, row in rows:
            with np.errstate(invalid="ignore"):
                s = round(float((np.array(row) / np.linalg.norm(row)) @ (np.array(v) / np.linalg.norm(v))), 6)
            best[g] = max(best.get(g, -2.0), s)
        want = sorted(((-s, g) for g, s in best.items() if s > -2.0))[:5]
        got = [(-r["similarity"], r["group_id"]) for r in found.to_pylist() if r["_q"] == q]
        assert [g for _, g in got] == [g for _, g in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-6)


@pytest.mark.parametrize("how", [{"keys": ["row_id"]}, {"keys": ["group_id"], "group": "group_id", "best_of_group": True}])
def test_blocks_in_rounds_send_no_more_than_both_sides_hold(spark, monkeypatch, how):
    """A round's shuffle files, and the best hits before it, are gone before the next one."""
    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 30}", rng.normal(size=8).tolist()) for i in range(600)]
    c = spark.createDataFrame(rows, "row_id int, group_id string, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "query_id int, embedding array<double>")
    listed = lambda found: sorted(tuple(r) for r in found.collect())
    expected = listed(similarity.nearest(q, c, k=3, **how))
    monkeypatch.setattr(similarity, "BATCH_BYTES", 8 * 8 * 120)
    monkeypatch.setattr(similarity, "ROUND_BYTES", 0)
    sent, gone = [], []
    own, drop = similarity.write_through, similarity.discard

    def written(df):
        out = own(df)
        sent.append((out.columns, _files(spark)))
        return out

    monkeypatch.setattr(similarity, "write_through", written)
    monkeypatch.setattr(similarity, "discard", lambda df: gone.append(df.inputFiles()) or drop(df))
    asked = similarity.QuestionSet(q, broadcast_rows=2)
    found = similarity.nearest(asked, c, k=3, **how)
    rounds = [files for columns, files in sent if "similarity" in columns]
    assert len(rounds) == 7 and rounds[-1] <= rounds[0]
    assert len(gone) == len(rounds) - 1 and not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for files in gone for f in files)
    assert listed(found) == expected


def _files(spark):
    """Shuffle files of the session."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.startswith("shuffle_") for d in folder.localDirsString() for _, _, names in os.walk(d) for f in names)


@pytest.mark.parametrize("store", [write_through, cut_lineage])
def test_stored_tables_leave_no_shuffle_behind(spark, store):
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    before = _files(spark)
    kept = store(rows)
    assert _files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert kept.join(store(rows), "k").count() == 10 == rows.count()


def test_hashes_of_all_terms_are_those_of_each():
    rng = random.Random(5)
    ranges = [(32, 127), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x110000)]
    terms = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    terms += ["", "a", "x" * 54, "x" * 55, "y" * 56, "y" * 64, "z" * 300, "é" * 27, "é" * 28]
    for some in (terms, [t for t in terms if len(t) > 60], ["b"], []):
        given = pa.array([*some, "left out"], pa.string()).slice(0, len(some))
        assert embedding._md5_heads(given).tolist() == [embedding._term_hash(t) for t in some]


def test_cluster_sums_are_those_of_rows_added_in_turn():
    rng = np.random.default_rng(2)
    points, chosen = rng.normal(size=(5000, 16)), rng.integers(0, 6, 5000)
    want = np.zeros((8, 16))
    np.add.at(want, chosen, points)
    assert np.array_equal(clustering._cluster_sums(points, chosen, 8), want)
