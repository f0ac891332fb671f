"""Cases that the test tables never reach."""

import os
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions.html import html_to_text
from paperloom.operators import changes, chunking, clustering, embedding, normalize, pooling, retrieval
from paperloom.plans.ingest import prepare
from paperloom.session import release, write_through
from paperloom.sources import events
from paperloom.streaming import events as live


@pytest.mark.parametrize(("markup", "text"), [
    ("<table><tr><th>Name</th><th>Port</th></tr><tr><td>api</td> <td>8080</td></tr></table>", "Name | Port\n\napi | 8080"),
    ("<ol><li>one</li><li>two</li></ol><ul><li>x</li></ul>", "1. one\n2. two\n\n- x"),
    ("a&#8217;b&mdash;c&#x1F600;d&#0;e&#55296;", "a\u2019b\u2014c\U0001f600d&#0;e&#55296;"),
    ("<strong>a <em>b <code>c</code></em></strong>", "**a _b `c`_**"),
    ("x<pre><code>if (a):\n  b</code></pre>y", "x\n\n```\nif (a):\n  b\n```\n\ny"),
    ("before<blockquote><p>said</p></blockquote>after", "before\n\n> said\n\nafter"),
])
def test_markup(spark, markup, text):
    assert spark.createDataFrame([(markup,)], "h string").select(html_to_text(F.col("h"))).first()[0] == text


@pytest.mark.parametrize("k", [5, 50])
def test_kmeans_is_the_same_in_tasks_and_blocks(spark, k):
    rng = np.random.default_rng(k)
    points = rng.standard_normal((300, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([("g", i, p.tolist()) for i, p in enumerate(points)], "key string, id int, embedding array<double>")
    found = [
        {(r["id"], r["cluster"]) for r in clustering.kmeans(
            rows, ["key"], "id", k=F.lit(k), dim=6, task_rows=size, block_rows=128, iterations=4).collect()}
        for size in (1000, 10)
    ]
    assert found[0] == found[1] and len({c for _, c in found[0]}) == k


def test_gate_keeps_null_keys_and_orders(spark):
    rows = spark.createDataFrame(
        [(None, 1, "a"), (None, 2, "a"), (None, 3, "b"), ("k", None, "a"), ("k", 5, "a"), ("k", 6, "c")], "k string, t int, c string")
    passed = changes.change_gate(rows, ["k"], ["t"], ["c"], bucket=F.floor(F.col("t") / 2))
    assert sorted(((r["k"], r["t"]) for r in passed.collect()), key=str) == [("k", 6), ("k", None), (None, 1), (None, 3)]


def test_text_gate_compares_with_the_text_last_seen(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "a"), ("k", 4, "b")], "k string, t int, c string")
    passed = changes.text_gate(rows, ["k"], ["t"], "c", bucket=F.lit(0))
    assert sorted((r["t"], r["old_text"]) for r in passed.collect()) == [(1, ""), (4, "a")]


def test_documents_need_an_object_and_a_text(spark):
    bodies = [
        '{"doc_id":"1","source":"s","content":"c","metadata":{}}', '{"doc_id":"2","source":"s","content":"c","metadata":[]}',
        '{"doc_id":"3","source":"s","content":"c","metadata":"x"}', '{"doc_id":"4","source":"s","content":7,"metadata":{}}',
    ]
    rows = events.read_documents(spark.createDataFrame([(b,) for b in bodies], "body string"), "body")
    assert {r["doc_id"]: r["error"] for r in rows.collect()} == {
        "1": None, "2": "metadata is not an object", "3": "metadata is not an object", "4": "content is not a string"}


def test_github_without_commits_has_empty_lists(spark):
    rows = spark.createDataFrame(
        [("e", "github", '{"repository":{"full_name":"a/b"},"ref":"refs/heads/x"}', '{"repo":"a/b"}')],
        "event_id string, source string, payload string, full_data string")
    metadata = normalize.normalize(rows).select("metadata").first()[0]
    assert '"commits":[]' in metadata and '"files":[]' in metadata


def test_sums_of_wide_vectors(spark):
    rng = np.random.default_rng(0)
    values = rng.standard_normal((500, 768))
    rows = [(None if k % 7 == 0 else f"k{k % 3}", k, v.tolist()) for k, v in enumerate(values)] + [("k0", 900, None)]
    frame = spark.createDataFrame(rows, "key string, id int, embedding array<double>").repartition(5)
    found = {r["key"]: r for r in pooling.sum_vectors(frame, ["key"], 768, members="id").collect()}
    for key in (None, "k0", "k1", "k2"):
        mine = [k for k in range(500) if rows[k][0] == key]
        assert np.allclose(found[key]["_sum"], values[mine].sum(axis=0))
        assert sorted(found[key]["_members"]) == mine + [900] * (key == "k0") and found[key]["_n"] == len(found[key]["_members"])
    with pytest.raises(Exception, match="Expected 3-dimensional"):
        pooling.sum_vectors(frame, ["key"], 3).collect()
    assert pooling.sum_vectors(frame.limit(0), ["key"], 768).collect() == []


def test_bad_vectors_are_set_apart(spark):
    rows = [("good", [1.0, 0.0]), ("short", [1.0]), ("none", None), ("hole", [1.0, None])]
    vectors = F.create_map(*(x for name, v in rows for x in (F.lit(name), F.lit(str(v)))))
    embedder = lambda text: F.from_json(
        F.replace(vectors[F.split_part(text, F.lit(" "), F.lit(-1))], F.lit("None"), F.lit("null")), "array<double>")
    batch = spark.createDataFrame([(n, n, "g", None, n) for n, _ in rows],
                                  "doc_id string, doc_path string, group_id string, title string, content string")
    out = prepare(batch, embedder, 2)
    assert {r["doc_id"] for r in out["rejected"].collect()} == {"short", "none", "hole"}
    assert {r["doc_id"] for r in out["chunks"].collect()} == {"good"} and out["documents"].count() == 4


def test_no_chunk_is_longer_than_its_size():
    rng = random.Random(3)
    for _ in range(60):
        words = ["x" * rng.choice([1, 5, 30, 400, 20_000]) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\n\n", ". ", "\t", "\u2003"]) for w in words)
        parts = chunking._split(text, 64, 8)
        assert all(chunking._tokens(p) <= 64 for p in parts)
        assert set("".join("".join(parts).split())) == set("".join(text.split()))


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_line_diff_keeps_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(changes, "_DIFF_BITS", bits)
    rng = random.Random(1)
    for _ in range(400):
        old, new = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        kept = sorted(changes._kept_positions(old, new))
        rest = iter(old)
        assert len(kept) == _longest(old, new) and all(new[k] in rest for k in kept)


def test_line_diff_of_long_texts_with_blank_lines():
    old, new = ("".join(f"{c}{i}\n\n" for i in range(5000)) for c in "lm")
    started = time.time()
    assert changes._added(old, new).startswith("m0")
    assert time.time() - started < 5


def test_moved_lines(spark):
    assert changes._added("a\nb\nc\n", "c\na\nb\n") == "c"


def test_empty_retrieval_has_empty_map_and_list(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    rated = spark.createDataFrame(
        [("q", "LOW", 15, "r", 0.0, 0.0, 0.0, 0, False, 0)],
        "query_id string, band string, score int, reason string, top_prototype_sim double, top_chunk_vec_sim double, "
        "top_chunk_rerank double, source_diversity int, tier_drop_flag boolean, n_chunks int")
    row = retrieval.retrieval_results(
        spark.createDataFrame([("q", "text")], "query_id string, text string"),
        empty("query_id string, rank int, group_id string, similarity double"), empty("query_id string"), None,
        empty("query_id string, source_index int, doc_path string, group_id string, text string, best_similarity double"), rated,
    ).first()
    assert row["citation_map"] == {} and row["debug"]["tier1_groups"] == [] and row["context_blocks"] == []


def test_written_tables_can_be_released(spark):
    rows = write_through(spark.range(5).toDF("a"))
    folder = Path(rows.inputFiles()[0].removeprefix("file:")).parent
    assert rows.count() == 5 and folder.is_dir()
    release(spark)
    assert not folder.exists()


def test_stream_triggers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n")
    rows = spark.readStream.text(str(tmp_path / "in"))
    running = live.table_sink(rows, str(tmp_path / "out"), str(tmp_path / "cp"), {"processingTime": "1 second"})
    try:
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_runs_from_another_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
         .config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate())
print('rows', e.queries()['embed_terms'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows" in done.stdout, done.stderr[-2000:]
