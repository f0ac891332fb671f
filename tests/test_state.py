"""Stored tables, ingest and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import embedding, tables
from paperloom.plans.classify import classify
from paperloom.plans.ingest import STATE_SCHEMAS, ingest, summary
from paperloom.session import write_through
from paperloom.sources import events, seed, versioned
from paperloom.sources.buckets import BucketedTable
from paperloom.sources.snapshots import versions
from paperloom.streaming import events as live, ingest as flow

DIM = 32
EMBED = embedding.hashed_terms(DIM)


def _empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in STATE_SCHEMAS.items()}


def _text(topic, i, n=400):
    return f"# {topic} {i}\n\n" + " ".join(f"{topic}{j % 40}" for j in range(i, n + i)) + "."


def _batch(spark, rows):
    return spark.createDataFrame(
        [(d, f"p/{d}", g, None, t) for d, g, t in rows],
        "doc_id string, doc_path string, group_id string, title string, content string",
    )


def _groups(spark, names):
    return spark.createDataFrame([(n, n, "", 0, 0) for n in names], STATE_SCHEMAS["groups"])


def _counts(state, key="group_id"):
    return {r.group_id: (r.doc_count, r.proto_count) for r in state["groups"].collect()}


def test_ingest_replaces_and_repairs(spark):
    state = {**_empty(spark), "groups": _groups(spark, ["a", "b"])}
    first = _batch(spark, [(f"d{i}", "a", _text("alpha", i)) for i in range(4)] + [("solo", "b", _text("beta", 1))])
    state = ingest(first, state, EMBED, DIM)
    assert _counts(state) == {"a": (4, 2), "b": (1, 1)}
    assert state["buffer"].count() == 0

    moved = _batch(spark, [("solo", "a", _text("alpha", 9)), ("d0", "a", "tiny text")])
    after = ingest(moved, state, EMBED, DIM)
    counts = _counts(after)
    assert counts["b"] == (0, 0) and counts["a"][0] == 5
    chunks = after["chunks"].where("doc_id = 'd0'").collect()
    assert len(chunks) == 1 and chunks[0].chunk_text == "tiny text"
    assert {r.doc_id for r in after["buffer"].collect()} == {"solo", "d0"}
    assert after["documents"].count() == 5
    assert after["segments"].where("doc_id = 'solo'").select("group_id").distinct().collect()[0][0] == "a"


def test_buffer_triggers_recompute(spark):
    state = {**_empty(spark), "groups": _groups(spark, ["a"])}
    state = ingest(_batch(spark, [("x", "a", _text("alpha", 0))]), state, EMBED, DIM)
    more = _batch(spark, [(f"d{i}", "a", _text("alpha", i)) for i in range(3)])
    waiting = ingest(more, state, EMBED, DIM, min_docs=4)
    assert waiting["buffer"].select("doc_id").distinct().count() == 3 and _counts(waiting) == {"a": (4, 1)}
    full = ingest(more, state, EMBED, DIM, min_docs=3)
    assert full["buffer"].count() == 0 and _counts(full) == {"a": (4, 2)}


def test_seed(spark):
    rows = spark.createDataFrame(
        [("g1", "one", "a/b.md", "T", "jira", "body"), ("g1", "one", "a/c.md", "U", "github", "other body")],
        "group_id string, group_name string, path string, title string, source string, body string",
    )
    docs = seed.seed_documents(rows)
    assert docs.orderBy("doc_id").first().content == "Title: T\nGroup: one\nSource: jira\n\nbody\n"
    state = ingest(docs, {**_empty(spark), "groups": seed.seed_groups(rows)}, EMBED, DIM)
    assert _counts(state) == {"g1": (2, 2)}
    assert {r.doc_id for r in summary(state).collect()} == {"g1:a/b.md", "g1:a/c.md"}


def test_upserts_are_idempotent(spark):
    rows = [("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None)]
    df = spark.createDataFrame(rows, "key string, version int, value string")
    once = tables.latest(df, ["key"], ["version"])
    assert {tuple(r) for r in once.collect()} == {("k", 3, "c"), ("j", 1, None)}
    assert {tuple(r) for r in tables.latest(once.unionByName(df), ["key"], ["version"]).collect()} == {
        ("k", 3, "c"), ("j", 1, None)}
    kept = tables.insert_if_absent(once, df.where("version < 3").withColumn("key", F.concat("key", F.lit("2"))), ["key"])
    assert kept.count() == 5


def _document(doc_id, text, at="2024-01-01T00:00:00.000Z", **extra):
    return (doc_id, "jira", extra.get("title"), text, json.dumps({"project": extra.get("project", ""), "receivedAt": at}))


DOCUMENT = "doc_id string, source string, title string, content string, metadata string"
RESPONSES = "doc_id string, raw string"


def test_classify(spark):
    state = {**_empty(spark), "groups": _groups(spark, ["a", "b"])}
    rows = [(f"{g}{i}", g, _text("alpha" if g == "a" else "beta", i)) for g in "ab" for i in range(3)]
    state = ingest(_batch(spark, rows), state, EMBED, DIM)
    docs = spark.createDataFrame(
        [_document("new", _text("alpha", 5)), _document("a1", "known document"), _document("bad", " "),
         _document("far", "zzz yyy xxx", title="Far Away"), _document("near", _text("mixed", 1))], DOCUMENT,
    )
    prints = spark.createDataFrame(
        [("new", json.dumps({"fingerprint": _text("alpha", 2), "doc_type": "design"}))], RESPONSES)
    decisions = spark.createDataFrame([("near", '{"decision": "ASSIGN", "assigned_group_id": "b"}')], RESPONSES)
    done = {r.doc_id: r for r in classify(docs, state, EMBED, fingerprints=prints, decisions=decisions).collect()}
    assert done["new"].outcome == "ASSIGNED" and done["new"].group_id == "a"
    assert done["new"].doc_path == "docs/a/design/jira/new.md"
    assert done["a1"].outcome == "ASSIGNED" and done["a1"].doc_path == "p/a1" and done["a1"].is_duplicate
    assert done["bad"].outcome == "INVALID" and done["bad"].doc_path is None
    assert done["far"].outcome in ("CREATED", "ASSIGNED")
    named = spark.createDataFrame([("far", " Distant Things "), ("new", "not asked")], RESPONSES)
    alone = {**state, **{n: state[n].limit(0) for n in ("segments", "prototypes", "buffer")}}
    for proposed, want in ((named, "distant-things"), (named.withColumn("raw", F.lit(" !? ")), "far-away"), (None, "far-away")):
        rows = classify(docs.where("doc_id = 'far'"), alone, EMBED, fingerprints=prints, decisions=decisions, names=proposed).collect()
        assert [(r.outcome, r.group_name) for r in rows] == [("CREATED", want)]


def test_versioned_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    write = lambda rows, v: versioned.append_version(spark.createDataFrame(rows, "k string, x int"), root, v)
    write([("a", 1), ("a", 2), ("b", 3)], 0)
    write([("a", 9)], 1)
    write([("a", 8)], 1)
    rows = versioned.all_versions(spark, root, "k string, x int")
    assert {(r.k, r.x) for r in versioned.current(rows, "k").collect()} == {("a", 8), ("b", 3)}


def _write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_debounce_stream(spark, tmp_path):
    rows = [("A", 0), ("B", 4), ("C", 9), ("D", 9.5), ("E", 100), ("late", 1), ("end", 4000)]
    for i, (p, s) in enumerate(rows):
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(1_700_000_000 + int(s))) + f".{int(s * 10 % 10)}Z"
        _write_lines(tmp_path / "in", f"{i}.json", [{"key": "k", "ts": stamp, "payload": p}])
    stream = spark.readStream.schema("key string, ts timestamp, payload string").option(
        "maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
    sent = live.debounce_stream(stream, "key", "ts", "payload")
    query = live.table_sink(sent, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    got = {(r.payload, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("D", 5), ("E", 1)}


def test_change_gate_stream(spark, tmp_path):
    for i, values in enumerate(["AAB", "BA", "AAC"]):
        rows = [{"key": "k", "at": i * 10 + j, "value": v} for j, v in enumerate(values)] + [
            {"key": "j", "at": i * 10, "value": "X"}]
        _write_lines(tmp_path / "in", f"{i}.json", rows[::-1])
        time.sleep(0.02)
    stream = spark.readStream.schema("key string, at int, value string").option(
        "maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = live.change_gate_stream(
        stream, "key", ["at"], ["value"], str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), bucket=F.floor(F.col("at") / 10), fold_every=2)
    assert query.awaitTermination(180)
    got = {(r.key, r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("k", 0), ("k", 2), ("k", 11), ("k", 22), ("j", 0)}


def test_dead_letter_stream(spark, tmp_path):
    good = {"source": "miro", "payload": {"item": {"title": "T"}}, "full_data": {"boardId": "b"}}
    lines = [good, "{broken", {"source": "pager", "payload": {}, "full_data": {}}, {**good, "payload": {}}]
    _write_lines(tmp_path / "in", "0.json", lines)
    from paperloom.operators.normalize import normalize

    raw = events.read_raw_events(spark, str(tmp_path / "in"), stream=True)

    def step(batch):
        done = normalize(batch.withColumnRenamed("error", "unread"))
        return done.withColumn("error", F.coalesce("unread", "error")).select("value", "doc_id", "content", "error")

    paths = [str(tmp_path / n) for n in ("good", "dead", "cp")]
    for _ in range(2):
        assert live.split_stream(raw, step, *paths).awaitTermination(120)
    passed = spark.read.parquet(paths[0]).collect()
    failed = spark.read.parquet(paths[1]).collect()
    assert [(r.doc_id, r.content) for r in passed] == [("b", "T")]
    assert len(failed) == 3 and sum("No normalizer" in r.error for r in failed) == 1


def test_ingest_stream(spark, tmp_path):
    root, cp = str(tmp_path / "state"), str(tmp_path / "cp")
    batches = [
        [_document("a0", _text("alpha", 0), project="Alpha"), _document("b0", _text("beta", 0), project="Beta")],
        [_document("a1", _text("alpha", 3)), _document("a0", "short now", at="2024-01-02T00:00:00.000Z"),
         _document("a0", "older", at="2024-01-01T00:00:00.000Z"), _document("x", "")],
    ]
    fields = ["doc_id", "source", "title", "content", "metadata"]
    for i, rows in enumerate(batches):
        _write_lines(tmp_path / "in", f"{i}.json", [dict(zip(fields, r)) for r in rows])
        time.sleep(0.02)
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    none = spark.createDataFrame([], RESPONSES)
    query = flow.ingest_stream(stream, root, cp, EMBED, DIM, fingerprints=none, decisions=none)
    assert query.awaitTermination(600)
    state = flow.read_state(spark, root)
    docs = {r.doc_id: r for r in state["documents"].collect()}
    assert set(docs) == {"a0", "b0", "a1"} and docs["a0"].content == "short now"
    names = {r.group_id: r.group_name for r in state["groups"].collect()}
    assert names[docs["a0"].group_id] == "alpha" and docs["a1"].group_id == docs["a0"].group_id
    assert state["chunks"].where("doc_id = 'a0'").count() == 1
    assert {r.doc_id for r in state["buffer"].collect()} == {"a0", "a1"}
    counts = {r.group_name: (r.doc_count, r.proto_count) for r in flow.with_counts(state).collect()}
    assert counts == {"alpha": (2, 1), "beta": (1, 1)}
    def content(state):
        return {n: sorted(map(str, t.collect())) for n, t in state.items()}

    before = content(state)
    for _ in range(2):
        flow.compact(spark, root, 1)
        assert versions(spark, f"{root}/chunks", "base") == [1]
        assert content(flow.read_state(spark, root)) == before
    again = spark.createDataFrame(batches[1], DOCUMENT)
    flow.ingest_batch(again, root, 1, EMBED, DIM, fingerprints=none, decisions=none)
    assert {r.doc_id for r in flow.read_state(spark, root)["documents"].collect()} == set(docs)


def _content(state):
    return {n: sorted(map(str, t.collect())) for n, t in state.items()}


def test_every_batch_may_run_twice(spark, tmp_path):
    """Batches, folds among them, run once or twice: equal tables, those of the whole state kept in memory, few folders."""
    rng = random.Random(3)
    none = spark.createDataFrame([], RESPONSES)
    batches = []
    for k in range(5):
        ids = rng.sample(range(8), 3)
        topic = lambda i: "alpha" if (i + k) % 3 else "beta"  # noqa: B023, E731
        batches.append([_document(f"d{i}", _text(topic(i), i + 7 * k) if i else "tiny", project=topic(i)) for i in ids])
    # groups of the documents that are known stay; these move by an agent's decision
    roots = [str(tmp_path / n) for n in ("once", "twice")]
    for root, times in zip(roots, (1, 2), strict=True):
        for k, rows in enumerate(batches):
            for _ in range(times):
                if k and k % 2 == 0:
                    flow.compact(spark, root, k - 1, 4)
                flow.ingest_batch(
                    spark.createDataFrame(rows, DOCUMENT), root, k, EMBED, DIM, fingerprints=none, decisions=none, min_docs=2, buckets=4)
    once, twice = (_content(flow.read_state(spark, root, buckets=4)) for root in roots)
    assert once == twice and len(once["documents"]) == len({r[0] for b in batches for r in b})
    for root in roots:
        assert versions(spark, f"{root}/segments", "base") == [1, 3]
        assert versions(spark, f"{root}/segments", "batch") == [2, 3, 4]  # the first fold's batches went with the second


def test_stream_state_is_that_of_the_batch_job(spark, tmp_path):
    """Documents that move between groups: counts, prototypes and buffer as ``ingest`` keeps them."""
    root, tables_ = str(tmp_path / "s"), flow.state_tables(str(tmp_path / "s"), 4)
    state = {**_empty(spark), "groups": _groups(spark, ["a", "b"])}
    tables_["groups"].write(state["groups"], 0)
    for name in ("documents", "chunks", "segments", "prototypes", "cache"):
        tables_[name].write(state[name], 0)
    from paperloom.plans.ingest import ingest_changes
    steps = [[(f"d{i}", "a", _text("alpha", i)) for i in range(3)] + [("solo", "b", _text("beta", 1))],
             [("solo", "a", _text("alpha", 9)), ("d0", "b", "tiny text")], [("d0", "a", "tiny again")]]
    for v, rows in enumerate(steps, 1):
        batch = _batch(spark, rows)
        seen = flow.read_state(spark, root, v, 4)
        old = seen["documents"].join(batch.select("doc_id"), "doc_id", "left_semi").select("group_id", "doc_id")
        changes = ingest_changes(batch, seen, EMBED, DIM, min_docs=2)
        pairs = batch.select("group_id", "doc_id").unionByName(old).distinct()
        for name, keys in (("chunks", batch), ("segments", pairs), ("documents", batch),
                           ("prototypes", changes["recomputed"].unionByName(changes["emptied"]))):
            tables_[name].write(changes[name], v, keys)
        state = ingest(batch, state, EMBED, DIM, min_docs=2)
        stored = flow.read_state(spark, root, buckets=4)
        for name in ("documents", "chunks", "segments", "prototypes", "buffer"):
            assert _content({name: stored[name]}) == _content({name: state[name].select(stored[name].columns)}), (v, name)
    assert _counts({"groups": flow.with_counts(stored)}) == _counts(state)


def test_a_batch_opens_only_its_buckets(spark, tmp_path):
    table = BucketedTable(str(tmp_path / "t"), "doc_id string, x int", ("doc_id",), "doc_id", 64)
    table.write(spark.range(5000).selectExpr("cast(id as string) AS doc_id", "cast(id as int) AS x"), 0)
    table.fold(spark, 0)
    table.write(spark.range(0, 5000, 50).selectExpr("cast(id as string) AS doc_id", "-1 AS x"), 1)
    asked = spark.createDataFrame([(str(k),) for k in range(0, 100, 10)], "doc_id string")
    mine = table.buckets_of(asked)
    found = table.current(spark, 2, mine)
    opened = {f.split("/bucket=64-")[1].split("/")[0] for f in found.inputFiles()}
    assert opened == {str(b) for b in mine} and len(mine) <= 10
    got = {r.doc_id: r.x for r in found.join(asked, "doc_id", "left_semi").collect()}
    assert got == {str(k): -1 if k % 50 == 0 else k for k in range(0, 100, 10)}
    assert table.current(spark).count() == 5000


def test_buckets_forget_what_is_gone(spark, tmp_path):
    table = BucketedTable(str(tmp_path / "t"), "g string, d string, x int", ("g", "d"), "g", 3)
    rows = lambda *r: spark.createDataFrame(list(r), "g string, d string, x int")
    keys = lambda *r: spark.createDataFrame(list(r), "g string, d string")
    everything = lambda: {(r.g, r.d, r.x, r.version) for r in table.current(spark).collect()}
    assert everything() == set()
    table.write(rows(("a", "1", 1), ("a", "1", 2), ("a", "2", 3), ("b", "3", 4)), 0)
    table.fold(spark, 0)
    table.write(rows(("b", "1", 9)), 1, keys(("a", "1"), ("b", "1")))
    want = {("a", "2", 3, 0), ("b", "3", 4, 0), ("b", "1", 9, 1)}
    assert everything() == want
    table.fold(spark, 1)
    table.fold(spark, 1)
    assert everything() == want
    table.write(rows(), 2, keys(("a", "2"), ("b", "1"), ("b", "3")))
    assert everything() == set()
    table.fold(spark, 2)
    assert everything() == set()
    assert {(r.g, r.d) for r in table.current(spark, 2).collect()} == {("a", "2"), ("b", "3"), ("b", "1")}
    with pytest.raises(ValueError):
        BucketedTable(table.root, table.schema, table.key, "g", 5).current(spark)


def test_gate_of_batches_is_the_gate_of_all_rows(spark, tmp_path):
    """A hot key with many rows, null keys, a batch that runs twice."""
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS key",
        "cast(id as int) AS at", "cast(floor(id / 5) * 7919 % 3 as int) AS value", "repeat('x', 50) AS payload")
    last, passed = live.last_hashes(str(tmp_path), 4), None
    for v, (lo, hi) in enumerate([(0, 25_000), (25_000, 25_001), (25_001, 60_000)]):
        part = rows.where(f"at >= {lo} AND at < {hi}")
        for _ in range(2):
            got = live.gate_batch(part, last, v, "key", ["at"], ["value"], bucket=F.floor(F.col("at") / 1000)).drop("content_hash")
            stored = write_through(got)  # as a stream does: two folds later its state is gone
        passed = stored if passed is None else passed.unionByName(stored)
        last.fold(spark, v)
    from paperloom.operators.changes import change_gate
    want = change_gate(rows, ["key"], ["at"], ["value"], bucket=F.floor(F.col("at") / 1000)).drop("content_hash")
    assert passed.exceptAll(want).count() == want.exceptAll(passed).count() == 0 and want.count() > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not [line for line in plan.splitlines() if "Window [" in line and "payload" in line]


def test_a_quiet_streams_last_burst_is_sent(spark, tmp_path):
    """One burst and nothing after it; a restart between the event and its timer loses nothing."""
    line = lambda p, s: {"key": "k", "ts": f"2024-01-01T00:00:{s:02d}.000Z", "payload": p}
    _write_lines(tmp_path / "in", "0.json", [line("B", 2), line("A", 0), line("C", 30)])
    stream = spark.readStream.schema("key string, ts timestamp, payload string").json(str(tmp_path / "in"))

    def run(until, gap_ms=4000):
        sent = live.debounce_timers(stream, "key", "ts", "payload", gap_ms=gap_ms)
        query = live.table_sink(sent, str(tmp_path / "out"), str(tmp_path / "cp"), {"processingTime": "500 milliseconds"})
        got = set()
        try:
            for _ in range(240):
                time.sleep(0.5)
                if query.exception():
                    raise query.exception()
                done = list((tmp_path / "out").glob("*.parquet"))
                got = {(r.payload, r.n) for r in spark.read.schema("key string, payload string, n long").parquet(
                    str(tmp_path / "out")).collect()} if done else set()
                if until(got):
                    break
        finally:
            query.stop()
        return got

    first = run(lambda got: got, gap_ms=20_000)  # A, B by their times; C waits for its timer
    assert first == {("B", 2)}
    assert run(lambda got: len(got) > 1) == {("B", 2), ("C", 1)}
