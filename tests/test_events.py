import json

import pytest
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators import changes, normalize as N, sessions
from paperloom.sources import deadletter, events

def _stamp():
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


def _normalize(spark, source, payload, details):
    df = spark.createDataFrame(
        [(source, json.dumps(payload), json.dumps(details))], "source string, payload string, full_data string"
    )
    row = N.normalize(df, _stamp()).first()
    return row, json.loads(row.metadata)


def test_github(spark):
    files = [
        {"filename": "docs/a.md", "status": "modified", "additions": 3, "deletions": 1, "patch": "one"},
        {"filename": "docs/a.md", "status": "modified", "patch": ""},
        {"filename": "b.md", "patch": "two\nlines"},
    ]
    row, meta = _normalize(
        spark, "github", {"ref": "refs/heads/main"},
        {"repo": "team/app", "description": "About", "commits": [
            {"commitId": "c1", "message": "m", "author": "x", "files": files[:2]}, {"commitId": "c2"},
            {"commitId": "c3", "files": files[2:]},
        ]},
    )
    assert row.error is None
    assert row.doc_id == "team-app-docs-a.md_b.md"
    assert row.title == "team/app"
    assert row.content == "About\nFILE: docs/a.md\none\n\nFILE: b.md\ntwo\nlines"
    assert meta["branch"] == "main" and meta["features"] == []
    assert [c["id"] for c in meta["commits"]] == ["c1", "c2", "c3"]
    assert [f["filename"] for f in meta["files"]] == ["docs/a.md", "docs/a.md", "b.md"]
    assert meta["receivedAt"] == "2024-05-06T07:08:09.000Z"


def test_github_without_anything(spark):
    row, _ = _normalize(spark, "github", {}, {"commits": []})
    assert row.doc_id == "unknown-repo" and row.title == "GitHub Repository"
    assert row.error == C.MISSING_FIELDS


def test_jira(spark):
    details = {
        "issueKey": "P-1", "summary": "", "description": "text", "labels": None,
        "changelog": [{"field": "status", "fromString": "", "toString": "Done"}, {"field": "rank"}],
    }
    row, meta = _normalize(spark, "jira", {}, details)
    assert row.title == "P-1"
    assert row.content == "text\nstatus: empty -> Done\nrank: empty -> empty"
    assert meta["labels"] == [] and meta["status"] is None and len(meta["changelog"]) == 2


def test_confluence(spark):
    row, meta = _normalize(
        spark, "confluence", {"timestamp": "t", "eventType": ""},
        {"pageId": 77, "content": "body", "change": {"versionBefore": 0, "versionAfter": 1},
         "updatedBy": {"accountId": "u"}},
    )
    assert (row.doc_id, row.title, row.error) == ("77", "Untitled", None)
    assert meta["versionBefore"] is None and meta["versionAfter"] == 1
    assert meta["eventType"] == "page_event" and meta["updatedBy"] == {"id": "u", "name": None}
    empty, _ = _normalize(spark, "confluence", {}, {"pageId": "1", "content": ""})
    assert empty.error == C.MISSING_FIELDS


def test_miro(spark):
    payload = {"boardId": {"id": "b1"}, "item": {"id": "i", "title": "T", "text": "", "data": {"content": "C"}}}
    row, meta = _normalize(spark, "miro", payload, {"boardId": "b1", "type": "item:created"})
    assert (row.doc_id, row.title, row.content) == ("b1", "Board b1", "T\nC")
    assert meta["item"] == {"itemId": "i", "itemType": None, "action": "created"}
    row, meta = _normalize(spark, "miro", {"boardId": {"name": "N"}}, {"boardId": "b1"})
    assert row.title == "N" and meta["type"] == "board_event" and meta["item"] is None
    assert row.error == C.MISSING_FIELDS


def test_unknown_source(spark):
    row, _ = _normalize(spark, "pager", {}, {})
    assert row.error == 'No normalizer registered for source: "pager"'


def test_dispatch(spark):
    rows = [
        ("github", '{"repository": {"full_name": "a/b"}}'), ("github", "{}"), ("jira", '{"issue": {"key": ""}}'),
        ("jira", '{"issue": {"key": "K"}}'), ("confluence", '{"page": {"id": 5}}'), ("pager", '{"page": {"id": 5}}'),
        ("miro", '{"boardId": {"id": "m"}}'), (None, "{}"),
    ]
    df = spark.createDataFrame(rows, "source string, payload string")
    assert {r.object_key for r in N.dispatch(df).collect()} == {"a/b", "K", "5", "m"}


@pytest.mark.parametrize("name, kept", [
    ("README", True), ("src/ReadMe.txt", True), ("x.MD", True), ("my-Docs/x.py", True), ("doc/x.py", False), ("md", False),
])
def test_doc_files(spark, name, kept):
    assert spark.range(1).select(N.is_doc_file(F.lit(name)).alias("k")).first().k is kept


def test_commit_enrichment_drops_commits_without_text(spark):
    file = lambda n: (n, "modified", 1, 0, 1)
    commits = [
        ("c1", "m", "x", "t", [file("b.md"), file("a.md"), file("code.py")]), ("c2", "m", "x", "t", [file("code.py")]),
        ("c3", "m", "x", "t", [file("a.md"), file("lost.md")]),
    ]
    schema = (
        "event_id int, repo string, commits array<struct<id: string, message: string, author: string, timestamp: string, "
        "files: array<struct<filename: string, status: string, additions: int, deletions: int, changes: int>>>>"
    )
    df = spark.createDataFrame([(1, "r", commits), (2, "r", [])], schema)
    contents = spark.createDataFrame([("r", "a.md", "A"), ("r", "b.md", "B")], "repo string, filename string, content string")
    done = {r.event_id: r.commits for r in N.enrich_commits(df, contents).collect()}
    assert [c.commitId for c in done[1]] == ["c1"]
    assert [(f.filename, f.patch) for f in done[1][0].files] == [("b.md", "B"), ("a.md", "A")]
    assert not done[2]
    coded = contents.withColumn("content", F.base64(F.col("content").cast("binary")))
    again = {r.event_id: r.commits for r in N.enrich_commits(df, coded, encoded=True).collect()}
    assert again == done


def test_validation(spark):
    rows = [
        ("d", "s", "text", '{"a": 1}'), ("", "s", None, '{"a": 1}'), ("d", "s", "text", "{}"), ("d", "s", " \n", '{"a": 1}'),
        ("d", None, " ", None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, source string, content string, metadata string")
    assert [r.errors for r in N.validate(df).collect()] == [
        [], ["Missing required fields: doc_id, content"], ["Missing required fields: metadata"],
        ["Content field is empty"], ["Missing required fields: source, metadata"],
    ]


def test_duplicates_need_a_group(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    stored = spark.createDataFrame([("a", "g", "p"), ("b", None, "p")], "doc_id string, group_id string, doc_path string")
    got = {r.doc_id: (r.is_duplicate, r.route, r.existing_group_id) for r in N.duplicate_check(docs, stored).collect()}
    assert got == {"a": (True, "AUTO_ASSIGN", "g"), "b": (False, None, None), "c": (False, None, None)}


def _events(spark, rows):
    return spark.createDataFrame(rows, "key string, at int, value string")


@pytest.mark.parametrize("width", [1, 2, 1000])
def test_change_gate_across_buckets(spark, width):
    rows = [("k", i, v) for i, v in enumerate("AABAACCCB")] + [("j", 3, "A")]
    passed = changes.change_gate(
        _events(spark, rows), ["key"], ["at"], ["value"], bucket=F.floor(F.col("at") / width)
    )
    assert {(r.key, r.at) for r in passed.collect()} == {("k", 0), ("k", 2), ("k", 3), ("k", 5), ("k", 8), ("j", 3)}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_debounce_gap(spark, width):
    rows = [("k", 0, "a"), ("k", 4, "b"), ("k", 9, "c"), ("k", 20, "d"), ("k", 25, "e"), ("k", 29, "f")]
    df = _events(spark, rows).withColumn("ts", F.timestamp_seconds("at")).withColumn("id", F.col("at"))
    sent = sessions.debounce(
        df, "key", "ts", "value", tie="id", bucket=F.floor(F.col("at") / width)
    ).orderBy("sent_at").collect()
    assert [(r.value, r.n) for r in sent] == [("b", 2), ("c", 1), ("d", 1), ("f", 2)]


def test_debounce_just_below_the_gap(spark):
    df = spark.sql(
        "SELECT 'k' key, id, timestamp_millis(id * 4999) ts, cast(id as string) value FROM range(5)"
    )
    sent = sessions.debounce(df, "key", "ts", "value", tie="id", bucket=F.col("id")).collect()
    assert [(r.value, r.n) for r in sent] == [("4", 5)]


@pytest.mark.parametrize("old, new, added", [
    ("", "a\nb\n", "a\nb"),
    ("a\nb\n", "a\nx\nb\ny\n", "x\n\ny"),
    ("a\nb\nc\n", "a\nb\nc\n", ""),
    ("a\nb\nc\n", "b\nc\na\n", "a"),
    ("a\n", "a\na\n", "a"),
    ("a", "a\nb", "a\nb"),
    ("a\nb\n", "", ""),
])
def test_added_text(spark, old, new, added):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    assert df.select(changes.added_text("o", "n").alias("x")).first().x == added


def test_added_text_is_minimal():
    old, new = list("abcabba"), list("cbabac")
    assert len(changes._kept_positions(old, new)) == 4


def test_bullets(spark):
    text = "intro\n - one\n* two\n*three\n-\n--four"
    found = spark.range(1).select(changes.bullet_features(F.lit(text)).alias("b")).first().b
    assert found == ["one", "two", "three", "", "-four"]


def test_version_changes(spark):
    rows = [("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("p", 5, "b")]
    df = spark.createDataFrame(rows, "page string, version int, content string")
    found = changes.version_changes(df, "page", "version", "content", bucket=F.floor(F.col("version") / 2))
    got = {r.version: (r.change and (r.change["from"], r.change["to"])) for r in found.collect()}
    assert got == {1: (None, "a"), 2: None, 3: ("a", "b"), 5: (None, "b")}


def test_messages_and_dead_letters(spark):
    good = json.dumps({"doc_id": "1", "source": "s", "content": "c", "metadata": {"a": [1]}})
    rows = [(1, good), (2, good[:20]), (3, json.dumps({"doc_id": "1"})), (4, "nonsense"), (5, None)]
    parsed = events.read_documents(spark.createDataFrame(rows, "id int, body string"), "body")
    ok, failed = deadletter.split_errors(parsed)
    row = ok.collect()
    assert [r.id for r in row] == [1] and row[0].metadata == '{"a":[1]}' and row[0].title is None
    errors = {r.id: r.error for r in failed.collect()}
    assert errors[3] == "missing fields: source, content, metadata"
    assert errors[2] == errors[4] == errors[5] == events.PARSE_FAILED
    fixed, still = deadletter.replay(
        failed.select("id", F.when(F.col("id") == 2, F.lit(good)).otherwise(F.col("body")).alias("body"), "error"),
        lambda df: events.read_documents(df, "body"),
    )
    assert [r.id for r in fixed.collect()] == [2] and still.count() == 3


def test_neighbours_texts_are_fetched_late(spark):
    """Only bucket borders look texts up, and the rows that carry what crosses a border hold no text."""
    from paperloom.operators.ordered import with_late_neighbour, with_neighbour

    rows = spark.range(400).selectExpr(
        "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('k', id % 4) END AS k", "cast(id as int) AS t",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('text ', floor(id / 23)) END AS c")
    late = with_late_neighbour(rows, ["k"], ["t"], "c", "was", bucket=F.floor(F.col("t") / 37))
    early = with_neighbour(rows, ["k"], ["t"], "c", "was", bucket=F.floor(F.col("t") / 37))
    assert late.drop("was_order").exceptAll(early).count() == early.exceptAll(late.drop("was_order")).count() == 0
    order = {(r.k, r.t): r.was_order and r.was_order.t for r in late.collect()}
    assert order[("k1", 1)] is None and all(order[("k1", t)] == t - 4 for t in range(5, 400, 4))
    edges = [line for line in late._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lag(_last" in line]
    assert edges and not any("c#" in line.replace("_bucket", "") for line in edges)


def test_file_texts_are_dealt_by_event_once(spark):
    """One exchange brings files with their texts to their event, one the events; the groupings add none."""
    file = "named_struct('filename', concat('docs/', id % 3), 'status', 'm', 'additions', 1, 'deletions', 0, 'changes', 1)"
    commit = f"named_struct('id', 'c', 'message', 'm', 'author', 'a', 'timestamp', '', 'files', array({file}))"
    rows = spark.range(50).selectExpr("id AS event_id", "concat('r', id % 2) AS repo", f"array({commit}, {commit}) AS commits")
    texts = spark.range(6).selectExpr("concat('r', id % 2) AS repo", "concat('docs/', id % 3) AS filename", "repeat('t', 100) AS content")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.enrich_commits(rows, texts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(event_id") == 2 and plan.count("Exchange hashpartitioning(") == 4
        assert all(len(r.commits) == 2 and r.commits[1].files[0].patch == "t" * 100 for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
