import pytest
from pyspark.sql import functions as F

from paperloom.operators import scoring as S, retrieval as R

HITS = "query_id string, group_id string, hit_index bigint, similarity double, kind string"


def _candidates(spark, rows):
    return {r.group_id: r for r in S.merge_candidates(spark.createDataFrame(rows, HITS)).collect()}


def test_single_hit_scores_itself(spark):
    row = _candidates(spark, [("q", "g", 3, 0.51, "buffer")])["g"]
    assert (row.similarity, row.max_similarity, row.hit_count, row.top_index) == (0.51, 0.51, 1, 3)


def test_multi_hit_score(spark):
    rows = [("q", "g", 1, 0.5, "segment"), ("q", "g", 2, 0.9, "segment"), ("q", "g", 9, 0.4, "segment")]
    row = _candidates(spark, rows)["g"]
    assert row.similarity == pytest.approx(0.7 * 0.9 + 0.3 * 0.6) and row.top_index == 2 and row.hit_count == 3


def test_merge_weighs_best_scores_by_hits(spark):
    rows = [
        ("q", "g", 1, 0.6, "prototype"), ("q", "g", 2, 0.8, "buffer"), ("q", "g", 3, 0.4, "buffer"),
        ("q", "g", 4, 0.8, "segment"), ("q", None, 1, 0.9, "segment"), ("q", "", 1, 0.9, "buffer"),
    ]
    found = _candidates(spark, rows)
    early = round(0.7 * 0.8 + 0.3 * (0.6 * 1 + 0.8 * 2) / 3, 6)
    assert set(found) == {"g"}
    row = found["g"]
    assert row.hit_count == 4 and row.max_similarity == 0.8 and row.top_index == 2
    assert row.similarity == pytest.approx(0.7 * 0.8 + 0.3 * (0.8 * 3 + 0.8) / 4) and early < row.similarity


def test_scores_match_the_single_list_form(spark):
    rows = [("q", "g", i, 0.4 + i / 100, "buffer") for i in range(7)] + [("q", "h", 1, 0.5, "buffer")]
    hits = spark.createDataFrame(rows, HITS)
    assert sorted(S.score_groups(hits).collect()) == sorted(S.merge_candidates(hits).collect())


def _route(spark, scores, **options):
    queries = spark.createDataFrame([("q",)], "query_id string")
    rows = [("q", f"g{i}", s, s, 1, 0, f"n{i}") for i, s in enumerate(scores)]
    schema = (
        "query_id string, group_id string, similarity double, max_similarity double, hit_count bigint, "
        "top_index bigint, name string"
    )
    return S.decide_route(queries, spark.createDataFrame(rows, schema), **options).first()


@pytest.mark.parametrize("scores, route, top, kept", [
    ([], "CREATE_NEW_GROUP", 0.0, None),
    ([0.7], "AUTO_ASSIGN", 0.7, ["g0"]),
    ([0.699999, 0.5], "REVIEW_BY_AGENT", 0.699999, ["g0", "g1"]),
    ([0.4, 0.6, 0.6, 0.5, 0.45], "REVIEW_BY_AGENT", 0.6, ["g1", "g2", "g3", "g4"]),
])
def test_routes(spark, scores, route, top, kept):
    row = _route(spark, scores)
    assert (row.route, row.top_similarity) == (route, top)
    assert (row.candidates and [c.id for c in row.candidates]) == kept
    assert row.existing_group_id == ("g0" if route == "AUTO_ASSIGN" else None)


def test_review_text(spark):
    df = spark.createDataFrame(
        [([("g", "name", 0.45678), ("h", None, None)],), ([],)],
        "c array<struct<id: string, name: string, similarity: double>>",
    )
    first, none = df.select(S.review_lines(F.col("c")).alias("t"), S.summarize_candidates(F.col("c")).alias("s")).collect()
    assert first.t == "- name (id=g, similarity=0.457)\n- unknown (id=h, similarity=0.000)"
    assert [tuple(c) for c in first.s] == [("g", "name", 0.4568), ("h", None, 0.0)]
    assert none.t == "No candidate groups found."


@pytest.mark.parametrize("errors, duplicate, route, existing, decision, group, outcome, target, path", [
    (["x"], False, "AUTO_ASSIGN", "g", None, None, "INVALID", None, "validate_input"),
    ([], True, "AUTO_ASSIGN", "g", None, None, "ASSIGNED", "g", "validate_input>check_duplicate>assign_node"),
    ([], False, "AUTO_ASSIGN", "g", "CREATE_NEW", None, "ASSIGNED", "g", "validate_input>check_duplicate>assign_node"),
    ([], False, "REVIEW_BY_AGENT", None, "ASSIGN", "h", "ASSIGNED", "h", "validate_input>check_duplicate>agent_review>assign_node"),
    ([], False, "REVIEW_BY_AGENT", None, "ASSIGN", None, "ERROR", None, "validate_input>check_duplicate>agent_review>assign_node"),
    ([], False, "REVIEW_BY_AGENT", None, None, None, "CREATED", None, "validate_input>check_duplicate>agent_review>create_node"),
    ([], False, "CREATE_NEW_GROUP", None, "ASSIGN", "h", "CREATED", None, "validate_input>check_duplicate>create_node"),
])
def test_outcomes(spark, errors, duplicate, route, existing, decision, group, outcome, target, path):
    schema = (
        "errors array<string>, is_duplicate boolean, route string, existing_group_id string, decision string, "
        "assigned_group_id string"
    )
    df = spark.createDataFrame([(errors, duplicate, route, existing, decision, group)], schema)
    row = S.final_outcome(df).first()
    assert (row.outcome, row.target_group_id, ">".join(row.decision_path)) == (outcome, target, path)


# --- retrieval -----------------------------------------------------------------------

def _vectors(spark, rows, index):
    return spark.createDataFrame(rows, f"group_id string, {index}, embedding array<double>")


def _at(cosine):
    return [cosine, (1 - cosine * cosine) ** 0.5]


def _shortlist(spark, prototypes, buffered):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    protos = _vectors(spark, [(g, i, _at(c)) for i, (g, c) in enumerate(prototypes)], "proto_index int")
    rows = _vectors(spark, [(g, str(i), _at(c)) for i, (g, c) in enumerate(buffered)], "doc_id string")
    found = R.shortlist_groups(queries, protos, rows).orderBy("rank").collect()
    return [(r.group_id, r.similarity) for r in found]


@pytest.mark.parametrize("prototypes, buffered, expected", [
    ([("a", 0.6), ("a", 0.7), ("b", 0.5)], [("b", 0.55)], ["a", "b"]),
    ([("a", 0.5)], [], ["a"]),
    ([("a", 0.1), ("b", 0.2), ("c", 0.3)], [], ["c", "b"]),
    ([(g, 0.9 - i / 100) for i, g in enumerate("abcdefg")], [], list("abcde")),
    ([], [], []),
])
def test_shortlist(spark, prototypes, buffered, expected):
    assert [g for g, _ in _shortlist(spark, prototypes, buffered)] == expected


def test_empty_shortlist_searches_everywhere(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    none = spark.createDataFrame([], "query_id string, group_id string")
    chunks = spark.createDataFrame(
        [("d", "g", 0, 1, "t", [1.0, 0.0])],
        "doc_id string, group_id string, chunk_index int, total_chunks int, chunk_text string, embedding array<double>",
    )
    docs = spark.createDataFrame([("d", "p", "g")], "doc_id string, doc_path string, group_id string")
    scoped = R.with_scope(queries, none)
    assert R.retrieve_chunks(scoped, chunks, docs).count() == 1
    nothing = queries.withColumn("groups", F.array().cast("array<string>"))
    assert R.retrieve_chunks(nothing, chunks, docs).count() == 0


FINAL = (
    "query_id string, doc_id string, doc_path string, group_id string, chunk_index int, chunk_text string, "
    "vector_similarity double, rerank_score double, rerank_rank int"
)


def _final(spark, paths, scores=None, vec=0.5):
    rows = [
        ("q", str(i), p, "g", 10 - i, f"t{i}", vec, (scores or [0.9] * len(paths))[i], i + 1)
        for i, p in enumerate(paths)
    ]
    return R.cap_per_path(spark.createDataFrame(rows, FINAL))


@pytest.mark.parametrize("paths, kept", [
    (["a", "a", "a", "b"], ["0", "1", "3"]),
    ([None, None, None], ["0", "1"]),
    (list("abcdefgh"), list("0123456")),
])
def test_cap(spark, paths, kept):
    assert [r.doc_id for r in _final(spark, paths).orderBy("final_rank").collect()] == kept


def test_blocks(spark):
    final = _final(spark, ["b", "a", "b", "c", "d", "e", "f"], [0.9, 0.95, 0.7, 0.6, 0.5, 0.4, 0.3])
    blocks = R.source_blocks(final).orderBy("source_index").collect()
    assert [b.doc_path for b in blocks] == ["b", "a", "c", "d", "e"]
    assert blocks[0].text == "t2\n\nt0" and blocks[0].best_similarity == 0.9 and blocks[0].n_chunks == 2


@pytest.mark.parametrize("proto, rerank, paths, vec, band, score", [
    (0.73, 0.81, ["a", "b"], 0.6, "HIGH", 90),
    (0.72, 0.81, ["a", "b"], 0.6, "MEDIUM", 70),
    (0.9, 0.80, ["a", "b"], 0.8, "MEDIUM", 70),
    (0.9, 0.81, ["a"], 0.8, "MEDIUM", 70),
    (0.9, 0.81, ["a", None], 0.8, "HIGH", 90),
    (0.9, 0.81, ["a", "b"], 0.6, "HIGH", 75),
    (0.8, 0.81, ["a", "b"], 0.6, "HIGH", 90),
    (0.6, 0.6, ["a"], 0.1, "MEDIUM", 55),
    (0.55, 0.9, ["a"], 0.5, "LOW", 30),
    (0.9, 0.55, ["a"], 0.1, "LOW", 30),
    (0.9, 0.9, [], 0.1, "LOW", 15),
])
def test_confidence(spark, proto, rerank, paths, vec, band, score):
    queries = spark.createDataFrame([("q",)], "query_id string")
    shortlist = spark.createDataFrame([("q", "g", proto)], "query_id string, group_id string, similarity double")
    row = R.confidence(queries, shortlist, _final(spark, paths, [rerank] * len(paths), vec)).first()
    assert (row.band, row.score) == (band, score)


def test_reranking(spark):
    df = spark.createDataFrame(
        [("q", "Alpha beta", 1, "d", 0, "nothing here"), ("q", "Alpha beta", 2, "d", 1, "BETA, alpha!"),
         ("q", "Alpha beta", 3, "d", 2, "alpha")],
        "query_id string, query_text string, rank int, doc_id string, chunk_index int, chunk_text string",
    )
    rows = R.rerank(df).orderBy("rerank_rank").collect()
    assert [r["rank"] for r in rows] == [2, 3, 1]
    assert rows[1].rerank_score == 0.5 and rows[0].rerank_score == pytest.approx(0.982014)


def test_urls_and_titles(spark):
    df = spark.createDataFrame(
        [("q", 1, None, "/docs/a.md", "t", None, 70), ("q", 2, "d", None, "t", 0.4, 70)],
        "query_id string, source_index int, doc_id string, doc_path string, text string, best_similarity double, score int",
    )
    a, b = R.source_rows(df, F.lit("https://h/")).collect()
    assert (a.url, a.title, a.similarity, a.doc_id) == ("https://h/docs/a.md", "a.md", 0.7, "")
    assert (b.url, b.title, b.similarity) == ("", "Untitled", 0.4)
    assert R.source_rows(df, F.lit("")).first().url == ""
