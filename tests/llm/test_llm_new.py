"""Quality classifier, spelling variants and Merkle manifest: plain versions, other sizes, edges."""

import random
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from paperloom.llm import merkle, quality_model, spelling
from paperloom.llm.queries import QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "Letters letter lettres Letter LETTER lettre letter écoles école ecole écoles école écoles ecole ecole abcde"
ROWS = [
    (1, SENTENCE, "en", "a", len(SENTENCE)),
    (1, SENTENCE, "en", "a", len(SENTENCE)),      # a repeated row
    (2, SENTENCE, None, None, None),
    (3, None, "en", None, None),
    (4, "", "de", "a", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (None, SENTENCE + " more", "de", "b", 3),
    (None, None, None, None, None),
    (7, "x" * 100_000, "de", "b", 300_000),       # one very long word
    (8, ("x" * 99_999 + " ") * 3 + ("x" * 100_000 + " ") * 2, "de", "b", 5),
    (9, "many words " * 60_000, "de", "b", 660_000),
]
CLASH = ["word", "form", "n", "leaf", "tree", "rank", "score", "pooled", "id", "TEXT_", "other", "digest"]


@pytest.fixture(scope="module")
def messy(spark):
    rows = spark.createDataFrame(ROWS, DOC)
    return rows.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH))).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# spelling


def found(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(QUERIES["op12_spelling_variants"](spark, SMALL)) == brute.spelling(docs)


@pytest.mark.parametrize("width", [7, 60, 100_000])
def test_spelling_ranges_change_nothing(spark, monkeypatch, width):
    """Words of two letters, so that halves are shared by very many, in many small ranges or one."""
    rng = random.Random(4)
    words = {"".join(rng.choice("aé") for _ in range(rng.randint(5, 9))) for _ in range(300)}
    text = " ".join(w + " " + " ".join([w] * rng.randint(2, 30)) for w in sorted(words))
    docs = spark.createDataFrame([(k, text, "en", "a", 1) for k in (1, 2)], DOC)
    monkeypatch.setattr(spelling, "RANGE", width)
    monkeypatch.setattr(spelling, "COMPARED", 37)
    want = brute.spelling([(1, text), (2, text)])
    assert max(w[3] for w in want.values()) > 5 and any(w[1] != w[0] for w in want.values() if w[0])
    assert found(spelling.variants(docs)) == want


def test_spelling_edges(messy, empty):
    assert found(spelling.variants(messy)) == brute.spelling([r[:2] for r in ROWS])
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, shortest=4)


def test_edit_rows_agree_with_the_whole_matrix():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(400)})
    listed = spelling.SortedList(words)
    every = np.arange(len(words))
    got = {(words[i], words[j]) for a, b in spelling.one_edit_hits(listed, every, np.ones(len(words), bool)) for i, j in zip(a, b, strict=True)}
    want = {(a, b) for a in words for b in words if brute.one_edit(a, b) and a[:len(a) // 2] == b[:len(a) // 2]}
    assert got == want


# manifest


def proofs(rows):
    return sorted((r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]) for r in rows.collect())


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = {r["doc_id"]: tuple(r)[1:5] for r in QUERIES["op13_merkle_manifest"](spark, SMALL).collect()}
    want = {r[0]: (*m[:3], brute.sha(*(x for p in m[3] for x in p))) for r, m in zip(rows, brute.merkle(rows), strict=True)}
    assert got == want


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 3), (3, 2), (8, 4)])
def test_manifest_storeys(spark, arity, levels):
    """Blocks of few leaves, so that blocks' digests make further storeys."""
    rows = [(k, f"text {k}", f"l{min(3, k % 7)}" if k % 5 else None, None, k) for k in random.Random(1).sample(range(1000), 90)]
    rows += [(1000 + k, "x", f"g{k}", None, 0) for k in range(20)]  # groups of one leaf
    got = merkle.manifest(spark.createDataFrame(rows, DOC), arity=arity, levels=levels)
    assert proofs(got) == sorted(brute.merkle(rows, arity))
    ok = got.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r["ok"] for r in ok.collect())


def test_manifest_edges(spark, messy, empty):
    got = merkle.manifest(messy, carry={"digest": F.lit(7), "leaf_id": F.col("id")})
    assert proofs(got) == sorted(brute.merkle(ROWS))
    assert {(r["digest"], r["leaf_id"]) for r in got.collect()} == {(7, CLASH.index("id"))}
    assert merkle.manifest(empty).collect() == []
    lone = merkle.manifest(spark.createDataFrame(ROWS[:1], DOC)).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof"] == []


def test_tampering_is_found(spark):
    rows = {r["doc_id"]: r["verified"] for r in QUERIES["op13_merkle_manifest"](spark, MORE).collect()}
    texts = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).collect()
    upper = set(string.ascii_uppercase)
    assert rows == {r["doc_id"]: not (r["h"] % 3 == 0 and upper & set(r["text"] or "")) for r in texts}


def test_manifest_moves_no_text(spark):
    plan = merkle.manifest(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan  # it was read and digested before the first exchange


# classifier


def judged(folder):
    return duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()


def test_classifier_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_classifier"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[d], y) for d, y in judged("/root/testdata/sf0.1") if got[d]["held_out"]]
    assert len(held) > 500
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.97
    assert np.mean([r["predicted"] == 0 for r, y in held if not y]) > 0.9
    # calibrated: the mean score is near the share of label 1
    assert abs(np.mean([r["score"] for r, _ in held]) - np.mean([y for _, y in held])) < 0.03


def test_classifier_learns_from_its_folds_only(spark):
    """Turning the labels of held-out documents round changes nothing."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = lambda marks: sorted(tuple(r) for r in quality_model.score(docs, marks).collect())
    assert rows(labels) == rows(turned)
    other = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"))
    assert rows(labels) == sorted(tuple(r) for r in quality_model.score(other.repartition(5), labels).collect())


def test_neighbour_sums():
    places, signs = quality_model.index_vectors()
    tokens = np.random.default_rng(1).integers(1, 9, 60)
    sums, counts = quality_model.neighbour_sums(tokens, places, signs)
    dense = np.zeros((quality_model.ROWS, quality_model.WIDTH))
    np.put_along_axis(dense, places, signs, axis=1)
    want = np.zeros_like(dense)
    for i, t in enumerate(tokens):
        for j in range(max(0, i - 2), min(len(tokens), i + 3)):
            if i != j:
                want[t] += dense[tokens[j]]
    assert np.allclose(sums, want) and counts.sum() == 60


def test_classifier_edges(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (9, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score(messy, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert quality_model.score(empty, labels).collect() == []
    none = quality_model.score(messy, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
