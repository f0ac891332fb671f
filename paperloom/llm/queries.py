"""One query per operator, with production parameters, over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import (
    credentials, embedding_dedup, licenses, lm_scoring, merkle, mixing, pieces, quality_model, quality_rules, sharding, simhash,
    spelling, substrings,
)
from paperloom.llm.common import lower_ascii
from paperloom.sources.tables import load


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, cosine 0.93 within a label."""
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality_rules.judge(load(spark, sf_dir, "documents"), keep=["doc_id"])
    m = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(m[n].alias(n) for n in names))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles and component, at most two differing bits, of every document."""
    found = simhash.classes(load(spark, sf_dir, "documents"), shingle=3, budget=2)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probability of every document; learns from the documents that aren't held out."""
    return lm_scoring.score(load(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet the square root of their shares; as many rows in all."""
    return mixing.mix(load(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets, and of linked weak parts, of every document."""
    found = credentials.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(credentials.joined(base), 256).alias("base_sha256"), credentials.joined(spans).alias("spans"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that earlier windows of twenty words repeat, and a digest of the rest."""
    cut = substrings.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of near equal bytes."""
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    found = licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("license")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), F.size(m["places"]).cast("long").alias("n_base"),
        F.array_min(m["places"]).alias("first_word"), F.array_max(m["places"]).alias("last_word"),
        F.array_join(m["base_labels"], ",").alias("base_labels"), F.array_join(m["labels"], ",").alias("labels"),
        m["score"].alias("score"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back (its own marks as blanks)."""
    model = pieces.read_model(pieces.default_model())
    found = pieces.encode(load(spark, sf_dir, "documents"), model, keep=["doc_id"], check="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document."""
    return quality_model.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, grouped with their variants one letter away."""
    return spelling.variants(load(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a third of them, tampered with, still verify."""
    docs, fields = load(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    other = merkle.leaf_digest(*(lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in fields))
    found = merkle.manifest(docs, fields=fields, carry={"other": F.when(tampered, other)})
    folded = merkle.folded(F.coalesce("other", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}
