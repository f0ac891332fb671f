"""Two-tier retrieval for a table of questions, and the assembly of cited sources."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom import constants as C
from paperloom.functions.bind import bind
from paperloom.functions.truth import text_or_null
from paperloom.operators.similarity import nearest

Scorer = Callable[[Column, Column], Column]


def shortlist_groups(
    queries: DataFrame, prototypes: DataFrame, buffer: DataFrame, *, top_k: int = C.SHORTLIST_SIZE,
    threshold: float = C.SHORTLIST_THRESHOLD, fallback: int = C.SHORTLIST_FALLBACK, **options,
) -> DataFrame:
    """(query_id, group_id, similarity, rank): groups by their best vector.

    Those at the threshold or above, at most ``top_k``; if there are none, the best two.
    """
    columns = ["group_id", "embedding"]
    vectors = prototypes.select(*columns).unionByName(buffer.select(*columns))
    best = nearest(
        queries, vectors, k=max(top_k, fallback), keys=["group_id"], group="group_id",
        best_of_group=True, **options,
    )
    near = F.max("similarity").over(Window.partitionBy("query_id")) >= threshold
    listed = best.withColumn("_near", near)
    return listed.where(
        F.when(F.col("_near"), (F.col("similarity") >= threshold) & (F.col("rank") <= top_k))
        .otherwise(F.col("rank") <= F.least(F.lit(fallback), F.lit(top_k)))
    ).drop("_near")


def with_scope(queries: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Add ``groups``: the shortlisted groups; null, for all groups, when there are none."""
    scope = shortlist.groupBy("query_id").agg(F.collect_list("group_id").alias("groups"))
    return queries.join(scope, "query_id", "left")


def retrieve_chunks(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame, *, k: int = C.CHUNKS_FETCHED,
    scoped: bool = True, **options,
) -> DataFrame:
    """Nearest chunks per question, inside its ``groups`` when ``scoped``.

    The vector scan reads ids and vectors only; texts and paths are looked up for the
    few rows that were found.
    """
    keys = ["doc_id", "chunk_index"]
    limits = {"group": "group_id", "scope": "groups"} if scoped else {}
    found = nearest(queries, chunks, k=k, keys=keys, **limits, **options)
    texts = chunks.select(*keys, "total_chunks", "chunk_text")
    paths = documents.select("doc_id", "doc_path", "group_id")
    return (
        texts.join(found, keys).join(paths, "doc_id")
        .withColumnRenamed("similarity", "vector_similarity")
    )


def terms(text: Column) -> Column:
    """Distinct lower-case terms (runs of letters and digits)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(found)


def term_overlap(query: Column, text: Column) -> Column:
    """Logit from the share of question terms found in the text: -4 for none, 4 for all."""
    def logit(asked: Column) -> Column:
        shared = F.size(F.array_intersect(asked, terms(text)))
        return F.when(F.size(asked) > 0, 8.0 * shared / F.size(asked) - 4.0).otherwise(F.lit(-4.0))

    return bind(terms(query), logit)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def rerank(hits: DataFrame, scorer: Scorer = term_overlap, query: str = "query_text") -> DataFrame:
    """Add ``rerank_score`` in 0..1 and the rank by it; ties keep the vector order.

    Scoring a pair costs far more than moving it, so the pairs are first dealt by their key, over the
    number of shuffle partitions; a few per question would otherwise be merged into one task.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hits.repartition(parts, "query_id", "doc_id", "chunk_index")
    scored = dealt.withColumn(
        "rerank_score", F.round(sigmoid(scorer(F.col(query), F.col("chunk_text"))), 6)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order))


def cap_per_path(
    ranked: DataFrame, per_path: int = C.CHUNKS_PER_PATH, top: int = C.CHUNKS_RETURNED
) -> DataFrame:
    """At most two chunks of one path, then the first seven; a null path is one path."""
    in_path = Window.partitionBy("query_id", "doc_path").orderBy("rerank_rank")
    overall = Window.partitionBy("query_id").orderBy("rerank_rank")
    kept = ranked.withColumn("_p", F.row_number().over(in_path)).where(F.col("_p") <= per_path)
    kept = kept.withColumn("final_rank", F.row_number().over(overall)).drop("_p")
    return kept.where(F.col("final_rank") <= top)


def source_blocks(final: DataFrame, limit: int = C.MAX_SOURCES) -> DataFrame:
    """(query_id, source_index, doc_path, group_id, text, best_similarity, n_chunks)."""
    part = F.struct("chunk_index", "final_rank", "chunk_text", "group_id", "doc_id")
    blocks = final.groupBy("query_id", "doc_path").agg(
        F.min("final_rank").alias("_first"),
        F.max("rerank_score").alias("best_similarity"),
        F.array_sort(F.collect_list(part)).alias("_parts"),
    )
    order = Window.partitionBy("query_id").orderBy("_first")
    numbered = blocks.withColumn("source_index", F.row_number().over(order))
    return numbered.where(F.col("source_index") <= limit).select(
        "query_id", "source_index", "doc_path",
        F.col("_parts")[0]["group_id"].alias("group_id"),
        F.col("_parts")[0]["doc_id"].alias("doc_id"),
        F.array_join(F.transform("_parts", lambda p: p["chunk_text"]), "\n\n").alias("text"),
        "best_similarity", F.size("_parts").alias("n_chunks"),
    )


def confidence(
    queries: DataFrame, shortlist: DataFrame, final: DataFrame, *,
    proto_high: float = C.PROTO_HIGH, proto_medium: float = C.PROTO_MEDIUM,
) -> DataFrame:
    """Band, score and reason per question, with the signals they rest on.

    A drop between the tiers lowers HIGH to 75 and MEDIUM to 55 points; the band stays.
    """
    tier1 = shortlist.groupBy("query_id").agg(F.max("similarity").alias("top_prototype_sim"))
    tier2 = final.groupBy("query_id").agg(
        F.count("*").alias("n_chunks"),
        F.max("rerank_score").alias("top_chunk_rerank"),
        F.max("vector_similarity").alias("top_chunk_vec_sim"),
        (F.countDistinct("doc_path") + F.max(F.col("doc_path").isNull().cast("int"))).alias("source_diversity"),
    )
    joined = (
        queries.select("query_id").join(tier1, "query_id", "left").join(tier2, "query_id", "left")
        .na.fill(0.0, ["top_prototype_sim", "top_chunk_rerank", "top_chunk_vec_sim"])
        .na.fill(0, ["n_chunks", "source_diversity"])
    )
    proto, rerank_top = F.col("top_prototype_sim"), F.col("top_chunk_rerank")
    drop = F.round(proto - F.col("top_chunk_vec_sim"), 6) > C.TIER_DROP
    band = (
        F.when(F.col("n_chunks") == 0, "LOW")
        .when(
            (proto > proto_high) & (rerank_top > C.RERANK_HIGH)
            & (F.col("source_diversity") >= C.SOURCES_HIGH), "HIGH",
        )
        .when((proto > proto_medium) & (rerank_top > C.RERANK_MEDIUM), "MEDIUM")
        .otherwise("LOW")
    )
    penalty = F.when(F.col("tier_drop_flag"), C.TIER_PENALTY).otherwise(0)
    score = (
        F.when(F.col("n_chunks") == 0, C.SCORE_EMPTY)
        .when(F.col("band") == "HIGH", C.SCORE_HIGH - penalty)
        .when(F.col("band") == "MEDIUM", C.SCORE_MEDIUM - penalty)
        .otherwise(C.SCORE_LOW)
    )
    reason = (
        F.when(F.col("n_chunks") == 0, C.REASON_EMPTY)
        .when(
            F.col("band") == "HIGH",
            F.format_string(C.REASON_HIGH, "source_diversity"),
        )
        .when(F.col("band") == "MEDIUM", C.REASON_MEDIUM)
        .when(proto <= proto_medium, C.REASON_WEAK_GROUP)
        .otherwise(C.REASON_WEAK_CHUNKS)
    )
    return (
        joined.withColumn("tier_drop_flag", drop).withColumn("band", band)
        .withColumn("score", score).withColumn("reason", reason)
    )


def context_strings(blocks: DataFrame, rated: DataFrame) -> DataFrame:
    """Confidence banner, source blocks and source list as one text per question."""
    block = F.struct(
        F.col("source_index"),
        F.concat(F.lit("[Source "), F.col("source_index"), F.lit("] "), F.coalesce("doc_path", F.lit("None")),
                 F.lit("\n"), F.col("text")).alias("body"),
        F.concat(F.lit("["), F.col("source_index"), F.lit("] "), F.coalesce("doc_path", F.lit("None"))).alias("line"),
    )
    listed = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("_b"))
    banner = F.format_string(C.BANNER, "band", "score", "reason")

    def joined(field: str, separator: str) -> Column:
        return F.coalesce(F.array_join(F.transform("_b", lambda b: b[field]), separator), F.lit(""))

    return rated.join(listed, "query_id", "left").select(
        "query_id",
        F.concat(banner, F.lit("\n\n"), joined("body", "\n\n"), F.lit("\n\nSources:\n"), joined("line", "\n")).alias("context"),
    )


def retrieval_results(queries: DataFrame, shortlist, fetched, final, blocks, rated) -> DataFrame:
    """One nested row per question: context blocks, citation map, confidence, debug."""
    block = F.struct("source_index", "doc_path", "group_id", "text", "best_similarity")
    per_query = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("context_blocks"))
    groups = shortlist.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "group_id", "similarity"))).alias("tier1_groups")
    )
    retrieved = fetched.groupBy("query_id").agg(F.count("*").alias("chunks_retrieved"))
    rating = F.struct("band", "score", "reason", F.struct(
        "top_prototype_sim", "top_chunk_vec_sim", "top_chunk_rerank", "source_diversity", "tier_drop_flag"
    ).alias("signals"))
    joined = (
        queries.join(rated, "query_id").join(per_query, "query_id", "left")
        .join(groups, "query_id", "left").join(retrieved, "query_id", "left")
    )
    def or_empty(name: str) -> Column:
        return F.coalesce(name, F.array().cast(dict(joined.dtypes)[name]))

    blocks_or_none = or_empty("context_blocks")
    return joined.select(
        "query_id", F.col("text").alias("query"), blocks_or_none.alias("context_blocks"),
        F.map_from_entries(
            F.transform(blocks_or_none, lambda b: F.struct(b["source_index"], b["doc_path"]))
        ).alias("citation_map"),
        rating.alias("retrieval_confidence"),
        F.struct(
            or_empty("tier1_groups").alias("tier1_groups"), F.coalesce("chunks_retrieved", F.lit(0)).alias("chunks_retrieved"),
            F.col("n_chunks").alias("chunks_returned"),
        ).alias("debug"),
    )


def document_url(base: Column, path: Column) -> Column:
    """Link under ``base``; empty when either part is missing."""
    return F.when(
        text_or_null(base).isNull() | text_or_null(path).isNull(), ""
    ).otherwise(F.concat(base, F.regexp_replace(path, "^/+", "")))


def source_rows(cited: DataFrame, base: Column) -> DataFrame:
    """Response rows of the cited blocks; ``score`` is the confidence score."""
    title = F.element_at(F.split("doc_path", "/", -1), -1)
    return cited.select(
        "query_id", "source_index", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "doc_path",
        document_url(base, F.col("doc_path")).alias("url"),
        F.col("text").alias("chunk_text"),
        F.coalesce("best_similarity", F.col("score") / 100.0).alias("similarity"),
        F.when(text_or_null(F.col("doc_path")).isNull(), C.DEFAULT_TITLE).otherwise(title).alias("title"),
    )


