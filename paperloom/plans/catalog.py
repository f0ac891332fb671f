"""Named queries over the test tables: name -> (spark, folder) -> DataFrame."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom import constants as C
from paperloom.functions import citations, text as T
from paperloom.functions.vector import cosine, dot, l2_normalize, norm
from paperloom.operators import (
    changes, chunking, clustering, embedding, normalize, parsing, pooling, pruning, retrieval, scoring,
    sessions, tables,
)
from paperloom.plans import bindings as B
from paperloom.plans.classify import classify
from paperloom.plans.ingest import STATE_SCHEMAS, ingest
from paperloom.plans.retrieve import respond, retrieve as run_retrieval
from paperloom.session import cut_lineage, scratch_folder, write_through
from paperloom.sources import deadletter, events, seed
from paperloom.sources.buckets import BucketedTable
from paperloom.sources.tables import load, spread, vector_table
from paperloom.streaming import events as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _elements(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row per vector element, at six decimals."""
    rows = df.select(*keys, F.posexplode_outer(vector).alias("pos", "value"))
    rows = rows.where(F.col("pos").isNotNull())
    return rows.withColumn("value", scoring.round6(F.col("value")))


def _millionths(vector: Column) -> Column:
    """All values of a vector as text, in millionths."""
    return F.array_join(F.transform(
        vector, lambda x: F.floor((x + F.lit(1e-9)) * F.lit(1e6) + F.lit(0.5)).cast("long").cast("string")), ",")


def _list_text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda d, n: d.withColumn(n, scoring.round6(F.col(n))), names, df)


# --- vector search and routing ----------------------------------------------------------

def _hits(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    table, index, floor = {
        "prototype": (B.prototypes, "proto_index", C.REVIEW_THRESHOLD),
        "buffer": (B.buffer, "segment_index", C.REVIEW_THRESHOLD),
        "segment": (B.segments, "segment_index", C.REVIEW_THRESHOLD - C.SEGMENT_MARGIN),
    }[kind]
    hits = scoring.search_kind(
        B.routed_queries(spark, sf), table(spark, sf), B.groups(spark, sf), index,
        keys=["group_id", index], min_similarity=floor,
    )
    return hits.select("query_id", "group_id", "hit_index", "similarity", "rank")


@query
def proto_topk(spark, sf):
    return _hits(spark, sf, "prototype")


@query
def document_proto_topk(spark, sf):
    """Every stored vector asks for its nearest prototypes, in batches of 128 queries."""
    asked = B.segments(spark, sf).select(F.col("doc_id").cast("string").alias("query_id"), "embedding")
    hits = scoring.search_kind(
        scoring.QuestionSet(asked, broadcast_rows=128), write_through(B.prototypes(spark, sf)),
        cut_lineage(B.groups(spark, sf)), "proto_index", keys=["group_id", "proto_index"],
        min_similarity=C.REVIEW_THRESHOLD,
    )
    return hits.select("query_id", "group_id", "hit_index", "similarity", "rank")


@query
def buffer_topk(spark, sf):
    return _hits(spark, sf, "buffer")


@query
def segment_topk(spark, sf):
    return _hits(spark, sf, "segment")


@query
def group_multi_hit_score(spark, sf):
    return scoring.score_groups(_hits(spark, sf, "segment"))


def _candidates(spark, sf, queries=None, groups=None):
    """Derived tables that several branches read are written once."""
    hits = scoring.search_groups(
        queries or cut_lineage(B.routed_queries(spark, sf)), write_through(B.prototypes(spark, sf)), B.buffer(spark, sf),
        B.segments(spark, sf), groups or cut_lineage(B.groups(spark, sf)),
    )
    return scoring.merge_candidates(hits)


@query
def group_candidates_merged(spark, sf):
    return _candidates(spark, sf)


def _routed(spark, sf):
    queries, groups = cut_lineage(B.routed_queries(spark, sf)), cut_lineage(B.groups(spark, sf))
    candidates = scoring.with_group_details(_candidates(spark, sf, queries, groups), groups)
    return scoring.decide_route(queries.select("query_id"), candidates)


@query
def route_decision(spark, sf):
    routed = _routed(spark, sf)
    return routed.select(
        "query_id", "route", "top_similarity", "existing_group_id",
        F.coalesce(_list_text(F.transform("candidates", lambda c: c["id"])), F.lit("")).alias("candidate_ids"),
    )


@query
def document_routes(spark, sf):
    """Every stored vector as a document to route: three searches, merge and decision."""
    queries = write_through(B.segments(spark, sf).select(F.col("doc_id").cast("string").alias("query_id"), "embedding"))
    groups = cut_lineage(B.groups(spark, sf))
    hits = scoring.search_groups(
        queries, write_through(B.prototypes(spark, sf)), write_through(B.buffer(spark, sf)), write_through(B.segments(spark, sf)), groups,
        broadcast_rows=64,
    )
    candidates = scoring.with_group_details(scoring.merge_candidates(hits), groups)
    routed = scoring.decide_route(queries.select("query_id"), candidates)
    return routed.select(
        "query_id", "route", "top_similarity", "existing_group_id",
        F.coalesce(_list_text(F.transform("candidates", lambda c: c["id"])), F.lit("")).alias("candidate_ids"),
    )


@query
def candidate_format(spark, sf):
    routed = _routed(spark, sf)
    shown = scoring.summarize_candidates(F.col("candidates"))
    lines = F.when(F.col("candidates").isNull(), C.NO_CANDIDATES).otherwise(
        scoring.review_lines(F.col("candidates"))
    )
    best = F.get(shown, F.lit(0))
    return routed.select(
        "query_id", lines.alias("lines"), F.coalesce(F.size(shown), F.lit(0)).alias("n_shown"),
        best["name"].alias("first_name"), best["similarity"].alias("first_similarity"),
    )


@query
def review_vector_cache(spark, sf):
    """Vectors cached for review, and the lookup for every routed document."""
    queries = cut_lineage(B.routed_queries(spark, sf))
    routed = scoring.decide_route(queries, _candidates(spark, sf, queries))
    cached = tables.cached_vectors(
        queries.select(F.col("query_id").alias("doc_id")), scoring.review_cache(routed)
    )
    return cached.select(
        "doc_id", F.col("embedding").isNotNull().alias("cached"), _millionths(F.col("embedding")).alias("vector")
    )


@query
def final_outcome(spark, sf):
    parsed = events.read_documents(B.messages(spark, sf), "body").drop("error")
    checked = normalize.validate(parsed.withColumn("doc_id", F.col("message_id").cast("string")))
    # toxic documents are stored too, without a group
    kept = load(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("q"), "quality")).alias("group_id"), F.lit("").alias("doc_path"),
    )
    checked = normalize.duplicate_check(checked, kept)
    routes = _routed(spark, sf).select(
        F.col("query_id").alias("_q"), F.col("route").alias("_route"),
        F.col("existing_group_id").alias("_group"),
    )
    joined = checked.withColumn("_q", F.concat_ws("/", "source", "title")).join(routes, "_q", "left")
    joined = joined.withColumn("route", F.coalesce("route", "_route", F.lit(C.ROUTE_CREATE)))
    joined = joined.withColumn("existing_group_id", F.coalesce("existing_group_id", "_group"))
    reviewed = parsing.parse_decision(B.decisions(spark, sf)).select(
        F.col("doc_id").cast("string").alias("doc_id"), "decision", "assigned_group_id"
    )
    resolved = scoring.final_outcome(joined.join(reviewed, "doc_id", "left"))
    return resolved.select(
        "doc_id", "outcome", "target_group_id", F.array_join("decision_path", ">").alias("decision_path"),
        F.array_join("errors", ";").alias("errors"),
    )


@query
def classify_pages(spark, sf):
    """Pages as new documents: normalised, validated, routed by content, placed."""
    state = B.text_state(spark, sf)
    state["groups"] = B.text_groups(state["documents"])
    state["documents"] = state["documents"].withColumn("doc_id", F.col("doc_id").cast("string"))
    incoming = normalize.normalize(B.confluence_events(spark, sf)).select(
        F.concat(F.lit("page-"), "doc_id").alias("doc_id"), "source", "title", "content", "metadata"
    )
    none = spark.createDataFrame([], "doc_id string, raw string")
    placed = classify(
        write_through(incoming), state, embedding.hashed_terms(B.TEXT_DIM), fingerprints=none, decisions=none
    )
    return placed.select(
        "doc_id", "outcome", "route", "top_similarity", "group_name", "group_id", "doc_path"
    )


@query
def group_chunk_topk(spark, sf):
    """Best chunks of the document's own group, asked with the stored medoid vectors."""
    asked = B.prototypes(spark, sf).select(
        F.concat_ws("/", "group_id", "lang").alias("query_id"), "embedding",
        F.array("group_id").alias("groups"),
    )
    found = retrieval.nearest(
        asked, B.segments(spark, sf), k=5, keys=["group_id", "doc_id"], group="group_id",
        scope="groups",
    )
    return found.select("query_id", "group_id", "doc_id", "similarity", "rank")


@query
def scoped_chunk_topk(spark, sf):
    """Every stored chunk asks for the nearest chunks of its own group: as many questions as chunks, joined by group."""
    chunks = B.stored_chunks(spark, sf).select("doc_id", "chunk_index", "group_id", "embedding")
    asked = chunks.select(
        F.concat_ws("/", "doc_id", "chunk_index").alias("query_id"), "embedding", F.array("group_id").alias("groups"))
    found = retrieval.nearest(
        asked, chunks, k=5, keys=["doc_id", "chunk_index"], group="group_id", scope="groups", broadcast_rows=64, batch_bytes=1 << 18)
    return found.select("query_id", "doc_id", "chunk_index", "similarity", "rank")


@query
def pruned_topk(spark, sf):
    """Every stored vector asks for its ten nearest; blocks that can't hold any of them are skipped."""
    stored = write_through(B.segments(spark, sf).select("doc_id", "embedding"))
    layout = pruning.lay_out(stored, "doc_id", B.VECTOR_DIM, clusters=64, rings=4)
    found, _ = pruning.pruned_nearest(
        stored.select(F.col("doc_id").alias("query_id"), "embedding"), layout, k=10, keys=["doc_id"], near=4)
    return found.select("query_id", "doc_id", "similarity", "rank")


@query
def global_chunk_topk(spark, sf):
    found = retrieval.nearest(
        B.questions(spark, sf), B.embedded_chunks(spark, sf), k=C.CHUNKS_FETCHED,
        keys=["doc_id", "chunk_index"],
    )
    return found.select("query_id", "doc_id", "chunk_index", "similarity", "rank")


@query
def group_shortlist(spark, sf):
    state = B.text_state(spark, sf)
    found = retrieval.shortlist_groups(
        B.questions(spark, sf), state["prototypes"], state["buffer"]
    )
    return found.select("query_id", "group_id", "similarity", "rank")


def _retrieval(spark, sf):
    return run_retrieval(B.questions(spark, sf), B.text_state(spark, sf))


@query
def shortlist_chunks(spark, sf):
    return _retrieval(spark, sf)["fetched"].select(
        "query_id", "doc_id", "chunk_index", "group_id", "doc_path", "vector_similarity", "rank"
    )


@query
def rerank_sigmoid(spark, sf):
    return _retrieval(spark, sf)["fetched"].select(
        "query_id", "doc_id", "chunk_index", "rerank_score", "rerank_rank"
    )


@query
def per_doc_cap(spark, sf):
    return _retrieval(spark, sf)["final"].select(
        "query_id", "doc_id", "chunk_index", "doc_path", "final_rank"
    )


@query
def source_blocks(spark, sf):
    return _retrieval(spark, sf)["blocks"].drop("doc_id")


@query
def retrieval_confidence(spark, sf):
    return _retrieval(spark, sf)["confidence"]


@query
def context_string(spark, sf):
    return _retrieval(spark, sf)["context"]


@query
def retrieve(spark, sf):
    """Nested results, flattened to scalars."""
    cited = F.array_join(
        F.transform(F.map_entries("citation_map"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return _retrieval(spark, sf)["results"].select(
        "query_id", "query", F.size("context_blocks").alias("n_blocks"), cited.alias("citations"),
        F.col("retrieval_confidence.band").alias("band"), F.col("retrieval_confidence.score").alias("score"),
        F.size("debug.tier1_groups").alias("n_groups"),
        F.col("debug.chunks_retrieved").alias("chunks_retrieved"),
        F.col("debug.chunks_returned").alias("chunks_returned"),
    )


@query
def source_rows(spark, sf):
    found = _retrieval(spark, sf)
    cited = found["blocks"].join(found["confidence"].select("query_id", "score"), "query_id")
    return retrieval.source_rows(cited, F.lit("https://docs.example.org/main/")).drop("doc_id")


@query
def search_response(spark, sf):
    """Answers with renumbered citations and the sources they cite, flattened."""
    found = respond(_retrieval(spark, sf), B.question_answers(spark, sf), "https://docs.example.org/main/")
    listed = F.transform("sources", lambda s: F.concat_ws("=", s["source_index"], s["title"]))
    return found.select(
        "query_id", "answer", "confidence_score", F.size("sources").alias("n_sources"),
        F.array_join(listed, ";").alias("sources"),
    )


@query
def citation_map(spark, sf):
    rows = B.answers(spark, sf)
    cited = citations.cited_numbers(F.col("answer"))
    kept = citations.kept_sources(cited, F.col("known"))
    found = rows.withColumn("_kept", kept)
    return found.select(
        "conv_id", "turn", F.size(cited).alias("n_cited"),
        F.array_join(
            F.transform("_kept", lambda n, i: F.concat_ws(">", n.cast("string"), (i + 1).cast("string"))), ","
        ).alias("renumbered"),
        citations.rewrite(F.col("answer"), F.col("_kept")).alias("answer"),
    )


# --- text ----------------------------------------------------------------------------

@query
def word_stats(spark, sf):
    rows = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    n = T.word_count(F.col("text"))
    return rows.select(
        "doc_id", n.alias("n_words"), T.estimate_tokens(n).alias("n_tokens"),
        F.size(T.lines(F.col("text"))).alias("n_lines"),
        F.array_join(T.words(F.col("text")), "|").alias("words"),
    )


@query
def struct_type(spark, sf):
    return B.analyzed(spark, sf).select("doc_id", "n_words", "struct_type")


@query
def page_struct_type(spark, sf):
    """Structural type of pages, whose headings and bullets come from their markup."""
    rows = B.page_texts(spark, sf)
    return chunking.analyze(rows).select("page_id", "n_words", "struct_type", "title")


@query
def title_extract(spark, sf):
    return B.analyzed(spark, sf).select("doc_id", "title")


@query
def window_chunks(spark, sf):
    return B.chunk_rows(spark, sf).select("doc_id", "chunk_index", "chunk_text")


@query
def chunk_stats(spark, sf):
    return B.chunk_rows(spark, sf).select(
        "doc_id", "chunk_index", "total_chunks", "word_count", "token_count"
    )


@query
def document_sizes(spark, sf):
    chunks = B.stored_chunks(spark, sf)
    return chunking.document_sizes(chunks, clustering.build_segments(chunks, B.TEXT_DIM))


@query
def recursive_chunks(spark, sf):
    return chunking.recursive_chunks(B.analyzed(spark, sf)).select(
        "doc_id", "chunk_index", "total_chunks", "chunk_text", "word_count", "token_count"
    )


@query
def recursive_chunk_words(spark, sf):
    """Every document's chunks hold its first, last and all distinct words, and none is too long."""
    rows = B.analyzed(spark, sf)
    chunks = chunking.recursive_chunks(rows)
    words = F.filter(F.split("chunk_text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    limit = F.when(F.col("struct_type") == "report", 1024).when(F.col("struct_type") == "code", 384).when(
        F.col("struct_type") == "list", 256).otherwise(512)
    fits = (F.ceil(F.size(words) * 0.75) <= limit) | (F.col("struct_type") == "short") | F.col("chunk_text").contains("```")
    per = chunks.withColumn("_w", words).groupBy("doc_id").agg(
        F.min_by(F.get("_w", F.lit(0)), "chunk_index").alias("first_word"),
        F.max_by(F.element_at("_w", -1), "chunk_index").alias("last_word"),
        F.flatten(F.collect_list(F.array_distinct("_w"))).alias("_all"), F.min(fits).alias("all_fit"),
    )
    return per.select(
        "doc_id", "first_word", "last_word", F.size(F.array_distinct("_all")).cast("long").alias("n_distinct"), "all_fit")


@query
def slugify(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query
def doc_path(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    name = F.when(F.col("toxic") == 1, F.concat("doc_id", F.lit(".MD"))).otherwise(F.col("doc_id").cast("string"))
    existing = F.when(F.col("quality") == 0, F.concat(F.lit("old/"), "doc_id"))
    path = T.doc_path(
        F.lit("docs"), T.slugify(F.concat(F.col("source"), F.lit(" "), F.col("lang"))),
        F.when(F.col("quality") == 1, "design").otherwise(""), F.col("source"), name, existing,
    )
    return rows.select("doc_id", path.alias("doc_path"))


@query
def group_name_resolve(spark, sf):
    rows = B.analyzed(spark, sf).join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.join(load(spark, sf, "labels"), "doc_id", "left")
    project = F.when(F.col("quality") == 1, F.concat(F.lit("Team "), F.col("source"))).when(
        F.col("quality") == 0, "  "
    )
    ident = F.col("doc_id").cast("string")
    return rows.select(
        "doc_id",
        T.new_group_name(F.lit(None).cast("string"), project, F.col("title"), ident).alias("group_name"),
        T.new_group_description(F.lit(None).cast("string"), F.col("title")).alias("description"),
    )


@query
def assigned_group_name(spark, sf):
    """Name of the routed group: from the candidates, else the id of the wanted group."""
    routed = _routed(spark, sf)
    wanted = F.coalesce("existing_group_id", F.split_part("query_id", F.lit("/"), F.lit(1)))
    return routed.select(
        "query_id", F.coalesce(T.assigned_group_name(wanted, F.col("candidates")), wanted).alias("group_name")
    )


# --- vectors and clusters -------------------------------------------------------------

@query
def vector_similarity(spark, sf):
    """Dot product and cosine of every vector with the sum of its group."""
    rows = B.segments(spark, sf)
    sums = pooling.sum_vectors(rows, ["group_id"], B.VECTOR_DIM).select("group_id", F.col("_sum").alias("total"))
    joined = rows.join(sums, "group_id")
    v, total = F.col("embedding"), F.col("total")
    return joined.select(
        "doc_id", scoring.round6(dot(v, total)).alias("dot"),
        scoring.round6(dot(v, F.slice(total, 1, 10))).alias("dot_shorter"),
        scoring.round6(cosine(v, total)).alias("cosine"),
    )


@query
def vector_norm_check(spark, sf):
    rows = embedding.split_by_dim(B.segments(spark, sf), B.VECTOR_DIM)
    return rows.select(
        "doc_id", F.size("embedding").alias("dim"), scoring.round6(norm(F.col("embedding"))).alias("norm"),
        "vector_error",
    )


@query
def l2_normalized(spark, sf):
    rows = B.segments(spark, sf).withColumn(
        "embedding", l2_normalize(F.transform("embedding", lambda x: x * (F.col("doc_id") + 1)))
    )
    return _elements(rows, ["doc_id"])


@query
def group_mean_vector(spark, sf):
    return _elements(
        pooling.mean_vectors(B.segments(spark, sf), ["group_id"], B.VECTOR_DIM), ["group_id", "n"]
    )


@query
def weighted_pool(spark, sf):
    sizes = load(spark, sf, "documents").select("doc_id", "n_chars")
    rows = B.described_segments(spark, sf).join(sizes, "doc_id", "left")
    return _elements(
        pooling.weighted_pool(rows, ["source", "lang"], "n_chars", B.VECTOR_DIM), ["source", "lang"]
    )


@query
def segment_plan(spark, sf):
    planned = pooling.plan_segments(B.chunk_rows(spark, sf))
    return planned.select("doc_id", "chunk_index", "n_segments", "segment_index")


@query
def segment_split(spark, sf):
    rows = clustering.build_segments(B.stored_chunks(spark, sf), B.TEXT_DIM)
    return _elements(
        rows.select("doc_id", "segment_index", _list_text(F.col("chunk_indices")).alias("chunk_indices"), "embedding"),
        ["doc_id", "segment_index", "chunk_indices"],
    )


@query
def nearest_centroid(spark, sf):
    centroids = B.prototypes(spark, sf).withColumnRenamed("proto_index", "cluster")
    found = clustering.nearest_centroid(B.segments(spark, sf), centroids, ["group_id"], "doc_id")
    return _doubles(found, "similarity")


def _clusters(spark, sf, iterations):
    rows = B.segments(spark, sf)
    return rows, clustering.kmeans(
        rows, ["group_id"], "doc_id", k=clustering.prototype_count(F.col("n")), dim=B.VECTOR_DIM,
        iterations=iterations,
    )


@query
def kmeans_one_step(spark, sf):
    rows, clusters = _clusters(spark, sf, 1)
    return clusters.select("group_id", "doc_id", "cluster")


@query
def kmeans_groups(spark, sf):
    rows, clusters = _clusters(spark, sf, C.KMEANS_ITERATIONS)
    return clusters.select("group_id", "doc_id", "cluster")


@query
def kmeans_blocks(spark, sf):
    """The same clusters when every group is too large for one task."""
    return clustering.kmeans(
        B.segments(spark, sf), ["group_id"], "doc_id", k=clustering.prototype_count(F.col("n")), dim=B.VECTOR_DIM,
        task_rows=1, block_rows=16,
    )


@query
def cluster_segments(spark, sf):
    """Each group read as one long document whose chunks are its vectors."""
    rows = B.segments(spark, sf)
    total = rows.groupBy("group_id").agg(F.count("*").cast("int").alias("total_chunks"))
    chunks = rows.join(total, "group_id").select(
        F.col("group_id").alias("doc_id"), F.col("segment_index").alias("chunk_index"), "total_chunks",
        F.lit(1).alias("word_count"), "embedding",
    )
    found = clustering.build_segments(chunks, B.VECTOR_DIM)
    return found.select(
        "doc_id", "segment_index", _list_text(F.col("chunk_indices")).alias("chunk_indices"),
        _millionths(F.col("embedding")).alias("vector"),
    )


@query
def group_medoid(spark, sf):
    found = clustering.medoids(B.segments(spark, sf), ["group_id"], "doc_id", B.VECTOR_DIM)
    return _doubles(found.select("group_id", "doc_id", "score", "n_members"), "score")


@query
def group_prototypes(spark, sf):
    found = clustering.group_prototypes(B.segments(spark, sf), "doc_id", B.VECTOR_DIM)
    return found.select("group_id", "proto_index", "doc_id")


@query
def embed_terms(spark, sf):
    rows = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _elements(
        embedding.embed_queries(rows, embedding.hashed_terms(B.TEXT_DIM)), ["doc_id"]
    )


@query
def vector_scan(spark, sf):
    """Stored vectors, read back with their group."""
    stored = load(spark, sf, "embeddings").withColumnRenamed("label", "group_id")
    rows = vector_table(stored)
    return _elements(rows, ["group_id", "vec_id"])


# --- stored tables --------------------------------------------------------------------

def _before_after(spark, sf):
    old, new = B.document_rows(spark, sf), B.batch_rows(spark, sf)
    state = {"documents": old, "chunks": B.line_rows(old), "segments": B.line_rows(old)}
    batch = {"documents": new, "chunks": B.line_rows(new), "segments": B.line_rows(new)}
    return state, batch


@query
def replace_by_document(spark, sf):
    state, batch = _before_after(spark, sf)
    return tables.replace_documents(state, batch)["chunks"]


@query
def upsert_documents(spark, sf):
    state, batch = _before_after(spark, sf)
    return tables.replace_documents(state, batch)["documents"]


@query
def upsert_latest(spark, sf):
    """Last event of every user."""
    rows = load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    return tables.latest(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query
def insert_if_absent(spark, sf):
    """Groups of the batch are added; those that exist keep their row."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("group_id").agg(F.count("*").alias("n")).withColumn(
            "group_name", F.concat(F.lit(prefix), "group_id")
        )

    old = named(load(spark, sf, "documents").withColumn("group_id", F.col("lang")), "old-")
    return tables.insert_if_absent(old, named(B.batch_rows(spark, sf), "new-"), ["group_id"])


@query
def append_chunks(spark, sf):
    """Old and new chunk rows side by side, as a plain append leaves them."""
    state, batch = _before_after(spark, sf)
    return state["chunks"].unionByName(batch["chunks"]).groupBy("doc_id", "group_id").agg(
        F.count("*").alias("n")
    )


def _updates(spark, sf) -> DataFrame:
    """Labelled documents get a quality group; toxic ones also a new path."""
    return load(spark, sf, "labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("doc_id"),
        F.when(F.col("quality") == 1, "good").alias("group_id"),
        F.when(F.col("toxic") == 1, "hidden").alias("doc_path"),
    )


@query
def cascade_regroup(spark, sf):
    state, _ = _before_after(spark, sf)
    changed = tables.update_documents(state, _updates(spark, sf), ("chunks", "segments"))
    return changed["chunks"].select("doc_id", "group_id", "chunk_index")


@query
def document_update(spark, sf):
    state, _ = _before_after(spark, sf)
    changed = tables.update_documents(state, _updates(spark, sf), ("chunks", "segments"))
    return changed["documents"].select("doc_id", "group_id", "doc_path")


@query
def cascade_delete(spark, sf):
    state, _ = _before_after(spark, sf)
    left = tables.delete_documents(state, _updates(spark, sf))
    counts = left["chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return left["documents"].select("doc_id", "group_id").join(counts, "doc_id", "left")


@query
def buffer_refresh(spark, sf):
    """Every buffered document, moved to its source's group."""
    fresh = B.described_segments(spark, sf).join(load(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")
    fresh = fresh.withColumn("group_id", F.col("source"))
    columns = ["group_id", "doc_id", "segment_index"]
    return tables.refresh_buffer(B.buffer(spark, sf).select(*columns), fresh).select(*columns)


@query
def buffered_distinct_docs(spark, sf):
    return tables.buffered_documents(B.buffer(spark, sf))


@query
def doc_count_refresh(spark, sf):
    """Groups of vectors, and groups named like sources, which have no document here."""
    refreshed = tables.refresh_doc_count(B.all_groups(spark, sf), B.segments(spark, sf))
    return refreshed.select("group_id", "doc_count")


@query
def proto_count_update(spark, sf):
    return tables.update_proto_count(B.groups(spark, sf), B.prototypes(spark, sf)).select(
        "group_id", "proto_count"
    )


@query
def recompute_policy(spark, sf):
    """Groups of vectors have prototypes; those named like sources have segments only."""
    return tables.recompute_policy(
        B.all_groups(spark, sf), B.buffer(spark, sf), B.prototypes(spark, sf), B.all_segments(spark, sf)
    )


@query
def prototype_replace(spark, sf):
    """New prototypes for the groups due; the others keep theirs."""
    old = B.prototypes(spark, sf).select("group_id", "proto_index")
    due = cut_lineage(recompute_policy(spark, sf).where("needs_recompute").select("group_id"))
    fresh = clustering.medoids(
        B.all_segments(spark, sf).join(due, "group_id", "left_semi"), ["group_id"], "doc_id", B.VECTOR_DIM
    ).select("group_id", F.col("doc_id").cast("int").alias("proto_index"))
    return tables.replace_prototypes(old, fresh)


@query
def buffer_clear(spark, sf):
    due = recompute_policy(spark, sf).where("needs_recompute")
    return tables.clear_buffer(B.buffer(spark, sf), due).select("group_id", "doc_id")


@query
def regroup_affected(spark, sf):
    state, batch = _before_after(spark, sf)
    after = tables.replace_documents(state, batch)
    return tables.regrouped(state["documents"], batch["documents"], after["segments"])


@query
def regroup_repair(spark, sf):
    """Groups that lose or gain vectors: counts and medoid after the change, from sums kept by difference."""
    old = B.segments(spark, sf).select("doc_id", "group_id", "embedding")
    labels = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    judged = old.join(labels, "doc_id")
    leaving = judged.where("quality = 0 OR toxic = 1").select(old.columns)
    coming = judged.where("quality = 1 AND toxic = 1").withColumn(
        "group_id", ((F.col("group_id").cast("long") + 1) % 10).cast("string")).select(old.columns)
    sums = write_through(pooling.sum_vectors(old, ["group_id"], B.VECTOR_DIM))
    now = cut_lineage(pooling.changed_sums(sums, leaving, coming, ["group_id"], B.VECTOR_DIM))
    touched = leaving.select("group_id").unionByName(coming.select("group_id")).distinct()
    members = old.join(leaving.select("doc_id"), "doc_id", "left_anti").unionByName(coming).join(touched, "group_id", "left_semi")
    found = clustering.medoids(members, ["group_id"], "doc_id", B.VECTOR_DIM, sums=now)
    return touched.join(found, "group_id", "left").select(
        "group_id", F.coalesce("n_members", F.lit(0)).alias("n_documents"), F.col("doc_id").alias("prototype"))


@query
def stored_state(spark, sf):
    """Documents kept as changes by bucket: all of them, then what labels move or drop, then one language again."""
    rows = load(spark, sf, "documents").select("doc_id", F.col("source").alias("group_id"), "lang")
    labels = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    table = BucketedTable(scratch_folder(spark), "doc_id bigint, group_id string, lang string", ("doc_id",), "doc_id", 32)
    table.write(rows, 0)
    judged = rows.join(labels, "doc_id")
    moved = judged.where("quality = 1").withColumn("group_id", F.when(F.col("toxic") == 1, "flagged").otherwise(F.col("group_id")))
    table.write(moved, 1, judged)
    table.fold(spark, 1)
    table.write(rows.where("lang = 'de'").withColumn("group_id", F.lit("de")), 2)
    return table.current(spark).select("doc_id", "group_id", "version")


def _seed_rows(spark, sf):
    return load(spark, sf, "documents").select(
        F.col("source").alias("group_id"), F.col("lang").alias("group_name"),
        F.concat("doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.lit("jira").alias("source"), F.col("text").alias("body"),
    )


@query
def seed_load(spark, sf):
    """Documents as seed rows: id, path and the content with its header lines."""
    return seed.seed_documents(_seed_rows(spark, sf))


@query
def seed_ingest(spark, sf):
    """Seed rows ingested with their groups into an empty store: chunks per document, documents and summary per group."""
    rows = _seed_rows(spark, sf).withColumn("group_id", F.concat_ws("-", "group_id", "group_name"))
    state = {name: spark.createDataFrame([], schema) for name, schema in STATE_SCHEMAS.items()}
    after = ingest(
        seed.seed_documents(rows), {**state, "groups": seed.seed_groups(rows)},
        embedding.hashed_terms(B.TEXT_DIM), B.TEXT_DIM, chunker=chunking.window_chunks,
    )
    chunks = after["chunks"].groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(T.word_count(F.col("chunk_text"))).alias("chunk_words"))
    held = after["documents"].select("doc_id", "doc_path", "group_id").join(chunks, "doc_id", "left")
    return held.join(after["groups"].select("group_id", "group_summary", "doc_count"), "group_id", "left")


@query
def ingest_batch(spark, sf):
    """Documents ingested into an empty store: the resulting group counters."""
    batch = B.stored_documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("doc_id"), "doc_path", "group_id",
        F.lit(None).cast("string").alias("title"), "content",
    )
    state = {name: spark.createDataFrame([], schema) for name, schema in STATE_SCHEMAS.items()}
    state["groups"] = batch.select("group_id").distinct().select(
        "group_id", F.col("group_id").alias("group_name"), F.lit("").alias("group_summary"),
        F.lit(0).cast("long").alias("doc_count"), F.lit(0).cast("long").alias("proto_count"),
    )
    after = ingest(
        batch, state, embedding.hashed_terms(B.TEXT_DIM), B.TEXT_DIM, chunker=chunking.window_chunks
    )
    waiting = tables.buffered_documents(after["buffer"])
    return after["groups"].join(waiting, "group_id", "left").select(
        "group_id", "doc_count", "proto_count", F.coalesce("n_buffered", F.lit(0)).alias("n_buffered")
    )


# --- events ----------------------------------------------------------------------------

@query
def route_by_source(spark, sf):
    """Where each event goes: skipped by the dispatcher, or failing in the normaliser."""
    rows = B.tool_events(spark, sf)
    known = F.col("source").isin(*C.SOURCES)
    normalized = normalize.normalize(rows.withColumn("full_data", F.lit("{}")))
    return normalized.select("event_id", "source", known.alias("dispatched"), "error")


@query
def payload_filter(spark, sf):
    return normalize.dispatch(B.tool_events(spark, sf)).select("event_id", "source", "object_key")


def _commit_files(spark, sf):
    """One commit per document; long lines are documentation, short ones code."""
    def file(line: Column) -> Column:
        word = F.split_part(line, F.lit(" "), F.lit(1))
        name = F.when(F.length(line) > 80, F.concat(F.lit("Docs/"), word)).otherwise(
            F.concat(F.lit("src/"), word, F.lit(".py"))
        )
        return F.struct(
            name.alias("filename"), F.lit("modified").alias("status"), F.length(line).alias("additions"),
            F.lit(0).alias("deletions"), F.length(line).alias("changes"),
        )

    commit = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("message"),
        F.col("source").alias("author"), F.lit("").alias("timestamp"),
        F.transform(F.split("text", "\n"), file).alias("files"),
    )
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("repo"), F.array(commit).alias("commits")
    )


@query
def doc_file_filter(spark, sf):
    files = _commit_files(spark, sf).select("event_id", F.explode(F.col("commits")[0]["files"]).alias("f"))
    kept = files.where(normalize.is_doc_file(F.col("f.filename")))
    return kept.select("event_id", "f.filename", "f.additions")


@query
def commit_enrichment(spark, sf):
    """Known file texts: the longest line of a labelled document with that file name."""
    rows = _commit_files(spark, sf)
    labelled = load(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    contents = (
        rows.join(labelled, "event_id", "left_semi")
        .select("repo", F.explode(F.col("commits")[0]["files"]["filename"]).alias("filename"))
        .groupBy("repo", "filename").agg(F.count("*").cast("string").alias("content"))
    )
    enriched = normalize.enrich_commits(rows, contents)
    files = F.flatten(F.transform("commits", lambda c: c["files"]))
    return enriched.select(
        "event_id", F.coalesce(F.size("commits"), F.lit(0)).alias("n_commits"),
        F.coalesce(F.array_join(F.transform(files, lambda f: F.concat_ws("=", f["filename"], f["patch"])), ";"), F.lit("")).alias("files"),
    )


@query
def changed_files(spark, sf):
    rows = _commit_files(spark, sf)
    return rows.select("event_id", F.array_join(normalize.unique_files(F.col("commits")), ";").alias("files"))


def _normalized(df: DataFrame, **paths: str) -> DataFrame:
    done = normalize.normalize(df)
    picked = [F.get_json_object("metadata", path).alias(name) for name, path in paths.items()]
    stamped = F.get_json_object("metadata", "$.receivedAt").isNotNull().alias("stamped")
    return done.select("event_id", "doc_id", "source", "title", "content", "error", stamped, *picked)


@query
def normalize_github(spark, sf):
    return _normalized(
        B.github_events(spark, sf), branch="$.branch", repo="$.repo", author="$.commits[0].author",
        first_file="$.files[0].filename",
    )


@query
def normalize_jira(spark, sf):
    return _normalized(
        B.jira_events(spark, sf), status="$.status", priority="$.priority", project="$.project",
        change="$.changelog[1].toString",
    )


@query
def normalize_confluence(spark, sf):
    return _normalized(
        B.confluence_events(spark, sf), version_before="$.versionBefore",
        version_after="$.versionAfter", url="$.url", kind="$.eventType",
    )


@query
def normalize_miro(spark, sf):
    return _normalized(
        B.miro_events(spark, sf), kind="$.type", action="$.item.action", item_id="$.item.itemId"
    )


def _day(column: str = "ts") -> Column:
    return F.date_trunc("day", column)


def _timed_events(spark, sf) -> DataFrame:
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def change_gate(spark, sf):
    """Events that change the kind last seen for their user."""
    passed = changes.change_gate(
        _timed_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_type"], bucket=_day()
    )
    return passed.select("event_id", "user_id", "event_type")


@query
def change_gate_batches(spark, sf):
    """The change gate over four batches of a stream, each of which knows only the last kinds before it."""
    rows = _timed_events(spark, sf)
    cuts = rows.agg(F.expr("percentile_approx(unix_micros(ts), array(0.25, 0.5, 0.75))")).first()[0] or []
    last, out = live.last_hashes(scratch_folder(spark), 16), None
    for version, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows if lo is None else rows.where(F.unix_micros("ts") >= lo)
        part = part if hi is None else part.where(F.unix_micros("ts") < hi)
        passed = live.gate_batch(part, last, version, "user_id", ["ts", "event_id"], ["event_type"], bucket=_day())
        out = passed if out is None else out.unionByName(passed)
    return out.select("event_id", "user_id", "event_type")


def _turn_block() -> Column:
    return F.floor(F.col("turn") / 1000)


def _topic_rows(spark, sf):
    """Conversation turns as versions of a page (the first turn is version 1)."""
    return load(spark, sf, "conversations").withColumn("version", F.col("turn") + 1)


@query
def readme_gate(spark, sf):
    """Texts by document source, in order: a repeated text does not pass."""
    rows = load(spark, sf, "documents").select("doc_id", "source", "text")
    passed = changes.text_gate(
        rows, ["source"], ["doc_id"], "text", bucket=F.floor(F.col("doc_id") / 5000)
    )
    return passed.select("doc_id", "source", F.md5("old_text").alias("old_md5"))


@query
def added_lines(spark, sf):
    found = changes.readme_changes(
        _topic_rows(spark, sf), ["conv_id"], ["turn"], "text", bucket=_turn_block()
    )
    return found.select("conv_id", "turn", "added")


@query
def bullet_features(spark, sf):
    rows = B.page_texts(spark, sf)
    listed = changes.bullet_features(F.col("text"))
    return rows.select(
        "page_id", F.size(listed).alias("n_features"), F.array_join(listed, "|").alias("features"),
        T.strip(F.col("text")).alias("description"),
    )


@query
def version_changes(spark, sf):
    found = changes.version_changes(
        _topic_rows(spark, sf), "conv_id", "version", "text", bucket=_turn_block()
    )
    return found.select(
        "conv_id", "version", F.col("change").isNotNull().alias("changed"),
        F.col("change.from").alias("from_text"), F.col("change.to").alias("to_text"), "summary",
    )


@query
def html_text(spark, sf):
    return B.page_texts(spark, sf)


@query
def required_fields(spark, sf):
    parsed = events.read_documents(B.messages(spark, sf), "body").drop("error")
    return normalize.validate(parsed).select("message_id", F.array_join("errors", ";").alias("errors"))


@query
def duplicate_check(spark, sf):
    incoming = load(spark, sf, "documents").select("doc_id", "source")
    stored = load(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 0, F.concat(F.lit("q"), "quality")).alias("group_id"),
        F.concat(F.lit("docs/"), "doc_id").alias("doc_path"),
    )
    return normalize.duplicate_check(incoming, stored)


@query
def dead_letter_split(spark, sf):
    parsed = deadletter.with_destination(events.read_documents(B.messages(spark, sf), "body"))
    return parsed.select("message_id", "doc_id", "destination", "error")


@query
def dead_letter_replay(spark, sf):
    """Quarantined messages run again after a repair that closes cut-off texts."""
    failed = events.read_documents(B.messages(spark, sf), "body").where(F.col("error").isNotNull())
    repaired = F.when(
        F.col("error") == events.PARSE_FAILED,
        F.to_json(F.struct(
            F.col("message_id").cast("string").alias("doc_id"), F.lit("replay").alias("source"),
            F.substring("body", 13, 2_000_000_000).alias("content"), F.struct(F.lit(1).alias("retry")).alias("metadata"),
        )),
    ).otherwise(F.col("body"))
    waiting = failed.select("message_id", repaired.alias("body"))
    good, _ = deadletter.replay(waiting.withColumn("error", F.lit(None)), lambda df: events.read_documents(df, "body"))
    return good.select("message_id", "doc_id", "source", "content")


def _clock(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


@query
def debounce_sessions(spark, sf):
    sent = sessions.debounce(
        _timed_events(spark, sf).withColumn("payload", F.concat_ws(":", "event_type", "props")),
        "user_id", "ts", "payload", tie="event_id", bucket=_day(),
    )
    return sent.select("user_id", _clock("sent_at"), "payload", "n")


@query
def debounce_long_gap(spark, sf):
    """The same with a gap of six hours, so that bursts hold many events and span days."""
    sent = sessions.debounce(
        _timed_events(spark, sf).withColumn("payload", F.concat_ws(":", "event_type", "props")),
        "user_id", "ts", "payload", tie="event_id", bucket=_day(), gap="6 hours",
    )
    return sent.select("user_id", _clock("started_at"), _clock("sent_at"), "payload", "n")


# --- model output -----------------------------------------------------------------------

@query
def strip_fences(spark, sf):
    raw = B.responses(spark, sf)
    body = parsing.strip_fences(F.col("raw"))
    return raw.select("doc_id", F.length(body).alias("n_chars"), F.md5(body).alias("body_md5"))


@query
def fingerprint_compose(spark, sf):
    return parsing.compose_fingerprint(B.responses(spark, sf)).select("doc_id", "fingerprint", "error")


@query
def doc_type_check(spark, sf):
    return parsing.compose_fingerprint(B.responses(spark, sf)).select("doc_id", "doc_type")


@query
def decision_parse(spark, sf):
    return parsing.parse_decision(B.decisions(spark, sf)).drop("raw")


@query
def message_content(spark, sf):
    """Conversation turns as message content: plain for users, a list for assistants."""
    entries = F.to_json(F.array(
        F.to_variant_object(F.struct(F.col("text").alias("text"))),
        F.to_variant_object(F.struct(F.col("role").alias("content"))),
    ))
    quoted = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    content = F.when(F.col("role") == "assistant", entries).otherwise(quoted)
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", parsing.message_text(content).alias("text")
    )
