"""The reference tables as views over the given test tables.

Every view covers its whole source tables; rows are tied together by natural keys
(a vector belongs to the document with the same id, a buffered segment to a labelled
document, and so on).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paperloom.functions.html import html_to_text
from paperloom.functions.vector import as_vector
from paperloom.operators import chunking, clustering, embedding, pooling
from paperloom.session import cut_lineage, write_through
from paperloom.sources.tables import load, spread

VECTOR_DIM = 64
TEXT_DIM = 128


# --- the embeddings table: one segment per vector, its label is the group ---------

def segments(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("group_id"),
        F.col("vec_id").cast("int").alias("segment_index"),
        as_vector(F.col("embedding")).alias("embedding"),
    )


def described_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with the language and source of the document they belong to."""
    documents = load(spark, sf, "documents").select("doc_id", "lang", "source")
    joined = segments(spark, sf).join(documents, "doc_id", "left")
    return joined.na.fill("none", ["lang", "source"])


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """The medoid of every group and language."""
    found = clustering.medoids(
        described_segments(spark, sf), ["group_id", "lang"], "doc_id", VECTOR_DIM
    )
    return found.select(
        "group_id", F.col("doc_id").cast("int").alias("proto_index"), "lang", "embedding"
    )


def buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the labelled documents."""
    labelled = load(spark, sf, "labels").select("doc_id")
    return segments(spark, sf).join(labelled, "doc_id", "left_semi")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """One group per label, with its document count."""
    return segments(spark, sf).groupBy("group_id").agg(F.count("*").alias("doc_count")).select(
        "group_id", F.concat(F.lit("group-"), "group_id").alias("group_name"), "doc_count",
        F.lit(0).cast("long").alias("proto_count"),
    )


def all_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of vectors, and one empty group per document source."""
    named = described_segments(spark, sf).select(F.col("source").alias("group_id")).distinct()
    empty = named.select(
        "group_id", F.concat(F.lit("group-"), "group_id").alias("group_name"),
        F.lit(0).cast("long").alias("doc_count"), F.lit(0).cast("long").alias("proto_count"),
    )
    return groups(spark, sf).unionByName(empty)


def all_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments under their label, and once more under their document's source."""
    by_source = described_segments(spark, sf).withColumn("group_id", F.col("source")).drop("lang", "source")
    return segments(spark, sf).unionByName(by_source)


def routed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to route: the mean vector of every source and language."""
    means = pooling.mean_vectors(described_segments(spark, sf), ["source", "lang"], VECTOR_DIM)
    return means.select(F.concat_ws("/", "source", "lang").alias("query_id"), "embedding")


# --- documents as text: chunked, embedded by hashed terms, grouped by source -------

def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("docs"), "source", F.lit("reference"), "lang", F.concat("doc_id", F.lit(".md")))
    return load(spark, sf, "documents").select(
        "doc_id", path.alias("doc_path"), F.col("source").alias("group_id"), "lang",
        F.col("text").alias("content"),
    )


def analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.analyze(spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id"))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.window_chunks(analyzed(spark, sf))


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    owner = load(spark, sf, "documents").select(
        "doc_id", "text", F.col("source").alias("group_id"), "lang"
    )
    chunks = chunking.window_chunks(chunking.analyze(spread(owner, "doc_id")))
    return embedding.embed_chunks(chunks, embedding.hashed_terms(TEXT_DIM))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The embedded chunks, written once as ingest writes them."""
    return write_through(embedded_chunks(spark, sf))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(load(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark texts as questions."""
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embedding.embed_queries(asked, embedding.hashed_terms(TEXT_DIM))


def text_segments(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    owner = documents.select("doc_id", "group_id", "lang")
    return clustering.build_segments(chunks, TEXT_DIM).join(owner, "doc_id").withColumn(
        "segment_id", F.concat_ws(":", "doc_id", "segment_index")
    )


def text_state(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Stored tables of the retrieval queries, written once as ingest would have."""
    chunks = stored_chunks(spark, sf)
    documents = stored_documents(spark, sf)
    stored = write_through(text_segments(chunks, documents))
    protos = clustering.medoids(stored, ["group_id", "lang"], "segment_id", TEXT_DIM)
    place = Window.partitionBy("group_id").orderBy("lang")
    protos = protos.withColumn("proto_index", F.row_number().over(place) - 1)
    labelled = load(spark, sf, "labels").select("doc_id")
    return {
        "chunks": chunks,
        "documents": documents,
        "segments": stored,
        "prototypes": cut_lineage(protos),
        "buffer": stored.join(labelled, "doc_id", "left_semi"),
    }


def text_groups(documents: DataFrame) -> DataFrame:
    counts = documents.groupBy("group_id").agg(F.count("*").alias("doc_count"))
    return counts.select(
        "group_id", F.concat(F.lit("team-"), "group_id").alias("group_name"), "doc_count",
        F.lit(0).cast("long").alias("proto_count"),
    )


# --- two states of the stored documents ----------------------------------------------

def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents before the batch: grouped by source."""
    return load(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), F.col("source").alias("group_id"),
        F.concat_ws("/", "source", "doc_id").alias("doc_path"), F.col("text").alias("content"),
    )


def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming batch: labelled documents move to a quality group, pages are new."""
    moved = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select(
        F.concat(F.lit("doc-"), "doc_id").alias("doc_id"),
        F.concat(F.col("source"), F.lit("-q"), "quality").alias("group_id"),
        F.concat_ws("/", "source", "quality", "doc_id").alias("doc_path"),
        F.lower("text").alias("content"),
    )
    pages = load(spark, sf, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("doc_id"),
        F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("group_id"),
        F.col("url").alias("doc_path"), F.col("html").alias("content"),
    )
    return moved.unionByName(pages)


def line_rows(documents: DataFrame) -> DataFrame:
    """Child rows of documents, one per line, standing in for chunks."""
    return documents.select(
        "doc_id", "group_id", F.posexplode(F.split("content", "\n")).alias("chunk_index", "chunk_text")
    )


# --- raw events -----------------------------------------------------------------------

def _json(**fields) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _struct(**fields) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])




def github_events(spark: SparkSession, sf: str) -> DataFrame:
    """A push per document: every line is the content of a file named by its first word."""
    null = F.lit(None).cast("string")
    rows = spread(load(spark, sf, "documents"), "doc_id").withColumn("_lines", F.split("text", "\n"))

    def changed(line):
        return _struct(
            filename=F.concat(F.lit("docs/"), F.split_part(line, F.lit(" "), F.lit(1)), F.lit(".md")),
            status=F.lit("modified"), additions=F.length(line), deletions=F.lit(0),
            changes=F.length(line), patch=line,
        )

    commit = _struct(
        commitId=F.col("doc_id").cast("string"), message=F.concat(F.lit("update "), F.col("lang")),
        author=F.col("source"), timestamp=null, files=F.transform("_lines", changed),
    )
    details = _json(
        repo=F.concat(F.lit("acme/"), F.col("source")), name=F.col("source"),
        description=F.col("lang"), commits=F.array(commit),
    )
    payload = _json(
        repository=_struct(full_name=F.concat(F.lit("acme/"), F.col("source"))),
        ref=F.concat(F.lit("refs/heads/"), F.col("lang")),
    )
    return rows.select(
        F.concat(F.lit("g"), "doc_id").alias("event_id"), F.lit("github").alias("source"),
        payload.alias("payload"), details.alias("full_data"),
    )


def jira_events(spark: SparkSession, sf: str) -> DataFrame:
    """An issue change per order."""
    key = F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    null = F.lit(None).cast("string")
    changes = F.array(
        _struct(field=F.lit("status"), fromString=F.lit(""), toString=F.col("o_orderstatus")),
        _struct(field=F.lit("price"), fromString=null, toString=price),
    )
    details = _json(
        issueKey=key, summary=F.col("o_orderpriority"), description=null,
        status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"),
        project=F.col("o_custkey").cast("string"), changelog=changes,
    )
    return spread(load(spark, sf, "orders"), "o_orderkey").select(
        F.concat(F.lit("j"), "o_orderkey").alias("event_id"), F.lit("jira").alias("source"),
        _json(issue=_struct(key=key)).alias("payload"), details.alias("full_data"),
    )


def confluence_events(spark: SparkSession, sf: str) -> DataFrame:
    """A page update per page; the number in the address is its version."""
    version = F.regexp_extract("url", r"/(\d+)", 1).try_cast("int")
    page = F.col("page_id").cast("string")
    details = _json(
        pageId=page, title=F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1),
        version=version, content=html_to_text(F.col("html")),
        space=F.regexp_extract("html", 'lang="([^"]*)"', 1), url=F.col("url"),
        change=_struct(versionBefore=version - 1, versionAfter=version),
    )
    return spread(load(spark, sf, "pages"), "page_id").select(
        F.concat(F.lit("c"), "page_id").alias("event_id"), F.lit("confluence").alias("source"),
        _json(page=_struct(id=page)).alias("payload"), details.alias("full_data"),
    )


def miro_events(spark: SparkSession, sf: str) -> DataFrame:
    """A board change per event; the user is the board."""
    kind = F.concat(F.lit("item:"), F.col("event_type"))
    payload = _json(
        boardId=_struct(id=F.col("user_id").cast("string"), viewLink=F.lit("")), type=kind,
        item=_struct(
            id=F.col("event_id").cast("string"), title=F.col("event_type"),
            data=_struct(content=F.col("props")),
        ),
    )
    details = _json(boardId=F.col("user_id").cast("string"), type=kind)
    return spread(load(spark, sf, "events"), "event_id").select(
        F.concat(F.lit("m"), "event_id").alias("event_id"), F.lit("miro").alias("source"),
        payload.alias("payload"), details.alias("full_data"),
    )


def tool_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by kind as messages of the four tools; errors come from an unknown tool.

    Sign-ups lack the object their payload should name.
    """
    source = (
        F.when(F.col("event_type") == "click", "github").when(F.col("event_type") == "view", "jira")
        .when(F.col("event_type") == "purchase", "confluence")
        .when(F.col("event_type") == "signup", "miro").otherwise("pager")
    )
    user = F.col("user_id").cast("string")
    payload = (
        F.when(F.col("event_type") == "click", _json(repository=_struct(full_name=F.concat(F.lit("acme/"), user))))
        .when(F.col("event_type") == "view", _json(issue=_struct(key=user)))
        .when(F.col("event_type") == "purchase", _json(page=_struct(id=user)))
        .otherwise(_json(boardId=_struct(name=user)))
    )
    return load(spark, sf, "events").select("event_id", source.alias("source"), payload.alias("payload"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON messages.

    Toxic ones are cut off and unreadable, those of low quality lack their content.
    """
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    content = F.when(F.coalesce(F.col("quality"), F.lit(1)) != 0, F.col("text"))
    body = _json(
        doc_id=F.col("doc_id").cast("string"), source=F.col("source"), title=F.col("lang"),
        content=content, metadata=_struct(project=F.col("source")),
    )
    cut = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.concat(F.lit('{"doc_id": "'), F.col("text")))
    return rows.select(F.col("doc_id").alias("message_id"), F.coalesce(cut, body).alias("body"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint responses: plain, fenced, with an unknown type, and no JSON at all."""
    words = F.slice(F.split("text", " "), 1, 3)
    good = _json(
        fingerprint=F.col("text"), doc_type=F.lit(" Design "), project_identity=F.col("source"),
        functional_domain=F.lit(""), lifecycle_stage=F.col("lang"), technical_concepts=words,
        key_entities=F.array().cast("array<string>"),
    )
    odd = _json(fingerprint=F.col("text"), doc_type=F.col("lang"), key_entities=F.array("source", "lang"))
    raw = (
        F.when(F.col("lang") == "en", good)
        .when(F.col("lang") == "fr", F.concat(F.lit("Here it is\n```json\n"), good, F.lit("\n```\nbye")))
        .when(F.col("lang") == "de", odd)
        .otherwise(F.concat(F.lit('{"fingerprint": '), F.col("text")))
    )
    return load(spark, sf, "documents").select("doc_id", raw.alias("raw"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Review responses: assign, create, an unknown decision, and no JSON at all."""
    assign = _json(
        decision=F.lit("ASSIGN"), assigned_group_id=F.col("source"),
        confidence=F.col("n_chars") / 1000.0, reasoning=F.col("text"),
    )
    create = _json(
        decision=F.lit("CREATE_NEW"), assigned_group_id=F.col("source"), confidence=F.lit(-0.5)
    )
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Decision: "), assign, F.lit(" as asked")))
        .when(F.col("lang") == "fr", create)
        .when(F.col("lang") == "de", _json(decision=F.lit("MAYBE"), confidence=F.lit(1.0)))
        .otherwise(F.lit("I do not know"))
    )
    return load(spark, sf, "documents").select("doc_id", raw.alias("raw"))


def cited_sentences(text: Column) -> Column:
    """The text with source n cited after its n-th sentence."""
    marked = F.transform(
        F.split(text, r"\. "),
        lambda s, i: F.concat(s, F.lit(" ["), (i + 1).cast("string"), F.lit("]")),
    )
    return F.array_join(marked, ". ")


def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that repeat the question and cite a source per sentence."""
    return load(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), cited_sentences(F.col("text")).alias("answer")
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as answers: the n-th sentence cites source n.

    As many sources exist as there were turns before, so early turns cite unknown ones.
    """
    known = F.when(F.col("turn") > 0, F.sequence(F.lit(1).cast("long"), F.col("turn"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", cited_sentences(F.col("text")).alias("answer"), known.alias("known")
    )
