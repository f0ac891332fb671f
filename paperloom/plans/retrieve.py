"""Questions to cited sources: shortlist groups, fetch chunks, rerank, cap, assemble."""

from pyspark.sql import DataFrame, functions as F

from paperloom import constants as C
from paperloom.functions import citations
from paperloom.operators import retrieval as R
from paperloom.session import cut_lineage


def retrieve(
    queries: DataFrame, state: dict[str, DataFrame], *, scorer: R.Scorer = R.term_overlap,
    threshold: float = C.SHORTLIST_THRESHOLD, **options,
) -> dict[str, DataFrame]:
    """Every stage for ``queries(query_id, text, embedding)``.

    The shortlist and the final chunks have a few rows per question and feed several
    later steps, so they are written once.
    """
    shortlist = cut_lineage(
        R.shortlist_groups(
            queries, state["prototypes"], state["buffer"], threshold=threshold, **options
        )
    )
    scoped = R.with_scope(queries, shortlist)
    fetched = R.retrieve_chunks(scoped, state["chunks"], state["documents"], **options)
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    fetched = cut_lineage(R.rerank(fetched.join(asked, "query_id"), scorer))
    final = R.cap_per_path(fetched)
    blocks = R.source_blocks(final)
    rated = R.confidence(queries, shortlist, final)
    return {
        "shortlist": shortlist, "fetched": fetched, "final": final, "blocks": blocks,
        "confidence": rated,
        "context": R.context_strings(blocks, rated),
        "results": R.retrieval_results(queries, shortlist, fetched, final, blocks, rated),
    }


def respond(found: dict[str, DataFrame], answers: DataFrame, base: str) -> DataFrame:
    """Responses for ``answers(query_id, answer)``: renumbered answer, score, cited sources."""
    blocks = found["blocks"]
    known = blocks.groupBy("query_id").agg(F.collect_list("source_index").alias("known"))
    cited = citations.cited_numbers(F.col("answer"))
    none = F.array().cast("array<int>")
    read = answers.join(known, "query_id", "left").withColumn(
        "kept", citations.kept_sources(cited, F.coalesce("known", none))
    )
    places = read.select("query_id", F.posexplode("kept").alias("place", "source_index"))
    scores = found["confidence"].select("query_id", "score")
    renumbered = blocks.join(places, ["query_id", "source_index"]).join(scores, "query_id")
    renumbered = renumbered.withColumn("source_index", F.col("place") + 1).drop("place")
    rows = R.source_rows(renumbered, F.lit(base))
    fields = ["source_index", "doc_id", "doc_path", "url", "chunk_text", "similarity", "title"]
    listed = rows.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("sources")
    )
    joined = read.join(scores, "query_id").join(listed, "query_id", "left")
    nothing = F.array().cast(dict(joined.dtypes)["sources"])
    return joined.select(
        "query_id", citations.rewrite(F.col("answer"), F.col("kept")).alias("answer"),
        F.col("score").cast("double").alias("confidence_score"),
        F.coalesce("sources", nothing).alias("sources"),
    )
