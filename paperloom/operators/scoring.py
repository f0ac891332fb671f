"""Search hits to group candidates, routes and final outcomes."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom import constants as C
from paperloom.functions.truth import first_text, text_or_null
from paperloom.operators.similarity import QuestionSet, nearest

KINDS = ["prototype", "buffer", "segment"]
_TIE = 1e-9                      # far above rounding noise, far below six decimals


def round6(value: Column) -> Column:
    """Six decimals; exact halves go up whatever the order of the additions was."""
    return F.round(value + _TIE, 6)


def search_kind(
    queries: DataFrame | QuestionSet, table: DataFrame, groups: DataFrame, index: str, *,
    keys: list[str], min_similarity: float, k: int = C.HITS_PER_SOURCE, **options,
) -> DataFrame:
    """Top-k rows of one vector table that belong to a known group."""
    known = table.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    hits = nearest(queries, known, k=k, keys=keys, min_similarity=min_similarity, **options)
    return hits.withColumn("hit_index", F.col(index).cast("long"))


def _weighted(best: Column, mean: Column) -> Column:
    return round6(C.MAX_WEIGHT * best + C.AVG_WEIGHT * mean)


def _hit_aggregates(hit: Column, prefix: str = "") -> list[Column]:
    """Max, mean, count and index of the best hit over the rows where ``hit`` holds."""
    sim = F.when(hit, F.col("similarity"))
    first_best = F.struct(F.col("similarity"), -F.col("hit_index"))
    return [
        F.max(sim).alias(f"{prefix}max"),
        F.avg(sim).alias(f"{prefix}avg"),
        F.count(sim).alias(f"{prefix}hits"),
        F.max_by("hit_index", F.when(hit, first_best)).alias(f"{prefix}index"),
    ]


def score_groups(hits: DataFrame) -> DataFrame:
    """Per query and group: 0.7 x best + 0.3 x mean similarity, hits, index of the best hit."""
    named = hits.where(text_or_null(F.col("group_id")).isNotNull())
    scored = named.groupBy("query_id", "group_id").agg(*_hit_aggregates(F.lit(True)))
    return scored.select(
        "query_id", "group_id",
        _weighted(F.col("max"), F.col("avg")).alias("similarity"),
        F.round("max", 6).alias("max_similarity"),
        F.col("hits").alias("hit_count"), F.col("index").alias("top_index"),
    )


def _merged(first: dict, second: dict) -> dict:
    """Candidate of two lists: hits add up, the mean weighs each best score by its hits."""
    both = first["max"].isNotNull() & second["max"].isNotNull()
    hits = F.coalesce(first["hits"], F.lit(0)) + F.coalesce(second["hits"], F.lit(0))
    best = F.greatest(first["max"], second["max"])
    mean = (first["max"] * first["hits"] + second["max"] * second["hits"]) / hits
    later = F.coalesce(second["max"] > first["max"], first["max"].isNull())
    return {
        "sim": F.when(both, _weighted(best, mean)).otherwise(F.coalesce(first["sim"], second["sim"])),
        "max": best,
        "hits": hits,
        "index": F.when(later, second["index"]).otherwise(first["index"]),
    }


def merge_candidates(hits: DataFrame) -> DataFrame:
    """One candidate per query and group from hits tagged with ``kind``.

    Prototypes are merged with the buffer and the result with the segments.  All three
    lists are aggregated side by side, so the merge needs one shuffle and no join.
    """
    named = hits.where(text_or_null(F.col("group_id")).isNotNull())
    aggregates = [
        a for kind in KINDS for a in _hit_aggregates(F.col("kind") == kind, f"{kind}_")
    ]
    wide = named.groupBy("query_id", "group_id").agg(*aggregates)
    for kind in KINDS:
        wide = wide.withColumn(
            f"{kind}_sim", _weighted(F.col(f"{kind}_max"), F.col(f"{kind}_avg"))
        )

    def candidate(kind: str) -> dict:
        return {part: F.col(f"{kind}_{part}") for part in ("sim", "max", "hits", "index")}

    early = _merged(candidate("prototype"), candidate("buffer"))
    wide = wide.select("*", *[value.alias(f"early_{part}") for part, value in early.items()])
    merged = _merged(candidate("early"), candidate("segment"))
    return wide.select(
        "query_id", "group_id",
        merged["sim"].alias("similarity"), F.round(merged["max"], 6).alias("max_similarity"),
        merged["hits"].alias("hit_count"), merged["index"].alias("top_index"),
    )


def search_groups(
    queries: DataFrame, prototypes: DataFrame, buffer: DataFrame, segments: DataFrame,
    groups: DataFrame, *, review: float = C.REVIEW_THRESHOLD, margin: float = C.SEGMENT_MARGIN,
    k: int = C.HITS_PER_SOURCE, **options,
) -> DataFrame:
    """Hits of all three vector tables, tagged with their kind."""
    queries = QuestionSet(queries, **options)
    rows = ["group_id", "doc_id", "segment_index"]
    searches = [
        ("prototype", prototypes, "proto_index", ["group_id", "proto_index"], review),
        ("buffer", buffer, "segment_index", rows, review),
        ("segment", segments.where(F.col("group_id").isNotNull()), "segment_index", rows, round(review - margin, 6)),
    ]
    found = None
    for kind, table, index, keys, floor in searches:
        hits = search_kind(
            queries, table, groups, index, keys=keys, min_similarity=floor, k=k
        ).select("query_id", "group_id", "hit_index", "similarity", F.lit(kind).alias("kind"))
        found = hits if found is None else found.unionByName(hits)
    return found


def with_group_details(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    details = groups.select("group_id", F.col("group_name").alias("name"), "doc_count", "proto_count")
    return candidates.join(details, "group_id", "left")


def decide_route(
    queries: DataFrame, candidates: DataFrame, *, auto: float = C.AUTO_ASSIGN_THRESHOLD,
    keep: int = C.CANDIDATES_FOR_REVIEW,
) -> DataFrame:
    """Route per query with its best candidates, in descending order of score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "group_id")
    best = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    name = F.col("name") if "name" in candidates.columns else F.lit(None).cast("string")
    entry = F.struct(
        F.col("_r"), F.col("group_id").alias("id"), name.alias("name"), F.col("similarity"),
        F.col("max_similarity"), F.col("hit_count"), F.col("top_index"),
    )
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    listed = listed.withColumn("candidates", F.transform("candidates", lambda c: c.dropFields("_r")))
    joined = queries.join(listed, "query_id", "left")
    top = F.get("candidates", F.lit(0))
    route = (
        F.when(top.isNull(), C.ROUTE_CREATE)
        .when(top["similarity"] >= auto, C.ROUTE_ASSIGN)
        .otherwise(C.ROUTE_REVIEW)
    )
    return (
        joined.withColumn("route", route)
        .withColumn("top_similarity", F.coalesce(top["similarity"], F.lit(0.0)))
        .withColumn("existing_group_id", F.when(F.col("route") == C.ROUTE_ASSIGN, top["id"]))
    )


def review_cache(routed: DataFrame) -> DataFrame:
    """Query vectors to cache: only documents sent to review."""
    return routed.where(F.col("route") == C.ROUTE_REVIEW).select(
        F.col("query_id").alias("doc_id"), "embedding"
    )


def final_outcome(df: DataFrame) -> DataFrame:
    """Outcome from ``errors``, ``is_duplicate``, ``route`` and the reviewed ``decision``.

    ``decision`` is ASSIGN or CREATE_NEW for reviewed documents; without one the review
    falls back to a new group.  An ASSIGN without a group is an error.
    """
    invalid = F.size("errors") > 0
    duplicate = ~invalid & F.col("is_duplicate")
    reviewed = ~invalid & ~duplicate & (F.col("route") == C.ROUTE_REVIEW)
    agreed = F.coalesce(F.col("decision") == "ASSIGN", F.lit(False))
    target = (
        F.when(duplicate, F.col("existing_group_id"))
        .when(reviewed & agreed, F.col("assigned_group_id"))
        .when(F.col("route") == C.ROUTE_ASSIGN, F.col("existing_group_id"))
    )
    assign = duplicate | (reviewed & agreed) | (F.col("route") == C.ROUTE_ASSIGN)
    outcome = (
        F.when(invalid, "INVALID")
        .when(assign & text_or_null(target).isNull(), "ERROR")
        .when(assign, "ASSIGNED")
        .otherwise("CREATED")
    )
    steps = F.array_compact(
        F.array(
            F.lit("validate_input"),
            F.when(~invalid, "check_duplicate"),
            F.when(reviewed, "agent_review"),
            F.when(~invalid & assign, "assign_node"),
            F.when(~invalid & ~assign, "create_node"),
        )
    )
    return (
        df.withColumn("outcome", outcome)
        .withColumn("target_group_id", F.when(~invalid, target))
        .withColumn("decision_path", steps)
    )


def summarize_candidates(candidates: Column, limit: int = 5) -> Column:
    """First candidates with their similarity at four decimals."""
    return F.transform(
        F.slice(candidates, 1, limit),
        lambda c: F.struct(
            c["id"].alias("id"), c["name"].alias("name"),
            F.round(F.coalesce(c["similarity"], F.lit(0.0)), 4).alias("similarity"),
        ),
    )


def review_lines(candidates: Column) -> Column:
    """One text line per candidate for the reviewer."""
    lines = F.transform(
        candidates,
        lambda c: F.concat(
            F.lit("- "), first_text(c["name"], F.lit("unknown")), F.lit(" (id="),
            first_text(c["id"], F.lit("unknown")), F.lit(", similarity="),
            F.format_string("%.3f", F.coalesce(c["similarity"], F.lit(0.0))), F.lit(")"),
        ),
    )
    return F.when(F.size(candidates) > 0, F.array_join(lines, "\n")).otherwise(
        C.NO_CANDIDATES
    )
