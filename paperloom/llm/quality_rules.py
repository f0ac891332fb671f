"""Quality rules whose thresholds come from the data: quantile sketches per language and source."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm.common import BREAKS, free_name, word_array
from paperloom.session import write_through

# fixed values
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent

#: relative width of a sketch's buckets
GAMMA = 1.02
#: a group with fewer documents takes the thresholds of its language, then those of all
LEAST_ROWS = 200
#: so many groups' fences (some 100 bytes each) are broadcast at most; more are joined by a shuffle
BROADCAST_GROUPS = 100_000
#: fences lie this many quartile distances outside the quartiles
REACH = 3
#: measures in thousandths: the least distance of a fence from its quartile, and whether low values fail too
MEASURES = {
    "symbols": (150, False),       # symbols per word
    "dup_lines": (350, False),     # share of lines that repeat an earlier one
    "word_chars": (3000, True),    # characters per word
    "repeat_words": (300, False),  # share of words in repeated windows
}


def measured(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add a struct column ``out`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows of eight words are compared by 64-bit hashes within their own text.
    """
    words, windows, tagged, starts = (free_name(docs, c) for c in ("ws", "wh", "wt", "wp"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size(F.col(words))
    hashed = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                    lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = docs.withColumn(words, word_array(F.col(text_col))).withColumn(windows, hashed)
    repeats = F.size(F.array_distinct(F.col(windows))) < F.size(F.col(windows))
    step = step.withColumn(
        tagged,
        F.when(repeats, F.sort_array(
            F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda s, k: F.col(tagged)[k]["h"] == s["h"]
    twice = F.filter(F.col(tagged), lambda s, k: F.when(k > 0, same(s, F.greatest(k - 1, F.lit(0)))).otherwise(False)
                     | F.when(k < F.size(F.col(tagged)) - 1, same(s, F.least(k + 1, F.size(F.col(tagged)) - 1)))
                     .otherwise(False))
    step = step.withColumn(starts, F.sort_array(F.transform(twice, lambda s: s["i"])))
    last = F.size(F.col(starts)) - 1
    covered = F.aggregate(
        F.transform(F.col(starts), lambda p, k: F.when(k < last, F.least(
            F.lit(WINDOW), F.col(starts)[F.least(k + 1, last)] - p)).otherwise(F.lit(WINDOW))),
        F.lit(0), lambda a, b: a + b,
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BREAKS, "") != "")
    return step.withColumn(out, F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, BREAKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )).drop(words, windows, tagged, starts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def _thousandths(m: Column) -> dict[str, Column]:
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    return {
        "symbols": F.floor(1000 * m["n_symbols"] / words),
        "dup_lines": F.floor(1000 * m["n_dup_lines"] / lines),
        "word_chars": F.floor(1000 * m["word_chars"] / words),
        "repeat_words": F.floor(1000 * m["n_repeat_words"] / words),
    }


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Quantile sketches: counts of values in buckets of relative width ``GAMMA``.

    One row per group, measure and bucket. Sketches of parts of the data merge by adding
    counts, in any order, to the sketch of the whole; a group has some hundred buckets at most
    per measure, whatever its size, and partial counts are combined before the shuffle.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items())))
    bucket = F.when(F.col("e.value") < 1, F.lit(0)).otherwise(
        1 + F.ceil(F.round(F.log(F.col("e.value").cast("double")) / F.log(F.lit(GAMMA)), 9))).cast("int")
    return (
        rows.select(*keys, each.alias("e"))
        .groupBy(*keys, F.col("e.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def bucket_value(bucket: Column) -> Column:
    """The middle of a bucket, as a relative error sees it."""
    top = F.pow(F.lit(GAMMA), (bucket - 1).cast("double"))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(top * F.lit(2 / (1 + GAMMA)))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 per group and measure: the buckets that hold the quarter's and three quarters' rank."""
    by = [*keys, "measure"]
    so_far = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    ranked = sketches.withColumn("upto", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(whole))
    return ranked.groupBy(*by).agg(
        F.max("all").alias("n"),
        bucket_value(F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket")))).alias("q1"),
        bucket_value(F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket")))).alias("q3"),
    )


def fences(sketches: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per language and source with a struct ``fences``: low and high per measure.

    ``sketches`` has columns lang, source, measure, bucket, n. Coarser sketches are sums of
    the finer ones. A group below ``least_rows`` documents takes its language's fences, a
    language below it those of all documents.
    """
    spread = lambda level: F.struct(
        *(F.struct(
            (F.lit(-1.0) if not low else F.max(F.when(F.col("measure") == k, F.col("q1") - F.greatest(
                REACH * (F.col("q3") - F.col("q1")), F.lit(float(least)))))).alias("low"),
            F.max(F.when(F.col("measure") == k, F.col("q3") + F.greatest(
                REACH * (F.col("q3") - F.col("q1")), F.lit(float(least))))).alias("high"),
        ).alias(k) for k, (least, low) in MEASURES.items())
    ).alias(level)
    sums = lambda keys: sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    rows = F.max("n")
    fine = quartiles(sketches, ["lang", "source"]).groupBy("lang", "source").agg(rows.alias("fine_n"), spread("fine"))
    mid = quartiles(sums(["lang"]), ["lang"]).groupBy(F.col("lang").alias("mid_lang")).agg(rows.alias("mid_n"), spread("mid"))
    whole = quartiles(sums([]), []).agg(spread("top")).first()["top"]  # one row
    top = F.struct(*(
        F.struct(*(F.lit(whole[k][end]).cast("double").alias(end) for end in ("low", "high"))).alias(k) for k in MEASURES
    ))
    both = fine.join(mid, F.col("lang").eqNullSafe(F.col("mid_lang")), "left")
    chosen = F.when(F.col("fine_n") >= least_rows, F.col("fine")).when(
        F.col("mid_n") >= least_rows, F.col("mid")).otherwise(top)
    return both.select("lang", "source", chosen.alias("fences"))


def judge(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_rows: int = LEAST_ROWS, out: str = "quality", keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct ``out``: the measures, ``base_failed`` and ``kept``.

    A document is kept if it has at least 20 words, at most 30 % of them in repeated windows,
    and every measure lies within the fences of its language and source. The measured rows are
    written once, then read for the sketches (no texts) and for the filter. ``keep`` names the
    columns to carry, all by default. Null languages and sources are groups of their own, null
    texts have no words and fail, repeated rows count each and are judged alike.
    """
    carried = docs if keep is None else docs.select(*dict.fromkeys([*keep, text_col, lang_col, source_col]))
    rows = measured(carried, text_col, out)
    if keep is not None:
        rows = rows.select(*dict.fromkeys([*keep, lang_col, source_col]), out)
    rows = write_through(rows)
    m = F.col(out)
    slim = rows.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), m.alias("m"))
    sketches = write_through(sketch(slim, ["lang", "source"], _thousandths(F.col("m"))))
    limits = fences(sketches, least_rows)
    names = {c: free_name(rows, f"limit_{c}") for c in ("lang", "source", "fences")}
    limits = write_through(limits.select(*(F.col(c).alias(n) for c, n in names.items())))
    # as a shuffled join, the texts of a hot source would meet in few tasks
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    joined = rows.join(
        limits,
        F.col(lang_col).eqNullSafe(F.col(names["lang"])) & F.col(source_col).eqNullSafe(F.col(names["source"])), "left",
    )
    limit = F.col(names["fences"])
    outside = reduce(or_, (
        (v < limit[k]["low"]) | (v > limit[k]["high"]) for k, v in _thousandths(m).items()
    ))
    verdict = m.withField("base_failed", base_failed(m)).withField(
        "kept", ~base_failed(m) & ~F.coalesce(outside, F.lit(False)))
    return joined.withColumn(out, verdict).drop(*names.values())


def keep_good(docs: DataFrame, **names) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    out = free_name(docs, "quality")
    return judge(docs, out=out, **names).where(F.col(out)["kept"]).drop(out)
