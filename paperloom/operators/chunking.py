"""Documents to chunks.  One row per document in, one row per chunk out, no shuffle."""

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from paperloom import constants as C
from paperloom.functions import text as T
from paperloom.functions.truth import text_or_null


def analyze(df: DataFrame, text: str = "text", given_title: str | None = None) -> DataFrame:
    """Add ``n_words``, ``struct_type`` and ``title``."""
    given = F.col(given_title) if given_title else None
    return (
        df.withColumn("_lines", T.lines(F.col(text)))
        .withColumn("n_words", T.word_count(F.col(text)))
        .withColumn("struct_type", T.struct_type(F.col(text), F.col("n_words"), F.col("_lines")))
        .withColumn("title", T.title(F.col(text), F.col("_lines"), F.col("struct_type"), given))
        .drop("_lines")
    )


def titled_text(text: str, title: str = "title") -> Column:
    return F.concat_ws("\n\n", text_or_null(F.col(title)), F.col(text))


def _rule(kind: Column, part: int) -> Column:
    """Chunk size or overlap by structural type; unknown types use the prose rule."""
    column = None
    for name, rule in C.CHUNK_RULES.items():
        column = (F if column is None else column).when(kind == name, rule[part])
    return column.otherwise(C.CHUNK_RULES["prose"][part])


def _chunk(text: Column, n_words: Column) -> Column:
    return F.struct(text.alias("chunk_text"), n_words.alias("word_count"))


def _explode(df: DataFrame, chunks: Column, drop: list[str]) -> DataFrame:
    """Chunk list to rows with index, total and sizes.

    The outer form of the generator keeps the optimiser from deriving a "list is not
    empty" filter, which it would push below and so compute every chunk twice.
    """
    listed = df.withColumn("_chunks", chunks).withColumn("total_chunks", F.size("_chunks"))
    kept = [c for c in listed.columns if c not in {"_chunks", *drop}]
    rows = listed.select(*kept, F.posexplode_outer("_chunks").alias("chunk_index", "_chunk"))
    rows = rows.where(F.col("_chunk").isNotNull()).select(*kept, "chunk_index", "_chunk.*")
    return rows.withColumn("token_count", T.estimate_tokens(F.col("word_count")))


def window_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Overlapping word windows; a short document is one chunk with its text as it is.

    ``df`` comes from ``analyze``.  A window starts only if it holds a word that the
    window before did not.
    """
    size, overlap = _rule(F.col("struct_type"), 0), _rule(F.col("struct_type"), 1)
    sized = (
        df.withColumn("_source", titled_text(text))
        .withColumn("_words", T.words(F.col("_source")))
        .withColumn("_size", size)
        .withColumn("_step", size - overlap)
    )
    fresh = F.size("_words") - (F.col("_size") - F.col("_step"))
    count = F.greatest(F.lit(1), F.ceil(fresh / F.col("_step"))).cast("int")

    def window(i: Column) -> Column:
        start = i * F.col("_step")
        text = F.array_join(F.slice("_words", start + 1, F.col("_size")), " ")
        return _chunk(text, F.least(F.col("_size"), F.size("_words") - start))

    windows = F.transform(F.sequence(F.lit(0), count - 1), window)
    whole = F.array(_chunk(F.col("_source"), F.size("_words")))
    chunks = F.when(F.col("struct_type") == "short", whole).otherwise(windows)
    return _explode(sized, chunks, [text, "_source", "_words", "_size", "_step"])


_FENCE_OPENING = re.compile(r"^[ \t]*(`{3,}|~{3,})", re.M)


def _tokens(text: str) -> int:
    """Estimated tokens; a long word counts once per ``LONG_WORD`` characters."""
    words = text.split()
    long = sum((len(w) - 1) // C.LONG_WORD for w in words if len(w) > C.LONG_WORD)
    return math.ceil((len(words) + long) * C.TOKENS_PER_WORD)


def _units(text: str) -> list[tuple[str, bool]]:
    """Text in order as (piece, is fenced code); a fence closes with its own marker."""
    units, begin, at = [], 0, 0
    while opening := _FENCE_OPENING.search(text, at):
        mark = re.escape(opening.group(1))
        closing = re.compile(rf"^[ \t]*{mark}[ \t]*(?:\n|\Z)", re.M)
        line_end = text.find("\n", opening.end())
        end = closing.search(text, line_end + 1) if line_end >= 0 else None
        at = end.end() if end else opening.end()
        if end:
            units += [(text[begin:opening.start()], False), (text[opening.start():at], True)]
            begin = at
    return [unit for unit in [*units, (text[begin:], False)] if unit[0]]


def _pieces(text: str, size: int, separators: list[str]) -> list[str]:
    """Cut at the first separator present, again within pieces that are still too long."""
    if _tokens(text) <= size:
        return [text]
    for rank, separator in enumerate(separators):
        if separator in text.strip(separator):
            parts = text.split(separator)
            parts = parts[:1] + [separator + part for part in parts[1:]]
            deeper = separators[rank + 1:]
            return [p for part in parts if part for p in _pieces(part, size, deeper)]
    return _characters(text, size)


def _characters(text: str, size: int) -> list[str]:
    """The last resort for a word without separators: cut by length, or in halves where blanks are odd."""
    length = max(1, math.floor(size / C.TOKENS_PER_WORD)) * C.LONG_WORD
    parts = [text[at : at + length] for at in range(0, len(text), length)]
    if len(parts) == 1 and len(text) > 1:
        parts = [text[: len(text) // 2], text[len(text) // 2 :]]
    return [p for part in parts for p in ([part] if _tokens(part) <= size else _characters(part, size))]


def _pack(pieces: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    """Fill chunks greedily; the next chunk starts with up to ``overlap`` tokens of the last."""
    chunks, held, total = [], [], 0
    for piece, length in pieces:
        if held and total + length > size:
            chunks.append("".join(p for p, _ in held).strip())
            while held and (total > overlap or total + length > size):
                total -= held.pop(0)[1]
        held.append((piece, length))
        total += length
    chunks.append("".join(p for p, _ in held).strip())
    return [chunk for chunk in chunks if chunk]


def _split(text: str, size: int, overlap: int) -> list[str]:
    pieces = []
    for unit, is_code in _units(text):
        parts = [unit] if is_code else _pieces(unit, size, C.SEPARATORS)
        pieces += [(part, _tokens(part)) for part in parts]
    return _pack(pieces, size, overlap)


@F.pandas_udf(ArrayType(StringType()))
def split_recursive(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([_split(*row) for row in zip(text, size, overlap)], dtype=object)


def recursive_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Chunks cut at paragraph, line, sentence and word ends; fenced code is never cut.

    A fenced block longer than the chunk size is a chunk of its own; nothing else is longer, as
    words without an end are cut by length.
    """
    sized = (
        df.withColumn("_source", titled_text(text))
        .withColumn("_size", _rule(F.col("struct_type"), 0))
        .withColumn("_overlap", _rule(F.col("struct_type"), 1))
    )
    texts = F.when(F.col("struct_type") == "short", F.array("_source")).otherwise(
        split_recursive("_source", "_size", "_overlap")
    )
    chunks = F.transform(texts, lambda text: _chunk(text, T.word_count(text)))
    return _explode(sized, chunks, [text, "_source", "_size", "_overlap"])


def document_sizes(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Chunk and segment counts per document."""
    n_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    n_segments = segments.groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    joined = n_chunks.join(n_segments, "doc_id", "full")
    return joined.na.fill(0, ["n_chunks", "n_segments"])
