"""Missing-value rules of the incoming JSON: "", 0 and {} count as absent."""

from pyspark.sql import Column, functions as F


def text_or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First non-empty text, as ``a || b || c`` picks it."""
    return F.coalesce(*[text_or_null(c) for c in cols])


def number_or_null(col: Column) -> Column:
    return F.when(col != 0, col)


def join_present(separator: str, *cols: Column) -> Column:
    """Join the non-empty texts; an empty text when there is none."""
    return F.concat_ws(separator, *[text_or_null(c) for c in cols])
