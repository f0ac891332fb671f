"""``[n]`` citations in answers; fenced code is left alone."""

from pyspark.sql import Column, functions as F

from paperloom import constants as C


def text_parts(answer: Column) -> Column:
    """Text around the fenced code blocks: one more part than there are blocks."""
    return F.split(answer, C.FENCED_CODE, -1)


def code_parts(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(C.FENCED_CODE), F.lit(0))


def _numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(C.CITATION), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def cited_numbers(answer: Column) -> Column:
    """Distinct cited numbers outside code, as text without leading zeros."""
    return F.array_distinct(F.flatten(F.transform(text_parts(answer), _numbers)))


def kept_sources(cited: Column, known: Column) -> Column:
    """Cited numbers that exist, ascending; position + 1 is the new number."""
    return F.array_sort(F.array_distinct(F.filter(known, lambda n: F.array_contains(cited, n.cast("string")))))


def _renumber(text: Column, names: Column) -> Column:
    numbers = _numbers(text)

    def follow(part: Column, i: Column) -> Column:
        number = F.get(numbers, i)
        place = F.array_position(names, number)
        mark = F.when(place > 0, F.concat(F.lit("["), place.cast("string"), F.lit("]"))).otherwise(number)
        return F.concat(part, F.coalesce(mark, F.lit("")))

    return F.array_join(F.transform(F.split(text, C.CITATION, -1), follow), "")


def rewrite(answer: Column, kept: Column) -> Column:
    """Known citations renumbered, unknown ones without brackets, code untouched."""
    names = F.transform(kept, lambda n: n.cast("string"))
    code = code_parts(answer)
    return F.array_join(
        F.transform(
            text_parts(answer),
            lambda text, i: F.concat(_renumber(text, names), F.coalesce(F.get(code, i), F.lit(""))),
        ),
        "",
    )
