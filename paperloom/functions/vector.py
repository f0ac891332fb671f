"""Vector expressions on ``array<double>`` columns; all stay in the JVM."""

from pyspark.sql import Column, functions as F

from paperloom.functions.bind import bind


def as_vector(col: Column) -> Column:
    """Vector from any numeric array."""
    return col.cast("array<double>")


def parse_vector(col: Column) -> Column:
    """Vector from its ``[v1,v2,...]`` text form."""
    return F.from_json(col, "array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null when either side has zero length."""
    return bind(
        norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size)
    )


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector, so that callers can quarantine it."""
    return bind(
        norm(v), lambda length: F.when(length > 0, F.transform(v, lambda x: x / length))
    )
