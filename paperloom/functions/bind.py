"""Name an intermediate value inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` computed once per row.

    The optimiser copies a column into every place that uses it, which repeats work
    such as parsing JSON; a lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))
