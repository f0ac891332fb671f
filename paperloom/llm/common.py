"""Pieces that several operators share: words, byte texts, wide and narrow scratch tables."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.session import write_through

# fixed values: the characters that part words
BREAKS = " \t\n\x0b\x0c\r"
BREAK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; a null text has none.

    ``bytes.split()`` parts exactly at the six characters of ``BREAKS`` and ``bytes.lower()``
    changes A-Z only, so byte texts need no pattern matching to get words.
    """
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: plans that read stored files and give their rows in the same order every time, whatever columns are asked for
_IN_ORDER = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def numbered_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a number per row that is the same whenever it is read, also by parts of a plan that read fewer columns.

    A table that is read from files is numbered in place; anything else is written first.
    """
    def in_order(plan) -> bool:
        children = plan.children()
        return plan.getClass().getSimpleName() in _IN_ORDER and all(in_order(children.apply(k)) for k in range(children.size()))

    numbered = df.withColumn(key, F.monotonically_increasing_id())
    return numbered if in_order(df._jdf.queryExecution().optimizedPlan()) else write_through(numbered)


SUMS = "block int, salt int, sums binary"


def sums_batch(block: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["block", "salt", "sums"])


def added_blocks(parts: DataFrame, kind: type, order: list[str]) -> DataFrame:
    """The sums of tasks' arrays per ``block``, from rows of ``SUMS`` and the ``order`` columns, which say in what order to add.

    Added in two steps, first per salt, so that no task adds more than a share of them; rows come sorted, so a task holds one sum.
    """
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for block, salt, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "sums")), strict=True):
                part = np.frombuffer(sums, kind)
                if (block, salt) == key:
                    total += part
                    continue
                if key is not None:
                    yield sums_batch(*key, total)
                key, total = (block, salt), part.copy()
        if key is not None:
            yield sums_batch(*key, total)

    salted = parts.repartition("block", "salt").sortWithinPartitions("block", "salt", *order).mapInArrow(merged, SUMS)
    last = salted.repartition("block").sortWithinPartitions("block", "salt").withColumn("salt", F.lit(0))
    return last.mapInArrow(merged, SUMS)
