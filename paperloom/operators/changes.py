"""Change detection between successive states of a key."""

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from paperloom import constants as C
from paperloom.functions.text import strip
from paperloom.operators.ordered import with_late_neighbour, with_neighbour


_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change_gate(
    df: DataFrame, keys: list[str], order: list[str], content: list[str], *, bucket: Column
) -> DataFrame:
    """Rows whose content differs from the previous row of the key (A, A, B, A -> 1, 3, 4)."""
    hashed = df.withColumn("content_hash", content_hash(*content))
    seen = with_neighbour(hashed, keys, order, "content_hash", "_last", bucket=bucket)
    return seen.where(~F.col("_last").eqNullSafe(F.col("content_hash"))).drop("_last")


def text_gate(
    df: DataFrame, keys: list[str], order: list[str], text: str, *, bucket: Column
) -> DataFrame:
    """Like ``change_gate`` on one text that starts out empty; adds ``old_text``.

    A row without a text changes nothing: the next text is compared with the last one seen.
    """
    given = df.where(F.col(text).isNotNull())
    seen = with_late_neighbour(given, keys, order, text, "_last", bucket=bucket)
    seen = seen.withColumn("old_text", F.coalesce("_last", F.lit(""))).drop("_last", "_last_order")
    return seen.where(F.sha2("old_text", 256) != F.sha2(text, 256))


#: bits of alignment rows kept at once; longer texts are halved first
_DIFF_BITS = 1 << 28


def _alignment(old: list, new: list) -> Iterator[int]:
    """Row i tells, as bits, where the common subsequence of ``old`` and ``new[:i + 1]`` does not grow.

    A row costs a few operations on integers with one bit per old line, however often lines repeat.
    """
    places: dict = {}
    for at, line in enumerate(old):
        places.setdefault(line, []).append(at)
    masks = {line: sum(1 << at for at in found) for line, found in places.items()}
    full = (1 << len(old)) - 1
    row = full
    for line in new:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _growth(row: int, size: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of the old lines."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _kept_positions(old: list, new: list) -> set[int]:
    """Positions of ``new`` on a longest common subsequence with ``old``."""
    if not old or not new:
        return set()
    if len(new) > 1 and len(old) * len(new) > _DIFF_BITS:
        half = len(new) // 2
        left = _growth(_last_row(old, new[:half]), len(old))
        right = _growth(_last_row(old[::-1], new[half:][::-1]), len(old))[::-1]
        cut = int(np.argmax(left + right))
        after = _kept_positions(old[cut:], new[half:])
        return _kept_positions(old[:cut], new[:half]) | {half + at for at in after}
    rows = list(_alignment(old, new))
    kept, row, column = set(), len(new) - 1, len(old) - 1
    while row >= 0 and column >= 0:
        if rows[row] >> column & 1:
            column -= 1
        else:
            # the subsequence grows here: with this line, unless it did without it
            if row and not rows[row - 1] >> column & 1:
                row -= 1
                continue
            kept.add(row)
            row -= 1
            column -= 1
    return kept


def _last_row(old: list, new: list) -> int:
    return deque(_alignment(old, new), maxlen=1).pop()


def _shared_edge(a: list[str], b: list[str]) -> int:
    """Number of leading lines both lists share."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _added(old: str | None, new: str | None) -> str:
    before, after = _LINE.findall(old or ""), _LINE.findall(new or "")
    head = _shared_edge(before, after)
    before, after = before[head:], after[head:]
    tail = _shared_edge(before[::-1], after[::-1])
    before, after = before[:len(before) - tail], after[:len(after) - tail]
    kept = _kept_positions(before, after)
    runs: list[str] = []
    for at, line in enumerate(after):
        if at in kept:
            continue
        if runs and at - 1 not in kept:
            runs[-1] += line
        else:
            runs.append(line)
    return "\n".join(runs).strip()


@F.pandas_udf(StringType())
def added_text(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines a line diff adds; runs of added lines are set apart by a line break."""
    return pd.Series([_added(a, b) for a, b in zip(old, new)], dtype=object)


def bullet_features(text: Column) -> Column:
    """Texts of the lines that start with ``-`` or ``*``."""
    rows = F.transform(F.split(text, "\n", -1), strip)
    marked = F.filter(rows, lambda row: row.startswith("-") | row.startswith("*"))
    return F.transform(marked, lambda row: F.regexp_replace(row, r"(?U)^[-*]\s*", ""))


def readme_changes(
    df: DataFrame, keys: list[str], order: list[str], text: str, *, bucket: Column
) -> DataFrame:
    """Changed texts with what was added and the features listed in the addition."""
    changed = text_gate(df, keys, order, text, bucket=bucket)
    changed = changed.withColumn("added", added_text("old_text", text))
    return changed.where(F.col("added") != "").withColumn(
        "features", bullet_features(F.col("added"))
    )


def version_changes(
    df: DataFrame, key: str, version: str, content: str, *, bucket: Column
) -> DataFrame:
    """Compare each version with the one numbered just before it.

    ``change`` is null for unchanged content; a first version changes from null.
    """
    seen = with_late_neighbour(df, [key], [version], content, "_was", bucket=bucket)
    previous = F.when(F.col(f"_was_order.{version}") == F.col(version) - 1, F.col("_was"))
    return (
        seen.withColumn("previous", previous)
        .withColumn(
            "change",
            F.when(
                ~F.col("previous").eqNullSafe(F.col(content)),
                F.struct(F.col("previous").alias("from"), F.col(content).alias("to")),
            ),
        )
        .withColumn("summary", F.substring(content, 1, C.SUMMARY_LENGTH))
        .drop("_was", "_was_order")
    )
