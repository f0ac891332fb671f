"""Exact top-k vector search for a whole table of queries.

Each task multiplies its stored vectors with the query matrix and keeps only the
k best rows per query, so a task emits at most ``k x queries`` rows whatever it
reads, and no (query, row) pair list is ever built.

* Few queries go to the tasks in batches of bounded rows and bytes, and few of these; the
  stored side is scanned in place, once per batch, and never shuffled or copied.  What is
  shuffled afterwards grows with scan tasks x queries x k.
* More queries stay in Spark.  If the stored side proves small it is broadcast, and the
  queries are scanned in place; else blocks of queries meet blocks of stored rows, dealt by
  row number, and the k best rows of every block are merged per query.  As each row is sent once per
  block of the other side, the blocks of stored rows come in rounds that send about as much as both sides
  hold; a round's files are gone before the next one.
* With a scope a batch reads only the groups its queries may see, and a task compares a
  group with the queries that may see it.  More queries are exploded by group and joined with the
  stored rows of theirs: a group is cut into as many blocks as its two counts ask for, small groups
  share a task, and a group that nobody may see is never shuffled.

Similarity is rounded to six decimals before ranking and ties go to the smaller
key, so the result does not depend on the partitioning.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from paperloom.functions.vector import as_vector
from paperloom.session import discard, write_through

DIGITS = 6
SLICE_CELLS = 4_000_000
SLICE_ROWS = 8_192               # stored rows made unit vectors at once
EXACT_CELLS = 2_000_000          # elements of the pairs compared in double precision at once
FILTERED_GROUPS = 1_000          # a longer list is left to the tasks
BATCH_BYTES = 64 << 20           # vectors of one batch of queries
BATCH_FILL = 0.8                 # batches are dealt by hash, so they aim below their bound
MOST_BATCHES = 8                 # together they hold no more than BATCH_BYTES
ROUND_BYTES = 1 << 30            # vectors that blocks send at once, unless both sides hold more
BLOCK_HITS = 2_000_000           # hits that a block of queries may keep at once
BLOCK_GROUPS = 24_000_000        # groups that the queries of a block list in all, about
MARKED_CELLS = 1_000_000         # listed groups that are marked at once
KEPT = 2                         # times k hits a query keeps before they are cut to the k best
BROADCAST_GROUPS = 100_000       # groups whose counts are broadcast; more are joined by a shuffle


def _unit_rows(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / lengths[:, None]


class _Questions:
    """Query ids, unit vectors and, per group, the queries that may see it."""

    def __init__(self, table: pa.Table, key: str, scope: str | None):
        self.ids = table.column(key).combine_chunks()
        self.vectors = _unit_rows(table.column("_v")) if table.num_rows else None
        self.allowed = None
        if scope:
            lists = table.column(scope).combine_chunks()
            self.everywhere = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            names = pc.unique(flat)
            # lists that name most groups are marks in a table, a byte each; others are sorted by group
            dense = len(names) * len(lists) <= 4 * len(flat)
            self.allowed = self._marked(lists, flat, names) if dense else self._sorted(lists, flat)

    def _marked(self, lists: pa.Array, flat: pa.Array, names: pa.Array) -> dict:
        """A row of marks per group, filled a slice of the lists at a time."""
        seen = np.zeros((len(names), len(lists)), bool)
        seen[:, self.everywhere] = True
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        bounds = np.append(0, np.cumsum(sizes))
        step = max(1, MARKED_CELLS * len(lists) // max(1, len(flat)))
        for start in range(0, len(lists), step):
            some = sizes[start:start + step]
            part = flat.slice(bounds[start], int(some.sum()))
            seen[pc.index_in(part, names).to_numpy(), np.repeat(np.arange(start, start + len(some)), some)] = True
        return dict(zip(names.to_pylist(), seen, strict=True))

    def _sorted(self, lists: pa.Array, flat: pa.Array) -> dict:
        """The queries of each group, in order."""
        owner, coded = pc.list_parent_indices(lists).to_numpy().astype(np.int32), flat.dictionary_encode()
        codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        order = np.lexsort((owner, codes))
        owner, codes = owner[order], codes[order]
        once = np.append(True, (np.diff(codes) != 0) | (np.diff(owner) != 0))[: len(codes)]
        owner, codes = owner[once], codes[once]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        values = [*coded.dictionary.to_pylist(), None]
        return {
            values[codes[start]]: np.sort(np.append(self.everywhere, part))
            for start, part in zip(starts, np.split(owner, starts[1:]))
        }

    def asking(self, group) -> np.ndarray:
        """The queries that may see a group, in ascending order."""
        found = self.allowed.get(group, self.everywhere)
        return np.flatnonzero(found) if found.dtype == bool else found

    def rows(self, asking: np.ndarray) -> np.ndarray:
        """Unit vectors of some queries, in ascending order; those of all are not copied."""
        return self.vectors if len(asking) == len(self.ids) else self.vectors[asking]

    def groups(self) -> list | None:
        """The only groups any query may see; null when some query sees all."""
        if self.allowed is None or len(self.everywhere):
            return None
        return list(self.allowed)


def _blocks(codes, values, questions: _Questions):
    """(rows, query positions) to compare; with a scope only a group's own queries."""
    everything = np.arange(len(questions.ids))
    if questions.allowed is None:
        yield np.arange(len(codes)), everything
        return
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for rows in np.split(order, starts[1:]):
        asking = questions.asking(values[codes[rows[0]]])
        if len(asking):
            yield np.sort(rows), asking


def _best_rows(batch: pa.Table, questions: _Questions, keys, group, best_of_group, k, floors):
    """The k best rows of every slice for every query: (query position, score, keys).

    ``floors`` holds the lowest score per query that can still matter.
    """
    vectors, names = _unit_rows(batch.column("_v")), batch.select(keys)
    codes, values = np.zeros(batch.num_rows, int), [None]
    if group:
        coded = batch.column(group).combine_chunks().dictionary_encode()
        codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        values = [*coded.dictionary.to_pylist(), None]
    scored = _group_scores if best_of_group else _row_scores
    for rows, asking in _blocks(codes, values, questions):
        asked = questions.rows(asking)
        rough = None if best_of_group else asked.T.astype(np.float32)
        step = max(1, SLICE_CELLS // max(1, len(asking)))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            for found, places, scores in scored(vectors, codes, part, asked, rough, floors[asking], k):
                hits = names.take(pa.array(found))
                hits = hits.append_column("_q", pa.array(asking[places].astype(np.int32)))
                yield hits.append_column("similarity", pa.array(scores))


def _group_scores(vectors, codes, rows, asked, rough, cut, k):
    """Best score per group: (a row of the group, query position, score)."""
    scores = np.round(vectors[rows] @ asked.T, DIGITS) + 0.0
    scores[np.isnan(scores)] = -np.inf
    order = np.argsort(codes[rows], kind="stable")
    starts = np.flatnonzero(np.diff(codes[rows][order], prepend=-1))
    scores, rows = np.maximum.reduceat(scores[order], starts, axis=0), rows[order[starts]]
    if len(rows) > k:
        cut = np.maximum(cut, np.partition(scores, len(rows) - k, axis=0)[len(rows) - k])
    found, places = np.nonzero((scores >= cut) & np.isfinite(scores))
    yield rows[found], places, scores[found, places]


def _row_scores(vectors, codes, rows, asked, rough, cut, k):
    """(row, query position, score): single precision leaves few pairs, which are compared in double precision."""
    width = vectors.shape[1]
    slack = (width + 16) * 1.2e-7 + 10.0 ** -DIGITS  # more than rounding in either precision can hide
    rows = rows[np.isfinite(vectors[rows]).all(axis=1)]
    if not len(rows):
        return
    near = vectors[rows].astype(np.float32) @ rough
    least = (cut - slack).astype(np.float32)
    many = np.flatnonzero(np.count_nonzero(near >= least, axis=0) > k) if len(rows) > k else ()
    if len(many):
        some = near if len(many) == len(cut) else near[:, many]
        least[many] = np.maximum(least[many], np.partition(some, len(rows) - k, axis=0)[len(rows) - k] - np.float32(slack))
    found, places = np.nonzero(near >= least)
    del near
    step = max(1, EXACT_CELLS // width)
    for start in range(0, len(found), step):
        r, q = rows[found[start:start + step]], places[start:start + step]
        scores = np.round(np.einsum("ij,ij->i", vectors[r], asked[q]), DIGITS) + 0.0
        kept = (scores >= cut[q]) & np.isfinite(scores)
        yield r[kept], q[kept], scores[kept]


def _shrink(parts: list, keys, best_of_group, k) -> pa.Table:
    table = pa.concat_tables(parts)
    if best_of_group:
        table = table.group_by(["_q", *keys]).aggregate([("similarity", "max")])
        table = table.rename_columns(
            ["similarity" if n == "similarity_max" else n for n in table.column_names]
        ).select(parts[0].column_names)  # as the hits that follow
    order = [("_q", "ascending"), ("similarity", "descending")]
    table = table.sort_by(order + [(key, "ascending") for key in keys])
    owner = table.column("_q").to_numpy()
    first = np.searchsorted(owner, owner, side="left")
    return table.filter(pa.array(np.arange(len(owner)) - first < k))


def _parts(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _search(batches, questions, keys, group, best_of_group, k, floor) -> pa.Table | None:
    """Best rows over all batches; the k-th best so far prunes what follows."""
    kept: list = []
    asked = len(questions.ids)
    held, limit = 0, KEPT * k * max(1, asked)
    floors = np.full(asked, -np.inf if floor is None else floor)
    for part in _parts(batches) if asked else ():
        for hits in _best_rows(part, questions, keys, group, best_of_group, k, floors):
            kept.append(hits)
            held += hits.num_rows
            if held > limit:
                kept = [_shrink(kept, keys, best_of_group, k)]
                held = kept[0].num_rows
                _raise_floors(floors, kept[0], k)
    return _shrink(kept, keys, best_of_group, k) if kept else None


def _raise_floors(floors: np.ndarray, best: pa.Table, k: int) -> None:
    owner, score = best.column("_q").to_numpy(), best.column("similarity").to_numpy()
    last = np.flatnonzero(np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") == k - 1)
    floors[owner[last]] = score[last]


def _answer(table: pa.Table, questions: _Questions, query_key: str, names: list) -> pa.Table:
    owners = questions.ids.take(table.column("_q").combine_chunks())
    return table.append_column(query_key, owners).select(names)


class QuestionSet:
    """Queries made ready for several searches: broadcast ``batches``, or a ``table`` that stays in Spark.

    A batch holds at most ``broadcast_rows`` queries and about ``batch_bytes`` (``BATCH_BYTES``) of vectors. One row
    more is asked for, which proves that one batch is enough; else the queries are written once and
    counted. Up to ``MOST_BATCHES`` with ``BATCH_BYTES`` in all are dealt by a hash of their key;
    beyond, the driver reads no query, and tasks compare blocks of about ``BATCH_BYTES`` on either side, whatever a
    batch may hold: every row is sent once per block of the other side.
    """

    def __init__(
        self, queries: DataFrame, *, query_key: str = "query_id", vector: str = "embedding",
        scope: str | None = None, broadcast_rows: int = 8_192, batch_bytes: int | None = None,
    ):
        asked = queries.where(F.col(vector).isNotNull()).select(
            query_key, as_vector(F.col(vector)).alias("_v"), *([scope] if scope else [])
        )
        self.key, self.scope, self.field = query_key, scope, asked.schema[query_key]
        self.batches, self.table, self.count = [], None, 0
        context = queries.sparkSession.sparkContext

        def shared(part: DataFrame):
            return context.broadcast(_Questions(part.toArrow(), query_key, scope))

        first = asked.limit(1).toArrow()
        width = max(1, len(first.column("_v")[0]) if first.num_rows else 1)
        self.block_rows = max(1, (batch_bytes or BATCH_BYTES) // (8 * width))
        self.join_rows = max(self.block_rows, BATCH_BYTES // (8 * width))
        self.round_rows = ROUND_BYTES // (8 * width)
        most = max(1, min(broadcast_rows, self.block_rows))
        head = asked.limit(most + 1).toArrow()
        if head.num_rows <= most:
            self.batches = [context.broadcast(_Questions(head, query_key, scope))]
            return
        stored = _numbered(asked)
        self.count = stored.count()
        count = math.ceil(self.count / max(1, int(BATCH_FILL * most)))
        if count > MOST_BATCHES or self.count > self.block_rows:
            self.table = stored
            return
        dealt = write_through(
            stored.drop("_n").withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(count)).cast("int")).repartition("_b")
        )
        self.batches = [shared(dealt.where(F.col("_b") == b).drop("_b")) for b in range(count)]


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows, written once with a number each, so that a task that runs again deals them alike."""
    return write_through(rows.withColumn("_n", F.monotonically_increasing_id()))


def _search_in_place(queries: QuestionSet, stored: pa.Table, schema: StructType, how: tuple) -> DataFrame:
    """All queries against a small stored side that every task holds."""
    shared = queries.table.sparkSession.sparkContext.broadcast(stored)
    key, scope, names = queries.key, queries.scope, schema.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and shared.value.num_rows:
                questions = _Questions(pa.Table.from_batches([batch]), key, scope)
                found = _search([shared.value], questions, *how)
                if found is not None:
                    yield from _answer(found, questions, key, names).to_batches()

    return queries.table.drop("_n").mapInArrow(scan, schema)


def _block_copies(asked: int, stored: int, asked_rows: int, stored_rows: int) -> int:
    """Rows that ``_search_blocks`` sends."""
    return asked * math.ceil(stored / max(1, int(BATCH_FILL * stored_rows))) + stored * math.ceil(asked / max(1, int(BATCH_FILL * asked_rows)))


def _asked_rows(queries: QuestionSet, k: int) -> int:
    """Queries of a block: a task holds their vectors, hits and lists of groups."""
    rows = min(queries.join_rows, BLOCK_HITS // (KEPT * k))
    if queries.scope:
        listed = queries.table.agg(F.sum(F.size(F.coalesce(queries.scope, F.array())))).first()[0]
        rows = min(rows, BLOCK_GROUPS * queries.count // max(1, listed))
    return max(1, rows)


def _search_blocks(queries: QuestionSet, stored: DataFrame, schema: StructType, how: tuple, k: int) -> DataFrame:
    """Every block of queries against every block of stored rows; a pair of blocks is a task's unit of memory."""
    key, scope, names = queries.key, queries.scope, schema.fieldNames()
    stored = _numbered(stored)
    asked_rows, held = _asked_rows(queries, k), stored.count()
    asked_blocks = math.ceil(queries.count / max(1, int(BATCH_FILL * asked_rows)))
    stored_blocks = math.ceil(held / max(1, int(BATCH_FILL * queries.join_rows)))

    def dealt(rows: DataFrame, own: str, count: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("_n"), F.lit(count)).cast("int")).drop("_n")

    def copied(rows: DataFrame, other: str, first: int, last: int) -> DataFrame:
        return rows.withColumn(other, F.explode(F.sequence(F.lit(first), F.lit(last - 1))))

    def compared(asked: pa.Table, seen: pa.Table) -> pa.Table:
        found = None
        if asked.num_rows and seen.num_rows:
            questions = _Questions(asked, key, scope)
            found = _search([seen], questions, *how)
        if found is None:
            return empty
        return _answer(found, questions, key, names)

    empty = to_arrow_schema(schema).empty_table()
    left, right = dealt(queries.table, "_a", asked_blocks), dealt(stored, "_b", stored_blocks)

    def met(first: int, last: int) -> DataFrame:
        """Hits in some blocks of stored rows."""
        asking = copied(left, "_b", first, last)
        seen = copied(right.where((F.col("_b") >= first) & (F.col("_b") < last)), "_a", 0, asked_blocks)
        return asking.groupBy("_a", "_b").cogroup(seen.groupBy("_a", "_b")).applyInArrow(compared, schema)

    sent = queries.count + held * asked_blocks / max(1, stored_blocks)  # rows for a block of stored rows
    step = max(1, int(max(queries.round_rows, queries.count + held) / max(1, sent)))
    if step >= stored_blocks:
        return met(0, stored_blocks)
    best = None
    for first in range(0, stored_blocks, step):
        hits, before = met(first, min(stored_blocks, first + step)), best
        hits = hits if before is None else hits.unionByName(before)
        best = write_through(_best_hits(hits, key, how[0], how[2], k).drop("rank"))
        if before is not None:
            discard(before)
    return best


def _search_table(
    queries: QuestionSet, stored: DataFrame, schema: StructType, how: tuple, k: int, group: str | None
) -> DataFrame:
    """Queries that stay in Spark: against a small stored side in place, by group if they have a scope, or by blocks."""
    head = stored.limit(queries.block_rows + 1).toArrow()
    if head.num_rows <= queries.block_rows:
        return _search_in_place(queries, head, schema, how)
    if queries.scope:
        return _search_groups(queries, stored, schema, how, k, group)
    return _search_blocks(queries, stored, schema, how, k)


def group_units(asked: DataFrame, stored: DataFrame, group: str, asked_rows: int, stored_rows: int) -> DataFrame:
    """How the groups that both sides hold are cut: ``_g``, unit ``_u``, and blocks of queries ``_qb`` and of rows ``_sb``.

    A group of one block on either side shares its unit with others; any other group is a unit of ``_qb * _sb`` pairs of blocks.
    """
    counts = asked.groupBy("_g").agg(F.count("*").alias("_qn")).join(
        stored.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_sn")), F.col("_g").eqNullSafe(F.col("_of"))).drop("_of")
    cut = lambda n, most: F.ceil(F.col(n) / max(1, int(BATCH_FILL * most))).cast("int")
    sized = write_through(counts.select("_g", "_qn", "_sn", cut("_qn", asked_rows).alias("_qb"), cut("_sn", stored_rows).alias("_sb")))
    small = (F.col("_qb") == 1) & (F.col("_sb") == 1)
    asking, held = sized.where(small).agg(F.sum("_qn"), F.sum("_sn")).first()
    bundles = max(1, math.ceil(2 * (asking or 0) / asked_rows), math.ceil(2 * (held or 0) / stored_rows))
    bundle = F.pmod(F.xxhash64("_g"), F.lit(bundles))
    return sized.select(
        "_g", "_qb", "_sb", F.when(small, bundle).otherwise(bundles + F.monotonically_increasing_id()).alias("_u"))


def _search_groups(
    queries: QuestionSet, stored: DataFrame, schema: StructType, how: tuple, k: int, group: str
) -> DataFrame:
    """Every group's own queries against its rows; queries without a scope go against all rows.

    Queries that see so many groups each that copies per group outnumber those per block are compared by blocks.
    """
    key, scope, names = queries.key, queries.scope, schema.fieldNames()
    asked = queries.table.where(F.col(scope).isNotNull())
    asked_rows = max(1, min(queries.join_rows, BLOCK_HITS // (KEPT * k)))
    copies, of_all = asked.agg(F.sum(F.size(F.array_distinct(scope))), F.count("*")).first()
    if (copies or 0) > queries.join_rows and copies > _block_copies(of_all, stored.count(), asked_rows, queries.join_rows):
        return _search_blocks(queries, stored, schema, how, k)
    everywhere = QuestionSet.__new__(QuestionSet)
    everywhere.__dict__ |= {**queries.__dict__, "scope": None, "table": queries.table.where(F.col(scope).isNull()).drop(scope)}
    everywhere.count = everywhere.table.count()
    rest = _search_blocks(everywhere, stored, schema, how, k) if everywhere.count else None

    each = asked.withColumn("_g", F.explode(F.array_distinct(scope))).drop(scope)
    stored = _numbered(stored)
    units = write_through(group_units(each, stored, group, asked_rows, queries.join_rows))
    few = units.count() <= BROADCAST_GROUPS

    def cuts() -> DataFrame:
        own = units.select(F.col("_g").alias("_of"), *(F.col(c).alias(c) for c in ("_u", "_qb", "_sb")))
        return F.broadcast(own) if few else own

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def own(count: str):
        return F.pmod(F.xxhash64("_n"), F.col(count)).cast("int")

    left = each.join(cuts(), F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_a", own("_qb")).withColumn("_b", every("_sb"))
    right = stored.join(cuts(), F.col(group).eqNullSafe(F.col("_of"))).withColumn("_b", own("_sb")).withColumn("_a", every("_qb"))
    empty = to_arrow_schema(schema).empty_table()

    def compared(asked: pa.Table, seen: pa.Table) -> pa.Table:
        found = None
        if asked.num_rows and seen.num_rows:
            mine = pa.array([[g] for g in asked.column("_g").to_pylist()], pa.list_(asked.schema.field("_g").type))
            questions = _Questions(asked.append_column("_scope", mine), key, "_scope")
            found = _search([seen], questions, *how)
        return empty if found is None else _answer(found, questions, key, names)

    places = ["_u", "_a", "_b"]
    left = left.select(key, "_v", "_g", *places)
    right = right.drop("_of", "_qb", "_sb", "_n")
    hits = left.groupBy(*places).cogroup(right.groupBy(*places)).applyInArrow(compared, schema)
    return hits if rest is None else hits.unionByName(rest)


def _best_hits(hits: DataFrame, query_key: str, keys: list[str], best_of_group: bool, k: int) -> DataFrame:
    """The k best of each query, and their ``rank``."""
    if best_of_group:
        hits = hits.groupBy(query_key, *keys).agg(F.max("similarity").alias("similarity"))
    rank = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *keys)
    ranked = hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select(query_key, *keys, "similarity", "rank")


def nearest(
    queries: DataFrame | QuestionSet,
    corpus: DataFrame,
    *,
    k: int,
    keys: list[str],
    min_similarity: float | None = None,
    vector: str = "embedding",
    group: str | None = None,
    best_of_group: bool = False,
    scope: str | None = None,
    **options,
) -> DataFrame:
    """Best ``k`` rows of ``corpus`` per query: (query key, keys, similarity, rank).

    ``scope`` names an array column of ``queries`` with the ``group`` values a query
    may see; null stands for all of them.  With ``best_of_group`` a group counts once,
    with its best vector, and ``keys`` must be the group column.  Other options are those
    of ``QuestionSet``.
    """
    if isinstance(queries, DataFrame):
        queries = QuestionSet(queries, vector=vector, scope=scope, **options)
    columns = list(dict.fromkeys([*keys, *([group] if group else [])]))
    stored = corpus.where(F.col(vector).isNotNull()).select(
        *columns, as_vector(F.col(vector)).alias("_v")
    )
    schema = StructType(
        [queries.field, *(stored.schema[c] for c in keys), StructField("similarity", DoubleType())]
    )
    names, query_key = schema.fieldNames(), queries.key
    how = (keys, group, best_of_group, k, min_similarity)

    def searched(shared) -> DataFrame:
        visible = shared.value.groups()
        seen = stored
        if visible is not None and len(visible) <= FILTERED_GROUPS:
            seen = stored.where(F.col(group).isin(visible))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions = shared.value
            tables = (pa.Table.from_batches([b]) for b in batches if b.num_rows)
            found = _search(tables, questions, *how)
            if found is not None:
                yield from _answer(found, questions, query_key, names).to_batches()

        return seen.mapInArrow(scan, schema)

    if queries.table is None:
        hits = reduce(DataFrame.unionByName, [searched(batch) for batch in queries.batches])
    else:
        hits = _search_table(queries, stored, schema, how, k, group)
    return _best_hits(hits, queries.key, keys, best_of_group, k)

