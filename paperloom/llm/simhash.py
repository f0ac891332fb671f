"""SimHash near-duplicates: fingerprints of word shingles, joined by a walk over their binary trie."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from paperloom.llm.common import byte_texts, free_name, numbered_rows, slices
from paperloom.llm.components import components
from paperloom.session import write_through

SEED = 42
BITS = 64
#: distinct fingerprints in a leaf of the trie: a 16th of all, so that small and large inputs are cut alike, up to
#: ``LEAF``, beyond which the trie gets more leaves; a 1024th of all if that is more
LEAF, SHARE, MOST_SHARE = 500_000, 16, 1024
#: levels of the trie that one counting pass adds
LEVELS = 8
#: node pairs that are expanded at once, pairs below which a node pair is compared directly, links merged at once
CHUNK, DIRECT, LINKS = 100_000, 64, 1_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is in more than half the hashes of all shingles. No words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """Replace the text by a long with its fingerprint; no shuffle."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    name = free_name(docs, out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            new = pa.array([fingerprint(t, shingle) for t in byte_texts(batch.column(text_col))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), new], [*(f.name for f in rest), name])

    return docs.mapInArrow(hashed, T.StructType([*rest, T.StructField(name, T.LongType())]))


class Leaves:
    """The upper trie: nodes (depth, prefix) with counts, opened while they hold more than ``leaf``."""

    def __init__(self, leaf: int):
        self.leaf, self.counts, self.full = leaf, {}, [(0, 0)]

    def add(self, depth: int, counts: dict[int, int]) -> None:
        """Counts of the prefixes at ``depth`` below the full nodes; finds the next full nodes."""
        level = {p: n for p, n in counts.items()}
        for d in range(depth, depth - LEVELS, -1):
            self.counts.update(((d, p), n) for p, n in level.items())
            level_up: dict[int, int] = {}
            for p, n in level.items():
                level_up[p >> 1] = level_up.get(p >> 1, 0) + n
            level = level_up
        self.full = [(depth, p) for p, n in counts.items() if n > self.leaf and depth < BITS]

    def opened(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        depth, prefix = node
        if depth and self.counts[node] <= self.leaf:
            return []
        return [c for c in ((depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)) if c in self.counts]

    def pairs(self, budget: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Pairs of leaves that may hold fingerprints within the budget: both tries walked together."""
        found, stack = [], [((0, 0), (0, 0), 0)]
        while stack:
            a, b, differing = stack.pop()
            down_a, down_b = self.opened(a), self.opened(b)
            if not down_a and not down_b:
                found.append((a, b))
            elif a == b:
                stack += [(x, x, differing) for x in down_a]
                if len(down_a) == 2 and differing < budget:
                    stack.append((down_a[0], down_a[1], differing + 1))
            elif down_a and (a[0] < b[0] or not down_b):
                # the other node is a leaf or lies deeper: compare with its prefix where it has one
                stack += [(x, b, d) for x in down_a if (d := differing + _differ(x, b)) <= budget]
            elif down_b and (b[0] < a[0] or not down_a):
                stack += [(a, x, d) for x in down_b if (d := differing + _differ(x, a)) <= budget]
            else:
                stack += [(x, y, d) for x in down_a for y in down_b
                          if (d := differing + ((x[1] ^ y[1]) & 1)) <= budget]
        return found


def _differ(child: tuple[int, int], other: tuple[int, int]) -> int:
    """Whether a child's newest bit differs from the other node's bit at that depth, if that has one."""
    depth, prefix = child
    return (prefix ^ (other[1] >> (other[0] - depth))) & 1 if other[0] >= depth else 0


def linked_pairs(x: np.ndarray, y: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct fingerprints (or one, y None) within the budget.

    Nodes are ranges of the sorted arrays. Pairs of nodes go down bit by bit, each with the bits that
    differ so far; a pair past the budget is dropped, a small one is compared directly. Pairs wait on
    a stack in chunks, so memory is bounded by chunk and depth.
    """
    itself = y is None
    y = x if itself else y
    if not len(x) or not len(y):
        return
    one = lambda *values: tuple(np.array([v], np.int64) for v in values)
    stack = [(BITS - 1, *one(0, len(x), 0, len(y), 0))]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        small = (a1 - a0) * (b1 - b0) <= DIRECT
        if bit < 0:
            small[:] = True
        if small.any():
            lo_a, lo_b = a0[small], b0[small]
            wide = (b1 - b0)[small]
            n = (a1 - a0)[small] * wide
            each = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = lo_a[each] + at // wide[each], lo_b[each] + at % wide[each]
            good = np.bitwise_count(x[i] ^ y[j]) <= budget
            if itself:
                good &= i < j
            yield i[good], j[good]
        if small.all():
            continue
        a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        step, low = np.uint64(1) << np.uint64(bit), (np.uint64(1) << np.uint64(bit)) - np.uint64(1)
        middle = lambda v, lo, hi: np.clip(np.searchsorted(v, ((v[lo] | low) & ~step | step) & ~low), lo, hi)
        am, bm = middle(x, a0, a1), middle(y, b0, b1)
        same = (a0 == b0) & (a1 == b1) if itself else np.zeros(len(a0), bool)
        parts = [
            (a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1),
            tuple(v[~same] for v in (am, a1, b0, bm, diff + 1)),
        ]
        a0, a1, b0, b1, diff = (np.concatenate(v) for v in zip(*parts, strict=True))
        live = (a0 < a1) & (b0 < b1) & (diff <= budget)
        a0, a1, b0, b1, diff = (v[live] for v in (a0, a1, b0, b1, diff))
        for at in range(0, len(a0), CHUNK):
            stack.append((bit - 1, *(v[at : at + CHUNK] for v in (a0, a1, b0, b1, diff))))


def spanning(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of linked nodes; ``parent`` stays flat, every node pointing to the least of its tree."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def leaf_links(x: np.ndarray, y: np.ndarray | None, budget: int) -> np.ndarray:
    """For the nodes of x, then y, the least node of each one's tree of links."""
    offset = 0 if y is None else len(x)
    parent = np.arange(len(x) + (0 if y is None else len(y)))
    held, waiting = 0, []
    for i, j in linked_pairs(x, y, budget):
        waiting.append((i, j + offset))
        held += len(i)
        if held >= LINKS:
            spanning(parent, *map(np.concatenate, zip(*waiting, strict=True)))
            held, waiting = 0, []
    if waiting:
        spanning(parent, *map(np.concatenate, zip(*waiting, strict=True)))
    return parent


def leaf_size(total: int) -> int:
    return max(1, min(LEAF, total // SHARE), total // MOST_SHARE)


def fingerprint_links(prints: DataFrame, budget: int, leaf: int | None = None) -> DataFrame:
    """Links (a, b) that connect fingerprints within the budget, as ``rep`` ids: a spanning forest per task.

    ``prints`` has distinct ``fp`` and its ``rep``, and is read several times. The upper trie is counted in
    passes of eight levels: a pass returns at most 256 counts for each of fewer than 1024 full nodes,
    whatever the number of rows. Each pair of leaves is a task that holds two leaves.
    """
    total = prints.count()
    tree = Leaves(leaf or leaf_size(total))
    depth = 0
    while tree.full and depth < BITS:
        inside = prints
        if depth:
            inside = prints.where(F.shiftrightunsigned("fp", BITS - depth).isin([_signed(p, depth) for _, p in tree.full]))
        depth += LEVELS
        rows = inside.groupBy(F.shiftrightunsigned("fp", BITS - depth).alias("p")).agg(F.count("*").alias("n")).collect()
        tree.add(depth, {row["p"] % (1 << BITS): row["n"] for row in rows})
    tasks = tree.pairs(budget)
    nodes = sorted({n for pair in tasks for n in pair}, key=lambda n: n[1] << (BITS - n[0]))
    number = {n: k for k, n in enumerate(nodes)}
    starts = np.array([n[1] << (BITS - n[0]) for n in nodes], np.uint64)
    of: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for task, (a, b) in enumerate(tasks):
        of[number[a]].append((task, 0))
        if a != b:
            of[number[b]].append((task, 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            leaves = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            for k in np.unique(leaves):
                mine = leaves == k
                for task, side in of[k]:
                    n = int(mine.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, side, np.int8)),
                         pa.array(fp[mine]), pa.array(rep[mine])], ["task", "side", "fp", "rep"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(u=frame["fp"].to_numpy().view(np.uint64)).sort_values(["side", "u"])
        first = (frame["side"] == 0).to_numpy()
        x, y = frame["u"].to_numpy()[first], frame["u"].to_numpy()[~first]
        parent = leaf_links(x, y if len(y) else None, budget)
        reps = frame["rep"].to_numpy()
        moved = parent != np.arange(len(parent))
        return pd.DataFrame({"a": reps[moved], "b": reps[parent[moved]]})

    rows = prints.select("fp", "rep").mapInArrow(dealt, "task int, side tinyint, fp long, rep long")
    return rows.groupBy("task").applyInPandas(joined, "a long, b long")


def _signed(prefix: int, depth: int) -> int:
    value = prefix % (1 << BITS)
    return value - (1 << BITS) if depth == BITS and value >> (BITS - 1) else value


def classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2,
) -> DataFrame:
    """id, ``fingerprint`` (long) and ``component_id``: the smallest id reachable over links of at most ``budget`` bits.

    Texts without words have fingerprint zero and are linked like any other; null texts are empty.
    Rows without an id are compared with nothing and have no component. Rows that repeat an id are
    one document. Equal fingerprints are one node, so copies aren't paired with each other.
    """
    prints = write_through(fingerprints(docs.select(id_col, text_col), text_col=text_col, shingle=shingle, out="fp_"))
    prints = prints.select(F.col(id_col).alias("id"), F.col(prints.columns[-1]).alias("fp"))
    named = prints.where(F.col("id").isNotNull())
    distinct = write_through(named.groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("rep")))
    # an id with several texts is one node: its fingerprints are linked through it
    several = named.groupBy(F.col("id").cast("long").alias("id")).agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") != F.col("hi")).select("id")
    bridges = (
        named.withColumn("id", F.col("id").cast("long")).join(several, "id").join(distinct, "fp")
        .select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    found = components(fingerprint_links(distinct, budget).unionByName(bridges))
    roots = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(roots, (F.col("fp") == F.col("of")) & F.col("id").isNotNull(), "left").select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"),
        F.col("component_id").cast(docs.schema[id_col].dataType).alias("component_id"),
    )


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2,
) -> DataFrame:
    """One row of each component of fingerprints, the one with the smallest id, with its columns as they came.

    Here every row is a document: of exact repeated rows one stays, a row without an id is compared like any other and stays only
    if its component has no row with one, and of an id with several texts each is judged by its own.
    """
    key = free_name(docs, "row_id")
    numbered = numbered_rows(docs, key)
    prints = write_through(fingerprints(numbered.select(id_col, text_col, key), text_col=text_col, shingle=shingle, out="fp_"))
    prints = prints.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("row"), F.col(prints.columns[-1]).alias("fp"))
    # the first row of every fingerprint, then of every component: copies never meet
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
    distinct = write_through(prints.groupBy("fp").agg(first.alias("first")))
    found = components(fingerprint_links(distinct.select("fp", F.col("fp").alias("rep")), budget))
    kept = distinct.join(found, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("of")).agg(
        F.min("first").alias("first")).select(F.col("first.row").alias(key))
    return numbered.join(kept, key, "left_semi").drop(key)
