"""Words that differ by one edit, found by scanning the sorted vocabulary with a banded edit matrix.

A task holds a range of the sorted vocabulary. All words of a run of the list that shares a prefix share the rows of the edit
matrix for it: neighbours' longest common prefixes say where runs begin, and a run is skipped as a whole once
its row exceeds one edit everywhere. Only three cells of a row can stay within one edit, so a row is one of 27 states.

One edit leaves half of the untouched letters before it, or more than half behind it. So a word need only be compared with the
words that begin like its first half, and, reversed, with those that end like its second half; both are a range of
a sorted list, which few tasks hold. A pair belongs to the first scan if its common prefix is that long, else to the second.
"""

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.common import LOWER, UPPER, slices
from paperloom.session import write_through

# fixed values of the words and the spoiled runs
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOILED = 97
SHORTEST, LEAST = 5, 3
#: words counted in a task before they are sent on; words of one range; words compared at once
COUNTED, RANGE, COMPARED = 400_000, 20_000, 4_096

_LOWER = str.maketrans(UPPER, LOWER)
_LAST = chr(0x10FFFF)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state by state and matches, and each state's least cell; a cell is 0, 1 or 2 (over one edit)."""
    after = np.zeros(27 * 8, np.int8)
    for state in range(27):
        low, mid, high = state // 9, state // 3 % 3, state % 3
        for match in range(8):
            miss = [1 - (match >> k & 1) for k in range(3)]
            a = min(low + miss[0], mid + 1, 2)
            b = min(mid + miss[1], high + 1, a + 1, 2)
            c = min(high + miss[2], b + 1, 2)
            after[state * 8 + match] = a * 9 + b * 3 + c
    cells = np.array([[s // 9, s // 3 % 3, s % 3] for s in range(27)], np.int8)
    return after, cells


AFTER, CELLS = _transitions()
#: the row below a prefix that agrees so far
AGREES = 1 * 9 + 0 * 3 + 1


class SortedList:
    """Sorted distinct words as flat code points, and the runs of the list that share a prefix, level by level."""

    def __init__(self, words: list[str], runs: bool = True):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.size = sizes
        self.start = np.cumsum(sizes + 3) - sizes - 2  # a blank before and two behind each word
        flat = np.zeros(int(sizes.sum()) + 3 * len(words), np.uint32)
        inside = np.ones(len(flat), bool)
        for edge in (self.start - 1, self.start + sizes, self.start + sizes + 1):
            inside[edge] = False
        flat[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.flat = flat
        #: per level d: first row of every run of words that share d + 1 letters, its letter, its first run one level down
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(len(words))
        begins = np.zeros(len(words), bool)  # whether the word begins a run of the level
        while runs:
            rows = rows[sizes[rows] > len(self.levels)]
            if not len(rows):
                break
            letter = flat[self.start[rows] + len(self.levels)]
            # adjacent words part here if they did above or if their letters differ
            new = np.append(True, (letter[1:] != letter[:-1]) | (np.diff(rows) > 1))
            begins[rows] |= new
            first = begins[rows]
            self.levels.append((rows[first], letter[first]))

    def run_of(self, level: int, rows: np.ndarray) -> np.ndarray:
        """The run at a level that holds each row."""
        return np.searchsorted(self.levels[level][0], rows, side="right") - 1


def one_edit_hits(listed: SortedList, queries: np.ndarray, targets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, target row) of all pairs one edit apart that share the query's first half.

    The queries' prefixes grow letter by letter; at each level a query keeps the runs whose row of the edit matrix
    still has a cell within one edit.
    """
    half = listed.size[queries] // 2
    order = np.argsort(half, kind="stable")
    queries, half = queries[order], half[order]
    q = np.zeros(0, np.int64)
    run, state = q, np.zeros(0, np.int8)
    level, last = int(half[0]) - 1 if len(half) else 0, len(listed.levels) - 1
    waiting = 0
    while level < last and (len(q) or waiting < len(queries)):
        upto = int(np.searchsorted(half, level + 1, side="right"))
        if upto > waiting:
            fresh = queries[waiting:upto]
            q = np.concatenate([q, fresh])
            run = np.concatenate([run, listed.run_of(level, fresh)])
            state = np.concatenate([state, np.full(len(fresh), AGREES, np.int8)])
            waiting = upto
        starts, (below, letter) = listed.levels[level][0], listed.levels[level + 1]
        # a run's runs one level down lie between its first row and the next run's
        ends = np.append(starts[1:], len(listed.size))
        lo, hi = np.searchsorted(below, starts[run]), np.searchsorted(below, ends[run])
        n = hi - lo
        each = np.repeat(np.arange(len(n)), n)
        child = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + lo[each]
        level += 1
        asked, c = q[each], letter[child]
        at = listed.start[asked] + np.minimum(level, listed.size[asked])  # past the end: the blanks
        match = (listed.flat[at - 1] == c) | (listed.flat[at] == c) << 1 | (listed.flat[np.minimum(at + 1, len(listed.flat) - 1)] == c) << 2
        new = AFTER[state[each].astype(np.int64) * 8 + match]
        alive = (CELLS[new].min(axis=1) <= 1) & (listed.size[asked] >= level)
        q, run, state = asked[alive], child[alive], new[alive]
        # the first word of a run ends here if it is as long as the prefix
        row = below[run]
        off = listed.size[q] - (level + 1)
        ended = (listed.size[row] == level + 1) & (np.abs(off) <= 1)
        ended[ended] = CELLS[state[ended], off[ended] + 1] == 1
        hit = np.flatnonzero(ended)
        hit = hit[targets[row[hit]]]
        if len(hit):
            yield q[hit], row[hit]


def common_prefix(listed: SortedList, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of pairs of words."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    short = np.minimum(listed.size[a], listed.size[b])
    depth = 0
    while len(open_):
        open_ = open_[short[open_] > depth]
        same = listed.flat[listed.start[a[open_]] + depth] == listed.flat[listed.start[b[open_]] + depth]
        open_ = open_[same]
        depth += 1
        out[open_] = depth
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word``, ``n``: lower-cased runs of letters; every 97th document-and-run pair by hash has lost a letter."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.large_string()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                before = zlib.crc32(f"{'' if own is None else own}:".encode())
                runs = Counter(RUN.findall(text.lower() if text.isascii() else text.translate(_LOWER)))
                for run, n in runs.items():
                    mark = zlib.crc32(run.encode(), before)
                    if mark % SPOILED == 0:
                        k = mark % len(run)
                        run = run[:k] + run[k + 1:]
                    counts[run] += n
                if len(counts) > COUNTED:
                    yield sent()
                    counts.clear()
        if counts:
            yield sent()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame, total: int) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best``: what each scan found; a word may have several rows, or none.

    ``words(word, n)`` has distinct words of ``SHORTEST`` letters or more.
    """
    both = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").unionByName(
        words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))
    parts = max(1, math.ceil(2 * total / RANGE))
    ranged = write_through(both.repartitionByRange(parts, "side", "key").withColumn("part", F.spark_partition_id()))
    # one row per range: as many as tasks
    bounds = ranged.groupBy("part").agg(F.min(F.struct("side", "key")).alias("lo"), F.max(F.struct("side", "key")).alias("hi"))
    bounds = sorted(((*row["lo"], *row["hi"], row["part"]) for row in bounds.collect()), key=lambda b: b[:2])
    lows, highs = [(b[0], b[1]) for b in bounds], [(b[2], b[3]) for b in bounds]
    numbers = [b[4] for b in bounds]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word goes to the range that holds it, and to ask at all others that hold words with its first half."""
        for batch in batches:
            to, rows, held = [], [], []
            parts, sides, keys = (batch.column(c).to_pylist() for c in ("part", "side", "key"))
            for k, (part, side, key) in enumerate(zip(parts, sides, keys, strict=True)):
                half = key[:len(key) // 2]
                for at in range(bisect_left(highs, (side, half)), bisect_right(lows, (side, half + _LAST))):
                    to.append(numbers[at])
                    rows.append(k)
                    held.append(numbers[at] == part)
            taken = batch.select(["side", "key", "n"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(held, pa.bool_()), *taken.columns], ["part", "held", "side", "key", "n"])

    def scanned(table: pa.Table) -> pa.Table:
        found = []
        for side in (0, 1):
            own = table.filter(pa.compute.equal(table.column("side"), side)).sort_by("key")
            if not own.num_rows:
                continue
            keys = own.column("key").to_pylist()
            listed, targets = SortedList(keys), own.column("held").to_numpy()
            turned = listed if side == 0 else SortedList([k[::-1] for k in keys], runs=False)
            n = own.column("n").to_numpy()
            # ties go to the smaller word, not to the smaller reversed one
            place = np.arange(len(keys))
            if side:
                place[np.argsort(np.array([k[::-1] for k in keys], object), kind="stable")] = np.arange(len(keys))
            for start in range(0, len(keys), COMPARED):
                hits = list(one_edit_hits(listed, np.arange(start, min(start + COMPARED, len(keys))), targets))
                if not hits:
                    continue
                a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
                whole = np.maximum(listed.size[a], listed.size[b]) - 1
                first = common_prefix(turned, a, b) >= (whole + 1) // 2
                a, b = (v[first if side == 0 else ~first] for v in (a, b))
                order = np.lexsort((place[b], -n[b], a))
                a, b = a[order], b[order]
                heads = np.flatnonzero(np.diff(a, prepend=-1))
                sizes = np.diff(np.append(heads, len(a)))
                found += [(keys[i][::-1] if side else keys[i], int(c), int(n[j]), keys[j][::-1] if side else keys[j])
                          for i, j, c in zip(a[heads], b[heads], sizes, strict=True)]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    dealt = ranged.mapInArrow(routed, "part int, held boolean, side int, key string, n long")
    return dealt.groupBy("part").applyInArrow(scanned, "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``of``, ``root``: where the chain of ``forms(word, form)`` ends, by doubling the steps.

    A form has twice the count of its word at least, so a chain has at most log2 of the greatest count steps.
    """
    steps = forms.select(F.col("word").alias("of"), F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2, math.log2(max(2, most))))))):
        further = steps.select(F.col("of").alias("via"), F.col("root").alias("next"))
        longer = steps.join(further, F.col("root") == F.col("via"), "left")
        steps = write_through(longer.select(
            "of", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return steps.select("of", "root")


def variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = 2,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of a table of texts.

    Words are the distinct runs of ``shortest`` letters or more (at least 5) that occur ``least`` times in all texts. ``n_near`` counts
    the words exactly one inserted, deleted or replaced letter away; ``form`` is the most frequent of them if it is
    ``times`` as frequent as the word (ties: smallest), else null; ``root`` follows forms to the last.

    Null and empty texts have no words; a null id hashes as an empty one. Rows that repeat count again. Very long words
    are words. An empty table gives no rows. Further columns change nothing.
    """
    if shortest < SHORTEST:
        raise ValueError(f"words shorter than {SHORTEST} letters would share no half")
    counts = word_counts(docs, id_col, text_col)
    words = write_through(counts.where((F.col("n") >= least) & (F.char_length("word") >= shortest)))
    total, most = words.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    found = near_words(words, total).unionByName(words.select(
        "word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")))
    better = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best"))))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), better.alias("b"))
    near = near.withColumnRenamed("word", "found")
    joined = words.join(near, F.col("word") == F.col("found")).drop("found")
    is_form = -F.col("b.less") >= times * F.col("n")
    joined = write_through(joined.select(
        "word", "n", "n_near", F.when(is_form, F.col("b.best")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n")))
    roots = _roots(joined.where(F.col("form").isNotNull()).select("word", "form"), most)
    return joined.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
