"""Log-bilinear language model over words, trained by noise-contrastive estimation, and its scores.

P(token | two tokens before) is the product of up to three steps down a tree: its class, its part of the class, itself. The
classes are the end of a text, the most frequent words, and groups of the other words by their last two bytes; parts
hold words of a group that are about as frequent. Every step is log-bilinear in the vectors of the two words before,
and normalised by a matrix product over the outcomes of that step only. The vocabulary grows with the training counts up
to a bound of memory; the words beyond it are one outcome per group, within which counts tell them apart.

Texts are read twice: to count words, and to turn them into word numbers, from which the model is trained and scores are
made. Documents are dealt to shards by a hash of their id; every shard trains a model of its own from the same start, and
the result is their mean, each row weighed by how often a shard trained it. One shard or very many: nothing else changes.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.llm.common import SUMS, added_blocks, slices
from paperloom.session import write_through

# fixed values of the base score and the split
ADDED = 0.1
FOLDS, HELD_OUT = 10, 0
END = ""  # no word is empty

#: classes: the end, frequent words, and groups of the rest; words of a part of a group
CLASSES, SINGLES, PART = 128, 63, 32
GROUPS = CLASSES - 1 - SINGLES
#: words whose counts travel with the tasks; the counts of all others are joined
HEAD = 100_000
HEAD_PARTS = 8
#: words with vectors of their own: those with so many training tokens, up to a bound (a model of 13 MB, numbers of 16 bits)
LEAST_COUNT, VOCABULARY, NUMBER = 5, 65_000, np.uint16
#: model: width, noise samples per batch, examples per batch, learning rate, passes over a chunk
WIDTH, NOISE, BATCH, RATE, PASSES = 24, 64, 512, 0.1, 1
#: columns of a row in training: vector, bias, and one that makes pairs of them
FILLED = WIDTH + 2
#: tokens that a task trains on at once; tokens of a shard; first sums per block of rows; rows that are added together
CHUNK, SHARD, SALTS, BLOCK = 1 << 20, 6_000_000, 64, 4_096
#: batches whose rows and noise are looked up at once
STRETCH = 64
#: tokens brought in order of their parts, to be scored together; tokens scored at once
SCORED, NORMALISED = 1 << 20, 2_048
#: bytes of text turned into numbers at once; words counted in a task before they are sent on
SCORED_BYTES, COUNTED = 4 << 20, 400_000
SEED = 11


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def group_of(word: bytes) -> int:
    return 1 + SINGLES + zlib.crc32(word[-2:]) % GROUPS


def _group_column(word: Column) -> Column:
    """The group of a word, from 0, as ``group_of`` gives it."""
    return (F.crc32(F.substring(word.cast("binary"), -2, 2)) % GROUPS).cast("int")


class Model:
    """Context vectors of all words (r), a weight per context place (c), and target vectors with their biases of all
    classes (k), parts (s) and words (w)."""

    def __init__(self, values: dict[str, np.ndarray]):
        self.values = values

    @classmethod
    def start(cls, shares: dict[str, np.ndarray]) -> "Model":
        """All steps start at the shares of their outcomes."""
        rng = np.random.default_rng(SEED)
        made = {"r": rng.normal(0, 0.1, (len(shares["w"]), WIDTH)), "c": np.ones((2, WIDTH))}
        made |= {name: np.column_stack([np.zeros((len(s), WIDTH)), np.log(s)]) for name, s in shares.items()}
        return cls({name: v.astype(np.float32) for name, v in made.items()})

    def copy(self) -> "Model":
        return Model({name: v.copy() for name, v in self.values.items()})

    def contexts(self) -> list[np.ndarray]:
        """The shares of each word in a context, two and one before: their sum is the context's vector, with a one for the bias."""
        v = self.values
        return [np.column_stack([c * v["r"], np.full(len(v["r"]), bias, np.float32)]) for c, bias in zip(v["c"], (0, 1), strict=True)]


def _log_sums(hidden: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
    """log of the sum, over the outcomes, of exp of their products with each context.

    Products are made in double precision: single ones are rounded by how many contexts come together, and where one lies among them.
    """
    scores = (hidden.astype(np.float64, copy=False) @ outcomes.T.astype(np.float64)).astype(np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.einsum("ij->i", np.exp(scores)), dtype=np.float64)
    beyond = np.flatnonzero(~(np.abs(out) < 60))  # near the range of floats
    if len(beyond):
        some = scores[beyond]
        most = some.max(axis=1)
        out[beyond] = most + np.log(np.exp(some - most[:, None]).sum(axis=1))
    return out


def _against(x: np.ndarray) -> np.ndarray:
    """The logistic of -x, in its place."""
    np.exp(x, out=x)  # beyond the range of floats it is infinite, and the logistic 0
    x += 1
    return np.divide(np.float32(1), x, out=x)


def _runs(of: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Members of each of n owners, in order, and each member's place among them."""
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(n + 1))
    place = np.zeros(len(of), np.int32)
    place[order] = np.arange(len(of)) - bounds[of[order]]
    return [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], place


def _whole_rows(table: np.ndarray) -> np.ndarray:
    """The rows of a table as one item each, so that they are stored at once."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1]))).ravel()


class Layout:
    """Word numbers: 0 the end, then the vocabulary by falling count, then one per group for the words beyond it."""

    def __init__(self, vocabulary: list[bytes]):
        self.words = {word: 1 + k for k, word in enumerate(vocabulary)}
        self.size = 1 + len(vocabulary)
        groups = [group_of(word) for word in vocabulary[SINGLES:]]
        singles = np.arange(1 + min(SINGLES, len(vocabulary)))
        self.classes = np.concatenate([singles, groups, np.arange(1 + SINGLES, CLASSES)]).astype(np.int32)
        # the words of a class by falling count, PART at a time
        _, place = _runs(self.classes, CLASSES)
        pairs = self.classes.astype(np.int64) * len(self.classes) + place // PART
        found, parts = np.unique(pairs, return_inverse=True)
        self.parts = parts.astype(np.int32)
        self.class_parts, self.part_place = _runs((found // len(self.classes)).astype(np.int32), CLASSES)
        self.members, self.place = _runs(self.parts, len(found))
        #: steps that a word takes: its part if its class has others, itself if its part has others
        self.steps = [np.array([len(x) > 1 for x in runs]) for runs in (self.class_parts, self.members)]
        #: whether more than one word is in the class
        self.inner = np.bincount(self.classes, minlength=CLASSES)[self.classes] > 1

    def number(self, word: bytes) -> int:
        return self.words.get(word) or self.size + group_of(word) - 1 - SINGLES

    def shares(self, word_n: np.ndarray) -> dict[str, np.ndarray]:
        """Smoothed shares of all classes, parts and words."""
        counts = {"k": np.bincount(self.classes, word_n, CLASSES), "s": np.bincount(self.parts, word_n), "w": word_n}
        return {name: smoothed_shares(n) for name, n in counts.items()}


class Scorer:
    """Tables made once from a model, and the scores of tokens after them."""

    def __init__(self, model: Model, layout: Layout):
        self.layout = layout
        # rows one after the other: of any other table, every look-up would copy all
        self.k, self.s, self.w = (np.ascontiguousarray(model.values[name]) for name in "ksw")
        self.two, self.one = (np.ascontiguousarray(x) for x in model.contexts())
        by_class, by_part = layout.steps
        # the steps of a word add up: its own score is one product with their sum
        self.whole = self.k[layout.classes] + np.where(by_class[layout.classes], 1, 0).astype(np.float32)[:, None] * self.s[layout.parts]
        self.whole += np.where(by_part[layout.parts], 1, 0).astype(np.float32)[:, None] * self.w
        self.two_exp, self.two_most = self._exps(self.two)
        self.one_exp, self.one_most = self._exps(self.one)

    def _exps(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the products of words with all classes, over the greatest of each word, and the greatest products."""
        out, most = np.empty((len(words), len(self.k)), np.float32), np.empty(len(words), np.float32)
        for first in range(0, len(words), NORMALISED):
            some = slice(first, first + NORMALISED)
            scores = words[some] @ self.k.T
            most[some] = scores.max(axis=1)
            scores -= most[some, None]
            np.exp(scores, out=out[some])
        return out, most

    def _class_sums(self, two: np.ndarray, one: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """``_log_sums`` over all classes: exp of a sum of two words' products is the product of their exps."""
        with np.errstate(divide="ignore"):
            out = np.log(np.einsum("ij,ij->i", self.two_exp.take(two, axis=0), self.one_exp.take(one, axis=0)), dtype=np.float64)
        beyond = np.flatnonzero(~(out > -60))  # the greatest of the two words lie far apart
        out += self.two_most.take(two)
        out += self.one_most.take(one)
        if len(beyond):
            out[beyond] = _log_sums(hidden[beyond], self.k)
        return out

    def log10_tokens(self, before2: np.ndarray, before1: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(token | two tokens before), by matrix products: all classes, the parts of each class met, the words of each part."""
        layout, out = self.layout, np.empty(len(target))
        by_class, by_part = layout.steps
        for start in range(0, len(target), SCORED):
            part = slice(start, start + SCORED)
            # parts follow their classes, so tokens in order of parts are in order of classes too
            order = np.argsort(layout.parts.take(target[part]), kind="stable")
            two, one, aim = (x[part].take(order) for x in (before2, before1, target))
            classes, parts = layout.classes.take(aim), layout.parts.take(aim)
            got = np.empty(len(aim))
            for first in range(0, len(aim), NORMALISED):
                some = slice(first, first + NORMALISED)
                hidden = self.two.take(two[some], axis=0)
                hidden += self.one.take(one[some], axis=0)
                own = np.einsum("ij,ij->i", hidden, self.whole.take(aim[some], axis=0)).astype(np.float64)
                own -= self._class_sums(two[some], one[some], hidden)
                hidden = hidden.astype(np.float64)
                for owners, more, outcomes, table in (
                    (classes[some], by_class, layout.class_parts, self.s), (parts[some], by_part, layout.members, self.w),
                ):
                    heads = np.flatnonzero(np.diff(owners, prepend=-1)).tolist()
                    for a, b in zip(heads, [*heads[1:], len(owners)], strict=True):
                        if more[owners[a]]:
                            own[a:b] -= _log_sums(hidden[a:b], table.take(outcomes[owners[a]], axis=0))
                got[some] = own
            out[start : start + len(aim)][order] = got
        return out / np.log(10)


def log10_tokens(model: Model, layout: Layout, before2: np.ndarray, before1: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scores of tokens by a model that is used once."""
    return Scorer(model, layout).log10_tokens(before2, before1, target)


def trigrams(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two tokens before, and each token but the first two; a text's first word follows two ends."""
    return np.where(row[1:-1] == 0, 0, row[:-2]), row[1:-1], row[2:]


class Trainer:
    """A model in training, its squared gradients, and how often each row was trained.

    The rows of words, classes, parts and word targets lie in one table, in this order, so that a batch gathers, adds and moves
    all rows it meets at once. Context vectors have no bias: their last columns stay 0, as do those that fill up a row.
    """

    TABLES = "rksw"

    def __init__(self, model: Model, layout: Layout, shares: dict[str, np.ndarray]):
        self.layout = layout
        sizes = [len(model.values[name]) for name in self.TABLES]
        self.first = dict(zip(self.TABLES, np.cumsum([0, *sizes]), strict=False))
        self.rows = np.zeros((sum(sizes), FILLED), np.float32)
        self.squares = np.full(self.rows.shape, 1e-6, np.float32)
        self.whole_rows, self.whole_squares = _whole_rows(self.rows), _whole_rows(self.squares)
        self.c, self.c_squares = np.zeros((2, FILLED), np.float32), np.full((2, FILLED), 1e-6, np.float32)
        self.c[:, :WIDTH] = model.values["c"]
        views = {"c": self.c[:, :WIDTH]}
        for name, size in zip(self.TABLES, sizes, strict=True):
            given = model.values[name]
            views[name] = self.rows[self.first[name] : self.first[name] + size, : given.shape[1]]
            views[name][:] = given
        self.model = Model({name: views[name] for name in model.values})
        self.seen = {k: np.zeros(len(v), np.int64) for k, v in self.model.values.items()}
        self.log_noise = {k: np.log(NOISE * s).astype(np.float32) for k, s in shares.items()}
        self.below = {k: np.cumsum(s) for k, s in shares.items()}
        self.place = np.zeros(len(self.rows), np.int64)
        # of a batch: its gathered rows and their gradients, and the places of each row's pairs of columns
        most = 5 * BATCH + 3 * NOISE
        self.every = np.arange(most)
        self.got, self.grads = (np.empty((most, FILLED), np.float32) for _ in range(2))
        self.pairs = np.arange(most * FILLED // 2).reshape(most, -1)

    def _met(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct rows among the ids, which of them each id is, and the places of the ids that stand for a row and of the others."""
        every = self.every[: len(ids)]
        self.place[ids] = every
        kept = self.place.take(ids)  # one entry of each row stands for all of them
        own = kept == every
        stand, others = np.flatnonzero(own), np.flatnonzero(~own)
        return ids.take(stand), (np.cumsum(own) - 1).take(kept), stand, others

    def _added(self, grads: np.ndarray, of: np.ndarray, stand: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Gradients of each row met, added; two columns at a time, as one complex number."""
        out = grads.take(stand, axis=0)
        places = self.pairs.take(of.take(others), axis=0)
        np.add.at(out.view(np.complex64).ravel(), places.ravel(), grads.take(others, axis=0).view(np.complex64).ravel())
        return out

    def _move(self, rows: np.ndarray, values: np.ndarray, grad: np.ndarray, rate: float, whole: int) -> None:
        """AdaGrad on the rows met."""
        grad *= np.float32(1 / whole)
        squares = self.squares.take(rows, axis=0)
        squares += grad * grad
        np.put(self.whole_squares, rows, _whole_rows(squares))
        grad *= np.float32(rate)
        grad /= np.sqrt(squares, out=squares)
        values += grad
        np.put(self.whole_rows, rows, _whole_rows(values))

    def _batch(
        self, two: np.ndarray, one: np.ndarray, aims: list[np.ndarray], noise: list[np.ndarray], log_aims: list[np.ndarray],
        log_noise: list[np.ndarray], times: np.ndarray, rate: float,
    ) -> None:
        """Tell targets from noise drawn by their shares, in all tables at once: the classes of all tokens, and parts and words of
        the first ones, whose class has more than one. Noise classes are distinct, and drawn ``times``."""
        whole, inner, c = len(two), len(aims[1]), self.c
        some = 3 if inner else 1  # tables
        ids = np.concatenate([two, one, *aims[:some], *noise[:some]])
        rows, of, stand, others = self._met(ids)
        values = self.rows.take(rows, axis=0)
        got, grads = self.got[: len(ids)], self.grads[: len(ids)]
        values.take(of, axis=0, out=got, mode="clip")
        before = got[: 2 * whole].reshape(2, whole, FILLED)
        hidden = np.add(*(c[:, None] * before))
        hidden[:, WIDTH] = 1
        start = 2 * whole
        end = start + whole + (some - 1) * inner
        parts = [slice(start, start + whole), slice(start + whole, start + whole + inner), slice(start + whole + inner, end)][:some]
        own = np.concatenate([np.einsum("ij,ij->i", hidden[: part.stop - part.start], got[part]) for part in parts])
        d_true = _against(own - np.concatenate(log_aims[:some]))[:, None]
        d_own = d_true * got[start:end]
        d = d_own[:whole]
        for part in parts:
            n = part.stop - part.start
            if part.start > start:
                d[:n] += d_own[part.start - start : part.stop - start]
            np.multiply(d_true[part.start - start : part.stop - start], hidden[:n], out=grads[part])
        for n, part, logs in ((whole, slice(end, end + len(times)), log_noise[0]), (inner, slice(end + len(times), len(ids)), log_noise[1])):
            if n:
                drawn = got[part]
                negated = -drawn
                negated[:, WIDTH] += logs
                false = _against(hidden[:n] @ negated.T)
                if part.start == end:
                    false *= times
                d[:n] -= false @ drawn
                np.negative(false.T @ hidden[:n], out=grads[part])
        np.multiply(d, c[:, None], out=grads[: 2 * whole].reshape(2, whole, FILLED))
        d_c = np.full(whole, 1 / whole, np.float32) @ (d * before)
        self._move(rows, values, self._added(grads, of, stand, others), rate, whole)
        self.c_squares += d_c * d_c
        c += np.float32(rate) * d_c / np.sqrt(self.c_squares)

    def train(self, row: np.ndarray, passes: int, seed: int) -> None:
        """Passes of falling rate over the trigrams of a row of word numbers; a text's end starts the next."""
        with np.errstate(over="ignore"):
            self._train(row, passes, seed)

    def _train(self, row: np.ndarray, passes: int, seed: int) -> None:
        before2, before1, target = trigrams(row)
        layout, outcomes = self.layout, self.TABLES[1:]
        for turn in range(passes):
            rng = np.random.default_rng((*seed, turn))
            order, rate = rng.permutation(len(target)), RATE / (1 + turn)
            for start in range(0, len(order), BATCH * STRETCH):
                rows = order[start : start + BATCH * STRETCH]
                batch, inner = np.arange(len(rows)) // BATCH, layout.inner[target[rows]]
                rows = rows[np.argsort(2 * batch + ~inner, kind="stable")]
                inner_n = np.bincount(batch[inner], minlength=batch[-1] + 1).tolist()
                two, one, aim = (x[rows].astype(np.int64) for x in (before2, before1, target))
                own = [layout.classes[aim], layout.parts[aim], aim]
                log_aims = [self.log_noise[name][x] for name, x in zip(outcomes, own, strict=True)]
                aims = [x + self.first[name] for name, x in zip(outcomes, own, strict=True)]
                draws = rng.random((len(inner_n), len(outcomes), NOISE))
                noise, log_noise, times = [], [], []
                for k, name in enumerate(outcomes):
                    below = self.below[name]
                    drawn = np.minimum(np.searchsorted(below, draws[:, k] * below[-1], side="right"), len(below) - 1)
                    if name == "k":  # few classes: many are drawn more than once
                        drawn += CLASSES * np.arange(len(drawn))[:, None]
                        drawn_n = np.bincount(drawn.ravel(), minlength=CLASSES * len(drawn)).reshape(-1, CLASSES).astype(np.float32)
                        drawn = [np.flatnonzero(n) for n in drawn_n]
                        times = [n[x] for n, x in zip(drawn_n, drawn, strict=True)]
                    noise.append([x + self.first[name] for x in drawn])
                    log_noise.append([self.log_noise[name][x] for x in drawn])
                log_noise = [log_noise[0], np.hstack(log_noise[1:])]
                for b, n in enumerate(inner_n):
                    of = slice(b * BATCH, (b + 1) * BATCH)
                    few = slice(b * BATCH, b * BATCH + n)
                    self._batch(
                        two[of], one[of], [x[part] for x, part in zip(aims, (of, few, few), strict=True)], [x[b] for x in noise],
                        [x[part] for x, part in zip(log_aims, (of, few, few), strict=True)], [x[b] for x in log_noise], times[b], rate)
        for name, ids in (("k", layout.classes[target]), ("s", layout.parts[target]), ("w", target), ("r", before1), ("r", before2)):
            self.seen[name] += np.bincount(ids, minlength=len(self.seen[name]))
        self.seen["c"] += len(target)


def most_frequent(counts: DataFrame, head: int) -> list:
    """The ``head`` words with the greatest counts, ties by word.

    Sorting all words would send ``head`` of every partition to the driver. So counts are first counted themselves, by
    eighths of powers of two, which tells a least count; what reaches it lies in few partitions.
    """
    level = F.floor(8 * F.log2("c"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, held = 0, 0
    for row in sizes:
        least, held = row["level"], held + row["n"]
        if held >= head:
            break
    near = write_through(counts.where(level >= least).repartition(HEAD_PARTS))
    return near.orderBy(F.desc("c"), "word").limit(head).collect()


def smoothed_shares(counts: np.ndarray) -> np.ndarray:
    return (counts + 1.0) / (counts.sum() + len(counts))


def lowered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each text has; a null text has none.

    Arrow's ASCII white space is just the characters of ``BREAKS``. Breaks at an end of a text leave an empty word, which is dropped.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    below = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(below[lists.offsets.to_numpy()])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``c``: lower-cased words and ends of all texts."""
    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        for batch in slices(batches, "text"):
            words, _ = lowered_words(batch.column("text"))
            held.append(pa.table(words.value_counts().flatten(), ["word", "c"]))
            ends += batch.num_rows
            if sum(part.num_rows for part in held) > 2 * COUNTED:
                held = [added(held)]
                if held[0].num_rows > COUNTED:
                    yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], ["word", "c"])

    return texts.mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sections(values: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """Blocks of rows of all tables, in order."""
    return [(name, start) for name, v in values.items() for start in range(0, len(v), BLOCK)]


def fit(numbered: DataFrame, layout: Layout, word_n: np.ndarray, shard: int = SHARD, passes: int = PASSES) -> Model:
    """The mean of the models that shards train on all trigrams of ``numbered(id, ids)``.

    A shard holds about ``shard`` tokens and trains ``passes`` over each chunk of them. Which documents it holds, and their
    order, follows from their ids alone. The driver gets one model.
    """
    shares, total = layout.shares(word_n), int(word_n.sum())
    start = Model.start(shares)
    if not total:
        return start
    shared = numbered.sparkSession.sparkContext.broadcast((start.values, layout, shares))  # 13 MB, and the words
    shards = max(1, round(total / shard))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, layout, shares = shared.value
        trainer, own = None, -1
        held, size, turn = [], 0, 0

        def chunk() -> None:
            trainer.train(np.concatenate([np.zeros(2, np.int32), *held]), passes, (SEED, own, turn))

        def sent() -> Iterator[pa.RecordBatch]:
            for block, (name, start) in enumerate(_sections(trainer.model.values)):
                value = trainer.model.values[name][start : start + BLOCK].astype(np.float64)
                weight = trainer.seen[name][start : start + BLOCK, None].astype(np.float64)
                if weight.any():
                    sums = np.column_stack([value * weight, weight]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([own % SALTS], pa.int32()), pa.array([sums.tobytes()], pa.binary()),
                         pa.array([own], pa.int32())], ["block", "salt", "sums", "shard"])

        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if shard != own:
                    if trainer and held:
                        chunk()
                        yield from sent()
                    trainer, own = Trainer(Model(values), layout, shares), shard
                    held, size, turn = [], 0, 0
                held.append(np.frombuffer(ids.as_buffer(), NUMBER).astype(np.int32))
                size += len(held[-1])
                if size >= CHUNK:
                    chunk()
                    held, size, turn = [held[-1][-1:]], 0, turn + 1  # an end, so that what is left is never empty
        if trainer and held:
            chunk()
            yield from sent()

    shard_of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    # by range: by hash, several shards would meet in one task
    dealt = numbered.withColumn("shard", shard_of).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "id", F.xxhash64("ids"))
    parts = dealt.select("shard", "ids").mapInArrow(trained, f"{SUMS}, shard int")
    out, sections = start.copy(), _sections(start.values)
    for row in added_blocks(parts, np.float32, ["shard"]).collect():  # one model
        name, first = sections[row["block"]]
        value = out.values[name]
        table = np.frombuffer(row["sums"], np.float32).reshape(-1, value.shape[1] + 1)
        met = table[:, -1] > 0
        value[first : first + len(table)][met] = table[met, :-1] / table[met, -1:]
    return out


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, shard: int = SHARD, passes: int = PASSES,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from all documents that aren't held out: counts of all words, and all trigrams, in
    which words beyond the vocabulary are those of their group. Scores cover whole texts and end with the end token.
    Null texts are empty ones, and score their end. Words that no training text has share the mass of one
    unknown word, in the base score and in their group. Null ids are held out. Every row is scored alone, so
    rows that repeat an id get a row each. Without training texts the classes are equally likely. Ties in
    frequency go to the smaller word. The model follows from the ids and texts, however the files are split.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = write_through(word_counts(rows.where(~held_out(F.col("id"))).select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(counts.where(F.col("word") != END), head)
    vocabulary = [row["word"].encode() for row in frequent[:VOCABULARY] if row["c"] >= LEAST_COUNT]
    layout, most = Layout(vocabulary), len(vocabulary)
    heads = [row["word"].encode() for row in frequent]
    c = np.array([row["c"] for row in frequent], np.float64)
    # words beyond the vocabulary are counted by group: all of the group, less the vocabulary
    by_group = counts.where(F.col("word") != END).groupBy(_group_column(F.col("word")).alias("g")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    rest_n, rest_v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for row in by_group:
        rest_n[row["g"]], rest_v[row["g"]] = row["n"], row["v"]
    ends = train_ends(counts) if total else 0
    of = np.array([group_of(word) - 1 - SINGLES for word in heads], np.int64)
    np.subtract.at(rest_n, of[:most], c[:most].astype(np.int64))
    np.subtract.at(rest_v, of[:most], 1)
    word_n = np.concatenate([[ends], c[:most], rest_n]).astype(np.int64)

    base_whole = total + ADDED * (distinct + 1)
    rest_whole = rest_n + ADDED * (rest_v + 1)
    base_log = lambda c: np.log10((c + ADDED) / base_whole)
    head_base = base_log(c) if len(c) else c
    head_own = np.where(np.arange(len(c)) < most, 0.0, np.log10((c + ADDED) / rest_whole[of])) if len(c) else c
    number = np.where(np.arange(len(c)) < most, 1 + np.arange(len(c)), layout.size + of).astype(np.int32)
    end_base, size = float(base_log(ends)), layout.size
    known_words = docs.sparkSession.sparkContext.broadcast((heads, number, head_base, head_own))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, number, head_base, head_own = known_words.value
        heads = pa.array(heads, pa.binary()).cast(pa.string())
        for batch in slices(batches, "text", SCORED_BYTES):
            words, sizes = lowered_words(batch.column("text"))
            of = np.repeat(np.arange(len(sizes)), sizes)  # the text of each word
            at = pc.fill_null(pc.index_in(words, heads), -1).to_numpy()
            known = at >= 0
            own, at = of[known], at[known]
            summed = lambda x: np.bincount(own, x, len(sizes))
            rare = words.filter(pa.array(~known)).dictionary_encode()
            code, names = rare.indices.to_numpy(), rare.dictionary
            groups = np.array([group_of(word) for word in names.cast(pa.binary()).to_pylist()], np.int32)
            row = np.zeros(len(words) + len(sizes), NUMBER)  # every text ends with an end
            place = np.arange(len(words)) + of
            row[place[known]] = number[at]
            row[place[~known]] = size + groups[code] - 1 - SINGLES
            pairs, times = np.unique(of[~known] * len(names) + code, return_counts=True)
            in_text, word = np.divmod(pairs, max(1, len(names)))
            found = pa.StructArray.from_arrays([names.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "times"])
            bounds = np.searchsorted(in_text, np.arange(len(sizes) + 1)).astype(np.int32)
            ends = np.append(0, np.cumsum((sizes + 1) * row.itemsize)).astype(np.int32)
            new = [
                pa.array(sizes + 1, pa.int64()), pa.array(np.bincount(own, minlength=len(sizes)) + (1 if total else 0), pa.int64()),
                pa.array(summed(head_base[at]) + end_base, pa.float64()), pa.array(summed(head_own[at]), pa.float64()), pa.ListArray.from_arrays(pa.array(bounds), found),
                pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(row)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *new], ["id", *PARTIAL])

    schema = T.StructType([rows.schema["id"], *(
        T.StructField(n, t) for n, t in (
            ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("own", T.DoubleType()),
            ("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.LongType())]))),
            ("ids", T.BinaryType()),
        ))])
    partial = write_through(rows.mapInArrow(turned, schema).withColumn("row", F.monotonically_increasing_id()))
    model = fit(partial.where(~held_out(F.col("id"))).select("id", "ids"), layout, word_n, shard, passes)
    shared = docs.sparkSession.sparkContext.broadcast((model.values, layout))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, layout = shared.value
        scorer = Scorer(Model(values), layout)
        for batch in slices(batches, "ids", NUMBER().nbytes * SCORED):
            lists = [np.frombuffer(ids.as_buffer(), NUMBER) for ids in batch.column("ids")]
            found = scorer.log10_tokens(*trigrams(np.concatenate([np.zeros(2, NUMBER), *lists]).astype(np.int32)))
            starts = np.cumsum([0, *(len(ids) for ids in lists[:-1])])
            own = batch.column("own").to_numpy() + np.add.reduceat(found, starts)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in KEPT] + [pa.array(own)], [*KEPT, "own"])

    whole_rows = partial.select(*KEPT, "own", "ids").mapInArrow(
        scored, T.StructType([*(partial.schema[n] for n in KEPT), T.StructField("own", T.DoubleType())]))
    rare = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    counted = rare.join(counts, "word", "left").select(
        "row", "times", F.coalesce("c", F.lit(0)).alias("c"), _group_column(F.col("word")).alias("g"))
    whole = F.element_at(F.lit([float(x) for x in rest_whole]), F.col("g") + 1)
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.col("c") + ADDED) / F.lit(float(base_whole)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + ADDED) / whole)).alias("more_own"),
    )
    joined = whole_rows.join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens",
        add("n_known", "known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        add("base", "more_base").alias("base_score"), add("own", "more_own").alias("score"),
    )


def train_ends(counts: DataFrame) -> int:
    return counts.where(F.col("word") == END).first()["c"]


PARTIAL = {
    "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "own": pa.float64(),
    "rare": pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])), "ids": pa.binary(),
}
KEPT = ["row", "id", "n_tokens", "n_known", "base"]
