"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing: every row of a hashed vocabulary has a sparse random index vector, and its word vector is the sum of the
index vectors of its neighbours in all texts. Tasks add up what they read and Spark adds up the tasks, so the vectors
cover the whole corpus in one pass and bounded memory. A document is the weighted mean and deviation of its word vectors, and the
mean products of its index vectors with their neighbours and with all others, which tell repeated words. The
network is trained on labelled documents, and its logits are divided by a temperature fitted to others of them.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.llm.common import SUMS, added_blocks, byte_texts, slices, sums_batch
from paperloom.session import write_through

# fixed values of the split and the verdict
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: hashed vocabulary, width and non-zero components of index vectors, neighbours on each side
ROWS, WIDTH, NONZERO, WINDOW = 1 << 15, 32, 2, 2
#: tokens counted at once, rows of the vocabulary that travel together, first sums per block
CHUNK, BLOCK, SALTS = 500_000, 512, 64
#: words remembered by a task
KNOWN = 200_000
#: weight of a word of share p: SMOOTH / (SMOOTH + p)
SMOOTH = 1e-3
#: network: hidden units, passes, examples per step, rate, decay; every CALIBRATION-th labelled document sets the temperature
HIDDEN, PASSES, BATCH, RATE, DECAY, CALIBRATION = 32, 30, 128, 3e-3, 1e-4, 5
SEED = 17
#: values of a pooled document: mean, deviation, products with the next, the next but one and any other word
POOLED = 2 * WIDTH + 3
#: characters of a word by kind, for its shape; runs of a kind count once
_KINDS = bytes(
    0x78 if 97 <= b <= 122 or b >= 128 else 0x58 if 65 <= b <= 90 else 0x39 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of every row; row 0 parts texts and has none."""
    rng = np.random.default_rng(SEED)
    places = rng.random((ROWS, WIDTH)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (ROWS, NONZERO))
    signs[0] = 0
    return places.astype(np.int64), signs


class Rows:
    """Two rows for a word: one for itself without regard to case, one for its shape."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for word in set(words).difference(known):
            shape = _RUNS.sub(rb"\1", word.translate(_KINDS))
            known[word] = (1 + zlib.crc32(word.lower()) % (ROWS - 1), 1 + zlib.crc32(b"\0" + shape) % (ROWS - 1))
        return np.array([known[w] for w in words], np.int64).reshape(-1)


def neighbour_sums(tokens: np.ndarray, places: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the sum of the index vectors of its neighbours, and how often it occurs."""
    sums = np.zeros(ROWS * WIDTH)
    base = tokens * WIDTH
    for step in range(1, WINDOW + 1):
        for here, there in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            other = tokens[there]
            for k in range(NONZERO):
                sums += np.bincount(base[here] + places[other, k], signs[other, k], ROWS * WIDTH)
    return sums.reshape(ROWS, WIDTH), np.bincount(tokens, minlength=ROWS)


def word_vectors(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors less their mean, and a weight, for every row of the vocabulary.

    Each task sends its sums in blocks; they are added in two steps, so that no task adds more than a share of them.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, counts = np.zeros((ROWS, WIDTH)), np.zeros(ROWS, np.int64)
        rows, held, size = Rows(), [], 0

        def chunk() -> None:
            more, n = neighbour_sums(np.concatenate(held), places, signs)
            np.add(sums, more, out=sums)
            np.add(counts, n, out=counts)

        gap = np.zeros(WINDOW, np.int64)
        for batch in slices(batches, "text"):
            for text in byte_texts(batch.column("text")):
                held += [rows.of(text.split()), gap]
                size += len(held[-2]) + WINDOW
                if size >= CHUNK:
                    chunk()
                    held, size = [], 0
        if held:
            chunk()
        whole = np.column_stack([counts, sums.astype(np.int64)])
        salt = TaskContext.get().partitionId() % SALTS
        for block in range(ROWS // BLOCK):
            part = whole[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield sums_batch(block, salt, part)

    whole = np.zeros((ROWS, WIDTH + 1))
    for row in added_blocks(texts.mapInArrow(counted, SUMS), np.int64, []).collect():  # the vocabulary's rows, whatever the corpus
        whole[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(BLOCK, -1)
    counts, sums = whole[:, 0].copy(), whole[:, 1:]
    counts[0] = 0
    shares = counts / max(1.0, counts.sum())
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    vectors -= shares @ vectors
    vectors[0] = 0
    return vectors.astype(np.float32), (SMOOTH / (SMOOTH + shares)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``pooled``: weighted mean and deviation of the word vectors of a text, zeros for one without words.

    The mean product of two words' index vectors, of length one, is how often the words are equal, but for a chance that all
    texts share; so equal rows are counted instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weights))  # 4 MB

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights = shared.value
        rows = Rows()
        for batch in slices(batches, "text"):
            out = np.zeros((batch.num_rows, POOLED), np.float32)
            for k, text in enumerate(byte_texts(batch.column("text"))):
                tokens = rows.of(text.split())
                found, n = np.unique(tokens, return_counts=True)
                if len(found):
                    own = tokens[::2]  # without shapes
                    same = np.unique(own, return_counts=True)[1] / len(own)
                    products = [np.mean(own[:-step] == own[step:]) if len(own) > step else 0 for step in (1, 2)]
                    w = weights[found] * n
                    w /= w.sum()
                    mean = w @ vectors[found]
                    deviation = np.sqrt(np.maximum(w @ vectors[found] ** 2 - mean**2, 0))
                    out[k] = np.concatenate([mean, deviation, products, [same @ same]])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * POOLED), pa.array(out.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "pooled"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("pooled", T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(mapped, schema)


class Network:
    """Standardised inputs, one hidden layer, one logit; probabilities at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        share = np.clip(y.mean(), 0.01, 0.99)
        self.params = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.array([np.log(share / (1 - share))])]
        self.temperature = 1.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.params[0] + self.params[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (self._hidden(x) @ self.params[2])[:, 0] + self.params[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(SEED + 1)
        first, second = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(len(x))
            for start in range(0, len(x), BATCH):
                at = order[start : start + BATCH]
                inputs = np.clip((x[at] - self.mean) / self.scale, -8, 8)
                hidden = np.tanh(inputs @ self.params[0] + self.params[1])
                error = (_sigmoid((hidden @ self.params[2])[:, 0] + self.params[3][0]) - y[at])[:, None] / len(at)
                back = error @ self.params[2].T * (1 - hidden**2)
                grads = [inputs.T @ back + DECAY * self.params[0], back.sum(0), hidden.T @ error + DECAY * self.params[2], error.sum(0)]
                step += 1
                for p, g, m, v in zip(self.params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross-entropy."""
        logits = self.logits(x)
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y * logits / t)
        self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fitted(x: np.ndarray, y: np.ndarray) -> Network | None:
    """A network trained on most rows and calibrated on the others; none without rows."""
    if not len(x):
        return None
    aside = np.arange(len(x)) % CALIBRATION == 0 if len(x) >= 2 * CALIBRATION else np.zeros(len(x), bool)
    made = Network(x[~aside], y[~aside])
    made.train(x[~aside], y[~aside])
    if aside.any():
        made.calibrate(x[aside], y[aside])
    return made


def score(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = 20_000, threshold: float = THRESHOLD,
) -> DataFrame:
    """id, ``held_out``, ``score`` (probability of label 1, calibrated) and ``predicted`` of every document.

    Word vectors come from all texts; labels only from documents that aren't held out, ``fit_rows`` of them at most: those
    with the smallest hash of their id (a fifth of them sets the temperature). Only the text is an input of a score.

    Null and empty texts have the zero vector and are scored like any other. Null ids are held out; rows that repeat an id get
    a row each. Labels that are null, or without an id or document, teach nothing; several labels of a document count by their
    mean. Without labels every score is 0.5. An empty table gives no rows. Further columns change nothing.
    """
    vectors, weights = word_vectors(docs.select(F.col(text_col).alias("text")))
    rows = write_through(pooled(docs, vectors, weights, id_col, text_col))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("of")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    order = F.md5(F.concat(F.lit(f"{SEED}|"), F.col("id").cast("string")))
    known = rows.join(marks, F.col("id") == F.col("of")).select("pooled", "y", order.alias("order"))
    sample = known.orderBy("order", "pooled").limit(fit_rows).toArrow()
    x = sample.column("pooled").combine_chunks().flatten().to_numpy().reshape(-1, POOLED).astype(np.float64)
    network = fitted(x, sample.column("y").to_numpy())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("pooled").flatten().to_numpy().reshape(-1, POOLED).astype(np.float64)
            found = np.full(len(x), 0.5) if network is None else network.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "score"])

    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(scored, schema).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
