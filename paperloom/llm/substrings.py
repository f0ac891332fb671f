"""Repeated passages: rolling hashes of every window of words, counted over all documents."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from paperloom.llm.common import byte_texts, free_name, slices
from paperloom.session import write_through

WINDOW = 20
#: odd factors of the two rolling hashes, modulo 2**64
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: words whose windows a task compares itself before it sends one of each
CHUNK_WORDS = 1_000_000
#: text bytes behind one bucket of window hashes, about two and a half million windows
BUCKET_BYTES = 16 << 20
#: buckets have a task each up to this many; beyond it, tasks take several buckets, one after another
MOST_TASKS = 100_000
#: word hashes a worker remembers
WORD_MEMORY = 400_000
#: the first hash travels whole, with 8 bits of the second from this one on, whose upper bits pick the bucket
CHECK_SHIFT = 8


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Rabin-Karp hashes of all windows of a sequence of word hashes, modulo 2**64."""

    def __init__(self, factor: int, window: int):
        self.factor, self.window = factor, window
        self.up, self.down = _powers(factor, 0), _powers(factor, 0)

    def roll(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(self.factor, n), _powers(pow(self.factor, -1, 1 << 64), n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], dtype=np.uint64, out=sums[1:])
        return (sums[self.window :] - sums[: -self.window]) * self.down[: n - self.window + 1]


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > WORD_MEMORY:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def tag_of(text: bytes) -> int:
    return zlib.crc32(text)


#: windows for their bucket, or runs for their slice of the documents (``part``), packed
SENT_TYPES = pa.schema([
    ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("docs", pa.int32()),
    ("hashes", pa.binary()), ("places", pa.binary()),
])
SENT_SCHEMA = "bucket int, part int, n int, docs int, hashes binary, places binary"


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(FACTORS[1])
    return (((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _packed_runs(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    """Runs of window starts, input ordered by id, tag and position: one row per slice of the documents."""
    doc = np.cumsum(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) if len(ids) else ids
    new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)) if len(ids) else np.empty(0, bool)
    at = np.flatnonzero(new)
    count, part = np.diff(np.append(at, len(ids))), _part_of(ids[at], parts)
    order = np.argsort(part, kind="stable")
    rows = []
    for one in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(one):
            own, runs = doc[at[one]], len(one)
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            of = at[one[heads]]
            places = b"".join((
                np.diff(ids[of], prepend=0).astype("<i8").tobytes(), tags[of].astype("<u4").tobytes(),
                np.diff(np.append(heads, runs)).astype("<i4").tobytes(),
                pos[at[one]].astype("<i4").tobytes(), count[one].astype("<i4").tobytes(),
            ))
            rows.append((int(part[one[0]]), runs, len(heads), pa.compress(places, "zstd", asbytes=True)))
    return _batch(len(rows), **{
        c: pa.array([row[k] for row in rows], SENT_TYPES.field(c).type) for k, c in enumerate(("part", "n", "docs", "places"))})


def _unpacked_runs(n: int, docs: int, places: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(places, 16 * docs + 8 * n, "zstd", asbytes=True)
    counts = np.frombuffer(raw, "<i4", docs, 12 * docs)
    ids = np.cumsum(np.frombuffer(raw, "<i8", docs))
    tags = np.frombuffer(raw, "<u4", docs, 8 * docs).astype(np.int64)
    first, count = (np.frombuffer(raw, "<i4", n, 16 * docs + k * 4 * n) for k in (0, 1))
    return np.repeat(ids, counts), np.repeat(tags, counts), first, count


def _batch(length: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in SENT_TYPES], schema=SENT_TYPES)


class Chunk:
    """Documents of one task, gathered up to ``CHUNK_WORDS`` words."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.rollers = [Roller(f, window) for f in FACTORS]
        self.hashes = WordHashes()
        self.clear()

    def clear(self) -> None:
        self.docs: dict[tuple[int, int], np.ndarray] = {}
        self.words = 0

    def add(self, doc_id: int, text: bytes) -> None:
        words = text.split()
        if len(words) >= self.window:
            key = (doc_id, tag_of(text))
            if key not in self.docs:  # rows that repeat a document send nothing new
                self.docs[key] = self.hashes.of(words)
                self.words += len(words)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """What earlier windows of the chunk repeat, as runs; and one of each window, by bucket."""
        if not self.docs:
            return
        keys = sorted(self.docs)
        ids, tags = (np.array([k[x] for k in keys], np.int64) for x in (0, 1))
        sizes = np.array([len(self.docs[k]) for k in keys], np.int64)
        words = np.concatenate([self.docs[k] for k in keys])
        starts = np.cumsum(sizes) - sizes
        self.clear()
        doc = np.repeat(np.arange(len(keys)), sizes - (self.window - 1))
        windows = sizes - (self.window - 1)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = starts[doc] + pos
        low, high = (r.roll(words)[at] for r in self.rollers)
        bucket = (((high >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)
        again = repeated(low, high, ids[doc], pos, ordered=len(np.unique(ids)) == len(ids))
        yield _packed_runs(ids[doc[again]], tags[doc[again]], pos[again], self.buckets)
        send = np.flatnonzero(~again)
        send = send[np.argsort(bucket[send].astype(np.uint32), kind="stable")]
        edges = np.flatnonzero(np.diff(bucket[send])) + 1
        check = (high >> np.uint64(CHECK_SHIFT)).astype(np.uint8)
        rows = [self._packed(part, bucket, low, check, doc, pos, ids, tags) for part in np.split(send, edges) if len(part)]
        columns = dict(zip(("bucket", "n", "docs", "hashes", "places"), zip(*rows, strict=True), strict=True))
        yield _batch(len(rows), **{c: pa.array(v, SENT_TYPES.field(c).type) for c, v in columns.items()})

    @staticmethod
    def _packed(part, bucket, low, check, doc, pos, ids, tags) -> tuple:
        """One bucket's windows: hashes, and documents with counts and position steps, compressed."""
        own, place = doc[part], pos[part]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        steps = np.diff(place, prepend=0)
        steps[heads] = place[heads]
        of = own[heads]
        places = b"".join((
            np.diff(ids[of], prepend=0).astype("<i8").tobytes(), tags[of].astype("<u4").tobytes(),
            np.diff(np.append(heads, len(own))).astype("<i4").tobytes(), steps.astype("<i4").tobytes(),
        ))
        hashes = low[part].astype("<u8").tobytes() + check[part].tobytes()
        return int(bucket[part[0]]), len(part), len(of), hashes, pa.compress(places, "zstd", asbytes=True)


def _unpacked(n: int, docs: int, hashes: bytes, places: bytes) -> tuple[np.ndarray, ...]:
    low, check = np.frombuffer(hashes, "<u8", n), np.frombuffer(hashes, np.uint8, n, 8 * n)
    raw = pa.decompress(places, 16 * docs + 4 * n, "zstd", asbytes=True)
    ids = np.cumsum(np.frombuffer(raw, "<i8", docs))
    tags = np.frombuffer(raw, "<u4", docs, 8 * docs).astype(np.int64)
    counts = np.frombuffer(raw, "<i4", docs, 12 * docs)
    steps = np.frombuffer(raw, "<i4", n, 16 * docs).astype(np.int64)
    heads = np.cumsum(counts) - counts
    sums = np.cumsum(steps)
    pos = sums - np.repeat(sums[heads] - steps[heads], counts)
    return low, check, np.repeat(ids, counts), np.repeat(tags, counts), pos.astype(np.int32)


def repeated(low: np.ndarray, high: np.ndarray, ids: np.ndarray, pos: np.ndarray, ordered: bool) -> np.ndarray:
    """Which windows start after another of equal hashes, by id, then position. ``ordered``: rows come so."""
    order = np.argsort(low, kind="stable")
    same = low[order[1:]] == low[order[:-1]]
    if (same & (high[order[1:]] != high[order[:-1]])).any():
        # windows are equal only if both hashes are; stable, so rows of one group stay in order
        order = np.lexsort((low, high))
        same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    out = np.zeros(len(low), bool)
    if ordered:
        out[order[1:][same]] = True
        return out
    several = np.zeros(len(low), bool)
    several[1:] |= same
    several[:-1] |= same
    group = np.cumsum(np.append(True, ~same))[several]
    rows = order[several]
    by = np.lexsort((pos[rows], ids[rows], group))
    group, rows = group[by], rows[by]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    head = rows[np.repeat(heads, np.diff(np.append(heads, len(rows))))]
    out[rows] = (ids[rows] != ids[head]) | (pos[rows] != pos[head])
    return out


def _bucket_runs(table: pa.Table, parts: int) -> pa.Table:
    """Runs of repeated windows in one bucket, packed by slice of the documents."""
    rows = [table.column(c).to_pylist() for c in ("n", "docs", "hashes", "places")]
    low, check, ids, tags, pos = (np.concatenate(v) for v in zip(*(_unpacked(*r) for r in zip(*rows, strict=True)), strict=True))
    del rows
    again = np.flatnonzero(repeated(low, check, ids, pos, ordered=False))
    by = again[np.lexsort((pos[again], tags[again], ids[again]))]
    return pa.Table.from_batches([_packed_runs(ids[by], tags[by], pos[by], parts)])


def _document_runs(table: pa.Table) -> pa.Table:
    """One row per document of a slice, with all its runs."""
    rows = zip(*(table.column(c).to_pylist() for c in ("n", "docs", "places")), strict=True)
    ids, tags, first, count = (np.concatenate(v) for v in zip(*(_unpacked_runs(*r) for r in rows), strict=True))
    by = np.lexsort((first, tags, ids))
    ids, tags, first, count = ids[by], tags[by], first[by], count[by]
    heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))
    offsets = pa.array(np.append(heads, len(ids)).astype(np.int32))
    runs = pa.StructArray.from_arrays([pa.array(first), pa.array(count)], ["first", "count"])
    return pa.table({"doc_id": ids[heads], "tag": tags[heads], "runs": pa.ListArray.from_arrays(offsets, runs)})


def repeated_runs(docs: DataFrame, *, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """doc_id, tag and ``runs`` (first, count) of starts of repeated windows, one row per document that has some.

    A task compares the windows of a million words itself and sends one of each, so a passage in
    a third of all documents reaches its bucket once per chunk. A window travels as 9 bytes of
    two rolling hashes, in a bucket that the second one picks, and its place in about two bytes. Both
    hashes must agree. Buckets and the tasks that take them grow in number with the text, so that one holds
    some two and a half million windows. What a bucket or a chunk finds
    goes back as one row per slice of the documents, and there are as many slices as buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-size // BUCKET_BYTES))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(buckets, window)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                if doc_id is not None:
                    chunk.add(doc_id, text)
                    if chunk.words >= CHUNK_WORDS:
                        yield from chunk.sent()
        yield from chunk.sent()

    def judged(table: pa.Table) -> pa.Table:
        # negative keys hold runs found within chunks, which pass
        return table.drop_columns("by") if table.column("bucket")[0].as_py() is None else _bucket_runs(table, buckets)

    key = F.coalesce(F.col("bucket"), F.lit(-1) - F.col("part"))
    tasks = min(buckets, MOST_TASKS)
    windows = rows.mapInArrow(sent, SENT_SCHEMA).withColumn("by", key).repartition(tasks, "by")
    runs = windows.groupBy("by").applyInArrow(judged, SENT_SCHEMA)
    return runs.repartition(tasks, "part").groupBy("part").applyInArrow(
        _document_runs, "doc_id long, tag long, runs array<struct<first: int, count: int>>")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_words, n_removed, ``removed`` (maximal word intervals, end exclusive) and ``kept_text``.

    A word goes if a window of ``window`` words that covers it has the same words as one that starts
    earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the
    input. Null texts have no words. Rows without an id are left whole and remove nothing elsewhere.
    Rows that repeat an id are one document: an equal row is no earlier one.
    """
    runs = write_through(repeated_runs(docs, id_col=id_col, text_col=text_col, window=window))
    names = {c: free_name(docs, c) for c in ("doc_id_", "tag_", "runs_", "own_tag")}
    found = runs.select(*(F.col(c).alias(names[n]) for c, n in (("doc_id", "doc_id_"), ("tag", "tag_"), ("runs", "runs_"))))
    tag = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.withColumn(names["own_tag"], tag).join(
        found, (docs[id_col].cast("long") == F.col(names["doc_id_"])) & (F.col(names["own_tag"]) == F.col(names["tag_"])), "left",
    ).drop(names["doc_id_"], names["tag_"], names["own_tag"])
    outs = [free_name(docs, c) for c in ("n_words", "n_removed", "removed", "kept_text")]
    held = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, text_col):
            rows = [
                removed_words(text, runs, window)
                for text, runs in zip(byte_texts(batch.column(text_col)), batch.column(names["runs_"]).to_pylist(), strict=True)
            ]
            n, gone, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in held), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, kind), pa.array(kept, pa.string())], [*held, *outs])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    types = [T.LongType(), T.LongType(), span, T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(outs, types, strict=True))])
    return joined.mapInArrow(cut, schema)


def removed_words(text: bytes, runs: list[dict] | None, window: int) -> tuple[int, int, list[dict], str]:
    """Number of words, of removed ones, maximal removed intervals, and the rest."""
    words = text.split()
    if not runs:
        return len(words), 0, [], b" ".join(words).decode()
    steps = np.zeros(len(words) + 1, np.int64)
    first = np.array([r["first"] for r in runs])
    np.add.at(steps, first, 1)
    np.add.at(steps, first + np.array([r["count"] for r in runs]) + window - 1, -1)
    covered = np.cumsum(steps)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    spans = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
    kept = b" ".join([words[k] for k in np.flatnonzero(~covered)])
    return len(words), int(covered.sum()), spans, kept.decode()
