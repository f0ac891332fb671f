"""Secrets in texts, and weak parts of credentials linked by their places."""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.llm.common import free_name, slices

# fixed values: patterns of the base kinds. ASCII letters only fold, and runs are taken whole
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "identifier", "credential", "endpoint"]

#: weak parts: each is common in harmless texts and is reported only beside its complements
IDENTIFIER = re.compile(
    r"""(?ai:\b(?:user(?:_?name)?|login|client_?id|account(?:_?(?:id|name))?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}))""")
CREDENTIAL = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9]{8,}|[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"""(?ai:\b[a-z][a-z0-9+.-]{0,20}://[^\s"'<>]+|\b(?:host(?:name)?|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,})""")
SCOPE_BREAK = re.compile(r"\n[\x20\t\r]*\n")
#: parts of one credential lie at most this many characters apart, in one paragraph
REACH = 400
#: a hex run counts as a credential from this length on, a shorter one if it has letters and digits
HEX_CREDENTIAL = 32
#: letters alone count as a credential from this length on, which words hardly reach
LETTERS_CREDENTIAL = 24


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _keylike(value: str) -> bool:
    """Letters and digits of any case, or a long run of letters, so that words and numbers aren't taken for keys."""
    letters = any(c.isalpha() for c in value)
    return letters and any(c.isdigit() for c in value) or len(value) >= LETTERS_CREDENTIAL and value.isalpha()


class Neighbours:
    """Sorted intervals; answers whether one lies within ``REACH`` of another, in the same scope."""

    def __init__(self, spans: list[Span], scopes: list[int]):
        self.scopes = scopes
        self.spans = sorted((bisect_right(scopes, s.start), s.start, s.end) for s in spans)
        self.keys = [(scope, start) for scope, start, _ in self.spans]
        # furthest end so far within a scope
        self.ends = [e for _, e in accumulate(
            ((scope, end) for scope, _, end in self.spans),
            lambda a, b: (b[0], max(a[1], b[1])) if a[0] == b[0] else b)]

    def near(self, span: Span) -> bool:
        scope = bisect_right(self.scopes, span.start)
        after = bisect_left(self.keys, (scope, span.start))
        if after < len(self.keys) and self.keys[after][0] == scope and self.keys[after][1] - span.end <= REACH:
            return True
        return after > 0 and self.keys[after - 1][0] == scope and span.start - self.ends[after - 1] <= REACH


def _inside(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap no span taken; both sides are swept in order."""
    ordered = sorted((s.start, s.end) for s in taken)
    starts, ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    free = []
    for span in spans:
        before = bisect_left(starts, span.end)
        if not (before and ends[before - 1] > span.start):
            free.append(span)
    return free


def find_spans(text: str) -> list[Span]:
    """Base spans and linked weak parts, by start, then kind.

    A weak identifier needs a credential, a weak credential an identifier, an endpoint both, each
    within ``REACH`` in the same paragraph. An assigned value under the base length is a weak
    credential too, for which an endpoint is enough, as its name tells what it is; an access key id is
    no complement of it, as its secret is long. Intervals are joined by sorted lookups, so a text
    with many parts costs n log n.
    """
    strong = base_spans(text)
    access = [s for s in strong if s.kind == 1]
    weak_ids, short = [], []
    if "=" in text or ":" in text:
        short = _inside([
            Span(m.start(), 4, m.end()) for m in ASSIGN.finditer(text)
            if len(m[2]) < LEAST_ASSIGN and any(c.isalnum() for c in m[2])], strong)
        weak_ids = _inside([Span(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)], strong + short)
    if access or weak_ids or short:
        scopes = [m.end() for m in SCOPE_BREAK.finditer(text)]
        keys = [s for s in strong if s.kind == 0 or s.kind == 2 and (
            s.end - s.start >= HEX_CREDENTIAL or _keylike(text[s.start : s.end]))]
        weak_keys = _inside(
            [Span(m.start(), 4, m.end()) for m in CREDENTIAL.finditer(text) if _keylike(m[0])], strong + weak_ids + short)
        ids, credentials = Neighbours(access + weak_ids, scopes), Neighbours(keys + weak_keys + short, scopes)
        places = _inside([Span(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)], strong)
        beside = Neighbours(weak_ids + places, scopes)
        strong += [s for s in weak_ids if credentials.near(s)]
        strong += [s for s in weak_keys if ids.near(s)]
        strong += [s for s in short if beside.near(s)]
        strong += [s for s in places if ids.near(s) and credentials.near(s)]
    return sorted(strong)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()),
]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def scan(docs: DataFrame, *, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add an array ``out`` of (start, kind, end) in code points; no shuffle.

    Null and empty texts have none. Spans of different kinds may overlap; equal starts are ordered
    as ``KINDS``. Rows are scanned alone and whole; an empty table stays empty.
    """
    name = free_name(docs, out)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = [
                [{"start": s.start, "kind": KINDS[s.kind], "end": s.end} for s in find_spans(text or "")]
                for text in batch.column(text_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, ARROW_SPANS)], [*batch.schema.names, name])

    return docs.mapInArrow(found, T.StructType([*docs.schema.fields, T.StructField(name, SPANS)]))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with the secrets replaced in the text, and its new length if there is a column for it."""
    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            old = batch.column(text_col).to_pylist()
            new = [None if t is None else redacted(t, s) if (s := find_spans(t)) else t for t in old]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(new, columns[text_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    cleaned = docs.mapInArrow(replaced, docs.schema)
    if length_col in docs.columns:
        return cleaned.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return cleaned


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
