"""License detections: ordered hand-written signature rules behind keyword gates, overlaps resolved by priority."""

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from paperloom.llm.common import byte_texts, free_name, slices
from paperloom.llm.license_rules import BARE, NAMES, NOTICES, SHORT, VERSIONED as VERSIONED_NAMES

# fixed values: phrases and their labels
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: what comes before a bare name, and what joins names in an expression
CONTEXT = re.compile(
    rb" (?:(?P<tag>spdx licen[cs]e identifier)"
    rb"|licen[cs](?:es?|ing)(?: (?:type|name|id|identifier|expression|key|is|are|under|osi approved|spdx))*"
    rb"|licen[cs]ed (?:under|with|as)|(?:released|distributed|available|published|provided|covered) under)"
    rb"(?: (?:the|a|either|both|terms of|conditions of|terms and conditions of))*(?= )")
JOINT = re.compile(rb"(?: (?:and or|or|and|with))?(?: the)?(?= )")
#: a full name after these words is a grant
GRANT = re.compile(
    rb" (?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:under|with)"
    rb"(?: the)?(?: terms(?: and conditions)? of)?(?: the)?$")
GRANT_REACH = 80
#: a bare name before these is part of a full name, which has rules of its own
FULL_NAME = r"(?! (?:software )?licen[cs]e)"

#: (priority, confidence) by place: a tag, a field or grant, a sentence, a versioned name, a plain one
TAG, FIELD, NOTICE, VERSIONED, PLAIN = (4, 1.0), (3, 0.95), (3, 0.8), (2, 0.85), (1, 0.6)
GRANTED = {VERSIONED: (3, 0.95), PLAIN: (3, 0.9)}
BASE_CONFIDENCE = 0.6


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    rank: tuple[int, float]

    @property
    def signature(self) -> re.Pattern:
        return re.compile(f" {_spelled(self.pattern)}(?= )".encode())


def _spelled(pattern: str) -> str:
    return f"(?:{pattern})".replace("LIC", "licen[cs]e").replace("VER", "(?:version |ver |v |v)?")


def _table(text: str, rank: tuple[int, float]) -> list[Rule]:
    lines = (line.split("  ", 2) for line in text.strip().splitlines())
    return [Rule(label, tuple(words.split(",")), pattern, rank) for label, words, pattern in lines]


class Signatures(NamedTuple):
    rules: list[Rule]
    patterns: list[re.Pattern]
    #: word -> rules whose matches hold it or another of their keywords
    gates: dict[bytes, list[int]]
    #: names of an expression as one pattern, and their rules
    operand: re.Pattern
    operands: list[Rule]


@cache
def signatures() -> Signatures:
    """All rules in order, compiled, with their keyword gates."""
    short, bare = _table(SHORT, VERSIONED), _table(BARE, FIELD)
    ordered = [*_table(NOTICES, NOTICE), *_table(VERSIONED_NAMES, VERSIONED), *short, *_table(NAMES, PLAIN)]
    gates: dict[bytes, list[int]] = {}
    for number, rule in enumerate(ordered):
        for word in rule.keywords:
            gates.setdefault(word.encode(), []).append(number)
    for rule in bare:  # no signature of their own, but their words open the gate
        for word in rule.keywords:
            gates.setdefault(word.encode(), [])
    either = "|".join(
        [f"({_spelled(r.pattern)}(?= ))" for r in short] + [f"({_spelled(r.pattern)}(?= ){FULL_NAME})" for r in bare])
    return Signatures(
        ordered, [r.signature for r in ordered], gates, re.compile(f" (?:{either})".encode()), short + bare)


def _expressions(joined: bytes) -> Iterator[tuple[int, int, Rule]]:
    """Names behind a tag, a field or a grant, one after another as far as they are joined."""
    known = signatures()
    for context in CONTEXT.finditer(joined):
        rank = TAG if context["tag"] else FIELD
        start, at = context.start() + 1, context.end()
        while name := known.operand.match(joined, at):
            yield start, name.end(), known.operands[name.lastindex - 1]._replace(rank=rank)
            joint = JOINT.match(joined, name.end())
            if not joint:
                break
            at = joint.end()
            start = at + 1


#: A-Z to a-z, and everything that is no word character to a blank; other bytes are word characters
FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split(b" ")


def _surviving(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Drop detections (priority, start, end, rule) that lie within one of higher priority, or within a
    longer or earlier-listed one of the same; n log n."""
    kept: list[tuple[int, int, int, int]] = []
    for level in sorted({x[0] for x in found}, reverse=True):
        higher = sorted((s, e) for _, s, e, _ in kept)
        starts, ends = [s for s, _ in higher], list(accumulate((e for _, e in higher), max))
        reach = -1
        for one in sorted((x for x in found if x[0] == level), key=lambda x: (x[1], -x[2], x[3])):
            _, start, end, _ = one
            before = bisect_right(starts, start)
            if end > reach and not (before and ends[before - 1] >= end):
                kept.append(one)
            reach = max(reach, end)
    return sorted(kept, key=lambda x: (x[1], x[2], x[3]))


def detect(text: bytes) -> dict:
    """All detections in one text: n_words, base places and labels, spans in words, labels, score."""
    words = [w for w in folded_words(text) if w]
    joined = b" " + b" ".join(words) + b" "
    out = {"n_words": len(words), "places": [], "base_labels": [], "spans": [], "labels": [], "score": 0.0}
    known = signatures()
    gates = known.gates.keys() & words
    if not gates:
        return out
    offsets: list[int] = []

    def word_at(offset: int) -> int:
        if not offsets:
            offsets.extend(accumulate((len(w) + 1 for w in words), initial=1))
        return bisect_right(offsets, offset) - 1

    base = set()
    for phrase, label in BASE.items():
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            out["places"].append(word_at(at + 1))
            base.add(label)
            at = joined.find(b" " + phrase + b" ", at + 1)
    chosen: list[Rule] = []
    found = []

    def add(start: int, end: int, rule: Rule) -> None:
        found.append((rule.rank[0], word_at(start), word_at(end - 1) + 1, len(chosen)))
        chosen.append(rule)

    for number in sorted({n for gate in gates for n in known.gates[gate]}):
        rule = known.rules[number]
        for match in known.patterns[number].finditer(joined):
            start = match.start() + 1
            granted = rule.rank in GRANTED and GRANT.search(joined[max(0, start - GRANT_REACH) : start - 1])
            add(start, match.end(), rule._replace(rank=GRANTED[rule.rank]) if granted else rule)
    for one in _expressions(joined):
        add(*one)
    kept = [(start, end, chosen[k]) for _, start, end, k in _surviving(found)]
    out["places"].sort()
    out["base_labels"] = sorted(base)
    out["spans"] = [{"first": s, "last": e - 1, "label": r.label, "confidence": r.rank[1]} for s, e, r in kept]
    out["labels"] = sorted(base | {r.label for _, _, r in kept})
    out["score"] = max([BASE_CONFIDENCE] * bool(base) + [r.rank[1] for _, _, r in kept], default=0.0)
    return out


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()),
    ]))),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
])
ARROW = pa.struct([
    ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([
        ("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))),
    ("labels", pa.list_(pa.string())), ("score", pa.float64()),
])


def scan(docs: DataFrame, *, text_col: str = "text", out: str = "license") -> DataFrame:
    """Add a struct ``out`` with the detections of each text; no shuffle.

    Words are runs of ASCII letters, digits and all characters past ASCII, A-Z lower-cased. A null
    or empty text has no words and no detections. Ties go to the rule that stands first. Rows are
    judged alone, so repeated rows get equal results; an empty table stays empty.
    """
    name = free_name(docs, out)

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            new = pa.array([detect(t) for t in byte_texts(batch.column(text_col))], ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, name])

    return docs.mapInArrow(detected, T.StructType([*docs.schema.fields, T.StructField(name, RESULT)]))
