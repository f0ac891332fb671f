"""SentencePiece encoding and decoding of whole texts by forward passes that words with equal beginnings share.

A text is cut into marked words: the mark that stands for a blank opens a word. Distinct words
of a batch are sorted, which lists the paths of their trie depth-first; the forward states of the
characters that a word shares with the one before it are kept, the others computed.

Unigram models: the state of a prefix is its best score and the piece that ends it (Viterbi).
BPE models: merging is no best sum of scores, but a piece sequence is the result of merging
exactly if each two neighbours stay apart when merged alone. So the state of a prefix is the one
piece that ends it and stays apart from the piece before, and the same pass gives the library's pieces.

Models with user-defined symbols are refused.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from paperloom.llm.common import free_name, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
USER_DEFINED = 4  # a kind of piece
#: score of an unknown character below the lowest piece
UNKNOWN_PENALTY = 10.0
#: words whose pieces a worker remembers, and neighbour pairs; when full, words out of use and all pairs are forgotten
WORD_MEMORY, PAIR_MEMORY = 250_000, 1_000_000
#: longer words aren't remembered
LONGEST_REMEMBERED = 64
#: bytes of text whose words are gathered at once
BATCH_BYTES = 4 << 20
#: characters that tell which pieces may end a prefix
TAIL = 4


class Codec:
    """A model's pieces, parsed once per worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        normal = proto.normalizer_spec
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models whose words begin with the mark")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined symbols aren't supported: those would have to be cut out of texts first")
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = processor.normalize if normal.precompiled_charsmap else None
        self.dummy, self.squeeze = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        self.unknown = processor.unk_id()
        self.ids, self.scores, self.byte_ids, self.surface = {}, {}, {}, []
        for number in range(processor.get_piece_size()):
            piece = processor.id_to_piece(number)
            if processor.is_byte(number):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = number
                self.surface.append(bytes([value]))
            elif processor.is_control(number):
                self.surface.append(b"")
            elif processor.is_unknown(number):
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                if not processor.is_unused(number):
                    self.ids[piece], self.scores[piece] = number, processor.get_score(number)
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # no piece crosses these borders, so words may be cut there
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        alone = [c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids)]
        single = "".join(map(re.escape, alone))
        self.words = re.compile(r"(?s:.+)") if crossing else re.compile(
            f"{MARK}*[^{MARK}{single}]+|{MARK}+" + (f"|[{single}]" if single else ""))
        self.known: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        # neighbours that were merged alone, by left piece; what a piece may end with, by the last characters
        self.apart: dict[str, dict[str, bool]] = {"": {}}
        self.pairs = 0
        self.candidates: dict[str, tuple[int, ...]] = {}
        self.totals: list[float] = []
        self.ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > TAIL:
                self.ends.setdefault(piece[-TAIL:], set()).add(len(piece))

    def marked(self, text: str) -> str:
        """The text as the model sees it: blanks as marks, one mark before the first word."""
        if self.normalize:
            return self.normalize(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy else "") + text.replace(" ", MARK)

    def _merged(self, symbols: list[str], border: int) -> bool:
        """Whether merging, best score first, then leftmost, keeps the border before symbol ``border`` and
        ends with one symbol on each side of it."""
        score = self.scores.get
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                value = score(symbols[k] + symbols[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if at < 0:
                return len(symbols) == border + 1 and border <= 1
            if at + 1 == border:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            border -= at + 1 < border

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths that a piece which ends with ``tail``, the last characters of a prefix, can have."""
        if len(self.candidates) >= PAIR_MEMORY:
            self.candidates.clear()
        short = [n for n in range(1, len(tail) + 1) if n == 1 or tail[-n:] in self.ids]
        found = self.candidates[tail] = (*short, *sorted(self.ends.get(tail, ())))
        return found

    def stay_apart(self, left: str, right: str, pairs: dict[str, bool]) -> bool:
        """Whether merging ``left`` and ``right`` together gives just these two pieces."""
        self.pairs += 1
        known = pairs[right] = self._merged(list(left + right), len(left))
        return known

    def _extend_merged(self, word: str, lasts: list[str], pairs: list[dict]) -> None:
        """Append the last piece of each further prefix of ``word``, and that piece's neighbours."""
        ids, candidates, apart = self.ids, self.candidates, self.apart
        for end in range(len(lasts) + 1, len(word) + 1):
            tail = word[end - TAIL if end > TAIL else 0 : end]
            for length in candidates.get(tail) or self._lengths(tail):
                start = end - length
                if start < 0:
                    break
                piece = word[start:end]
                if length > TAIL and piece not in ids:
                    continue
                keep = pairs[start].get(piece)
                if keep is None:
                    keep = self.stay_apart(lasts[start - 1] if start else "", piece, pairs[start])
                if keep:
                    lasts.append(piece)
                    own = apart.get(piece)
                    if own is None:
                        own = apart[piece] = {}
                    pairs.append(own)
                    break
            else:
                raise AssertionError(f"no piece ends {word[:end]!r}")

    def _extend_best(self, word: str, lasts: list[str], _) -> None:
        """Append the last piece of the best segmentation of each further prefix; totals go beside."""
        totals = self.totals
        del totals[len(lasts):]
        for end in range(len(lasts) + 1, len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                score = self.scores.get(piece)
                if score is None:
                    if start < end - 1:
                        continue
                    score = self.lowest
                total = score + (totals[start - 1] if start else 0.0)
                if best is None or total > best:
                    best, chosen = total, piece
            lasts.append(chosen)
            totals.append(best)

    def _raw(self, piece: str) -> bytes:
        """Ids of a piece, or of an unknown character, as 32-bit numbers."""
        number = self.ids.get(piece)
        if number is not None:
            found = [number]
        else:
            found = [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]
        out = np.array(found, "<i4").tobytes()
        if len(self.raw) < PAIR_MEMORY:
            self.raw[piece] = out
        return out

    def _ids_of(self, lasts: list[str]) -> bytes:
        pieces, end, raw = [], len(lasts), self.raw
        while end:
            piece = lasts[end - 1]
            pieces.append(raw.get(piece) or self._raw(piece))
            end -= len(piece)
        pieces.reverse()
        if not self.byte_ids:  # a run of unknown characters is one unknown piece
            alone = np.array([self.unknown], "<i4").tobytes()
            pieces = [p for k, p in enumerate(pieces) if not (k and p == alone == pieces[k - 1])]
        return b"".join(pieces)

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct marked words: one depth-first pass over their trie."""
        extend = self._extend_merged if self.kind == BPE else self._extend_best
        if self.pairs >= PAIR_MEMORY:
            self.apart, self.pairs = {"": {}}, 0
        out, before, lasts, pairs = {}, "", [], [self.apart[""]]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared:], pairs[shared + 1 :]
            extend(word, lasts, pairs)
            out[word] = self._ids_of(lasts)
            before = word
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        cut = [self.words.findall(self.marked(text)) if text else [] for text in texts]
        used = set().union(*cut)
        fresh = used.difference(self.known)
        if len(self.known) + len(fresh) > WORD_MEMORY:
            self.known = {word: self.known[word] for word in used.intersection(self.known)}
        got = self.encode_words(fresh)
        if any(len(word) > LONGEST_REMEMBERED for word in got) or len(self.known) + len(got) > WORD_MEMORY:
            find = {**self.known, **got}
            room = max(0, WORD_MEMORY - len(self.known))
            self.known.update([(w, i) for w, i in got.items() if len(w) <= LONGEST_REMEMBERED][:room])
        else:
            find = self.known
            find.update(got)
        rows = [b"".join(map(find.__getitem__, words)) for words in cut]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return offsets, np.frombuffer(b"".join(rows), "<i4")

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file, read where the job starts; it travels with the tasks, so executors need no copy."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, model: bytes, *, text_col: str = "text", out: str = "ids", keep: list[str] | None = None,
    check: str | None = None,
) -> DataFrame:
    """Add an array ``out`` of piece ids; no shuffle.

    ``keep`` names the columns to carry (all by default, in which the text is left out if need be). ``check`` names a
    further column that tells whether the ids decode to the text again, with its own marks as blanks.
    Null and empty texts have no ids. Unknown characters become byte pieces, or one unknown piece
    for a run of them if the model has none. Words of any length are encoded whole. Rows are
    encoded alone; an empty table stays empty.
    """
    kept = docs.columns if keep is None else keep
    name = free_name(docs.select(*kept), out)
    fields = [*(docs.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.IntegerType()))]
    if check:
        fields.append(T.StructField(check, T.BooleanType()))
    names = [f.name for f in fields]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch in slices(batches, text_col, BATCH_BYTES):
            texts = batch.column(text_col).to_pylist()
            ends, ids = made.encode_batch(texts)
            new = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if check:
                new.append(pa.array([
                    made.decode(ids[a:b].tolist()) == (text or "").replace(MARK, " ")
                    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names)

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(encoded, T.StructType(fields))


def decode(rows: DataFrame, model: bytes, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; null ids give a null text, no ids an empty one."""
    name = free_name(rows, out)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch in batches:
            column = batch.column(ids_col)
            values, ends = np.asarray(column.values), np.asarray(column.offsets)
            whole = np.asarray(column.is_valid())
            texts = [made.decode(values[a:b].tolist()) if valid else None
                     for a, b, valid in zip(ends[:-1], ends[1:], whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
