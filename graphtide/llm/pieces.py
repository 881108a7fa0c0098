"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search reads a text from left to right and keeps, for each position of a window as long as the longest
piece, the last piece of the best path to it. As soon as the paths to all positions of the window go back
to one boundary, the ids up to that boundary are committed and what led to them is dropped. A path is best
by the model's own law: for a unigram model the largest sum of piece scores; for a BPE model the path whose
neighbouring pieces are what the merges make of their joint text. Merging leaves exactly one such path to
each position, so the ids are those that the model's merges give.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffers message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


class PieceModel:
    """The pieces of a model file and the search over them.

    memo: how many words' ids are kept; pairs: how many answers of the merge test are kept. The oldest
    words and all pairs go when these are full, so memory is bounded; both change only the time taken.
    """

    def __init__(self, data: bytes, memo: int = 800_000, pairs: int = 1_000_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.charsmap = True, True, b""
        suffix = False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback, suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.charsmap, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or suffix or self.charsmap or USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("only unigram and BPE models without a character map, user-defined or unused pieces are supported")
        normal = [i for i, t in enumerate(self.types) if t == NORMAL]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.id_of), default=1)
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.lengths = list(map(len, self.pieces))
        self.reach: dict[str, int] = {}  # the longest piece that ends with a character
        for piece in self.id_of:
            self.reach[piece[-1]] = max(self.reach.get(piece[-1], 0), len(piece))
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.lowest = min((self.scores[i] for i in normal), default=0.0) - 10.0
        #: No piece holds a space mark after another character: then words are apart from each other.
        self.by_word = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in self.id_of)
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        self._pairs: dict[int, dict[int, bool]] = {}  # by the left piece, -1 for none
        self._n_pairs, self._max_pairs = 0, pairs
        self._memo = _Memo(self, memo)

    def _raw(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.types[i] == CONTROL:
            return b""
        if self.types[i] == UNKNOWN:
            return b" \xe2\x81\x87 "
        return self.pieces[i].replace(SPACE, " ").encode()

    # ------------------------------------------------------------ laws of the search

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the left one among equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _stands(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces gives these two; left -1: the right one alone."""
        row = self._pairs.get(left)
        if row is None:
            row = self._pairs[left] = {}
        known = row.get(right)
        if known is None:
            b = self.pieces[right]
            known = self.merged(b) == [b] if left < 0 else self.merged(self.pieces[left] + b) == [self.pieces[left], b]
            self._n_pairs += 1
            if self._n_pairs > self._max_pairs:
                self._pairs.clear()
                self._n_pairs = 0
            row[right] = known
        return known

    def _step_bpe(self, text: str, at: int, base: int, last: list, _scores: list) -> tuple[int, float]:
        for n in range(min(self.reach[text[at - 1]], at - base), 0, -1):
            k = self.id_of.get(text[at - n : at])
            if k is not None and self._stands(last[at - n - base], k):
                return k, 0.0
        raise AssertionError("a position without a path")

    def _word(self, text: str) -> list[int]:
        """The search over a text that the window holds whole, for a BPE model."""
        get, reach, pairs, stands = self.id_of.get, self.reach, self._pairs, self._stands
        last, rows, at = [-1], [pairs.get(-1) or {}], 0
        for c in text:
            at += 1
            n = reach[c]
            i = at - n if at > n else 0
            while True:
                k = get(text[i:at])
                if k is not None:
                    ok = rows[i].get(k)
                    if ok or (ok is None and stands(last[i], k)):
                        last.append(k)
                        rows.append(pairs.get(k) or {})
                        break
                i += 1
        out, lengths = [], self.lengths
        while at:
            k = last[at]
            out.append(k)
            at -= lengths[k]
        out.reverse()
        return out

    def _step_unigram(self, text: str, at: int, base: int, _last: list, scores: list) -> tuple[int, float]:
        best, found = -1, float("-inf")
        for n in range(min(self.reach[text[at - 1]], at - base), 0, -1):
            k = self.id_of.get(text[at - n : at])
            if k is not None and (s := scores[at - n - base] + self.scores[k]) > found:
                best, found = k, s
        return best, found

    # ------------------------------------------------------------ search

    def _span(self, text: str) -> Iterator[int]:
        """Ids of a text of known characters, committed while it is read."""
        step = self._step_bpe if self.kind == BPE else self._step_unigram
        base, last, scores = 0, [-1], [0.0]  # position base is committed; last[i]: the piece that ends at base + i
        check = max(2 * self.longest, 16)
        for at in range(1, len(text) + 1):
            k, s = step(text, at, base, last, scores)
            last.append(k)
            scores.append(s)
            if len(last) > check:
                front = set(range(len(last) - self.longest, len(last)))
                while len(front) > 1:
                    top = max(front)
                    front.remove(top)
                    front.add(top - len(self.pieces[last[top]]))
                if (meet := front.pop()) > 0:
                    yield from self._back(last, meet)
                    # The piece that ends at the boundary stays: the next one must stand beside it.
                    base, last, scores = base + meet, last[meet:], scores[meet:]
                    check = max(2 * self.longest, 16)
                else:
                    check += self.longest
        yield from self._back(last, len(last) - 1)

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.pieces[last[at]])
        return out[::-1]

    def search(self, text: str) -> list[int]:
        """Ids of a marked text (spaces as marks). Characters that are no piece become bytes, or the unknown id."""
        if text and self.chars.issuperset(text):
            return self._word(text) if self.kind == BPE and len(text) <= 2 * self.longest else list(self._span(text))
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.id_of:
                if i > start:
                    out += self._span(text[start:i])
                start = i + 1
                out += [self.byte_ids[b] for b in c.encode()] if self.byte_fallback else [self.unknown]
        if start < len(text):
            out += self._span(text[start:])
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.by_word or not self.dummy_prefix:
            marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
            ids = self.search(marked)
            return struct.pack(f"<{len(ids)}i", *ids)
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        return b"".join(map(self._memo.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        data = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(data) // 4}i", data))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class _Memo(dict):
    """Word -> ids, filled on demand; words over 64 characters are searched each time.

    Half of the words are kept as the older ones; a full half becomes the older one, so words in use stay.
    """

    def __init__(self, model: PieceModel, size: int):
        super().__init__()
        self.model, self.half, self.older = model, size // 2, {}

    def __missing__(self, word: str) -> bytes:
        data = self.older.get(word)
        if data is None:
            data = array("i", self.model.search(SPACE + word)).tobytes()
        if len(word) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = data
        return data


_MODELS: dict[bytes, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """The model of a file's bytes; a worker process keeps one."""
    if data not in _MODELS:
        _MODELS.clear()
        _MODELS[data] = PieceModel(data)
    return _MODELS[data]


def _read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, key: str = "doc_id") -> DataFrame:
    """(key, ids, n_ids, round_trip) of each row's whole text.

    The driver reads the model file, whose size is bounded, and broadcasts it. Null texts give null ids,
    n_ids 0 and a null round_trip; empty texts no ids. round_trip tells whether decoding gives the text
    back; it is false only for texts that hold the space mark itself. Rows, also repeated ones and null
    keys, come out once each. Only the key and the text are read, so other columns can't clash.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(_read_model(model_path))
    light = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = model_of(shipped.value)
        raw = model.raw
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, ends, same, valid = [], [0], [], []
                for value in part.column(1):
                    text = value.as_py()
                    data = b"" if text is None else model.encode_bytes(text)
                    found.append(data)
                    ends.append(ends[-1] + len(data) // 4)
                    valid.append(text is not None)
                    if text is None:
                        same.append(None)
                    else:
                        back = b"".join(map(raw.__getitem__, np.frombuffer(data, "<i4").tolist()))
                        same.append((back[1:] if model.dummy_prefix and back[:1] == b" " else back) == text.encode())
                values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                counts = [b - a for a, b in zip(ends, ends[1:], strict=False)]
                offsets = pa.array(ends, pa.int32()) if all(valid) else pa.array([e if v else None for e, v in zip(ends, [*valid, True], strict=True)], pa.int32())
                ids = pa.ListArray.from_arrays(offsets, values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], ["_key", "ids", "n_ids", "round_trip"])

    kind = light.schema["_key"].dataType.simpleString()
    return light.mapInArrow(run, f"_key {kind}, ids array<int>, n_ids long, round_trip boolean").withColumnRenamed("_key", key)


def decode_ids(encoded: DataFrame, model_path: str = DEFAULT_MODEL, key: str = "doc_id") -> DataFrame:
    """(key, text) of each row's ids; null ids give a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(_read_model(model_path))
    light = encoded.select(F.col(key).alias("_key"), F.col("ids").alias("_ids"))

    def run(batches):
        model = model_of(shipped.value)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    kind = light.schema["_key"].dataType.simpleString()
    return light.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
