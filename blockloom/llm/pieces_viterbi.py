"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

The text is marked (a space becomes U+2581, one is put in front) and cut before every run of marks that follows another
character; no piece of a model that this module accepts crosses such a cut, which is checked on loading. The distinct marked
words of a batch are sorted, which lists the leaves of their trie in depth-first order: a word keeps the forward states of the
prefix it shares with its predecessor and computes only the rest.

The state of a prefix depends on the model's type. Unigram: the best score of the prefix and its last piece (Viterbi). BPE:
merging ranks do not add up, so the best-scoring path is not what the model means; there the state is the last piece of the
prefix's own encoding. It is the one piece that ends there, starts at an encodable prefix, and is stable next to that prefix's
last piece (merging the two pieces' characters gives those two again). Either way the ids are read back from the last prefix.
Characters without a piece become byte pieces, or the unknown id where the model has none.

Scale: map-only; words are shared within batches and by a bounded cache across them; no table of all words is built.

Defined results: null counts as empty, which has no ids; one row per input row, repeated rows and null ids included.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

MARK = "▁"
CACHE = 400_000
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
# piece types and model types of the file format (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """A model file and the forward states of the last word that was encoded."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.surface: list[bytes] = []
        self.id_of: dict[str, int] = {}
        self.score: list[float] = []
        self.byte_id: dict[int, int] = {}
        self.unknown, self.kind, prefix, self.squeeze = 0, UNIGRAM, 1, 1
        kinds = []
        for field, value in _fields(raw):
            if field == 1:
                x = dict(_fields(value))
                text, kind = x[1].decode(), x.get(3, NORMAL)
                i = len(kinds)
                kinds.append(kind)
                self.score.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.surface.append(text.replace(MARK, " ").encode())
                if kind in (NORMAL, USER_DEFINED):
                    self.id_of[text] = i
                elif kind == BYTE:
                    self.byte_id[int(text[3:5], 16)] = i
                    self.surface[i] = bytes([int(text[3:5], 16)])
                elif kind == UNKNOWN:
                    self.unknown = i
                    self.surface[i] = " ⁇ ".encode()
                elif kind == CONTROL:
                    self.surface[i] = b""
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                prefix, self.squeeze = norm.get(3, 1), norm.get(4, 1)
                if norm.get(2):
                    raise ValueError("models with a normalisation table are not supported")
        if self.squeeze or not prefix:
            raise ValueError("only models that keep white space and add a leading space are supported")
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on over the start of a word")
        self.longest = max(map(len, self.id_of), default=1)
        self.lost = min((self.score[i] for i in self.id_of.values()), default=0.0) - 10.0
        self.stable: dict[tuple[str, str], bool] = {}
        self.word, self.last, self.best = "", [""], [0.0]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, left: str, piece: str) -> bool:
        key = (left, piece)
        ok = self.stable.get(key)
        if ok is None:
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            ok = self.stable[key] = self.merged(left + piece) == ([left, piece] if left else [piece])
        return ok

    def encode_sorted(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of sorted distinct words, depth first through their trie."""
        id_of, longest, score = self.id_of, self.longest, self.score
        bpe = self.kind == BPE
        last, best = [""], [0.0]  # of each prefix: its last piece and score
        before, out = "", {}
        for word in words:
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], best[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                found, top = word[end - 1], None
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = word[start:end]
                    i = id_of.get(piece)
                    if i is None:
                        continue
                    if bpe:
                        if self._fits(last[start], piece):
                            found, top = piece, 0.0
                            break
                    elif top is None or best[start] + score[i] >= top:  # ties go to the longer piece
                        found, top = piece, best[start] + score[i]
                if not bpe and (one := best[end - 1] + self.lost) and word[end - 1] not in id_of and (top is None or one > top):
                    found, top = word[end - 1], one
                last.append(found)
                best.append(0.0 if top is None else top)
            ids: list[int] = []
            end = len(word)
            while end:
                piece = last[end]
                i = id_of.get(piece)
                if i is not None:
                    ids.append(i)
                elif self.byte_id:
                    ids += [self.byte_id[b] for b in reversed(piece.encode())]
                else:  # neighbouring unknown characters are one unknown piece
                    if not (ids and ids[-1] == self.unknown):
                        ids.append(self.unknown)
                end -= len(piece)
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def encode(self, texts: list[str], cache: dict[str, tuple[int, ...]] | None = None) -> list[np.ndarray]:
        cache = {} if cache is None else cache
        if len(cache) > CACHE:
            cache.clear()
        cut = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(cut)) - cache.keys()
        cache |= self.encode_sorted(sorted(fresh))
        return [np.fromiter(chain.from_iterable(map(cache.__getitem__, words)), dtype="<u4") for words in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    path = path or vocabulary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = model_of(path), {}
        for batch in pieces(batches, "text"):
            ids = [x.view("<i4") for x in model.encode([t or "" for t in batch.column("text").to_pylist()], cache)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); null ids count as none."""
    path = path or vocabulary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(scan, "doc_id long, text string")


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Both ways in one pass: doc_id, n_ids, ids_sha256 and ids_crc32 (little-endian 32-bit ids), text_sha256 (of what the ids decode to), exact (it is the text)."""
    path = path or vocabulary()
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = model_of(path), {}
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for d, t, ids in zip(batch.column("doc_id").to_pylist(), texts, model.encode(texts, cache), strict=True):
                raw, back = ids.tobytes(), model.decode(ids.tolist())
                rows.append((d, len(ids), hashlib.sha256(raw).hexdigest(), binascii.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == t))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_ids", "ids_sha256", "ids_crc32", "text_sha256", "exact"])

    schema = "doc_id long, n_ids long, ids_sha256 string, ids_crc32 long, text_sha256 string, exact boolean"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


QUERY = ("op1_sentencepiece", query)
