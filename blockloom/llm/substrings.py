"""Removal of repeated passages by super-k-mers of words.

A window is `k` consecutive words of one document. Its minimiser is the least hash among its `m`-word grams; windows with
equal words have equal minimisers wherever they stand. Consecutive windows that share a minimiser form a super-k-mer,
which travels once, as packed text, to the bucket of its minimiser; there the windows are hashed, sorted and counted, and
windows of equal hash are compared word by word.

The result for document d: a window is removed if its words also start in a document with a smaller id. Only the least id
of each window matters, and that lets almost everything be settled before it moves:

1. In a batch, the super-k-mers of equal words are grouped. Those of any but the least id are wholly removed, at once. The
   group travels as one copy of its words with the places where the least id holds it, packed (zstd) with others of its bucket.
2. A bucket finds the least id of each window and gives runs of removed windows, by document.
3. The documents meet their runs in one join by id and text; words covered by a run go.

Skew: exact copies and passages shared by many documents are equal super-k-mers, of which a bucket gets one from each batch
at most. Windows that reach over the edge of a shared passage differ from document to document but share its minimiser;
if too many do, longer grams take over (see `minimisers`).

Defined results: null or empty text has no words; fewer than k words: nothing is removed; rows with a null id are neither
judged nor counted as sources; rows that repeat an id never remove each other's words, whether their texts are equal or not,
each is judged against smaller ids, and each comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import MIX_1, PHI, _tables, documents, gram_hashes, joined, mix, pieces, spans, table, utf8, word_hashes
from .minimisers import FULL, RANGE, counting, frequent, levels, ranges, tagged, to_bytes, window_min, with_runs

K = 50
M = 5
PACK_BYTES = 1 << 18
HELD_BYTES = 16 << 20
SETTLE_WINDOWS = 1_000_000
BLOCK = 4000


class Cut:
    """The super-k-mers of a batch of texts: arrays over super-k-mers `doc` (row), `first` (word in the document), `n` (windows), `key`, `level`, `start` and `end` (bytes of the batch)."""

    def __init__(self, texts: list[bytes], hot: np.ndarray, k: int, lengths: list[int]):
        self.data, at = joined(texts)
        self.starts, self.ends = spans(self.data)
        bounds = np.searchsorted(self.starts, at)  # words of row i: bounds[i] .. bounds[i + 1]
        self.words = words = word_hashes(self.data, self.starts, self.ends)
        self.k = k
        n_win = len(words) - k + 1
        if n_win <= 0:
            self.doc = self.first = self.n = self.start = self.end = self.word = self.level = np.zeros(0, dtype=np.int64)
            self.key = self.mark = np.zeros(0, dtype=np.uint64)
            return
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whole = row[:n_win] == row[k - 1 :]
        key, level = self._least(lengths[0]), np.zeros(n_win, dtype=np.int8)
        self._split(key, level, whole, row)
        for i, m in enumerate(lengths[1:], 1):
            again = np.isin(self.key, hot) & (self.level == i - 1) if len(hot) else np.zeros(1, dtype=bool)
            if not again.any():
                break
            windows = np.repeat(self.word[again], self.n[again]) + counting(self.n[again])
            key[windows] = mix(self._least(m)[windows] + np.uint64(i) * PHI)
            level[windows] = i
            self._split(key, level, whole, row)
        self.doc = row[self.word]
        self.first = self.word - bounds[self.doc]
        self.start, self.end = self.starts[self.word], self.ends[self.word + self.n + k - 2]

    def _least(self, m: int) -> np.ndarray:
        return window_min(gram_hashes(self.words, m), self.k - m + 1)

    def _split(self, key: np.ndarray, level: np.ndarray, whole: np.ndarray, row: np.ndarray) -> None:
        cut = np.ones(len(key), dtype=bool)
        cut[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1]) | (whole[1:] != whole[:-1]) | (row[1 : len(key)] != row[: len(key) - 1])
        begin = np.flatnonzero(cut)
        n = np.diff(np.append(begin, len(key)))
        keep = whole[begin]
        self.word, self.n = begin[keep], n[keep]
        self.key, self.level = key[self.word], level[self.word].astype(np.int64)
        self.mark = self.words[self.word] + self.n.astype(np.uint64)

    def packed(self, i: int) -> bytes:
        """The words of super-k-mer i, with one space between."""
        raw = self.data[self.start[i] : self.end[i]].tobytes()
        return b" ".join(raw.split())

    def hashes(self) -> np.ndarray:
        """Two independent 64-bit hashes of each super-k-mer's words (and their number)."""
        up, down = _tables(len(self.words) + 1)
        out = np.zeros((len(self.doc), 2), dtype=np.uint64)
        last = self.word + self.n + self.k - 1
        for j, salted in enumerate((self.words, mix(self.words ^ PHI))):
            run = np.zeros(len(salted) + 1, dtype=np.uint64)
            np.cumsum(salted * up[: len(salted)], out=run[1:])
            out[:, j] = mix((run[last] - run[self.word]) * down[self.word] + (last - self.word).astype(np.uint64) * MIX_1)
        return out


def window_keys(words: np.ndarray, k: int) -> np.ndarray:
    """Two independent 64-bit hashes of each window of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros((0, 2), dtype=np.uint64)
    out = np.zeros((n, 2), dtype=np.uint64)
    up, down = _tables(len(words) + 1)
    for j, salted in enumerate((words, mix(words ^ PHI))):
        run = np.zeros(len(salted) + 1, dtype=np.uint64)
        np.cumsum(salted * up[: len(salted)], out=run[1:])
        out[:, j] = mix((run[k:] - run[:-k]) * down[:n])
    return out


def _packer(k: int, lengths: list[int], buckets: int, hot: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        sizes: dict[int, int] = {}
        zip_ = zstandard.ZstdCompressor(level=3)

        def row(b: int, places: bytes | None, texts: bytes | None, settled: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x and zip_.compress(x)], pa.binary()) for x in (places, texts, settled))], ["bucket", "places", "texts", "settled"])

        def flush(b: int) -> pa.RecordBatch:
            texts, places = held.pop(b)
            sizes.pop(b)
            return row(b, np.array(places, dtype=np.int64).tobytes(), b"\n".join(texts), None)

        for number, batch in enumerate(pieces(batches, "text")):
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
            cut = Cut(utf8(batch.column("text")), hot, k, lengths)
            if not len(cut.doc):
                continue
            keys, owner = cut.hashes(), ids[cut.doc]
            order = np.lexsort((cut.first, owner, keys[:, 1], keys[:, 0]))
            keys, owner, tag = keys[order], owner[order], tags[cut.doc[order]]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            group = np.cumsum(fresh) - 1
            late = owner > owner[np.flatnonzero(fresh)][group]
            if late.any():
                i = order[late]
                yield row(int((number * 7919 + ids[0]) % buckets), None, None, to_bytes(ranges(owner[late], tag[late], cut.first[i], cut.n[i])))
            go = np.flatnonzero(~late)
            buckets_of = (mix(cut.key[order[go]]) % np.uint64(buckets)).astype(np.int64)
            last = -1
            for g, i, d, t, f, b in zip(group[go].tolist(), order[go].tolist(), owner[go].tolist(), tag[go].tolist(), cut.first[order[go]].tolist(), buckets_of.tolist(), strict=True):
                texts, places = held.setdefault(b, ([], []))
                if g != last or not texts:
                    text = cut.packed(i)
                    texts.append(text)
                    sizes[b] = sizes.get(b, 0) + len(text)
                    last = g
                places += (len(texts) - 1, d, t, f)
                sizes[b] += 32
                if sizes[b] >= PACK_BYTES:
                    yield flush(b)
            if sum(sizes.values()) > HELD_BYTES:
                for b in list(held):
                    yield flush(b)
        for b in list(held):
            yield flush(b)

    return pack


def settle(texts: list[bytes], places: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The removed windows of some buckets; places: text, doc_id, tag, first of each super-k-mer."""
    hashes, numbers = [], []
    for a in range(0, len(texts), BLOCK):  # few bytes at a time; only the words' hashes stay
        data, at = joined(texts[a : a + BLOCK])
        starts, ends = spans(data)
        hashes.append(word_hashes(data, starts, ends))
        numbers.append(np.diff(np.searchsorted(starts, at)))
    words, per = np.concatenate(hashes), np.concatenate(numbers)
    bounds = np.cumsum(per) - per
    text, owner, tag, first = places.T
    n = (per - k + 1)[text]
    string, place = np.repeat(np.arange(len(n)), n), counting(n)
    word = bounds[text][string] + place
    doc = owner[string]
    keys = window_keys(words, k)[word]
    order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    heads = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    gone = np.flatnonzero(doc[order] > doc[order[heads]])
    left, right = word[order[gone]], word[order[heads[gone]]]
    for j in range(k):  # equal hashes: compare the words
        if not np.array_equal(words[left + j], words[right + j]):
            raise ArithmeticError("two different windows have one 128-bit hash")
    if len(gone):
        i = order[gone]
        yield ranges(doc[i], tag[string[i]], first[string[i]] + place[i], np.ones(len(gone), dtype=np.int64))


def _judge(k: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        texts, places, windows, bucket = [], [], 0, None
        for batch in batches:
            for b, more, a, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "places", "texts")), strict=True):
                if b != bucket and windows > SETTLE_WINDOWS:
                    yield from settle(texts, np.concatenate(places), k)
                    texts, places, windows = [], [], 0
                bucket = b
                if more:
                    yield from pa.ipc.open_stream(unzip.decompress(more))
                    continue
                part = unzip.decompress(packed).split(b"\n")
                place = np.frombuffer(unzip.decompress(a), dtype=np.int64).reshape(-1, 4)
                windows += int(sum(p.count(b" ") for p in part)) - (k - 2) * len(part)
                places.append(place + [len(texts), 0, 0, 0])
                texts += part
        if texts:
            yield from settle(texts, np.concatenate(places), k)

    return judge


def removed_windows(df: DataFrame, k: int = K, m: int = M, hot_least: int | None = None) -> DataFrame:
    """(doc_id, tag, first, n): runs of windows, by their first word, that also start in a document with a smaller id."""
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, lengths = tagged(df), levels(k, m)
    hot, total = frequent(rows, lambda texts, hot: Cut(texts, hot, k, lengths), lengths, parts, hot_least)
    buckets = max(4 * parts, total // FULL)
    packed = rows.mapInArrow(_packer(k, lengths, buckets, hot), "bucket long, places binary, texts binary, settled binary")
    return table(packed.repartition(max(parts, buckets // 8), "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(k), RANGE), "op3-runs")


def kept_words(text: bytes, runs: list[tuple[int, int]], k: int) -> tuple[int, list[bytes]]:
    """The number of words, and those that no removed window covers."""
    words = text.split()
    if not runs:
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for first, n in runs:
        edge[first] += 1
        edge[first + n + k - 1] -= 1
    cover = np.cumsum(edge)[:-1]
    return len(words), [words[i] for i in np.flatnonzero(cover == 0)]


def digest(df: DataFrame, k: int = K, m: int = M, hot_least: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows = df.select("doc_id", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for d, t, r in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("_runs").to_pylist(), strict=True):
                n, kept = kept_words(t, [(x["first"], x["n"]) for x in r or ()], k)
                out.append((d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_runs(rows, removed_windows(rows, k, m, hot_least)).mapInArrow(compute, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip(df: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """The rows (all columns) whose text has lost its repeated passages; a text that loses nothing stays as it is, null included."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            i = batch.schema.get_field_index("text")
            texts = [b" ".join(kept_words(t.encode(), [(x["first"], x["n"]) for x in r], k)[1]).decode() if r else t for t, r in zip(batch.column(i).to_pylist(), batch.column("_runs").to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type)).drop_columns(["_runs"])

    return with_runs(df, removed_windows(df.select("doc_id", "text"), k, m)).mapInArrow(compute, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERY = ("op3_superkmer_dedup", query)
