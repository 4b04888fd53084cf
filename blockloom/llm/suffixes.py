"""Removal of repeated byte strings by merged sparse Burrows-Wheeler transforms.

Wanted: every window of `k` bytes that also starts somewhere else, in the same document or another. A window's anchor is the
first place of the least hash among its `m`-byte grams; equal windows have it at the same place. Consecutive windows with one
anchor form a string, which travels, packed, to the bucket of the gram's key (see `minimisers` for frequent keys). Only
anchors need be ranked, one for each string, and not every suffix:

* A packed part of a bucket is a shard. Its transform holds one row an anchor, in the order of the bytes to the left of it,
  read backwards, and for each row the bytes to the right of it. The task that cuts the strings sorts them; equal strings
  of a batch become one row, all but settled.
* All shards of a bucket are merged by interleave refinement. The interleave starts as the shards one after another, by key;
  a pass takes the symbols at one depth (eight bytes wide) and moves rows stably into symbol order. A block whose rows come
  from one shard is settled: its order is the shard's, and no pass touches it again. Each border is opened by one pass,
  which gives the common prefix of its neighbours; within settled blocks they are the shard's own.
* The merged transform's right columns are then read byte by byte, again as stable moves: after pass r a block's rows share
  the r bytes from the anchor on, still in left order, so that of all rows of the block the neighbours share most on
  the left; the minimum of the common prefixes between them says how much. The window with r bytes from the anchor on is
  repeated if that is k - r or more. Rows that can't reach k any more leave.

No suffix of the union is sorted or compared anew, and a text's windows cost a row for each anchor instead of each byte.

Defined results: null text counts as empty; rows with a null id are neither judged nor counted; identical rows repeat each
other and lose all their windows; rows that repeat an id with another text are judged apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import MIX_1, PHI, _tables, documents, joined, mix, pieces, table, utf8
from .minimisers import FULL, RANGE, counting, frequent, levels, ranges, tagged, to_bytes, window_min, with_runs

K = 400
M = 24
PACK_BYTES = 1 << 18
HELD_BYTES = 16 << 20
SETTLE_BYTES = 8 << 20
#: Bits for a byte's place in its text; the hash has the others. Longer texts are cut in segments that overlap.
PLACE = 24
SEGMENT = 8 << 20


def _grams(data: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of each m consecutive bytes."""
    if len(data) < m:
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[m:] - run[:-m]) * down[: len(data) - m + 1])


class Cut:
    """The strings of a batch of texts, as arrays: `doc` (row), `first` (byte in the document), `n` (windows), `key`, `level`, `left` (bytes before the anchor), `start` (byte in `data`)."""

    def __init__(self, texts: list[bytes], hot: np.ndarray, k: int, lengths: list[int]):
        row, shift, parts = [], [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t) - k + 1, SEGMENT):
                row.append(i)
                shift.append(a)
                parts.append(t[a : a + SEGMENT + k - 1])
        self.k = k
        self.doc = self.first = self.n = self.start = self.left = self.level = np.zeros(0, dtype=np.int64)
        self.key = self.mark = np.zeros(0, dtype=np.uint64)
        self.data = np.zeros(0, dtype=np.uint8)
        if not parts:
            return
        self.data, at = joined(parts)
        n_win = len(self.data) - k + 1
        sizes = np.diff(at) - 1
        self.at = np.arange(len(self.data), dtype=np.uint64) - np.repeat(at[:-1], sizes + 1).astype(np.uint64)  # in its text or segment
        edge = np.zeros(n_win + 1, dtype=np.int8)
        edge[at[:-1]] += 1
        np.add.at(edge, at[:-1] + sizes - k + 1, -1)
        whole = np.cumsum(edge[:-1]).astype(bool)
        place = self._first(lengths[0])
        level = np.zeros(n_win, dtype=np.int8)
        self._split(place, level, whole)
        for i, m in enumerate(lengths[1:], 1):
            again = np.isin(self.key, hot) & (self.level == i - 1) if len(hot) else np.zeros(1, dtype=bool)
            if not again.any():
                break
            windows = np.repeat(self.start[again], self.n[again]) + counting(self.n[again])
            place[windows] = self._first(m)[windows]
            level[windows] = i
            self._split(place, level, whole)
        piece = np.searchsorted(at, self.start, side="right") - 1
        self.doc = np.array(row)[piece]
        self.first = self.start - at[piece] + np.array(shift)[piece]

    def _first(self, m: int) -> np.ndarray:
        """Of each window, the least hash of its grams and the first place that has it, in one number."""
        x = _grams(self.data, m)
        low = np.uint64(PLACE)
        return window_min(((x >> low) << low) | self.at[: len(x)], self.k - m + 1)

    def _split(self, place: np.ndarray, level: np.ndarray, whole: np.ndarray) -> None:
        cut = np.ones(len(place), dtype=bool)
        cut[1:] = (place[1:] != place[:-1]) | (level[1:] != level[:-1]) | (whole[1:] != whole[:-1])
        begin = np.flatnonzero(cut)
        n = np.diff(np.append(begin, len(place)))
        keep = whole[begin]
        self.start, self.n = begin[keep], n[keep]
        self.level = level[self.start].astype(np.int64)
        self.key = (place[self.start] >> np.uint64(PLACE)) | (self.level.astype(np.uint64) << np.uint64(64 - PLACE))
        self.left = ((place[self.start] & np.uint64((1 << PLACE) - 1)) - self.at[self.start]).astype(np.int64)
        self.mark = (self.n << 20 | self.left).astype(np.uint64)

    def hashes(self) -> np.ndarray:
        """Two independent 64-bit hashes of each string."""
        out = np.zeros((len(self.start), 2), dtype=np.uint64)
        last = self.start + self.n + self.k - 1
        up, down = _tables(len(self.data) + 1)
        wide = self.data.astype(np.uint64) + np.uint64(1)
        for j, x in enumerate((wide, mix(wide ^ PHI))):
            run = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(x * up[: len(x)], out=run[1:])
            out[:, j] = mix((run[last] - run[self.start]) * down[self.start] + (last - self.start).astype(np.uint64) * MIX_1)
        return out


def _words(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Of each row the `width` bytes from `at` on, as big-endian 64-bit words; zeros after `size` bytes."""
    padded = np.concatenate([data, np.zeros(width, dtype=np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    out[np.arange(width) >= size[:, None]] = 0
    return out.view(">u8").astype(np.uint64)


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of a 64-bit word are zero."""
    n = np.zeros(len(x), dtype=np.int64)
    for b in range(8):
        n += x < (np.uint64(1) << np.uint64(8 * b))
    return n


def interleave(key: np.ndarray, shard: np.ndarray, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all shards in the order of (key, symbols), and what each shares with the row before (-1 where the key changes).

    Rows come shard by shard, each shard in that order; size: bytes of symbols that a row has.
    """
    order = np.argsort(key, kind="stable")
    border = np.ones(len(order), dtype=bool)
    border[1:] = key[order[1:]] != key[order[:-1]]
    common = np.where(border, -1, -2)  # -2: no border yet
    for depth in range(symbols.shape[1]):
        heads = np.flatnonzero(border)
        mixed = np.minimum.reduceat(shard[order], heads) != np.maximum.reduceat(shard[order], heads)
        block = np.cumsum(border) - 1
        at = np.flatnonzero(mixed[block])  # the other blocks are settled
        if not len(at):
            break
        rows, of = order[at], block[at]
        symbol = symbols[rows, depth]
        move = np.lexsort((symbol, of))  # of is in order already: symbols move within their blocks
        order[at], symbol = rows[move], symbol[move]
        new = np.flatnonzero((symbol[1:] != symbol[:-1]) & (of[1:] == of[:-1])) + 1
        border[at[new]] = True
        common[at[new]] = 8 * depth + _equal_bytes(symbol[new] ^ symbol[new - 1])
    else:  # rows of several shards that have all symbols in common: the shorter first
        heads, block = np.flatnonzero(border), np.cumsum(border) - 1
        at = np.flatnonzero((np.minimum.reduceat(shard[order], heads) != np.maximum.reduceat(shard[order], heads))[block])
        order[at] = order[at][np.lexsort((size[order[at]], block[at]))]
    left = np.flatnonzero(common == -2)
    for a in range(0, len(left), 20_000):  # neighbours from one shard, or equal
        i = left[a : a + 20_000]
        differ = symbols[order[i]] ^ symbols[order[i - 1]]
        j = np.argmax(differ != 0, axis=1)
        word = differ[np.arange(len(i)), j]
        common[i] = np.where(word == 0, 8 * symbols.shape[1], 8 * j + _equal_bytes(word))
    both = common >= 0
    common[both] = np.minimum(common[both], np.minimum(size[order[1:]], size[order[:-1]])[np.flatnonzero(both) - 1])
    return order, common


class Least:
    """Minimum of x over (a, b], by a table of doubled spans."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=np.int64)
        size = np.frexp((b - a).astype(np.float64))[1] - 1
        for s in np.unique(size):
            i = np.flatnonzero(size == s)
            out[i] = np.minimum(self.rows[s][a[i] + 1], self.rows[s][b[i] - (1 << int(s)) + 1])
        return out


def repeats(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, shard: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, r) of all repeated windows: those with k - r bytes before the row's anchor and r from it on.

    Rows come shard by shard, each shard in the order of (key, bytes before the anchor, read backwards).
    """
    width = max(8, -(-int(left.max()) // 8) * 8)
    order, common = interleave(key, shard, _words(data[::-1], len(data) - anchor, left, width), left)
    least = Least(common)
    rank = np.arange(len(order))
    block = np.cumsum(common == -1)
    reach = right[order]
    first, last = k - left[order], reach  # the values of r for which a row has a window
    at = anchor[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    padded = np.concatenate([data, np.zeros(1, dtype=np.uint8)])
    shared, changed = None, True
    for r in range(1, k + 1):
        here = reach[rank] >= r
        if not here.all():
            rank, block, changed = rank[here], block[here], True
        symbol = padded[at[rank] + r - 1]
        if ((symbol[1:] != symbol[:-1]) & (block[1:] == block[:-1])).any():
            move = np.lexsort((symbol, block))
            rank, block, symbol = rank[move], block[move], symbol[move]
            new = np.zeros(len(rank), dtype=np.int64)
            new[1:] = (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])
            block, changed = np.cumsum(new), True
        while changed and len(rank):
            between = np.full(len(rank) + 1, -1, dtype=np.int64)
            same = np.flatnonzero(block[1:] == block[:-1])
            between[same + 1] = least(rank[same], rank[same + 1])
            shared = np.maximum(between[:-1], between[1:])
            able = (shared >= 0) & (shared + reach[rank] >= k)
            changed = not able.all()
            rank, block, shared = rank[able], block[able], shared[able]
        if not len(rank):
            break
        hit = np.flatnonzero((shared >= k - r) & (first[rank] <= r) & (last[rank] >= r))
        if len(hit):
            found.append((order[rank[hit]], np.full(len(hit), r, dtype=np.int64)))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


ROW = "bucket long, arrays binary, texts binary, settled binary"


def _packer(k: int, lengths: list[int], buckets: int, hot: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def row(b: int, arrays: bytes | None, texts: bytes | None, settled: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x and zip_.compress(x)], pa.binary()) for x in (arrays, texts, settled))], ["bucket", "arrays", "texts", "settled"])

        def flush(b: int) -> pa.RecordBatch:
            """A shard's transform."""
            rows = held.pop(b)
            sizes.pop(b)
            rows.sort()
            return row(b, np.array([x[3:] + (x[0], len(x[1])) for x in rows], dtype=np.uint64).tobytes(), b"".join([x[2] for x in rows]), None)

        for number, batch in enumerate(pieces(batches, "text")):
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
            cut = Cut(utf8(batch.column("text")), hot, k, lengths)
            if not len(cut.doc):
                continue
            keys = cut.hashes()
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys = keys[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            group = np.cumsum(fresh) - 1
            many = (np.bincount(group) > 1)[group]
            if many.any():
                i = order[many]
                yield row(int((number * 7919 + ids[0]) % buckets), None, None, to_bytes(ranges(ids[cut.doc[i]], tags[cut.doc[i]], cut.first[i], cut.n[i])))
            i = order[fresh]
            to = (mix(cut.key[i]) % np.uint64(buckets)).astype(np.int64)
            numbers = (ids[cut.doc[i]].view(np.uint64), tags[cut.doc[i]].view(np.uint64), cut.first[i], cut.n[i], many[fresh].astype(np.int64))
            whole = cut.data.tobytes()
            for b, key, a, left, *rest in zip(to.tolist(), cut.key[i].tolist(), cut.start[i].tolist(), cut.left[i].tolist(), *(x.tolist() for x in numbers), strict=True):
                end = a + rest[3] + k - 1
                held.setdefault(b, []).append((key, whole[a : a + left][::-1], whole[a:end], *rest))
                sizes[b] = sizes.get(b, 0) + end - a
                if sizes[b] >= PACK_BYTES:
                    yield flush(b)
            if sum(sizes.values()) > HELD_BYTES:
                for b in list(held):
                    yield flush(b)
        for b in list(held):
            yield flush(b)

    return pack


def settle(shards: list[tuple[np.ndarray, bytes]], k: int) -> Iterator[pa.RecordBatch]:
    """The removed windows of some buckets, from their shards' transforms."""
    numbers = np.concatenate([x[0] for x in shards])
    doc, tag, first, n, many, key, left = (x if j == 5 else x.view(np.int64) for j, x in enumerate(np.ascontiguousarray(numbers.T)))
    blob = b"".join([x[1] for x in shards])
    sizes = n + k - 1
    ends = np.cumsum(sizes)
    seen: dict[bytes, int] = {}
    name = np.array([seen.setdefault(blob[a:b], len(seen)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
    gone = np.bincount(name)[name] > 1
    if gone.any():
        yield ranges(doc[gone], tag[gone], first[gone], n[gone])
    head = np.sort(np.unique(name, return_index=True)[1])  # one of each distinct string
    _, group, size = np.unique(key[head], return_inverse=True, return_counts=True)
    head = head[size[group] > 1]
    if not len(head):
        return
    shard = np.repeat(np.arange(len(shards)), [len(x[0]) for x in shards])[head]
    anchor = (ends - sizes + left)[head]
    row, r = repeats(np.frombuffer(blob, dtype=np.uint8), anchor, left[head], (sizes - left)[head], key[head], shard, k)
    row = head[row]
    open_ = ~gone[row] & (many[row] == 0)  # the others have gone as whole strings
    row, r = row[open_], r[open_]
    yield ranges(doc[row], tag[row], first[row] + r + left[row] - k, np.ones(len(row), dtype=np.int64))


def _judge(k: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        shards, size, bucket = [], 0, None
        for batch in batches:
            for b, more, arrays, texts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "arrays", "texts")), strict=True):
                if b != bucket and size > SETTLE_BYTES:
                    yield from settle(shards, k)
                    shards, size = [], 0
                bucket = b
                if more:
                    yield from pa.ipc.open_stream(unzip.decompress(more))
                    continue
                raw = unzip.decompress(texts)
                shards.append((np.frombuffer(unzip.decompress(arrays), dtype=np.uint64).reshape(-1, 7), raw))
                size += len(raw)
        if shards:
            yield from settle(shards, k)

    return judge


def repeated_windows(df: DataFrame, k: int = K, m: int = M, hot_least: int | None = None) -> DataFrame:
    """(doc_id, tag, first, n): runs of windows, by their first byte, that also start somewhere else."""
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, lengths = tagged(df), levels(k, m)
    hot, total = frequent(rows, lambda texts, hot: Cut(texts, hot, k, lengths), lengths, parts, hot_least)
    buckets = max(4 * parts, total // FULL)
    packed = rows.mapInArrow(_packer(k, lengths, buckets, hot), ROW)
    return table(packed.repartition(max(parts, buckets // 8), "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(k), RANGE), "op10-runs")


def removed_spans(runs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of the bytes that the runs' windows cover."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(runs):
        end = first + n + k - 1
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def digest(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows, k = df.select("doc_id", "text"), options.get("k", K)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for d, t, r in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("_runs").to_pylist(), strict=True):
                spans = removed_spans([(x["first"], x["n"]) for x in r or ()], k)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(t[at:a])
                    at = b
                kept = b"".join([*kept, t[at:]])
                out.append((d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_runs(rows, repeated_windows(rows, **options)).mapInArrow(compute, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERY = ("op10_bwt_dedup", query)
