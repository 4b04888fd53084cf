"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents are tokenised where they lie and cut only if longer than a sequence (the first piece may be shorter). The pieces
are range-sorted by falling length, then id, which gives each a rank within its length. Lengths and gaps take at most
`capacity` values each, so the state of a round is a table of at most that many classes: how many pieces of each length,
which runs of sequences have each gap. A round takes the next length and sweeps to its successor, the least gap that
holds it; the k-th piece by rank takes the k-th sequence of the run, which settles conflicts; the gaps are updated, and the
sweep repeats until the length is spent, opening sequences where no gap is left. That is best-fit decreasing for the
whole class at once. The rounds give intervals (length, ranks -> sequences, offset), and each piece finds its own by rank.

Scale: one shuffle, of some 40 bytes a piece; token ids never move. The driver sees counts by (sorted partition, length),
at most partitions + capacity rows, and interval lists bounded by capacity, however many documents there are. The sorted
pieces are written once in the shared folder, so ranks can't change under recomputation.

Defined results: null text counts as empty (one piece that holds the end id alone); repeated rows and null ids are packed like
any others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, table

CAPACITY = 1024
END_ID = 2
#: The vocabulary's special token (fixed value); as the tokenizers file has it, its string in a text is that token.
SPECIAL = {"<|endoftext|>": 50256}
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def vocabulary() -> str:
    """The public vocabulary of byte_bpe_50k.json, in the form of ranks (same ids)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tiktoken.Encoding:
    if path not in _ENCODERS:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def tokenised(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of (doc_id, text)."""
    path = path or vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in pieces(batches, "text"):
            rows = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), end_id).astype("<u4")
                raw = memoryview(ids.tobytes())
                rows += [(d, i, a, n, binascii.crc32(raw[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): the pieces of that length with these ranks go, in order, into these sequences at that offset."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first sequence, number)
    open_, sequences = 0, 0  # open_: bit g is set if gap g has runs

    def leave(gap: int, first: int, number: int) -> None:
        nonlocal open_
        if gap and number:
            gaps[gap].append((first, number))
            open_ |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if fits := open_ >> length:
                gap = length + (fits & -fits).bit_length() - 1
                first, number = gaps[gap].pop()
                take = min(number, left)
                leave(gap, first + take, number - take)
                if not gaps[gap]:
                    open_ &= ~(1 << gap)
                out.append((length, rank, take, first, capacity - gap))
                leave(gap - length, first, take)
                rank, left = rank + take, left - take
                continue
            per = capacity // length
            for number, layers in ((left // per, per), (1, left % per)):
                if number and layers:
                    for j in range(layers):
                        out.append((length, rank, number, sequences, j * length))
                        rank += number
                    leave(capacity - layers * length, sequences, number)
                    sequences += number
            left = 0
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def packed(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rank of each piece among those of its length in this sorted partition."""
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            if not len(lengths):
                continue
            head = np.ones(len(lengths), dtype=bool)
            head[1:] = lengths[1:] != lengths[:-1]
            at = np.flatnonzero(head)
            rank = np.arange(len(lengths)) - np.repeat(at, np.diff(np.append(at, len(lengths))))
            if lengths[0] == last:
                rank[: at[1] if len(at) > 1 else None] += seen
            last, seen = lengths[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part), pa.int32()), pa.array(rank, pa.int64())], [*batch.schema.names, "part", "rank"])

    cut_up = tokenised(df, path, capacity, end_id)
    # tokenised once: the range boundaries would otherwise be sampled from a second run
    cut_up = table(cut_up, "op4-pieces")
    by = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ordered = cut_up.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    ordered = table(ordered.mapInArrow(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "op4-ranked")
    seen = ordered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).orderBy("part", "length").collect()
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in seen:
        before[r.part, r.length] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    plan = rounds(counts, capacity)
    span = max(counts.values(), default=0) + 1
    plan = plan[np.argsort(plan[:, 0] * span + plan[:, 1])]
    keys = plan[:, 0] * span + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, parts = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            pair, inverse = np.unique(parts.astype(np.int64) * (capacity + 1) + lengths, return_inverse=True)
            base = np.array([before[int(p) // (capacity + 1), int(p) % (capacity + 1)] for p in pair], dtype=np.int64)
            rank = batch.column("rank").to_numpy() + (base[inverse] if len(base) else 0)
            i = np.searchsorted(keys, lengths * span + rank, side="right") - 1
            columns = [*batch.columns[:5], pa.array(plan[i, 3] + rank - plan[i, 1], pa.int64()), pa.array(plan[i, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ordered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


QUERY = ("op4_bestfit_packing", query)
