"""What both substring operators share: keys of window minimisers, frequent keys, packed parts, runs by document.

A window's minimiser is the least hash among its grams of `m` units; windows of equal content have equal minimisers, and
consecutive windows with one minimiser form a string, which travels to the bucket of its key. A key that too many strings
share is refined: its windows take the minimiser of a longer gram instead, up to the window itself (`levels`). So a hot key's
strings still travel packed and meet in buckets; only the gram that they have to share grows. At the last level a string is
one window, of which a batch sends one copy.

Rows are told apart by (doc_id, hash of the text): rows that repeat an id with another text are judged apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, table, utf8

#: Strings of one key that a bucket may hold, as far as the number of buckets allows; and strings for one bucket on average.
HOT = 40_000
FULL = 20_000
RANGE = "doc_id long, tag long, first long, n long"
RANGE_NAMES = ["doc_id", "tag", "first", "n"]


def levels(k: int, m: int) -> list[int]:
    """Gram lengths: m, then a quarter and a sixteenth of the room left free, then the window."""
    return sorted({m, k - (k - m) // 4, k - (k - m) // 16, k})


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    have, span = x, 1
    while span * 2 <= w:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = w - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def counting(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def tagged(df: DataFrame) -> DataFrame:
    """doc_id, tag, text of the rows that are judged."""
    return df.select("doc_id", F.xxhash64("text").alias("tag"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def frequent(rows: DataFrame, cut: Callable, lengths: list[int], parts: int, least: int | None = None) -> tuple[np.ndarray, int]:
    """The keys of all levels that must be refined, sorted, and the number of strings.

    cut(texts, hot) gives a batch's strings, with their `key`, `level` and `mark`; equal strings of a batch, which travel once, have
    equal marks and count once. A level is counted only if the one before has frequent
    keys. A task reports at most 16 keys for each partition; which keys are listed decides where strings meet, never what is found.
    """
    hot, total = np.zeros(0, dtype=np.uint64), 0
    for level in range(len(lengths) - 1):

        def often(batches: Iterator[pa.RecordBatch], level=level, hot=hot) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            for batch in pieces(batches, "text"):
                strings = cut(utf8(batch.column("text")), hot)
                own = strings.level == level
                keys, times = np.unique(strings.key[own][np.unique(strings.key[own] ^ mix(strings.mark[own]), return_index=True)[1]], return_counts=True)
                found, at = np.unique(np.concatenate([found, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(found)).astype(np.int64)
            if len(found):
                much = n >= max(2, n.sum() // (16 * parts))
                yield pa.RecordBatch.from_arrays([pa.array([None, *found[much].view(np.int64).tolist()], pa.int64()), pa.array([n.sum(), *n[much]], pa.int64())], ["key", "n"])

        counted = table(rows.mapInArrow(often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "frequent-keys")
        total = total or counted.where("key IS NULL").agg(F.sum("n")).first()[0] or 0
        limit = least if least is not None else max(HOT, total // (8 * parts))
        new = [r.key for r in counted.where(F.col("key").isNotNull() & (F.col("n") > limit)).collect()]
        if not new:
            break
        hot = np.sort(np.concatenate([hot, np.array(new, dtype=np.int64).view(np.uint64)]))
    return hot, total


def ranges(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs of removed windows; runs that touch become one."""
    order = np.lexsort((first, tag, doc))
    doc, tag, first, n = doc[order], tag[order], first[order], n[order]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] != first[:-1] + n[:-1])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[head], tag[head], first[head], np.add.reduceat(n, np.flatnonzero(head)) if len(n) else n)], RANGE_NAMES)


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def with_runs(df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (all columns) with their runs, an array of (first, n) or null, as the last column `_runs`."""
    by_doc = found.groupBy(F.col("doc_id").alias("_run_doc"), F.col("tag").alias("_run_tag")).agg(F.collect_list(F.struct("first", "n")).alias("_runs"))
    return df.join(by_doc, (df["doc_id"] == by_doc["_run_doc"]) & (F.xxhash64(df["text"]) == by_doc["_run_tag"]), "left").drop("_run_doc", "_run_tag")
