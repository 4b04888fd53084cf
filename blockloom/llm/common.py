"""What the training-data operators share: written tables, batch helpers, vectorised word and n-gram hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources import shared
from ..sources.shared import scratch  # noqa: F401

#: The 64-bit odd multiplier of all polynomial hashes (the golden ratio's).
PHI = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    tune(df.sparkSession)
    return shared.table(df, name)


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default of 10,000 rows, which whole texts would make large; another setting is left alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def pieces(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that the named string column of each holds about max_bytes at most (one longer row comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
        start, held = 0, 0.0
        for i, n in enumerate(sizes):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0.0
            held += n
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = PHI) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PHI and of its inverse, n at least; grown by whole steps, one pair kept."""
    have = next(iter(_TABLES), 0)
    if have < n:
        size = -(-n // (1 << 20)) << 20
        _TABLES.clear()
        _TABLES[size] = powers(size), powers(size, np.uint64(pow(int(PHI), -1, 1 << 64)))
    return next(iter(_TABLES.values()))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without U+0020 and U+0009 to U+000D) in an array of UTF-8 bytes."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, by one running polynomial over the whole array."""
    up, down = _tables(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX_1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive entries (empty where there are fewer)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * PHI + words[i : len(words) - n + 1 + i]
    return mix(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, a line break after each, and where each starts (one more entry: the end)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8), at


def utf8(column: pa.Array) -> list[bytes]:
    """Null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
