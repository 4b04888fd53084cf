"""Media columns: payloads kept as images in archives, read back by a Spark data source.

`write` stores each payload losslessly as an 8-bit greyscale PNG (64 samples a row) in ZIP archives of bounded size, in a
folder that all executors share. The source `archive_media` lists the folder and plans byte ranges over each archive; a
task reads the archive's own directory, takes the members whose local header starts in its range, seeks to each by offset,
and streams record batches of bounded size. A member that can't be read (I/O error, bad checksum) is retried by itself, with
a fresh handle, at its offset; after `retries` tries the read fails, or with `onError=row` gives a row that says why.

Scale: map-only, no shuffle. The driver sees archive names and sizes only. Archives are written under a temporary name and
renamed, so a lost executor leaves no half archive, and a second attempt at a task writes the same name.

Defined results: null text counts as empty; one row per input row, repeated rows and null ids included; a payload longer
than one archive's size gets an archive of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import documents, pieces, scratch

ROW = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A PNG whose samples are the payload, padded with 0 to a positive multiple of 64; the true length is kept as text."""
    rows = max(1, -(-len(payload) // ROW))
    lines = np.zeros((rows, ROW + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload.ljust(rows * ROW, b"\0"), dtype=np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(payload)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[np.ndarray, int]:
    """The samples as stored, row after row, and the length of the payload in them. Checks every checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, length, body = 8, 0, 0, []
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != binascii.crc32(kind + part):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", part)[0]
        elif kind == b"tEXt" and part.startswith(b"bytes\0"):
            length = int(part[6:])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not expected here")
    return np.ascontiguousarray(lines[:, 1:]).reshape(-1), length


class _Archive:
    """One ZIP file being written; its members are stored as they are."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path, self.size, self.n = store, path, 0, 0
        self.part = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out = store.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Sink(self.out), 1 << 20), "w", zipfile.ZIP_STORED)

    def add(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.size += len(data)
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        inner = self.zip.fp
        self.zip.close()
        inner.flush()
        self.out.close()
        self.store.move(self.part, self.path)
        return self.path.rpartition("/")[2], self.n, self.size


class _Sink(io.RawIOBase):
    """What zipfile needs of an output stream that can't seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores every row's text; returns (archive, members, bytes), one row an archive. Nothing is written before an action."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = store_of(folder)
        target.create_dir(root, recursive=True)
        task, number, archive, done = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, None, []
        for batch in pieces(batches, "text"):
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = to_png(text or b"")
                if archive and archive.size + len(data) > archive_bytes:
                    done.append(archive.close())
                    archive, number = None, number + 1
                archive = archive or _Archive(target, f"{root}/{task:08d}-{number:06d}.zip")
                archive.add(f"{archive.n}_{'null' if key is None else key}.png", data)
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "members", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, "archive string, members long, bytes long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("onerror", "fail")

    def partitions(self) -> list[ByteRange]:
        store, root = store_of(self.folder)
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [ByteRange(f.path, a, min(a + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".zip") for a in range(0, f.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """The member's bytes, read by its offset with a handle of its own at each try, or why they can't be had."""
        why = ""
        for _ in range(max(1, self.retries)):
            try:
                with store.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member header at its offset")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(info.header_offset + 30 + name + extra)
                    data = f.read(info.compress_size)
                if len(data) != info.file_size or binascii.crc32(data) != info.CRC:
                    raise ValueError("bad checksum")
                return data, None
            except (OSError, ValueError) as e:
                why = f"{info.filename} at {info.header_offset} of {path}: {e}"
        if self.on_error != "row":
            raise OSError(why)
        return None, why

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = store_of(self.folder)
        with store.open_input_file(partition.path) as f:
            members = [i for i in zipfile.ZipFile(f).infolist() if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        for info in sorted(members, key=lambda i: i.header_offset):
            data, why = self.member(store, partition.path, info)
            rows.append((partition.path.rpartition("/")[2], info.filename, info.header_offset, data, why))
            held += len(data or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


FIELDS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").option("rangeBytes", ...).option("retries", 3).option("onError", "fail").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").options(**options).load(folder)


def feature(samples: np.ndarray) -> str:
    """A 64-bit average hash in hex: bit i says whether the mean of the i-th of 64 equal stretches of the samples exceeds their mean."""
    means = samples.reshape(64, -1).mean(axis=1)
    return f"{int(''.join('1' if m > samples.mean() else '0' for m in means), 2):016x}"


def features(media: DataFrame) -> DataFrame:
    """The contract's columns of the rows of `read`."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples, length = from_png(data)
                key = name.rpartition(".")[0].partition("_")[2]
                raw = samples.tobytes()
                rows.append((None if key == "null" else int(key), length, len(raw), hashlib.sha256(raw).hexdigest(), binascii.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("member", "media").mapInArrow(compute, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op2-archives")
    write(documents(spark, sf_dir), folder).agg(F.sum("members")).collect()
    return features(read(spark, folder))


QUERY = ("op2_media_archives", query)
