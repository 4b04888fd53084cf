"""Sources and sinks: raw images and records, block tables, journals by day, configuration files; a registry of them by name."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import is_zero
from ..schemas import BLOCKS, JOURNAL


def read_image(spark: SparkSession, path: str, size: int, whole: int = 1 << 30) -> DataFrame:
    """The non-zero blocks of raw image files: volume (the file's name), block_index, content.

    Files of up to `whole` bytes are read as one value each; larger ones, which have to be a multiple of the block size, as
    records from byte ranges that many tasks share.
    """
    files = spark.read.format("binaryFile").load(path)
    volume = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("volume")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))
    cut = F.transform(numbers, lambda i: F.struct(i.alias("block_index"), F.substring("content", (i * size + 1).cast("int"), F.lit(size)).alias("content")))
    rows = files.where(F.col("length") <= whole).select(volume, F.explode(cut).alias("b")).select("volume", "b.block_index", "b.content")
    for file in files.where(F.col("_metadata.file_size") > whole).select("path", volume).collect():  # names only; the listing has the sizes, no file is opened for them
        records = spark.sparkContext.binaryRecords(file.path, size).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
        rows = rows.union(spark.createDataFrame(records, "block_index bigint, content binary").select(F.lit(file.volume).alias("volume"), "block_index", "content"))
    return rows.where(~is_zero(F.col("content")))


def write_images(texts: DataFrame, path: str, most: int = 1000) -> None:
    """Every text (one column) as an image file of its own, with a zero byte behind it, in folders of about `most` files.

    A folder is one task's, so a commit moves folders, not files, and listings are shared by folder.
    """
    n = texts.count() // most + 1
    rows = texts.withColumn("folder", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    rows.repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def write_records(blocks: DataFrame, path: str) -> None:
    """Gzip files of records as test images have them: the index as decimal digits, zero-padded to 8, then the content. A file a partition."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = b"".join(f"{i:08d}".encode() + bytes(c) for i, c in zip(part["block_index"], part["content"], strict=True))
            yield pd.DataFrame({"content": [gzip.compress(raw, mtime=0)], "n": [len(part)]})

    blocks.select("block_index", "content").mapInPandas(pack, "content binary, n bigint").write.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(block_index, content) of gzipped records with contents of `size` bytes: of Parquet files as write_records makes them, else of raw files."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                data = gzip.decompress(bytes(raw))
                if len(data) % (8 + size):
                    raise ValueError("the file does not hold whole records")
                at = range(0, len(data), 8 + size)
                yield pd.DataFrame({"block_index": [int(data[a : a + 8]) for a in at], "content": [data[a + 8 : a + 8 + size] for a in at]})

    raw = spark.read.format("binaryFile").load(path) if path.endswith(".gz") else spark.read.parquet(path)
    return raw.select("content").mapInPandas(unpack, "block_index bigint, content binary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """One directory a volume; zero blocks are not stored."""
    blocks.where(~is_zero(F.col("content"))).write.mode("append").partitionBy("volume").parquet(path)


def read_blocks(spark: SparkSession, path: str, *volumes: str) -> DataFrame:
    rows = spark.read.schema(BLOCKS).parquet(path)
    return rows.where(F.col("volume").isin(*volumes)) if volumes else rows


def delete_volume(spark: SparkSession, path: str, volume: str) -> bool:
    """Drops the volume's directory; says whether there was one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/volume={volume}")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def write_journal(journal: DataFrame, path: str) -> None:
    """By volume and day, sorted by seq within files: bounds by time prune directories, bounds by seq prune row groups. A volume's day may be long: ranges share it."""
    day = F.to_date(F.timestamp_micros(F.expr("ts div 1000")))
    journal.withColumn("day", day).repartitionByRange("volume", "day", "seq").sortWithinPartitions("volume", "day", "seq").write.mode("append").partitionBy("volume", "day").parquet(path)


def read_journal(spark: SparkSession, path: str, volume: str | None = None, start_ns: int = 0, end_ns: int = 0) -> DataFrame:
    rows = spark.read.schema(JOURNAL + ", day date").parquet(path)
    if volume is not None:
        rows = rows.where(F.col("volume") == volume)
    for bound, op in ((start_ns, "ge"), (end_ns, "le")):
        if bound:
            day = F.to_date(F.timestamp_micros(F.lit(bound // 1000)))
            rows = rows.where((F.col("ts") >= bound) & (F.col("day") >= day) if op == "ge" else (F.col("ts") <= bound) & (F.col("day") <= day))
    return rows.drop("day")


def last_sequence(journal: DataFrame) -> DataFrame:
    return journal.groupBy("volume").agg(F.max("seq").alias("last_seq"))


def write_config(entries: DataFrame, path: str, kind: str, most: int = 10_000) -> None:
    """JSON documents {kind: {id: {...}}} of rows with an `id`, each a file of its own, of about `most` entries: documents grow in number, not in length.

    An id that several rows have is in as many documents.
    """
    n = entries.count() // most + 1
    copy = F.row_number().over(Window.partitionBy("id").orderBy(*entries.drop("id").columns))
    held = F.struct(F.lit(n).alias("n"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("part"), copy.alias("copy"))
    made = entries.withColumn("_at", held).groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*entries.drop("id").columns)))).alias(kind))
    made.select(F.to_json(F.struct(kind)).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_config(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Entries of one kind from JSON documents {kind: {id: {...}}}: the id as `id`, then the schema's columns. A file may hold several documents, one behind the other."""

    @F.pandas_udf("array<string>")
    def documents(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[str]:
            found, decoder, gap = [], json.JSONDecoder(), json.decoder.WHITESPACE
            at = gap.match(text, 0).end()
            while at < len(text):
                try:
                    end = decoder.raw_decode(text, at)[1]
                except ValueError:  # not strict JSON: Spark's parser has the rest
                    end = len(text)
                found.append(text[at:end])
                at = gap.match(text, end).end()
            return found

        return texts.map(of)

    text = spark.read.text(path, wholetext=True).select(F.explode(documents("value")).alias("value"))
    entries = text.select(F.explode(F.from_json("value", f"{kind} map<string, struct<{schema}>>")[kind]).alias("id", "v"))
    return entries.select("id", "v.*")


def config_document(kind: str, entries: dict[str, dict]) -> str:
    return json.dumps({kind: entries}, sort_keys=True)


_SOURCES: dict[str, Callable] = {}


def register(name: str, reader: Callable) -> None:
    """Makes a reader known by name; a name stands for one reader."""
    if _SOURCES.setdefault(name, reader) is not reader:
        raise ValueError(f"{name} is taken")


def source(name: str) -> Callable:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


for _name, _reader in (("image", read_image), ("records", read_records), ("blocks", read_blocks), ("journal", read_journal), ("config", read_config)):
    register(_name, _reader)
