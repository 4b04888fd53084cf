"""Snapshots: a header (metadata, index -> hash) and contents by hash, written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import blake2b_256, snapshot_key
from ..sources.shared import table
from .rechunk import deflate, rechunk


def export(blocks: DataFrame, source_size: int, block_size: int, known: DataFrame | None = None, key: bytes | None = None, compression: int = 0) -> tuple[DataFrame, DataFrame]:
    """(map, new contents) of a volume at the snapshot's block size: map has block_index and hash; contents not in `known` come once, by ranges of the hash.

    The hashed blocks are written once, for both. Contents travel once: known hashes come to the same ranges as rows without a content.
    """
    digest = blake2b_256(snapshot_key(key, compression))
    hashed = table(rechunk(blocks, source_size, block_size).withColumn("hash", digest("content")), "hashed", "zstd")
    rows = hashed.select("hash", "content", F.lit(False).alias("known"))
    if known is not None:
        rows = rows.union(known.select("hash", F.lit(None).cast("binary"), F.lit(True)))
    once = rows.repartitionByRange("hash").groupBy("hash").agg(F.first("content", ignorenulls=True).alias("content"), F.max("known").alias("known"))
    return hashed.select("block_index", "hash"), once.where("NOT known").select("hash", "content")


def restore(map_: DataFrame, contents: DataFrame, block_size: int, target_size: int, key: bytes | None = None, compression: int = 0) -> DataFrame:
    """The blocks of a snapshot at another block size; a content that does not have its hash fails the read."""
    digest = blake2b_256(snapshot_key(key, compression))
    checked = map_.join(contents, "hash").withColumn("content", F.when(digest("content") == F.col("hash"), F.col("content")).otherwise(F.raise_error(F.lit("content is corrupt")).cast("binary")))
    return rechunk(checked.select("block_index", "content"), block_size, target_size)


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(block_index, hash) that are new or differ."""
    old = before.select("block_index", F.col("hash").alias("_old"))
    return now.join(old, "block_index", "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).select("block_index", "hash")


def merged(now: DataFrame, before: DataFrame) -> DataFrame:
    """The map of a repeated export onto one header: now over before; indices that have gone stay."""
    return before.join(now.select("block_index"), "block_index", "left_anti").select("block_index", "hash").union(now.select("block_index", "hash"))


def extent(blocks: DataFrame, source_size: int, target_size: int) -> DataFrame:
    """Bytes that an import needs at the target's block size (one row): up to the last block, or its last slice that is not zero."""
    last = blocks.agg(F.max_by(F.struct("block_index", "content"), "block_index").alias("b")).select("b.*")
    if target_size == source_size:
        size = (F.col("block_index") + 1) * target_size
    elif target_size > source_size:
        size = (F.expr(f"block_index div {target_size // source_size}") + 1) * target_size
    else:
        return deflate(last, target_size, source_size // target_size).agg(((F.max("block_index") + 1) * target_size).alias("size"))
    return last.select(size.alias("size"))


def fits(blocks: DataFrame, source_size: int, target_size: int, volume_bytes: int) -> DataFrame:
    """Fails if the snapshot is larger than its target."""
    return extent(blocks, source_size, target_size).select(F.when(F.col("size") <= volume_bytes, F.col("size")).otherwise(F.raise_error(F.lit("snapshot is too large for its target")).cast("bigint")).alias("size"))


def describe(map_: DataFrame, block_size: int) -> DataFrame:
    """n_blocks, snapshot_bytes (stored), volume_bytes (extent), n_distinct, as one row."""
    return map_.agg(
        F.count("*").alias("n_blocks"), (F.count("*") * block_size).alias("snapshot_bytes"), ((F.max("block_index") + 1) * block_size).alias("volume_bytes"), F.count_distinct("hash").alias("n_distinct")
    )


def describe_json(map_: DataFrame, block_size: int, pretty: bool = False) -> DataFrame:
    return describe(map_, block_size).select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("json"))


def header(map_: DataFrame, snapshot: str, block_size: int, source_id: str, source_size: int, span: int = 1 << 16) -> DataFrame:
    """Nested rows, one for each `span` indices that holds blocks: the metadata and, sorted, the parallel arrays of the map. A part has `span` entries at most, whatever the volume's size."""
    pairs = F.array_sort(F.collect_list(F.struct("block_index", "hash")))
    source = F.struct(F.lit(source_id).alias("id"), F.lit(block_size).alias("bs"), F.lit(source_size).alias("sz"))
    return map_.groupBy(F.expr(f"block_index div {span}").alias("part")).agg(pairs.alias("p")).select(
        "part", F.lit(snapshot).alias("id"), F.lit(block_size).alias("bs"), source.alias("src"), F.struct(F.size("p").alias("c"), F.col("p.block_index").alias("i"), F.col("p.hash").alias("h")).alias("map")
    )


def header_rows(header_: DataFrame) -> DataFrame:
    """The map of a header; parts whose arrays and count disagree fail the query."""
    whole = (F.size("map.i") == F.col("map.c")) & (F.size("map.h") == F.col("map.c"))
    zipped = F.arrays_zip(F.col("map.i").alias("i"), F.col("map.h").alias("h"))
    rows = header_.select(F.explode(F.when(whole, zipped).otherwise(F.raise_error(F.lit("invalid header")).cast("array<struct<i:bigint,h:string>>"))).alias("z"))
    return rows.select(F.col("z.i").alias("block_index"), F.col("z.h").alias("hash"))


def snapshot_id(volume: Column, at: Column | None = None) -> Column:
    """The default name of a snapshot: the volume's and the second (now)."""
    return F.concat_ws("_", volume, F.unix_timestamp(F.coalesce(at, F.current_timestamp()) if at is not None else F.current_timestamp()).cast("string"))


def header_choice(exists: Column, readable: Column, have: Column, want: Column, force: Column) -> Column:
    """What an export does about a header: new if there is none, reuse it if its block size fits, else new by force or an error."""
    return (
        F.when(~exists, "new")
        .when(~readable, F.when(force, "new").otherwise("error: unreadable"))
        .when(have == want, "reuse")
        .otherwise(F.when(force, "new").otherwise("error: incompatible block size"))
    )


def write(root: str, snapshot: str, map_: DataFrame, contents: DataFrame) -> None:
    """Contents, as `export` gives them by ranges of the hash, are appended once, in sorted files, so that reads by hash skip row groups; the map replaces the snapshot's own."""
    contents.sortWithinPartitions("hash").write.mode("append").parquet(f"{root}/content", compression="zstd")
    map_.write.mode("overwrite").parquet(f"{root}/map/snapshot={snapshot}")


def read(spark: SparkSession, root: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/map/snapshot={snapshot}"), spark.read.parquet(f"{root}/content")


def listed(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Names of the snapshots under root, of those that match."""
    names = spark.read.parquet(f"{root}/map").select(F.col("snapshot").cast("string").alias("snapshot")).distinct()
    return names.where(F.col("snapshot").rlike(pattern)) if pattern else names
