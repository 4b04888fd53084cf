"""Block stores: content-addressed (index -> hash -> content), plain, and overlay; templates behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SECTOR


def is_zero(content: Column) -> Column:
    """Null, or nothing but zero bytes, whatever the length."""
    return content.isNull() | ~F.hex(content.cast("binary")).rlike("[1-9A-F]")


def without_zero(blocks: DataFrame) -> DataFrame:
    """Zero is absent: such blocks are not stored."""
    return blocks.where(~is_zero(F.col("content")))


def dedup_write(blocks: DataFrame, content: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, new content): what a write does to the volume's index (hash null: a block of zeros, which is deleted), and one copy of each content that the store does not hold yet."""
    hashed = blocks.withColumn("hash", F.when(~is_zero(F.col("content")), F.sha2(F.col("content").cast("binary"), 256)))
    fresh = hashed.where("hash IS NOT NULL").select("hash", "content").dropDuplicates(["hash"])
    if content is not None:
        fresh = fresh.join(content.select("hash"), "hash", "left_anti")
    keys = [c for c in ("volume", "block_index") if c in blocks.columns]
    return hashed.select(*keys, "hash"), fresh


def applied(lba: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """The index after changes (hash null: delete), one a block at most."""
    return upsert(lba, changes, *keys).where("hash IS NOT NULL")


def plain_write(blocks: DataFrame, written: DataFrame, *keys: str) -> DataFrame:
    """A store without deduplication after a write, one of a block at most: blocks of zeros are deleted."""
    return without_zero(upsert(blocks, written, *keys))


def overlay_write(base: DataFrame, over: DataFrame, touched: DataFrame, written: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, overlay, touched) after a write: the overlay takes the blocks, their bits are set for good, the base's own copies go."""
    marks = touched.select("block_index").union(written.select("block_index")).distinct()
    return deleted(base, written.select("block_index")), plain_write(over, written, "block_index"), marks


def overlay_delete(base: DataFrame, over: DataFrame, touched: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, overlay) after a delete: where the bit is set the overlay loses the block, elsewhere the base does."""
    mine = gone.select("block_index").join(touched.select("block_index"), "block_index", "left_semi")
    return deleted(base, gone.select("block_index").join(touched.select("block_index"), "block_index", "left_anti")), deleted(over, mine)


def deleted(store: DataFrame, gone: DataFrame, key: str = "block_index") -> DataFrame:
    return store.join(gone.select(key), key, "left_anti")


def dedup_stats(blocks: DataFrame) -> DataFrame:
    """n_blocks and n_distinct contents, as one row."""
    return blocks.agg(F.count("*").alias("n_blocks"), F.count_distinct("hash").alias("n_distinct"))


def shared_contents(blocks: DataFrame) -> DataFrame:
    """Contents that several blocks have: how many, and the first."""
    return blocks.groupBy("hash").agg(F.count("*").alias("n"), F.min("block_index").alias("first_index")).where("n > 1")


def to_bitmap(indices: DataFrame) -> DataFrame:
    """(word, bits): the indices as a packed bitmap of 64-bit words, those without a bit left out. Partial aggregation, one shuffle by word."""
    bit = F.expr("shiftleft(1L, CAST(block_index % 64 AS INT))")
    return indices.groupBy(F.expr("block_index div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def from_bitmap(bitmap: DataFrame) -> DataFrame:
    rows = bitmap.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return rows.where(F.getbit("bits", F.col("p")) == 1).select((F.col("word") * 64 + F.col("p")).alias("block_index"))


def test_bits(indices: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Whether each index has its bit set."""
    rows = indices.withColumn("word", F.expr("block_index div 64")).join(bitmap, "word", "left")
    return rows.withColumn("is_set", F.coalesce(F.getbit("bits", (F.col("block_index") % 64).cast("int")) == 1, F.lit(False))).drop("word", "bits")


def bitmap_bytes(bitmap: DataFrame, words: int = 512) -> DataFrame:
    """(page, bytes): the bitmap as it is stored, in pages of `words` words, gzipped."""
    from ..functions.codecs import gzip_compress

    at = (F.col("word") % words).cast("int")
    pages = bitmap.groupBy(F.expr(f"word div {words}").alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("p"), F.col("bits").alias("b")))).alias("m"))
    hexed = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))), 16, "0"))
    return pages.select("page", gzip_compress(F.unhex(F.array_join(hexed, ""))).alias("bytes"))


def bitmap_of_bytes(pages: DataFrame, words: int = 512) -> DataFrame:
    from ..functions.codecs import gzip_decompress

    raw = pages.select("page", F.hex(gzip_decompress(F.col("bytes"))).alias("h"))
    rows = raw.select("page", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.substring("h", i * 16 + 1, F.lit(16)))).alias("p", "w")).where(F.col("w") != "0" * 16)
    high, low = (F.conv(F.substring("w", a, 8), 16, 10).cast("bigint") for a in (1, 9))
    return rows.select((F.col("page") * words + F.col("p")).alias("word"), F.shiftleft(high, 32).bitwiseOR(low).alias("bits"))


def dedup_read(lba: DataFrame, content: DataFrame) -> DataFrame:
    return lba.join(content, "hash").select(*[c for c in lba.columns if c != "hash"], "content")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new over old, by key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def with_template(lba: DataFrame, primary: DataFrame, template: DataFrame, key: str = "hash") -> DataFrame:
    """Content from the primary store, else from the template's; `origin` says which. Rows that neither has are null."""
    p = primary.select(key, F.col("content").alias("_p"), F.lit(True).alias("_in_p"))
    t = template.select(key, F.col("content").alias("_t"), F.lit(True).alias("_in_t"))
    origin = F.when(F.col("_in_p"), "primary").when(F.col("_in_t"), "template")
    return lba.join(p, key, "left").join(t, key, "left").select(*lba.columns, F.when(F.col("_in_p"), F.col("_p")).otherwise(F.col("_t")).alias("content"), origin.alias("origin"))


def copy_back(lba: DataFrame, primary: DataFrame, template: DataFrame, key: str = "hash") -> DataFrame:
    """What reads through the template would copy to the primary store."""
    return template.join(lba.select(key).distinct(), key, "left_semi").join(primary.select(key), key, "left_anti")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """A block that the overlay has touched is the overlay's, even when that is null; any other is the base's."""
    b = base.select("block_index", F.col("content").alias("_base"))
    o = over.select("block_index", F.col("content").alias("_over"), F.lit(True).alias("_touched"))
    return b.join(o, "block_index", "full").select("block_index", F.when(F.col("_touched"), F.col("_over")).otherwise(F.col("_base")).alias("content"))


def union_indices(*stores: DataFrame) -> DataFrame:
    out = stores[0].select("block_index")
    for s in stores[1:]:
        out = out.union(s.select("block_index"))
    return out.distinct()


def to_sectors(lba: DataFrame, width: int = SECTOR) -> DataFrame:
    """Packs hashes by sector: `hashes` has `width` places, null where there is no block. Sectors without blocks don't appear."""
    place = (F.col("block_index") % width).cast("int")
    packed = lba.groupBy(F.expr(f"block_index div {width}").alias("sector")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("p"), F.col("hash").alias("h")))).alias("m"))
    return packed.select("sector", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at(F.col("m"), i)).alias("hashes"))


def from_sectors(sectors: DataFrame, width: int = SECTOR) -> DataFrame:
    return sectors.select("sector", F.posexplode("hashes").alias("p", "hash")).where("hash IS NOT NULL").select((F.col("sector") * width + F.col("p")).alias("block_index"), "hash")


def orphans(content: DataFrame, lba: DataFrame) -> DataFrame:
    """Contents that no index refers to any more."""
    return content.join(lba.select("hash"), "hash", "left_anti")


def volumes(blocks: DataFrame, pattern: str | None = None) -> DataFrame:
    out = blocks.select("volume")
    return (out.where(F.col("volume").rlike(pattern)) if pattern else out).distinct()


def existing(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the wanted volumes, whether any server has a key for each. keys: (server_index, volume)."""
    there = keys.select("volume").distinct().withColumn("_there", F.lit(True))
    return wanted.select("volume").join(there, "volume", "left").select("volume", F.coalesce("_there", F.lit(False)).alias("found"))


def migrated_keys(keys: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    """(old_key, new_key) of the keys that have no known prefix yet, each once: they get the prefix of their kind."""
    from ..functions.values import PREFIXES, storage_key

    known = "^(" + "|".join(sorted(PREFIXES.values(), key=len, reverse=True)) + ")"
    legacy = keys.select("key").distinct().where(~F.col("key").rlike(known))
    if pattern:
        legacy = legacy.where(F.col("key").rlike(pattern))
    return legacy.select(F.col("key").alias("old_key"), storage_key(kind, F.col("key")).alias("new_key"))


def read_blocks(store: DataFrame, wanted: DataFrame, key: str = "block_index") -> DataFrame:
    """Point reads: the wanted indices with their content, null where there is none."""
    return wanted.select(key).join(store.select(key, "content"), key, "left")


def corrupted(content: DataFrame) -> DataFrame:
    """Contents whose hash is not the one they are stored under."""
    return content.where(F.sha2(F.col("content").cast("binary"), 256) != F.col("hash"))
