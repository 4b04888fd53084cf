"""Changing the block size of a volume, in either direction, with zero blocks left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import is_zero


def _padded(content: Column, size: int) -> Column:
    return F.rpad(content, size, bytes(1))


def inflate(blocks: DataFrame, size: int, ratio: int) -> DataFrame:
    """ratio blocks of `size` bytes into one; gaps and the tail are zeros. Partial aggregation by target block, one shuffle."""
    at = (F.col("block_index") % ratio).cast("int")
    groups = blocks.groupBy(F.expr(f"block_index div {ratio}").alias("big")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("o"), _padded(F.col("content"), size).alias("c")))).alias("m"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(ratio - 1)), lambda i: F.hex(F.coalesce(F.try_element_at(F.col("m"), i), F.lit(bytes(size)))))
    return groups.select(F.col("big").alias("block_index"), F.unhex(F.array_join(parts, "")).alias("content"))


def deflate(blocks: DataFrame, size: int, ratio: int) -> DataFrame:
    """One block into ratio blocks of `size` bytes; zero slices are dropped, short blocks zero-extended. No shuffle."""
    rows = blocks.select("block_index", _padded(F.col("content"), size * ratio).alias("content"), F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("o"))
    cut = rows.select((F.col("block_index") * ratio + F.col("o")).alias("block_index"), F.substring("content", F.col("o") * size + 1, F.lit(size)).alias("content"))
    return cut.where(~is_zero(F.col("content")))


def rechunk(blocks: DataFrame, source_size: int, target_size: int) -> DataFrame:
    if source_size == target_size:
        return blocks.where(~is_zero(F.col("content")))
    if max(source_size, target_size) % min(source_size, target_size):
        raise ValueError("one block size must divide the other")
    if source_size < target_size:
        return inflate(blocks, source_size, target_size // source_size)
    return deflate(blocks, target_size, source_size // target_size)
