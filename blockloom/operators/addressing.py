"""Byte ranges on blocks: requests cut at block borders, partial writes merged, reads padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_requests(requests: DataFrame, size: int) -> DataFrame:
    """(offset, length) into pieces that each lie in one block: block_index, block_offset, piece_length. No shuffle."""
    last = F.expr(f"(offset + length - 1) div {size}")
    rows = requests.where("length > 0").withColumn("block_index", F.explode(F.sequence(F.expr(f"offset div {size}"), last)))
    start = F.greatest(F.col("offset"), F.col("block_index") * size)
    end = F.least(F.col("offset") + F.col("length"), (F.col("block_index") + 1) * size)
    return rows.withColumn("block_offset", start - F.col("block_index") * size).withColumn("piece_length", end - start)


#: Blocks that one task's ranges are cut by.
RANGE = 1 << 12


def ranged_pieces(requests: DataFrame, size: int) -> DataFrame:
    """`split_requests` with the pieces of a range of RANGE blocks (block_range) in one task: only offsets and lengths travel, and requests that reach over a border.

    An aggregation by block_range and block_index needs no further shuffle, and no table of a map task's blocks: where requests come in no order, that one has an entry for each piece.
    """
    border = size * RANGE
    rows = requests.where("length > 0").select("offset", "length").withColumn("block_range", F.explode(F.sequence(F.expr(f"offset div {border}"), F.expr(f"(offset + length - 1) div {border}"))))
    start = F.greatest(F.col("offset"), F.col("block_range") * border)
    part = rows.select("block_range", start.alias("offset"), (F.least(F.col("offset") + F.col("length"), (F.col("block_range") + 1) * border) - start).alias("length"))
    return split_requests(part.repartition("block_range"), size)


#: What a client may ask for (fixed values): reads and writes touch blocks; trim and flush are accepted without an effect on them.
COMMANDS = ("read", "write", "disconnect", "flush", "trim", "write_zeroes")


def violations(requests: DataFrame, volume_bytes: int, read_only: bool = False, most: int = 32 << 20, least: int = 1) -> DataFrame:
    """Why each request is refused, null if it is not: unknown command, write to a read-only volume, too long, out of bounds, off the least block's borders."""
    why = F.when(F.col("length") > most, "too long").when((F.col("offset") < 0) | (F.col("offset") + F.col("length") > volume_bytes), "out of bounds")
    if least > 1:
        why = why.when((F.col("offset") % least != 0) | (F.col("length") % least != 0), "not aligned")
    if "cmd" in requests.columns:
        if read_only:
            why = F.when(F.col("cmd").isin("write", "write_zeroes", "trim"), "read only").otherwise(why)
        why = F.when(~F.col("cmd").isin(*COMMANDS), "unknown command").otherwise(F.when(F.col("cmd").isin("flush", "disconnect"), None).otherwise(why))
    return requests.withColumn("violation", why)


def effective(requests: DataFrame) -> DataFrame:
    """The requests that change blocks: trim is accepted and does nothing."""
    return requests.where(F.col("cmd").isin("write", "write_zeroes"))


def merge_write(content: Column, data: Column, offset: Column, size: int) -> Column:
    """A block after a partial write: short or absent blocks are zero-extended to size first; a block longer than size fails the query."""
    short = F.octet_length(F.coalesce(content, F.lit(b""))) <= size
    whole = F.when(short, F.rpad(F.coalesce(content, F.lit(b"")), size, bytes(1))).otherwise(F.raise_error(F.lit(f"a block has more than {size} bytes")).cast("binary"))
    return F.overlay(whole, data, (offset + 1).cast("int"))


def merge_zeroes(content: Column, offset: Column, length: Column, size: int) -> Column:
    """A partial write of zeros; an absent block stays absent."""
    zeros = F.rpad(F.lit(b""), length.cast("int"), F.lit(bytes(1)))
    return F.when(content.isNotNull(), F.overlay(F.rpad(content, size, bytes(1)), zeros, (offset + 1).cast("int")))


def padded_read(content: Column, offset: Column, length: int) -> Column:
    """length bytes from offset; zeros past the content's end or where there is no block."""
    return F.rpad(F.substring(F.coalesce(content, F.lit(b"")), offset + 1, F.lit(length)), length, bytes(1))


def islands(indices: DataFrame) -> DataFrame:
    """Runs of consecutive block indices: first, last, how many. A window per range would need one task for all rows, so
    starts and ends are found by anti joins with the neighbours, then paired by rank within range partitions."""
    from .journal import numbered

    own = indices.select("block_index").distinct()
    starts = own.join(own.select((F.col("block_index") + 1).alias("block_index")), "block_index", "left_anti")
    ends = own.join(own.select((F.col("block_index") - 1).alias("block_index")), "block_index", "left_anti")
    a = numbered(starts, "block_index", "n").select("n", F.col("block_index").alias("first_index"))
    b = numbered(ends, "block_index", "n").select("n", F.col("block_index").alias("last_index"))
    return a.join(b, "n").select("first_index", "last_index", (F.col("last_index") - F.col("first_index") + 1).alias("n_blocks"))
