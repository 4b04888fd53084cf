"""How busy volumes are: operations and KiB a second, over whole spans or tumbling windows with idle ones filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(n: Column, total: Column, seconds: Column) -> list[Column]:
    """iops and kibs; spans under a second count as one, sums are exact beyond 64 bits."""
    span = F.greatest(seconds.cast("double"), F.lit(1.0))
    return [(n.cast("double") / span).alias("iops"), (total.cast("double") / 1024.0 / span).alias("kibs")]


def summed(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(0))


def io_rates(io: DataFrame, seconds: float) -> DataFrame:
    return io.agg(*rates(F.count("*"), summed("bytes"), F.lit(seconds)))


def windows(io: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Rates in tumbling windows of event time, by key: (keys, bucket, iops, kibs); bucket is the window's epoch second."""
    bucket = (F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds).cast("bigint")
    return io.groupBy(*keys, bucket.alias("bucket")).agg(*rates(F.count("*"), summed("bytes"), F.lit(seconds)))


def with_idle(windows_: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Adds windows without operations, from the first to the last of each key, as zeros."""
    span = windows_.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = span.select(*keys, F.explode(F.sequence("a", "b", F.lit(seconds).cast("bigint"))).alias("bucket"))
    filled = spine.join(windows_, [*keys, "bucket"], "left")
    return filled.select(*keys, "bucket", F.coalesce("iops", F.lit(0.0)).alias("iops"), F.coalesce("kibs", F.lit(0.0)).alias("kibs"))


def enriched(metrics: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    return metrics.join(tags, key, "left")


def resident(accesses: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """What a cache that evicts the least recently used key holds after all accesses: the `capacity` keys used last, the oldest last."""
    return accesses.groupBy(key).agg(F.max(order).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(capacity)
