"""Connected components of a links table, without gathering links anywhere: large-star and small-star rounds in DataFrames.

Each round links every node's larger (then smaller-or-equal) neighbours to its least neighbour; the number of rounds is
logarithmic in the size of a component. Each round's links are written to the shared folder, which cuts the lineage,
and take the place of the round before's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop
from .common import table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    joined = both.join(least, "u")
    if large:  # neighbours larger than u go to m
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to m
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link with the least node of its component."""
    now = table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "components")
    before = None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        now, last = table(_star(_star(now, True), False), "components"), now
        drop(last)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
