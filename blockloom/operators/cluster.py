"""Servers: who owns a block, who is up, what moves when their number changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sharding import shard_by_hash


def assigned(rows: DataFrame, servers: DataFrame, shard: str = "server_index") -> DataFrame:
    """Rows with their server. A cluster's servers number in the hundreds (checked): they are broadcast."""
    if servers.limit(10_001).count() > 10_000:
        return rows.join(servers, shard)
    return rows.join(F.broadcast(servers), shard)


def moved(rows: DataFrame, old: int, new: int, digest: str = "hash") -> DataFrame:
    """Blocks by old and new shard when a volume is cloned to a cluster of another size."""
    return rows.groupBy(shard_by_hash(F.col(digest), old).alias("old_shard"), shard_by_hash(F.col(digest), new).alias("new_shard")).agg(F.count("*").alias("n_blocks"))


def clone_case(source_servers: int, target_servers: int | None) -> str:
    """same cluster (no target), same count (server by server), or reshard."""
    if target_servers is None:
        return "same cluster"
    return "same count" if target_servers == source_servers else "reshard"


def cloned(rows: DataFrame, source_servers: int, target_servers: int | None = None, unit: int = 1) -> DataFrame:
    """A volume's rows with the servers they are read from and written to: `unit` consecutive indices (a sector's 128 for a deduplicated volume, else 1) stay together and go by their number."""
    number = F.expr(f"block_index div {unit}")
    target = source_servers if target_servers is None else target_servers
    return rows.withColumn("source_server", number % source_servers).withColumn("target_server", number % target)


def copied_counts(cloned_: DataFrame, unit: int = 1) -> DataFrame:
    """How many units each server gave to each: what a copy reports, server by server."""
    return cloned_.groupBy("source_server", "target_server").agg(F.count_distinct(F.expr(f"block_index div {unit}")).alias("n"))


def total(counts: DataFrame, what: str = "nothing was copied") -> DataFrame:
    """The sum of per-server counts; zero is an error."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(n.alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit(what)).cast("bigint")).alias("n"))


def correlated(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies of many servers in the order of the requests (ordinal); null where none has come."""
    return requests.join(replies.select("ordinal", "reply"), "ordinal", "left").orderBy("ordinal")


def batches(actions: DataFrame, size: int = 1000) -> DataFrame:
    """(server_index, batch, actions): what each server is sent, in order and at most `size` at a time."""
    from .journal import numbered

    by = F.struct("server_index", "ordinal")
    placed = numbered(actions.withColumn("_by", by), "_by", "_n").drop("_by")
    first = placed.groupBy("server_index").agg(F.min("_n").alias("_first"))
    parted = placed.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, "server_index").withColumn("batch", F.expr(f"(_n - _first) div {size}"))
    return parted.groupBy("server_index", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "action"))), lambda x: x["action"]).alias("actions"))


def states(changes: DataFrame, order: str) -> DataFrame:
    """Effective state changes of each server: rip is final, repeats are ignored. Few servers may have many changes: no task gets all of one server's."""
    from .journal import before

    end = changes.groupBy("server_index").agg(F.min(F.when(F.col("state") == "rip", F.col(order))).alias("_end"))
    alive = changes.join(end, "server_index").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    rows = alive.select(*changes.columns, F.struct("server_index", order).alias("_by"), F.struct("server_index", "state").alias("_now"))
    return before(rows, "_now", "_by").where(~F.col("_now").eqNullSafe(F.col("_before"))).select(*changes.columns)


def counts(servers: DataFrame) -> DataFrame:
    """How many servers each cluster has, and how many of them are online, out of order and gone for good."""
    state = F.col("state")
    return servers.groupBy("cluster").agg(
        F.count("*").alias("n_servers"), F.count_if(state == "online").alias("n_online"), F.count_if(~state.isin("online", "rip")).alias("n_failing"), F.count_if(state == "rip").alias("n_rip")
    )


def first_online(servers: DataFrame) -> DataFrame:
    return servers.groupBy("cluster").agg(F.min_by(F.when(F.col("state") == "online", F.col("address")), F.when(F.col("state") == "online", F.col("server_index"))).alias("address"), F.count_if(F.col("state") == "online").alias("n_online"))


def operational(servers: DataFrame) -> DataFrame:
    """online may be used; rip is skipped; any other state is an error for whoever needs that server."""
    return servers.withColumn("usable", F.when(F.col("state") == "online", F.lit(True)).when(F.col("state") == "rip", F.lit(False)))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """The i-th server of one cluster with the i-th of another of the same size."""
    r = right.select("server_index", F.col("address").alias("target_address"), F.col("db").alias("target_db"))
    return left.join(r, "server_index", "full").withColumn("target_address", F.when(F.col("address").isNotNull() & F.col("target_address").isNotNull(), F.col("target_address")).otherwise(F.raise_error(F.lit("clusters differ in size"))))
