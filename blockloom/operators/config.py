"""Configuration as tables: volumes, their clusters by role, what is wrong with them, what a change or a copy means.

volumes: (volume, type, block_size, size_gib); nbd: (volume, primary_cluster, template_cluster, slave_cluster, tlog_cluster); clusters:
(cluster_id, servers), servers an array of (address, db, state) whose order decides where blocks lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import TYPES, has_bits, valid_address, valid_block_size

ROLES = ("primary", "template", "slave")


def composed(volumes: DataFrame, nbd: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each volume with its primary cluster's servers (required) and those of its template and slave clusters (null if none)."""

    def role(name: str) -> DataFrame:
        return clusters.select(F.col("cluster_id").alias(f"{name}_cluster"), F.col("servers").alias(f"{name}_servers"))

    rows = volumes.join(nbd, "volume").join(role("primary"), "primary_cluster")
    return rows.join(role("template"), "template_cluster", "left").join(role("slave"), "slave_cluster", "left")


def storage_type(volumes: DataFrame) -> DataFrame:
    """Boot volumes are deduplicated, others are not; which may have a journal or a template is a bit of the type."""
    t = F.col("type")
    return volumes.withColumn("storage", F.when(has_bits(t, TYPES["boot"] & 1), "deduped").otherwise("nondeduped")).withColumn("journal", has_bits(t, 16)).withColumn("template", has_bits(t, 32))


def backends(volumes: DataFrame) -> DataFrame:
    """What a volume's store is made of: the kind of store, a template behind it, a journal around it."""
    rows = storage_type(volumes)
    behind = F.col("template") & F.col("template_cluster").isNotNull()
    return rows.select("volume", "storage", behind.alias("with_template"), (F.col("journal") & F.col("tlog_cluster").isNotNull()).alias("with_journal"), F.col("slave_cluster").isNotNull().alias("with_slave"))


def bad_servers(servers: Column) -> Column:
    """Whether a list of servers is missing, empty, or holds one without a valid address or with a negative database; servers that are gone for good don't count."""
    bad = F.exists(servers, lambda s: (F.coalesce(s["state"], F.lit("online")) != "rip") & (~F.coalesce(valid_address(s["address"]), F.lit(False)) | (F.coalesce(s["db"], F.lit(0)) < 0)))
    return servers.isNull() | (F.size(servers) < 1) | F.coalesce(bad, F.lit(False))


def violations(volumes: DataFrame) -> DataFrame:
    """The list of rules that each volume's composed configuration breaks."""
    size = F.coalesce(F.col("size_gib").cast("bigint"), F.lit(0))
    rules = [
        (F.col("volume").isNull() | (F.col("volume") == ""), "no id"),
        (~F.coalesce(valid_block_size(F.col("block_size")), F.lit(False)), "block size"),
        (size <= 0, "size"),
        ((size > 0) & (size * (1 << 30) < F.col("block_size")), "smaller than a block"),
        (~F.coalesce(F.col("type").isin(*TYPES.values()), F.lit(False)), "type"),
        (F.col("primary_cluster").isNull(), "no primary cluster"),
        *((bad_servers(F.col(f"{r}_servers")) & (F.col(f"{r}_cluster").isNotNull() if r != "primary" else F.lit(True)), f"{r} servers") for r in ROLES),
        (F.coalesce(F.size("slave_servers") < F.size("primary_servers"), F.lit(False)) & F.col("slave_servers").isNotNull(), "fewer slave servers than primary servers"),
    ]
    return volumes.withColumn("violations", F.array_compact(F.array(*(F.when(c, name) for c, name in rules))))


def changes(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A watch: of each key's events those that change its value; null values (bad events) don't count."""
    w = Window.partitionBy(key).orderBy(order)
    good = events.where(F.col(value).isNotNull())
    return good.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def composition_changes(events: DataFrame, order: str, required: str = "primary") -> DataFrame:
    """A watch over several sources of one volume: (volume, role, value) events, of which null ones are bad and don't count.

    Emits the composition (a column a role) whenever it is valid, i.e. has the required role, and differs from the one before.
    """
    w = Window.partitionBy("volume").orderBy(order)
    roles = [F.last(F.when(F.col("role") == r, F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(r) for r in ROLES]
    rows = events.where("value IS NOT NULL").select("volume", order, *roles).where(F.col(required).isNotNull())
    now = F.struct(*ROLES)
    return rows.withColumn("_before", F.lag(now).over(w)).where(~now.eqNullSafe(F.col("_before"))).drop("_before")


def same(a: Column, b: Column) -> Column:
    """Whether two configurations are the same in structure; the order of servers counts, absent ones equal none."""
    return a.eqNullSafe(b)


def all_servers(volumes: DataFrame) -> DataFrame:
    """The servers that a deletion has to visit: the primary cluster's, then the slave cluster's."""
    none = F.array().cast("array<struct<address:string,db:int,state:string>>")
    return volumes.withColumn("all_servers", F.concat("primary_servers", F.coalesce("slave_servers", none)))


def exported(served: DataFrame, volumes: DataFrame) -> DataFrame:
    """(server, volume, block_size, size_bytes) of the volumes that each block server exports: those named in its list that have a configuration."""
    return served.join(volumes.select("volume", "block_size", "size_gib"), "volume").select("server", "volume", "block_size", (F.col("size_gib").cast("bigint") * (1 << 30)).alias("size_bytes"))


def imported(have: DataFrame, want: DataFrame, force: bool = False) -> DataFrame:
    """What an import of (key, value) does to what is there: written, unchanged, or a conflict to be asked about (overwritten by force)."""
    rows = want.select("key", F.col("value").alias("_want")).join(have.select("key", F.col("value").alias("_have"), F.lit(True).alias("_there")), "key", "left")
    done = F.when(F.col("_there").isNull(), "written").when(F.col("_have").eqNullSafe(F.col("_want")), "unchanged").otherwise("overwritten" if force else "conflict")
    return rows.select("key", done.alias("outcome"))


def clone_action(pairs: DataFrame) -> DataFrame:
    """What a copy of a volume does about its journal. pairs: (source_type, source_tlog, target_type, target_tlog, source_store, target_store); a tlog or store is a cluster's name or null.

    skip: the target has no journal; generate: the source has none; reference or full: both have one, in the same store or not.
    """
    target = has_bits(F.col("target_type"), 16) & F.col("target_tlog").isNotNull()
    source = has_bits(F.col("source_type"), 16) & F.col("source_tlog").isNotNull()
    return pairs.withColumn("action", F.when(~F.coalesce(target, F.lit(False)), "skip").when(~source, "generate").when(F.col("source_store").eqNullSafe(F.col("target_store")), "reference").otherwise("full"))


def with_journal(volumes: DataFrame, journals: DataFrame) -> DataFrame:
    return volumes.join(journals.select("volume"), "volume", "left_semi")


def without_journal(volumes: DataFrame, journals: DataFrame) -> DataFrame:
    return volumes.join(journals.select("volume"), "volume", "left_anti")


def journals_valid(volumes: DataFrame) -> DataFrame:
    """How many volumes have a journal configured (one row); none at all is an error."""
    n = F.count_if(has_bits(F.col("type"), 16) & F.col("tlog_cluster").isNotNull())
    return volumes.agg(n.alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no volume has a journal")).cast("bigint")).alias("n"))


def collected_errors(errors: DataFrame, *keys: str) -> DataFrame:
    """All messages of a key in one, sorted and joined by '; '; null messages are no errors. Equal messages count once, so a key's text stays short."""
    return errors.where("message IS NOT NULL").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("errors"))
