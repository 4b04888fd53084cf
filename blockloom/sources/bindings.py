"""The driver's tables seen as the engine's: a journal, block stores, byte-range requests, servers and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DELETE, SET


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: seq is the id plus 1, the user's id the block, an error a delete, the properties the content."""
    dead = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("block_index"), F.when(dead, DELETE).otherwise(SET).alias("op"), F.when(~dead, F.col("props")).alias("data"), "ts"
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the id is the index, the text the content."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_index"), F.col("text").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_orderkey") * 4096 + F.col("l_linenumber") * 512).cast("bigint").alias("offset"), (F.col("l_quantity") * 512).cast("bigint").alias("length")
    )


#: Size of the blocks that texts are cut into, and the indices that each text has for itself.
BLOCK, STRIDE = 600, 1 << 16


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every text cut into blocks of 600 bytes, the last one of a text as long as it is."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("t")).where(F.octet_length("t") > 0)
    numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(octet_length(t) - 1) div {BLOCK}"))
    cut = F.transform(numbers, lambda o: F.struct(o.alias("o"), F.substring("t", (o * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("content")))
    return rows.select("doc_id", F.explode(cut).alias("p")).select((F.col("doc_id") * STRIDE + F.col("p.o")).alias("block_index"), "p.content")


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier: each nation a cluster, its suppliers the servers in order; some are offline, gone for good, or badly configured."""
    k = F.col("s_suppkey")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("cluster"), (F.row_number().over(w) - 1).alias("server_index"),
        F.when(k % 13 != 12, F.concat(F.lit("10.0.0."), k.cast("string"), F.lit(":16379"))).otherwise("").alias("address"), (k % 5 - F.when(k % 29 == 28, 9).otherwise(0)).cast("int").alias("db"),
        F.when(k % 17 == 3, "rip").when(k % 4 == 2, "offline").otherwise("online").alias("state"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("server_index", F.struct("address", "db", "state").alias("s"))))
    return servers(spark, sf_dir).groupBy(F.col("cluster").alias("cluster_id")).agg(F.transform(listed, lambda x: x["s"]).alias("servers"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer: each a volume; types, sizes and block sizes vary, some are wrong."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, (49, 50, 4, 8, 7))), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_name").alias("volume"), kind.alias("type"), F.when(k % 7 == 0, 1000).otherwise(F.lit(512) * F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (k % 4 + 1).cast("int"))).alias("block_size"), (k % 11).cast("int").alias("size_gib"))


def nbd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer: the clusters of each volume: its nation's, some with the next nation's as template and the one after as slave, half with a journal."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    other = [F.concat(F.lit("n"), ((n + i) % 25).cast("string")) for i in range(3)]
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("volume"), other[0].alias("primary_cluster"), F.when(k % 3 == 0, other[1]).alias("template_cluster"), F.when(k % 4 == 0, other[2]).alias("slave_cluster"),
        F.when(k % 2 == 0, F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tlog_cluster"),
    )


def volume_journal(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """events as the journals of n volumes (the user's id modulo n), each with its own numbers from 1; ts in epoch microseconds."""
    w = Window.partitionBy("volume").orderBy("event_id")
    dead = F.col("event_type") == "error"
    rows = read(spark, sf_dir, "events").withColumn("volume", F.concat(F.lit("v"), (F.col("user_id") % n).cast("string")))
    return rows.select(
        "volume", F.row_number().over(w).cast("bigint").alias("seq"), F.col("user_id").alias("block_index"), F.when(dead, DELETE).otherwise(SET).alias("op"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.when(~dead, F.col("props")).alias("data"),
    )
