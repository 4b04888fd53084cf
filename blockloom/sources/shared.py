"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a folder of this machine serves local masters; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("blockloom.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("blockloom.scratch.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written once as Parquet and read again: cuts the lineage, survives lost executors, and is the same at every read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._blockloom_path = path
    return out


def table_path(df: DataFrame) -> str | None:
    """Where `table` wrote what df reads."""
    return getattr(df, "_blockloom_path", None)


def drop(df: DataFrame) -> None:
    """Deletes a table that nothing reads any more."""
    if path := table_path(df):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
