"""The journal as a stream: ordered ingestion, segments, replica, metrics, status events. Each has a batch twin in operators/."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.journal import FLUSH_SECONDS, FLUSH_SIZE
from ..schemas import SEGMENT, SET

ROW = "volume string, seq bigint, block_index bigint, op int, ts bigint, data string"
COLUMNS = ("volume", "seq", "block_index", "op", "ts", "data")
#: Rows that a task gives away at once, and sequence numbers that are judged by one.
PIECE, CHUNK = 10_000, 1 << 16


def ordered(stream: DataFrame, most_waiting: int = 100_000, after: DataFrame | None = None) -> DataFrame:
    """Each volume's rows in exactly sequence order, each once, from 1, or behind the last flushed one (volume, seq) of `after`.

    A row that comes twice, or late, is dropped. A row that comes early waits in state until those before it have come (a receiver
    with a resending client would drop it instead; a stream can't ask again). More than most_waiting waiting rows fail the query: a
    volume's waiting rows are one task's memory. `ordered_sink` has them on disk, for rows that come in no order at all.
    """
    rows = stream.select(*COLUMNS)
    if after is None:
        rows = rows.withColumn("flushed", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(after.groupBy("volume").agg(F.max("seq").alias("flushed")), "volume", "left").withColumn("flushed", F.coalesce("flushed", F.lit(0)))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, waiting = (state.get[0], dict(zip(state.get[1], zip(*state.get[2:], strict=True), strict=True))) if state.exists else (None, {})
        for part in parts:
            if expected is None and len(part):
                expected = int(part["flushed"].iloc[0]) + 1
            for row in part[list(COLUMNS[1:])].itertuples(index=False):
                if row[0] >= expected:
                    waiting.setdefault(int(row[0]), tuple(row[1:]))
            out = []
            while expected in waiting:
                out.append((key[0], expected, *waiting.pop(expected)))
                expected += 1
                if len(out) == PIECE:
                    yield pd.DataFrame(out, columns=list(COLUMNS))
                    out = []
            if out:
                yield pd.DataFrame(out, columns=list(COLUMNS))
        if len(waiting) > most_waiting:
            raise RuntimeError(f"{len(waiting)} rows of {key[0]} wait for {expected}")
        rest = sorted(waiting)
        columns = [[waiting[s][i] for s in rest] for i in range(4)]
        state.update((expected, rest, *([None if pd.isna(x) else (int(x) if i < 3 else x) for x in c] for i, c in enumerate(columns))))

    held = "expected bigint, seqs array<bigint>, idx array<bigint>, ops array<bigint>, tss array<bigint>, datas array<string>"
    return rows.groupBy("volume").applyInPandasWithState(step, ROW, held, "append", GroupStateTimeout.NoTimeout)


def segments(stream: DataFrame, size: int = FLUSH_SIZE, seconds: float | None = FLUSH_SECONDS) -> DataFrame:
    """(volume, segment_no, first_seq, last_seq, n) of ordered rows: a segment at `size` rows, or when `seconds` of processing time go by without one. The state is what the open segment holds.

    A timer keeps a query running, even one that should end with what is available; without it (seconds None) only full segments are written.
    """
    timeout = GroupStateTimeout.NoTimeout if seconds is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, n = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((key[0], number, first, first + n - 1, n))
                number, n = number + 1, 0
        else:
            for seq in sorted(s for part in parts for s in part["seq"].tolist()):
                first, n = (first, n + 1) if n else (seq, 1)
                if n == size:
                    out.append((key[0], number, first, seq, n))
                    number, n = number + 1, 0
        state.update((number, first, n))
        if n and seconds is not None:
            state.setTimeoutDuration(int(seconds * 1000))
        if out:
            yield pd.DataFrame(out, columns=["volume", "segment_no", "first_seq", "last_seq", "n"])

    made = "volume string, segment_no bigint, first_seq bigint, last_seq bigint, n bigint"
    return stream.select("volume", "seq").groupBy("volume").applyInPandasWithState(step, made, "number bigint, first bigint, n bigint", "append", timeout)


def segment_sink(path: str, size: int = SEGMENT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes ordered rows with their segment number; the same batch again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("segment_no", F.floor((F.col("seq") - 1) / size).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers n of the complete tables path/n or path/batch=n, ascending."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [x.getPath() for x in fs.listStatus(fs_path)]
    number = {p: p.getName().removeprefix("batch=") for p in names}
    return sorted(int(n) for p, n in number.items() if n.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


HEADS = "volume string, expected bigint"


def _with_head(rows: DataFrame, heads: DataFrame, name: str, otherwise: int) -> DataFrame:
    at = heads.select(F.col("volume").alias("_volume"), F.col("expected").alias(name))
    return rows.join(at, F.col("volume").eqNullSafe(F.col("_volume")), "left").drop("_volume").withColumn(name, F.coalesce(name, F.lit(otherwise).cast("bigint")))


def _reached(rows: DataFrame, chunk: int) -> DataFrame:
    """(volume, reach) of rows with volume, part (seq div chunk), seq and expected, none behind what is expected: the first number that is missing.

    Chunks of numbers are judged side by side; then a short pass over a volume's chunks, one row each, links those that are whole.
    """
    start = F.greatest("expected", F.col("part") * chunk)
    seen = rows.select("volume", "part", "expected", "seq").repartition("volume", "part").groupBy("volume", "part", "expected", "seq").agg(F.lit(1).alias("_one"))
    at = seen.withColumn("n", F.row_number().over(Window.partitionBy("volume", "part").orderBy("seq")))
    ends = at.groupBy("volume", "part", "expected").agg(F.count_if(F.col("seq") - start == F.col("n") - 1).alias("run")).withColumn("end", start + F.col("run"))
    w = Window.partitionBy("volume").orderBy("part")
    linked = F.col("part") - F.expr(f"expected div {chunk}") == F.row_number().over(w) - 1
    ends = ends.withColumn("linked", linked).withColumn("whole", F.col("linked") & (F.col("end") == (F.col("part") + 1) * chunk))
    so_far = F.coalesce(F.min("whole").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    ends = ends.withColumn("so_far", so_far)
    return ends.groupBy("volume").agg(F.coalesce(F.max(F.when(F.col("linked") & F.col("so_far"), F.col("end"))), F.max("expected")).alias("reach"))


def ordered_sink(path: str, after: DataFrame | None = None, chunk: int = CHUNK) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that does what `ordered` does, with early rows waiting in tables: any number, in no order, in bounded memory.

    A batch takes the rows that wait and its own, drops what is behind or comes twice (what came first stays), finds how far each
    volume's numbers go without a gap, and writes the rows once, those up to there as released, sorted by volume and seq within
    files. It starts from what the batch before left and runs its source twice; a batch that runs again replaces what it wrote.
    """
    if after is not None:
        after.groupBy("volume").agg((F.max("seq") + 1).alias("expected")).write.mode("overwrite").parquet(f"{path}/start")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        past = [n for n in _versions(spark, f"{path}/rows") if n < number]
        sent = batch.select(*COLUMNS, F.lit(1).alias("fresh"))
        if past:
            heads = spark.read.schema(HEADS).parquet(f"{path}/heads/{past[-1]}")
            sent = sent.union(_arrived(spark, path, past[-1:]).where("NOT released").select(*COLUMNS, F.lit(0)))
        elif after is not None:
            heads = spark.read.schema(HEADS).parquet(f"{path}/start")
        else:
            heads = spark.createDataFrame([], HEADS)
        kept = _with_head(sent, heads, "expected", 1).where("seq >= expected").withColumn("part", F.expr(f"seq div {chunk}"))
        moved = _reached(kept, chunk).withColumnRenamed("volume", "_moved")
        heads = heads.join(moved, F.col("volume").eqNullSafe(F.col("_moved")), "full")
        heads = heads.select(F.coalesce("volume", "_moved").alias("volume"), F.coalesce("reach", "expected").alias("expected"))
        heads.write.mode("overwrite").parquet(f"{path}/heads/{number}")
        first = F.min_by(F.struct(*COLUMNS[2:]), "fresh").alias("v")
        rows = kept.repartition("volume", "part").groupBy("volume", "part", "seq").agg(first).select("volume", "seq", "v.*")
        rows = _with_head(rows, spark.read.schema(HEADS).parquet(f"{path}/heads/{number}"), "reach", 0).withColumn("released", F.col("seq") < F.col("reach"))
        rows.select(*COLUMNS, "released").sortWithinPartitions("released", "volume", "seq").write.mode("overwrite").partitionBy("released").parquet(f"{path}/rows/batch={number}")
        for n in past[:-1]:  # if this batch runs again it needs the last one's
            _delete(spark, f"{path}/rows/batch={n}/released=false")

    return write


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _arrived(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    held = f"{ROW}, batch bigint, released boolean"
    rows = spark.read.schema(held).option("basePath", f"{path}/rows")
    return rows.parquet(*(f"{path}/rows/batch={n}" for n in numbers)) if numbers else spark.createDataFrame([], held)


def ordered_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `ordered_sink` has released so far."""
    return _arrived(spark, path, _versions(spark, f"{path}/rows")).where("released").select(*COLUMNS)


VERSION = "volume string, block_index bigint, op int, data string, seq bigint"


def replica_rows(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest operation of each block of each volume, from the last base and the changes behind it."""
    base = max((n for n in _versions(spark, f"{path}/base") if upto is None or n <= upto), default=None)
    parts = [f"{path}/changes/{n}" for n in _versions(spark, f"{path}/changes") if (base is None or n > base) and (upto is None or n <= upto)]
    parts += [f"{path}/base/{base}"] if base is not None else []
    rows = spark.read.schema(VERSION).parquet(*parts) if parts else spark.createDataFrame([], VERSION)
    return rows.groupBy("volume", "block_index").agg(F.max_by(F.struct("op", "data", "seq"), "seq").alias("v")).select("volume", "block_index", "v.*")


def replica(spark: SparkSession, path: str) -> DataFrame:
    """The replica's blocks: volume, block_index, data."""
    return replica_rows(spark, path).where(F.col("op") == SET).select("volume", "block_index", "data")


def synced(spark: SparkSession, path: str) -> DataFrame:
    """The last seq that the replica has of each volume."""
    return replica_rows(spark, path).groupBy("volume").agg(F.max("seq").alias("synced"))


def replica_sink(path: str, compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a replica of all volumes in the stream.

    A batch writes the last operation of each block that it touches, and nothing else; every compact_every batches changes and
    base are folded into a new base. A batch that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("volume", "block_index").agg(F.max_by(F.struct("op", "data", "seq"), "seq").alias("v")).select("volume", "block_index", "v.*")
        last.select("volume", "block_index", F.col("op").cast("int").alias("op"), "data", "seq").write.mode("overwrite").parquet(f"{path}/changes/{number}")
        if number and number % compact_every == 0:
            replica_rows(batch.sparkSession, path, number).write.mode("overwrite").parquet(f"{path}/base/{number}")

    return write


def replay_with(journal: DataFrame, callback: Callable[[int], None], apply: Callable[[DataFrame], None], start: int = 0, end: int = 0, step: int = 100_000) -> int:
    """Applies a journal's rows in runs of `step` sequence numbers, and after each run tells the callback the last seq; gives the last seq of all (0: none)."""
    from ..operators.journal import bounded

    rows = bounded(journal, "seq", start, end)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    if high is None:
        return 0
    for a in range(low, high + 1, step):
        part = rows.where((F.col("seq") >= a) & (F.col("seq") < a + step))
        apply(part)
        callback(min(a + step - 1, high))
    return high


def wait_synced(last: Callable[[], int], seq: int, timeout: float = 240.0, every: float = 0.5) -> int:
    """Waits until last() has reached seq, and gives it; TimeoutError after `timeout` seconds (4 minutes)."""
    end = time.monotonic() + timeout
    while (at := last()) < seq:
        if time.monotonic() >= end:
            raise TimeoutError(f"synced up to {at} of {seq}")
        time.sleep(every)
    return at


def stop_all(queries: Iterable[StreamingQuery], timeout: float = 60.0) -> None:
    """Lets queries take what is there, then stops them; all their errors become one."""
    errors = []
    for q in queries:
        try:
            if q.isActive:
                q.processAllAvailable()
                q.stop()
                q.awaitTermination(timeout)
            if q.exception() is not None:
                errors.append(f"{q.name or q.id}: {q.exception()}")
        except Exception as e:  # one query's failure must not keep the others running
            errors.append(f"{q.name or q.id}: {e}")
    if errors:
        raise RuntimeError("; ".join(errors))


def json_sink(path: str, subject: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes rows as status events: lines of JSON with their subject."""

    def write(batch: DataFrame, number: int) -> None:
        status_events(batch, subject).write.mode("overwrite").text(f"{path}/{number}")

    return write


def status_events(rows: DataFrame, subject: str) -> DataFrame:
    """(value): one JSON object a row, with the subject first and absent values left out."""
    return rows.select(F.to_json(F.struct(F.lit(subject).alias("subject"), F.struct(*rows.columns).alias("data"))).alias("value"))


def metric_windows(stream: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """Rates by tumbling window of event time; rows later than `late` are dropped."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = rows.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    return made.select(F.unix_seconds("window.start").alias("bucket"), (F.col("n") / F.lit(float(seconds))).alias("iops"), (F.col("total") / 1024.0 / F.lit(float(seconds))).alias("kibs"))


def lag(journal: DataFrame, synced_: DataFrame) -> DataFrame:
    """How far each volume's replica is behind its journal."""
    head = journal.groupBy("volume").agg(F.max("seq").alias("last_seq"))
    at = synced_.groupBy("volume").agg(F.max("synced").alias("synced"))
    return head.join(at, "volume", "left").select("volume", "last_seq", F.coalesce("synced", F.lit(0)).alias("synced"), (F.col("last_seq") - F.coalesce("synced", F.lit(0))).alias("lag"))
