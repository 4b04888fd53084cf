"""Each stream gives what its batch twin gives."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import journal, metrics
from blockloom.streaming import ingest


def rows_of(n):
    rng = random.Random(2)
    return [(v, s, rng.randrange(9), 2 if rng.random() < 0.2 else 1, s * 1000, f"{v}{s}") for v in "ab" for s in range(1, n + 1)]


def feed(spark, tmp_path, rows):
    """Rows in three files, shuffled, with repeats."""
    rng = random.Random(3)
    sent = rows + rng.sample(rows, len(rows) // 3)
    rng.shuffle(sent)
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(sent[i::3], ingest.ROW).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ingest.ROW).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ordered_ingestion_and_segments(spark, tmp_path):
    rows = rows_of(60)
    out = str(tmp_path / "segments")
    q = ingest.ordered(feed(spark, tmp_path, rows)).writeStream.foreachBatch(ingest.segment_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(tuple(r) for r in got.drop("segment_no", "batch").collect()) == sorted(rows)
    want = journal.segments(spark.createDataFrame([r for r in rows if r[0] == "a"], ingest.ROW))
    assert {(r.segment_no, r.n) for r in want.collect()} == {(r.segment_no, r["count"]) for r in got.where("volume = 'a'").groupBy("segment_no").count().collect()}


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_ordered_rows_wait_on_disk(spark, tmp_path, chunk):
    """More rows wait than any task holds; gaps, repeats, late rows, a volume that had rows flushed, and a batch that runs again."""
    out, rows = str(tmp_path / "out"), rows_of(60) + [(None, s, 1, 1, s, None) for s in (1, 2)]
    after = spark.createDataFrame([("a", 20), ("c", 5)], "volume string, seq bigint")
    sink = ingest.ordered_sink(out, after, chunk)

    def send(number, wanted):
        sink(spark.createDataFrame([r for r in rows if wanted(r)] * 2, ingest.ROW).repartition(3), number)
        return {v: sorted(r.seq for r in ingest.ordered_rows(spark, out).collect() if r.volume == v) for v in (None, "a", "b")}

    assert send(0, lambda r: r[1] % 2 == 0) == {None: [], "a": [], "b": []}
    for _ in range(2):
        assert send(1, lambda r: r[1] % 4 == 1 or r[1] == 3) == {None: [1, 2], "a": [21, 22], "b": [*range(1, 7)]}
    assert send(2, lambda r: r[1] == 23 or r[1] < 9) == {None: [1, 2], "a": [*range(21, 27)], "b": [*range(1, 11)]}
    assert send(3, lambda r: False)["b"] == [*range(1, 11)]
    assert send(4, lambda r: True) == {None: [1, 2], "a": [*range(21, 61)], "b": [*range(1, 61)]}
    assert sorted(map(repr, map(tuple, ingest.ordered_rows(spark, out).collect()))) == sorted(repr(r) for r in rows if r[0] != "a" or r[1] > 20)
    assert not list(tmp_path.glob("out/rows/batch=[012]/released=false"))


def test_ordered_rows_by_the_million(spark, tmp_path):
    """As many rows wait for the first one as the queries' bound used to allow, and one more."""
    rows = spark.range(1, 1_000_003).select(F.lit("v").alias("volume"), F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("block_index"), F.lit(1).alias("op"), "id", F.lit(None).cast("string").alias("data")).withColumnRenamed("id", "ts")
    sink = ingest.ordered_sink(str(tmp_path))
    sink(rows.where("seq > 1"), 0)
    assert ingest.ordered_rows(spark, str(tmp_path)).isEmpty()
    sink(rows.where("seq = 1"), 1)
    assert ingest.ordered_rows(spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("seq"), F.max("seq")).first()[:] == (1_000_002,) * 3


def test_replica_follows(spark, tmp_path):
    rows = rows_of(60)
    out = str(tmp_path / "replica")
    q = ingest.ordered(feed(spark, tmp_path, rows)).writeStream.foreachBatch(ingest.replica_sink(out, 2)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = spark.createDataFrame(rows, ingest.ROW)
    want = sorted(tuple(r) for r in journal.replay(table, "volume").select("volume", "block_index", "data").collect())
    assert sorted(tuple(r) for r in ingest.replica(spark, out).collect()) == want
    assert {r.lag for r in ingest.lag(table, ingest.synced(spark, out)).collect()} == {0}
    assert ingest._versions(spark, f"{out}/base") and ingest._versions(spark, f"{out}/nothing") == []
    ingest.replica_sink(out, 2)(table.where("seq > 55"), 3)  # the same rows once more change nothing
    assert sorted(tuple(r) for r in ingest.replica(spark, out).collect()) == want


def test_resumed_receiver_and_segments(spark, tmp_path):
    rows = rows_of(60)
    after = spark.createDataFrame([("a", 20)], "volume string, seq bigint")
    q = ingest.ordered(feed(spark, tmp_path, rows), after=after).writeStream.format("memory").queryName("resumed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.volume, r.seq) for r in spark.table("resumed").collect()) == sorted((r[0], r[1]) for r in rows if r[0] == "b" or r[1] > 20)
    folder = str(tmp_path / "ordered")
    spark.createDataFrame(rows, ingest.ROW).coalesce(1).write.parquet(folder)
    q = ingest.segments(spark.readStream.schema(ingest.ROW).parquet(folder), 25, None).writeStream.format("memory").queryName("segments").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("segments").collect())) == [(v, n, 25 * n + 1, 25 * n + 25, 25) for v in "ab" for n in (0, 1)]


def test_segment_timer(spark, tmp_path):
    """A segment that is not full is written when its time is over."""
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows_of(3), ingest.ROW).coalesce(1).write.parquet(folder)
    q = ingest.segments(spark.readStream.schema(ingest.ROW).parquet(folder), 25, 0.5).writeStream.format("memory").queryName("timed").trigger(processingTime="200 milliseconds").start()
    ingest.wait_synced(lambda: spark.table("timed").count(), 2, 60)
    ingest.stop_all([])
    q.stop()
    assert sorted(map(tuple, spark.table("timed").collect())) == [("a", 0, 1, 3, 3), ("b", 0, 1, 3, 3)]


def test_waiting_and_stopping(spark, tmp_path):
    seen = iter(range(10))
    assert ingest.wait_synced(lambda: next(seen), 3, 5, 0) == 3
    with pytest.raises(TimeoutError, match="up to 2 of 9"):
        ingest.wait_synced(lambda: 2, 9, 0.01, 0.001)
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows_of(3), ingest.ROW).write.parquet(folder)

    def fails(batch, number):
        raise ValueError("no room")

    stream = spark.readStream.schema(ingest.ROW).parquet(folder)
    good = stream.writeStream.format("memory").queryName("good").start()
    bad = stream.writeStream.foreachBatch(fails).queryName("bad").start()
    with pytest.raises(RuntimeError, match=r"(?s)bad: .*no room"):
        ingest.stop_all([good, bad])
    assert not good.isActive and spark.table("good").count() == 6


def test_replay_tells_how_far_it_is(spark):
    told, taken = [], []
    rows = spark.createDataFrame(rows_of(60), ingest.ROW).where("volume = 'a'")
    last = ingest.replay_with(rows, told.append, lambda part: taken.append(part.count()), 5, 50, 20)
    assert (last, told, taken) == (50, [24, 44, 50], [20, 20, 6]) and ingest.replay_with(rows, told.append, taken.append, 99) == 0


def test_status_lines(spark, tmp_path):
    ingest.json_sink(str(tmp_path / "status"), "volume")(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), 0)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "status/0")).collect()) == ['{"subject":"volume","data":{"n":1,"s":"a"}}', '{"subject":"volume","data":{"n":2}}']


def test_metric_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.length("props").cast("bigint").alias("bytes"))
    folder = str(tmp_path / "events")
    events.write.parquet(folder)
    q = ingest.metric_windows(spark.readStream.schema(events.schema).parquet(folder), 30).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.bucket: (round(r.iops, 9), round(r.kibs, 9)) for r in metrics.windows(events, 30).collect()}
    assert {r.bucket: (round(r.iops, 9), round(r.kibs, 9)) for r in spark.table("windows").collect()} == want
