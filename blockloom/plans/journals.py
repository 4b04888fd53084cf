"""Queries over the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as j
from ..operators import metrics, snapshot
from ..sources import bindings as b
from ..sources.shared import scratch
from ..sources.volumes import last_sequence
from ..streaming import ingest
from ..streaming.ingest import lag

J = "j AS (SELECT event_id + 1 AS seq, user_id AS block_index, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS data, ts FROM events)"
LAST = "SELECT block_index, data, seq FROM (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY seq DESC) AS rn FROM {0}) WHERE rn = 1 AND op = 1"
T0, T1 = "2024-01-03 00:00:00", "2024-01-20 00:00:00"


def replay_by_sequence(s, d):
    return j.replay(j.bounded(b.journal(s, d), "seq", 0, 5000))


def replay_by_time(s, d):
    return j.replay(j.bounded(b.journal(s, d), "ts", F.lit(T0).cast("timestamp_ntz"), F.lit(T1).cast("timestamp_ntz")))


def replay_onto_store(s, d):
    state = b.blocks(s, d).select("block_index", F.col("content").alias("data"))
    return j.replay_onto(state, b.journal(s, d))


def journal_segments(s, d):
    made = j.chained(j.segments(b.journal(s, d), 25))
    return made.select("segment_no", "n", "first_seq", "last_seq", "full", "previous", "next")


def adjacent_uniq(s, d):
    rows = b.read(s, d, "events").select("user_id", "event_id", "event_type")
    return j.adjacent_unique(rows, "event_type", "event_id", "user_id")


def version_history(s, d):
    return j.history(b.journal(s, d))


def synthesise_journal(s, d):
    made = j.synthesised(b.blocks(s, d), 1_700_000_000_000_000_000)
    return made.select("seq", "block_index", "op", "ts", F.sha2(F.col("data").cast("binary"), 256).alias("hash"), F.floor((F.col("seq") - 1) / 25).cast("bigint").alias("segment_no"))


def journal_gap_check(s, d):
    return j.gaps(b.journal(s, d).where("op = 1"), "seq", "block_index")


def sequence_check(s, d):
    """Arrivals with repeats and early ones: each volume (users modulo 40) sees numbers that mostly follow each other."""
    volume = F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string"))
    return j.accepted(b.read(s, d, "events").select(volume.alias("volume"), (F.expr("event_id div 300") + F.col("event_id") % 3).alias("seq"), F.col("event_id").alias("arrival")))


def _maps(s, d):
    """The maps of a volume now and when half of its journal was written."""
    rows = b.journal(s, d)
    half = rows.agg(F.max("seq")).first()[0] // 2
    return (j.replay(x).select("block_index", F.sha2(F.col("data").cast("binary"), 256).alias("hash")) for x in (rows, rows.where(F.col("seq") <= half)))


def snapshot_diff(s, d):
    return snapshot.changed(*_maps(s, d))


def snapshot_merge_stale(s, d):
    return snapshot.merged(*_maps(s, d))


def pending_ack(s, d):
    rows = b.journal(s, d)
    return j.pending(rows, rows.where("seq % 25 <> 0")).select("seq", "block_index", "op")


def unflushed_view(s, d):
    rows = b.journal(s, d)
    stored = j.replay(rows.where("seq <= 5000")).select("block_index", "data")
    return j.unflushed_view(rows, stored, 5000)


def segment_refcount(s, d):
    rows = b.journal(s, d).select(F.floor((F.col("seq") - 1) / 25).cast("bigint").alias("segment_key"), F.concat(F.lit("v"), (F.col("block_index") % 40).cast("string")).alias("volume"))
    return j.owners(rows)


def segments_to_delete(s, d):
    rows = b.journal(s, d).select(F.floor((F.col("seq") - 1) / 2).cast("bigint").alias("segment_key"), F.concat(F.lit("v"), (F.col("block_index") % 10).cast("string")).alias("volume"))
    return j.deletable(rows, "v3")


def clone_by_reference(s, d):
    rows = b.journal(s, d).select(F.floor((F.col("seq") - 1) / 25).cast("bigint").alias("segment_key"), F.concat(F.lit("v"), (F.col("block_index") % 10).cast("string")).alias("volume"))
    return j.referenced(rows, "v3", "copy").where("volume IN ('v3', 'copy')")


def replica_lag(s, d):
    rows = b.journal(s, d).withColumn("volume", F.concat(F.lit("v"), (F.col("block_index") % 10).cast("string")))
    return lag(rows, rows.where("seq <= 5000 AND volume <> 'v9'").select("volume", F.col("seq").alias("synced")))


def _io(s, d):
    return b.read(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.length("props").cast("bigint").alias("bytes"))


def _rounded(df):
    return df.withColumn("iops", F.round("iops", 6)).withColumn("kibs", F.round("kibs", 6))


def io_stats_window(s, d):
    return _rounded(metrics.windows(_io(s, d), 3600, "event_type"))


def io_stats_idle_spine(s, d):
    return _rounded(metrics.with_idle(metrics.windows(_io(s, d), 3600, "event_type"), 3600, "event_type"))


def io_totals(s, d):
    return _rounded(metrics.io_rates(_io(s, d), 30.0))


def flush_segments(s, d):
    """Segments of 25 rows, or of 6 hours without a flush."""
    return j.flushed(_seconds(s, d), 25, 6 * 3600)


def flush_forced(s, d):
    """As above, with a flush asked for at each volume's 40th row."""
    return j.flushed(_seconds(s, d), 25, 6 * 3600, forced=b.volume_journal(s, d).where("seq = 40").select("volume", "seq"))


def flush_resumed(s, d):
    """As above, by a receiver that had flushed up to the 30th row of all volumes but v0."""
    return j.flushed(_seconds(s, d), 25, 6 * 3600, after=b.volume_journal(s, d).where("seq = 30 AND volume <> 'v0'").select("volume", "seq"))


def _seconds(s, d):
    return b.volume_journal(s, d).select("volume", "seq", (F.col("ts") / 1_000_000).alias("ts"))


def segment_bounds(s, d):
    made = j.segments(b.journal(s, d), 25).select("segment_no", "first_seq", "last_seq")
    return j.straddling(made, "seq", 2010, 5030)


def catch_up(s, d):
    """A store that stopped at a third of the journal is brought to its end, which is checked."""
    rows = b.journal(s, d)
    last = rows.agg(F.max("seq")).first()[0]
    return j.caught_up(j.replay(rows.where(F.col("seq") <= last // 3)).select("block_index", "data"), rows, last // 3, last)


def _keys(s, d):
    return j.segments(b.journal(s, d), 25).select("segment_no", j.segment_key(F.lit("v"), F.col("last_seq").cast("string")).alias("segment_key"))


def clone_journal(s, d):
    return j.cloned(_keys(s, d), "copy")


def journal_positions(s, d):
    held = b.volume_journal(s, d).groupBy("volume").agg(F.max("seq").alias("last_flushed"))
    return j.copied_positions(held, "v3", "v5")


def last_sequences(s, d):
    return last_sequence(b.volume_journal(s, d))


def released_references(s, d):
    rows = b.journal(s, d).select(F.floor((F.col("seq") - 1) / 25).cast("bigint").alias("segment_key"), F.concat(F.lit("v"), (F.col("block_index") % 10).cast("string")).alias("volume"))
    return j.released(rows.distinct(), "v3")


def evicted_cache(s, d):
    """Every 25th sequence number is acknowledged."""
    rows = b.journal(s, d).select("seq", "block_index")
    return j.evicted(rows, rows.where("seq % 25 = 0").select("seq"))


def ignored_prefix(s, d):
    return j.ignore_before(b.journal(s, d), 4000).select("seq", "block_index", "op")


def cache_resident(s, d):
    return metrics.resident(b.read(s, d, "events").select("user_id", "event_id"), "user_id", "event_id", 32)


def metric_tags(s, d):
    tags = b.read(s, d, "nation").select(F.element_at(F.array(*map(F.lit, ("view", "click", "error", "none"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("event_type"), F.col("n_name").alias("tag")).where("n_name < 'NATION_12'")
    return metrics.enriched(metrics.windows(_io(s, d), 3600, "event_type").select("event_type", "bucket"), tags, "event_type")


def _files(s, rows, n, name):
    """Rows in n files of a new folder of the shared ones, as a stream source."""
    path = scratch(s, name)
    rows.repartition(n).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, n // 2)).parquet(path)


def _run(s, stream, name, sink=None, mode="append"):
    """Takes all that is there, then stops; the rows that the sink has."""
    out = scratch(s, name)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(s, f"{name}-checkpoint")).trigger(availableNow=True)
    q = (w.foreachBatch(sink(out)) if sink else w.format("parquet").option("path", out)).start()
    q.awaitTermination()
    return out


def _sent(s, d):
    """Journals as a sender delivers them: in no order, one row in three twice."""
    times = F.when(F.col("seq") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return b.volume_journal(s, d).withColumn("time", F.explode(times)).drop("time")


def stream_ordered(s, d):
    out = _run(s, _files(s, _sent(s, d), 4, "stream"), "ordered", ingest.ordered_sink)
    return ingest.ordered_rows(s, out).select("volume", "seq", "block_index", "op", "data")


def stream_resumed(s, d):
    """A receiver that had flushed 100 rows of each volume but v0."""
    after = b.volume_journal(s, d).where("seq = 100 AND volume <> 'v0'").select("volume", "seq")
    out = _run(s, _files(s, _sent(s, d), 2, "stream"), "resumed", lambda path: ingest.ordered_sink(path, after))
    return ingest.ordered_rows(s, out).groupBy("volume").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def stream_segments(s, d):
    """Segments that are full; the last rows of a volume stay in state."""
    rows = b.volume_journal(s, d).select("volume", "seq")
    out = _run(s, ingest.segments(_files(s, rows, 1, "stream"), 25, None), "segments")
    return s.read.parquet(out)


def stream_replica(s, d):
    out = _run(s, _files(s, b.volume_journal(s, d), 4, "stream"), "replica", lambda path: ingest.replica_sink(path, 1))
    return ingest.replica(s, out)


def stream_windows(s, d):
    """All windows are given up to the last one that a row behind the watermark could still reach."""
    rows = b.read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.length("props").cast("bigint").alias("bytes"))
    out = _run(s, ingest.metric_windows(_files(s, rows, 1, "stream"), 3600), "windows", lambda path: lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/n={n}"), "complete")
    last = s.read.parquet(out).select(F.max("n")).first()[0]
    return _rounded(s.read.parquet(f"{out}/n={last}"))


def status_lines(s, d):
    return ingest.status_events(b.read(s, d, "events").select("event_id", "event_type"), "event")


QUERIES = {f.__name__: f for f in (
    replay_by_sequence, replay_by_time, replay_onto_store, journal_segments, adjacent_uniq, version_history, synthesise_journal, journal_gap_check, sequence_check, snapshot_diff,
    snapshot_merge_stale, pending_ack, unflushed_view, segment_refcount, segments_to_delete, clone_by_reference, replica_lag, io_stats_window, io_stats_idle_spine, io_totals,
    flush_segments, flush_forced, flush_resumed, segment_bounds, catch_up, clone_journal, journal_positions, last_sequences, released_references, evicted_cache, ignored_prefix, cache_resident, metric_tags,
    stream_ordered, stream_resumed, stream_segments, stream_replica, stream_windows, status_lines,
)}

_MAPS = ", ".join(f"{n} AS (SELECT block_index, sha256(data) AS hash FROM (" + LAST.format(m) + "))" for n, m in (("now_", "j"), ("before_", "(SELECT * FROM j WHERE seq <= (SELECT max(seq) // 2 FROM j))")))
_WINDOW = "SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bucket, round(count(*) / 3600.0::DOUBLE, 6) AS iops, round(CAST(sum(length(props)) AS DOUBLE) / 1024.0 / 3600.0::DOUBLE, 6) AS kibs FROM events GROUP BY ALL"
VJ = "vj AS (SELECT 'v' || (user_id % 10) AS volume, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS seq, user_id AS block_index, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, epoch_us(ts) / 1000000 AS ts, CASE WHEN event_type <> 'error' THEN props END AS data FROM events)"


def _flush(ignored: str, forced: str) -> str:
    """The receiver as a recursion over a volume's rows: n rows in the buffer behind row i, when the timer was started, the segment of row i, and whether a forced flush is still waited for."""
    due, late = "waits AND seq >= {0}".format(forced), "floor((ts - timer) / 21600)"
    return f"""WITH RECURSIVE {VJ}, r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY seq) AS i FROM vj WHERE NOT ({ignored})),
f(volume, i, seq, segment_no, n, timer, waits) AS (SELECT volume, 0::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT, ts, {forced} IS NOT NULL FROM r WHERE i = 1
UNION ALL SELECT volume, i, seq, no, CASE WHEN due OR held = 25 THEN 0 ELSE held END, CASE WHEN due OR held = 25 THEN ts ELSE timer + late * 21600 END, waits AND NOT due
FROM (SELECT *, CASE WHEN n = 0 OR late > 0 THEN 1 ELSE n + 1 END AS held, CASE WHEN n = 0 OR late > 0 THEN segment_no + 1 ELSE segment_no END AS no, coalesce({due}, false) AS due
FROM (SELECT r.volume, r.i, r.seq, r.ts, f.segment_no, f.n, f.timer, f.waits, {late.replace('ts -', 'r.ts -').replace('timer', 'f.timer')} AS late FROM f JOIN r ON r.volume = f.volume AND r.i = f.i + 1)))
SELECT volume, segment_no, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM f WHERE i > 0 GROUP BY 1, 2"""


SQL = {
    "replay_by_sequence": f"WITH {J} {LAST.format('(SELECT * FROM j WHERE seq <= 5000)')}",
    "replay_by_time": f"WITH {J} " + LAST.format(f"(SELECT * FROM j WHERE ts BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}')"),
    "replay_onto_store": f"WITH {J}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY seq DESC) AS rn FROM j) WHERE rn = 1) SELECT coalesce(l.block_index, doc_id) AS block_index, CASE WHEN l.block_index IS NOT NULL THEN l.data ELSE text END AS data FROM documents FULL JOIN l ON doc_id = l.block_index WHERE l.block_index IS NULL OR l.op = 1",
    "journal_segments": f"WITH {J}, s AS (SELECT CAST((seq - 1) // 25 AS BIGINT) AS segment_no, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM j GROUP BY 1) SELECT *, n = 25 AS \"full\", lag(segment_no) OVER (ORDER BY segment_no) AS previous, lead(segment_no) OVER (ORDER BY segment_no) AS next FROM s",
    "adjacent_uniq": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM b",
    "version_history": f"WITH {J} SELECT block_index, seq, op, row_number() OVER w AS version, lead(seq) OVER w AS replaced_by, lead(seq) OVER w IS NULL AS latest FROM j WINDOW w AS (PARTITION BY block_index ORDER BY seq)",
    "synthesise_journal": "SELECT seq, block_index, 1 AS op, 1700000000000000000 AS ts, hash, CAST((seq - 1) // 25 AS BIGINT) AS segment_no FROM (SELECT row_number() OVER (ORDER BY doc_id) AS seq, doc_id AS block_index, sha256(text) AS hash FROM documents)",
    "journal_gap_check": f"WITH {J} SELECT *, next_seq - after_seq - 1 AS missing FROM (SELECT block_index, lag(seq) OVER (PARTITION BY block_index ORDER BY seq) AS after_seq, seq AS next_seq FROM j WHERE op = 1) WHERE next_seq - after_seq > 1",
    "sequence_check": """WITH RECURSIVE a AS (SELECT 'v' || (user_id % 40) AS volume, event_id // 300 + event_id % 3 AS seq, event_id AS arrival FROM events), g(volume, seq, arrival) AS (SELECT DISTINCT volume, 0::BIGINT, -1::BIGINT FROM a
UNION ALL SELECT volume, seq, arrival FROM (SELECT g.volume, g.seq + 1 AS seq, (SELECT min(a.arrival) FROM a WHERE a.volume = g.volume AND a.seq = g.seq + 1 AND a.arrival > g.arrival) AS arrival FROM g) WHERE arrival IS NOT NULL)
SELECT a.volume, a.seq, a.arrival, CASE WHEN a.seq = g.seq + 1 THEN 'accept' WHEN a.seq <= g.seq THEN 'duplicate' ELSE 'early' END AS verdict FROM a ASOF JOIN g ON a.volume = g.volume AND a.arrival > g.arrival""",
    "snapshot_diff": f"WITH {J}, {_MAPS} SELECT * FROM now_ EXCEPT SELECT * FROM before_",
    "snapshot_merge_stale": f"WITH {J}, {_MAPS} SELECT * FROM now_ UNION ALL SELECT * FROM before_ WHERE block_index NOT IN (SELECT block_index FROM now_)",
    "pending_ack": f"WITH {J} SELECT seq, block_index, op FROM j WHERE seq % 25 = 0",
    "unflushed_view": f"WITH {J}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY seq DESC) AS rn FROM j WHERE seq > 5000) WHERE rn = 1), st AS ({LAST.format('(SELECT * FROM j WHERE seq <= 5000)')}) SELECT * FROM (SELECT coalesce(p.block_index, st.block_index) AS block_index, CASE WHEN p.block_index IS NOT NULL THEN p.data ELSE st.data END AS data FROM p FULL JOIN st USING (block_index)) WHERE data IS NOT NULL",
    "segment_refcount": f"WITH {J} SELECT CAST((seq - 1) // 25 AS BIGINT) AS segment_key, count(DISTINCT block_index % 40) AS owners FROM j GROUP BY 1",
    "segments_to_delete": f"WITH {J} SELECT CAST((seq - 1) // 2 AS BIGINT) AS segment_key FROM j GROUP BY 1 HAVING count(DISTINCT block_index % 10) = 1 AND bool_or(block_index % 10 = 3)",
    "clone_by_reference": f"WITH {J} SELECT DISTINCT CAST((seq - 1) // 25 AS BIGINT) AS segment_key, unnest(['v3', 'copy']) AS volume FROM j WHERE block_index % 10 = 3",
    "replica_lag": f"WITH {J}, x AS (SELECT 'v' || (block_index % 10) AS volume, max(seq) AS last_seq, coalesce(max(CASE WHEN seq <= 5000 AND block_index % 10 <> 9 THEN seq END), 0) AS synced FROM j GROUP BY 1) SELECT *, last_seq - synced AS lag FROM x",
    "io_stats_window": _WINDOW,
    "io_stats_idle_spine": f"WITH w AS ({_WINDOW}), s AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 3600, 3600)) AS bucket FROM w GROUP BY 1) SELECT event_type, CAST(bucket AS BIGINT) AS bucket, coalesce(iops, 0) AS iops, coalesce(kibs, 0) AS kibs FROM s LEFT JOIN w USING (event_type, bucket)",
    "io_totals": "SELECT round(count(*) / 30.0::DOUBLE, 6) AS iops, round(CAST(sum(length(props)) AS DOUBLE) / 1024.0 / 30.0::DOUBLE, 6) AS kibs FROM events",
    "flush_segments": _flush("1 = 0", "NULL::BIGINT"),
    "flush_forced": _flush("1 = 0", "40"),
    "flush_resumed": _flush("volume <> 'v0' AND seq <= 30", "NULL::BIGINT"),
    "segment_bounds": f"WITH {J}, s AS (SELECT CAST((seq - 1) // 25 AS BIGINT) AS segment_no, min(seq) AS first_seq, max(seq) AS last_seq FROM j GROUP BY 1) SELECT *, 2010 BETWEEN first_seq + 1 AND last_seq AS starts_inside, 5030 BETWEEN first_seq AND last_seq - 1 AS ends_inside FROM s",
    "catch_up": f"WITH {J} SELECT block_index, data FROM ({LAST.format('j')})",
    "clone_journal": f"WITH {J}, k AS (SELECT segment_no, sha256('copy' || sha256('v' || last_seq)) AS segment_key FROM (SELECT CAST((seq - 1) // 25 AS BIGINT) AS segment_no, max(seq) AS last_seq FROM j GROUP BY 1)) SELECT segment_no, segment_key, lag(segment_key) OVER (ORDER BY segment_no) AS previous_key, lead(segment_key) OVER (ORDER BY segment_no) AS next_key FROM k",
    "journal_positions": "WITH h AS (SELECT 'v' || (user_id % 10) AS volume, count(*) AS n FROM events GROUP BY 1) SELECT volume, CASE volume WHEN 'v5' THEN (SELECT n FROM h WHERE volume = 'v3') ELSE n END AS last_flushed FROM h",
    "last_sequences": "SELECT 'v' || (user_id % 10) AS volume, count(*) AS last_seq FROM events GROUP BY 1",
    "released_references": f"WITH {J} SELECT DISTINCT CAST((seq - 1) // 25 AS BIGINT) AS segment_key, 'v' || (block_index % 10) AS volume FROM j WHERE block_index % 10 <> 3",
    "evicted_cache": f"WITH {J} SELECT seq, block_index FROM j WHERE seq > coalesce((SELECT max(x.seq) FROM j x WHERE x.block_index = j.block_index AND x.seq % 25 = 0), 0)",
    "ignored_prefix": f"WITH {J} SELECT seq, block_index, op FROM j WHERE seq >= 4000",
    "cache_resident": "SELECT user_id, max(event_id) AS last_used FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 32",
    "metric_tags": "WITH t AS (SELECT ['view', 'click', 'error', 'none'][n_nationkey % 4 + 1] AS event_type, n_name AS tag FROM nation WHERE n_name < 'NATION_12') SELECT event_type, bucket, tag FROM (SELECT DISTINCT event_type, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bucket FROM events) LEFT JOIN t USING (event_type)",
    "stream_ordered": f"WITH {VJ} SELECT volume, seq, block_index, op, data FROM vj",
    "stream_resumed": f"WITH {VJ} SELECT volume, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM vj WHERE volume = 'v0' OR seq > 100 OR (SELECT count(*) FROM vj x WHERE x.volume = vj.volume) < 100 GROUP BY 1",
    "stream_segments": f"WITH {VJ} SELECT volume, CAST((seq - 1) // 25 AS BIGINT) AS segment_no, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM vj GROUP BY 1, 2 HAVING count(*) = 25",
    "stream_replica": f"WITH {VJ} SELECT volume, block_index, data FROM (SELECT *, row_number() OVER (PARTITION BY volume, block_index ORDER BY seq DESC) AS rn FROM vj) WHERE rn = 1 AND op = 1",
    "stream_windows": "SELECT CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bucket, round(count(*) / 3600.0::DOUBLE, 6) AS iops, round(CAST(sum(length(props)) AS DOUBLE) / 1024.0 / 3600.0::DOUBLE, 6) AS kibs FROM events GROUP BY 1",
    "status_lines": """SELECT '{"subject":"event","data":{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS value FROM events""",
}
