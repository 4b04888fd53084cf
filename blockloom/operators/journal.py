"""The journal: a total order of set and delete operations on a volume's blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import DELETE, SEGMENT, SET
from ..sources.shared import table

#: Arrivals that one task judges at a time.
CHUNK = 1_000_000
#: Rows and seconds after which a receiver writes a segment (fixed values).
FLUSH_SIZE, FLUSH_SECONDS = 25, 25


def bounded(journal: DataFrame, column: str = "seq", start=None, end=None) -> DataFrame:
    """Rows with start <= column <= end; None or 0 leaves a side open. Reaches the scan as a filter."""
    for bound, test in ((start, ">="), (end, "<=")):
        if not isinstance(bound, (type(None), int)) or bound:
            journal = journal.where(F.col(column) >= bound if test == ">=" else F.col(column) <= bound)
    return journal


def replay(journal: DataFrame, *keys: str) -> DataFrame:
    """The state after all rows: the last operation of each block, deletes dropped. One partial aggregation, one shuffle."""
    by = [*keys, "block_index"]
    last = journal.groupBy(*by).agg(F.max_by(F.struct("op", "data", "seq"), "seq").alias("last"))
    return last.where(F.col("last.op") == SET).select(*by, F.col("last.data").alias("data"), F.col("last.seq").alias("seq"))


def replay_onto(state: DataFrame, journal: DataFrame) -> DataFrame:
    """state (block_index, data) with the journal applied: blocks that the journal names take its last operation."""
    last = journal.groupBy("block_index").agg(F.max_by(F.struct("op", "data"), "seq").alias("last"))
    both = state.select("block_index", "data").join(last, "block_index", "full")
    touched = F.col("last").isNotNull()
    return both.where(~touched | (F.col("last.op") == SET)).select("block_index", F.when(touched, F.col("last.data")).otherwise(F.col("data")).alias("data"))


def numbered(rows: DataFrame, order: str, alias: str = "seq", partitions: int | None = None) -> DataFrame:
    """Dense numbers from 1 by `order`, without a window over all rows.

    The rows are sorted by range and written once with their place in their partition: the ranges can't move between counting
    and numbering. The driver sees one count a partition.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, start = (_free(rows, x) for x in ("_at", "_part", "_start"))
    held = table(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    held = held.withColumn(part, F.shiftrightunsigned(at, 33))
    before_, total = [], 1
    for r in sorted(held.groupBy(part).count().collect()):
        before_.append((r[part], total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(before_, f"{part} bigint, {start} bigint"))  # a row a partition
    number = F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)
    return held.join(starts, part).withColumn(alias, number).drop(part, start, at)


def _free(rows: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name in rows.columns:
        name += "_"
    return name


def before(rows: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    """Adds `_before`, the value of the row before, and `_first`, whether there is none. Without a partition the rows are numbered and meet their neighbours by number, so no task has to sort them all."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(order)
        return rows.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    held = numbered(rows, order, "_n")
    earlier = held.select((F.col("_n") + 1).alias("_n"), F.col(value).alias("_before"), F.lit(False).alias("_first"))
    return held.join(earlier, "_n", "left").withColumn("_first", F.coalesce("_first", F.lit(True))).drop("_n")


def segments(journal: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments of `size` consecutive rows of a journal whose seq is dense from 1, with what the one before ends on."""
    no = F.floor((F.col("seq") - 1) / size).cast("bigint")
    made = journal.groupBy(no.alias("segment_no")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_sort(F.collect_list("seq")).alias("sequences")
    )
    return made.withColumn("full", F.col("n") == size)


def chained(segments_: DataFrame) -> DataFrame:
    """Predecessor and successor of each segment: numbers are dense, so neighbours are arithmetic, not a window."""
    there = segments_.select((F.col("segment_no") - 1).alias("segment_no"), F.lit(True).alias("_next"))
    return segments_.join(there, "segment_no", "left").select(
        "*", F.when(F.col("segment_no") > 0, F.col("segment_no") - 1).alias("previous"), F.when(F.col("_next"), F.col("segment_no") + 1).alias("next")
    ).drop("_next")


def adjacent_unique(rows: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    """Drops rows whose value equals that of the row before."""
    return before(rows, value, order, *partition).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).select(*rows.columns)


def history(journal: DataFrame) -> DataFrame:
    """Each row's version number within its block, whether it is the latest, and the seq that replaced it."""
    w = Window.partitionBy("block_index").orderBy("seq")
    return journal.select(
        "block_index", "seq", "op", F.row_number().over(w).cast("bigint").alias("version"), F.lead("seq").over(w).alias("replaced_by"), F.lead("seq").over(w).isNull().alias("latest")
    )


def gaps(journal: DataFrame, order: str = "seq", *partition: str) -> DataFrame:
    """Where the numbers jump: the last one before, the next one, how many are missing."""
    near = before(journal, order, order, *partition).select(*partition, F.col("_before").alias("after_seq"), F.col(order).alias("next_seq"))
    return near.where(F.col("next_seq") - F.col("after_seq") > 1).withColumn("missing", F.col("next_seq") - F.col("after_seq") - 1)


def _reached(seqs: np.ndarray) -> list[tuple[int, int, int]]:
    """(lo, hi, to): a receiver that expects a number of lo .. hi before these arrivals expects `to` after them."""
    ends: dict[int, int] = {}
    for s in seqs[::-1].tolist():
        ends[s] = ends.get(s + 1, s + 1)
    out: list[tuple[int, int, int]] = []
    for s in sorted(ends):
        if out and out[-1][1] == s - 1 and out[-1][2] == ends[s]:
            out[-1] = (out[-1][0], s, ends[s])
        else:
            out.append((s, s, ends[s]))
    return out


def accepted(arrivals: DataFrame, arrival: str = "arrival", chunk: int = CHUNK) -> DataFrame:
    """What a receiver that expects each next seq (from 1, by volume) makes of arrivals: accept, duplicate, or early (dropped, to be sent again).

    Only an accepted row raises what is expected. A volume's arrivals are judged in chunks of bounded size: each chunk first says
    where it leads from every number that may be expected before it (as intervals), a short pass over these gives what is
    expected at each chunk's start, and then the chunks are judged side by side. Rows without a seq have no verdict.
    """
    by, columns = F.struct("volume", arrival), arrivals.columns
    held = numbered(arrivals.withColumn("_by", by), "_by", "_n").withColumn("_chunk", F.expr(f"(_n - 1) div {chunk}")).drop("_by")
    held = table(held, "arrivals")

    def lead(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _reached(rows.dropna().sort_values("_n")["seq"].to_numpy(np.int64))
        return pd.DataFrame([(*key, *x) for x in found] or [(*key, 0, -1, 0)], columns=["volume", "_chunk", "lo", "hi", "to"])

    leads = held.select("volume", "_chunk", "_n", "seq").groupBy("volume", "_chunk").applyInPandas(lead, "volume string, _chunk bigint, lo bigint, hi bigint, to bigint")

    def start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, expected, after = None, 1, 1
        for part in parts:
            out = []
            for volume, number, lo, hi, to in part.itertuples(index=False):
                if (volume, number) != at:
                    expected = after = after if at and at[0] == volume else 1
                    at = (volume, number)
                    out.append((volume, number, expected))
                if lo <= expected <= hi:
                    after = to
            yield pd.DataFrame(out, columns=["volume", "_chunk", "_expected"])

    starts = leads.repartition("volume").sortWithinPartitions("volume", "_chunk").mapInPandas(start, "volume string, _chunk bigint, _expected bigint")

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        expected, verdicts = int(rows["_expected"].iloc[0]), []
        for s in rows["seq"].tolist():
            if s is None or s != s:
                verdicts.append(None)
            elif s == expected:
                verdicts.append("accept")
                expected += 1
            else:
                verdicts.append("duplicate" if s < expected else "early")
        return rows[columns].assign(verdict=verdicts)

    schema = StructType([*arrivals.schema.fields, StructField("verdict", StringType())])
    return held.join(starts, ["volume", "_chunk"]).groupBy("volume", "_chunk").applyInPandas(judge, schema)


def flushed(journal: DataFrame, size: int = FLUSH_SIZE, seconds: float = FLUSH_SECONDS, forced: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """(volume, segment_no, n, first_seq, last_seq): the segments that a receiver writes of an ordered journal (volume, seq, ts in epoch seconds).

    A segment is written when it has `size` rows; when the timer, which every flush restarts and which runs from the first row on,
    ends and the buffer holds something; or when the row of a forced flush (volume, seq) has come, for which it waits. Rows up to the
    last flushed one (volume, seq) of `after` are ignored: a resumed receiver goes on behind it. What is left at the end is a segment too.

    A fold in order of seq with a state of a few numbers; volumes run side by side.
    """
    rows = journal.select("volume", "seq", F.col("ts").cast("double").alias("ts"))
    for asked, name in ((forced, "_forced"), (after, "_after")):
        if asked is None:
            rows = rows.withColumn(name, F.lit(None).cast("bigint"))
        else:
            rows = rows.join(asked.groupBy("volume").agg(F.max("seq").alias(name)), "volume", "left")
    rows = rows.where(F.col("_after").isNull() | (F.col("seq") > F.col("_after")))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume, number, first, last, n, timer, waits = None, 0, 0, 0, 0, 0.0, False
        out: list[tuple] = []

        def flush() -> None:
            nonlocal number, n
            if n:
                out.append((volume, number, n, first, last))
                number, n = number + 1, 0

        for part in parts:
            for v, seq, ts, force, _ in part.itertuples(index=False):
                if v != volume:
                    flush()
                    volume, number, timer, waits = v, 0, ts, force == force and force is not None
                if ts - timer >= seconds:
                    flush()
                    timer += (ts - timer) // seconds * seconds
                first, last, n = first if n else seq, seq, n + 1
                due = waits and seq >= force
                if due or n >= size:
                    waits = waits and not due
                    flush()
                    timer = ts
            yield pd.DataFrame(out, columns=["volume", "segment_no", "n", "first_seq", "last_seq"])
            out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=["volume", "segment_no", "n", "first_seq", "last_seq"])

    sorted_ = rows.select("volume", "seq", "ts", "_forced", "_after").repartition("volume").sortWithinPartitions("volume", "seq")
    return sorted_.mapInPandas(fold, "volume string, segment_no bigint, n bigint, first_seq bigint, last_seq bigint")


def straddling(segments_: DataFrame, column: str = "seq", start: int = 0, end: int = 0) -> DataFrame:
    """Whether a bound cuts a segment: `starts_inside` (begins before start, ends at or after it), `ends_inside` (begins at or before end, ends after it). 0 leaves a side open."""
    lo, hi = F.col(f"first_{column}"), F.col(f"last_{column}")
    return segments_.withColumn("starts_inside", F.lit(bool(start)) & (hi >= start) & (lo < start)).withColumn("ends_inside", F.lit(bool(end)) & (hi > end) & (lo <= end))


def caught_up(state: DataFrame, journal: DataFrame, flushed_: int, head: int | None = None) -> DataFrame:
    """A store that stands at seq `flushed_`, brought to the journal's end, which has to be `head`."""
    rest = journal.where(F.col("seq") > flushed_)
    if head is not None and (last := rest.agg(F.coalesce(F.max("seq"), F.lit(flushed_))).first()[0]) != head:
        raise ValueError(f"the journal should end at {head}, it ends at {last}")
    return replay_onto(state, rest)


def synthesised(blocks: DataFrame, ts: int) -> DataFrame:
    """A journal that writes a store's blocks: seq from 1 by index, one timestamp, all sets."""
    return numbered(blocks, "block_index").select("seq", "block_index", F.lit(SET).alias("op"), F.lit(ts).cast("bigint").alias("ts"), F.col("content").alias("data"))


def ignore_before(journal: DataFrame, seq: int) -> DataFrame:
    return journal.where(F.col("seq") >= seq)


def segment_key(volume: Column, payload: Column) -> Column:
    """The key of a segment: the hash of the volume's name and the bytes."""
    return F.sha2(F.concat(volume.cast("binary"), payload.cast("binary")), 256)


def cloned(segments_: DataFrame, target: str) -> DataFrame:
    """A full clone: (segment_no, segment_key) of the source becomes a chain of its own, with keys from the target's name and the old keys, and the keys before and after."""
    mine = segments_.select("segment_no", segment_key(F.lit(target), F.col("segment_key")).alias("segment_key"))
    out = mine
    for name, step in (("previous_key", 1), ("next_key", -1)):
        out = out.join(mine.select((F.col("segment_no") + step).alias("segment_no"), F.col("segment_key").alias(name)), "segment_no", "left")
    return out


def referenced(refs: DataFrame, source: str, target: str) -> DataFrame:
    """A clone by reference: target becomes an owner of all segments of source. refs: (segment_key, volume)."""
    return refs.union(refs.where(F.col("volume") == source).select("segment_key", F.lit(target).alias("volume"))).distinct()


def owners(refs: DataFrame) -> DataFrame:
    """How many volumes own each segment."""
    return refs.groupBy("segment_key").agg(F.count_distinct("volume").alias("owners"))


def deletable(refs: DataFrame, volume: str) -> DataFrame:
    """Segments of a volume with no other owner: their data go when the volume's journal is deleted."""
    held = refs.groupBy("segment_key").agg(F.count_distinct("volume").alias("owners"), F.bool_or(F.col("volume") == volume).alias("own"))
    return held.where("own AND owners = 1").select("segment_key")


def released(refs: DataFrame, volume: str) -> DataFrame:
    """The references that stay when a volume's journal is deleted."""
    return refs.where(F.col("volume") != volume)


def copied_positions(positions: DataFrame, source: str, target: str) -> DataFrame:
    """positions (volume, last_flushed) after the target has taken over the source's."""
    mine = positions.where(F.col("volume") == source).select(F.lit(target).alias("volume"), "last_flushed")
    return positions.where(F.col("volume") != target).unionByName(mine)


def evicted(pending_: DataFrame, acked: DataFrame) -> DataFrame:
    """What an acknowledged flush leaves of the write-behind cache (seq, block_index): rows of a block up to its newest acknowledged seq go."""
    top = acked.join(pending_.select("seq", "block_index"), "seq").groupBy("block_index").agg(F.max("seq").alias("_top"))
    return pending_.join(top, "block_index", "left").where(F.col("_top").isNull() | (F.col("seq") > F.col("_top"))).drop("_top")


def pending(sent: DataFrame, acked: DataFrame) -> DataFrame:
    """Rows sent and not yet acknowledged, in the order in which they would be sent again."""
    return sent.join(acked.select("seq"), "seq", "left_anti").orderBy("seq")


def unflushed_view(pending_: DataFrame, store: DataFrame, flushed: int) -> DataFrame:
    """Reads during write-behind: the newest unflushed operation of a block, else the store's content; a pending delete hides the store."""
    newest = pending_.where(F.col("seq") > flushed).groupBy("block_index").agg(F.max_by(F.struct("op", "data"), "seq").alias("p"))
    both = store.select("block_index", F.col("data").alias("stored")).join(newest, "block_index", "full")
    return both.select("block_index", F.when(F.col("p").isNotNull(), F.when(F.col("p.op") == SET, F.col("p.data"))).otherwise(F.col("stored")).alias("data")).where("data IS NOT NULL")
