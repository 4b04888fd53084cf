"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are the ids of a public byte-level vocabulary (V of them, so tables by unit are bounded); the order is 3, with two
extra units where a document begins. With c the count of (u, v, w), the model is

    p3(w | u v) = max(c - D(c), 0) / c(u v) + back(u v) p2(w | v), or p2(w | v) where u v was never seen

and so on down to the uniform distribution; p2 and p1 have the numbers of distinct left neighbours in place of counts. Every
order has discounts D1, D2, D3+ of its own, estimated from its counts of counts; back is what they took, spread evenly.
The tables of trusted trigrams and of pairs (v, w) are as large as the text makes them.

Scoring is a sharded join. Both tables lie in shards by the middle unit v, so that one visit gives a trigram's
probability; a unit v with many trigrams is dealt over several shards by u, and its pairs are copied to each of these. A batch of
documents sends each shard its distinct (trigram, document) pairs, packed and compressed; a shard looks them up and returns
one sum a document, packed by batch; sums are added by batch. Log-probabilities are whole 1/4096 nats, so sums do not depend on
order. The `TOP` most frequent trusted trigrams are scored where the text lies: they make up much of a text.

The model learns from all labelled good documents except a fifth, chosen by hash; on that whole fifth each language's threshold
is the given quantile of perplexity. Ids meet documents in shuffled semi joins, so neither side need fit in memory; a bitmap of the
ids' hashes, of bounded size, keeps most other texts out of that shuffle. A document is
kept if it does not exceed the threshold of its language (of all languages together, if its own has none). Whole texts of all
documents are scored.

Defined results: null or empty text has no units, perplexity null, and is not kept; null languages use the common threshold;
one row per input row, repeated rows and null ids included; without trusted text perplexity is V and everything stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, pieces, table
from .minimisers import counting
from .packing import encoder, vocabulary

UNITS = 50_258  # the vocabulary's ids, one spare, and the last for the beginning
BEGIN = UNITS - 1
TOP = 1 << 18
QUANTILE = 0.98
UNIT = 4096
#: Bits of the map of trusted ids (8 MB), in parts of MAP, which is what bitmap_construct_agg makes.
BITS = 1 << 26
MAP = 1 << 15


def trigrams(path: str, text: str) -> np.ndarray:
    """The keys (u * UNITS + v) * UNITS + w of a text's trigrams."""
    ids = encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    if not len(ids):
        return ids
    ids = np.concatenate([[BEGIN, BEGIN], ids])
    return (ids[:-2] * UNITS + ids[1:-1]) * UNITS + ids[2:]


def discounts(n: list[float]) -> np.ndarray:
    """0, D1, D2, D3+ from how many entries have the counts 1, 2, 3, 4; kept within bounds where counts are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        a, b = n[k - 1], n[k]
        out.append(min(max(k - (k + 1) * y * b / a, 0.1), k - 0.01) if a and b else 0.5 * k if n[0] else 0.0)
    return np.array(out)


@dataclass
class Model:
    """What is bounded by the number of units, and the top trigrams: discounts by order; of each v the sum of its pairs' numbers and what backs off; p1; over how many shards v is dealt (a share)."""

    d3: np.ndarray
    d2: np.ndarray
    sum2: np.ndarray
    back2: np.ndarray
    p1: np.ndarray
    share: np.ndarray
    top: np.ndarray
    top_logp: np.ndarray

    def logp(self, keys: np.ndarray, c: np.ndarray, context: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """In 1/UNIT nats. context: (keys x 4) the context's count, and its followers seen once, twice, more; n2: the pair's number."""
        v, w = keys // UNITS % UNITS, keys % UNITS
        p2 = np.maximum(n2 - self.d2[np.minimum(n2, 3)], 0) / np.maximum(self.sum2[v], 1) + self.back2[v] * self.p1[w]
        seen = np.maximum(context[:, 0], 1)
        back = np.where(context[:, 0] > 0, context[:, 1:] @ self.d3[1:] / seen, 1.0)
        return np.rint(np.log(np.maximum(c - self.d3[np.minimum(c, 3)], 0) / seen + back * p2) * UNIT).astype(np.int64)

    def splits(self, shards: int) -> np.ndarray:
        """Over how many shards each v is dealt."""
        return np.clip(np.ceil(2 * shards * self.share), 1, shards).astype(np.int64)


@dataclass
class Tables:
    """counts (key, n) and pairs (vw, n) of the trusted text."""

    counts: DataFrame
    pairs: DataFrame


def count_trigrams(df: DataFrame, path: str) -> DataFrame:
    """(key, n) over the whole texts of df."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 16 << 20):
            keys, n = np.unique(np.concatenate([trigrams(path, t or "") for t in batch.column("text").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return df.select("text").mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _of_counts(df: DataFrame) -> list[float]:
    return [float(x) for x in df.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()]


def _kinds() -> list:
    n = F.col("n")
    return [F.sum("n").alias("n"), F.count_if(n == 1).alias("n1"), F.count_if(n == 2).alias("n2"), F.count_if(n > 2).alias("n3")]


def possible(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id is among ids, and some others, fewer the less ids there are to a bit; for the join that settles it."""
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS))
    maps = ids.select(bit.alias("bit")).groupBy(F.expr(f"bit div {MAP}").alias("_part")).agg(F.expr(f"bitmap_construct_agg(bit % {MAP})").alias("_map"))
    placed = df.withColumn("_bit", bit).join(F.broadcast(maps), F.expr(f"_bit div {MAP}") == F.col("_part"))
    byte = F.expr(f"CAST(conv(hex(substring(_map, CAST(_bit % {MAP} div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    return placed.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0).select(df.columns)


def learn(trusted: DataFrame, path: str) -> tuple[Tables, Model]:
    """The tables and the model. The driver sees a row a unit, the histogram of counts, and the top trigrams."""
    counts = table(count_trigrams(trusted, path), "op7-counts")
    pairs = table(counts.groupBy((F.col("key") % (UNITS * UNITS)).alias("vw")).agg(F.count(F.lit(1)).alias("n")), "op7-pairs")
    sum2, kinds2, n1, share = np.zeros(UNITS), np.zeros((UNITS, 3)), np.zeros(UNITS, np.int64), np.zeros(UNITS)
    for r in pairs.groupBy(F.expr(f"vw div {UNITS}").alias("v")).agg(*_kinds()).collect():
        sum2[r.v], kinds2[r.v] = r.n, (r.n1, r.n2, r.n3)
    for r in pairs.groupBy((F.col("vw") % UNITS).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect():
        n1[r.w] = r.n
    for r in counts.groupBy((F.expr(f"key div {UNITS}") % UNITS).alias("v")).agg(F.sum("n").alias("n")).collect():
        share[r.v] = r.n
    d3, d2 = discounts(_of_counts(counts)), discounts(_of_counts(pairs))
    d1 = discounts([float((n1 == k).sum()) for k in (1, 2, 3, 4)])
    kinds1 = np.array([(n1 == 1).sum(), (n1 == 2).sum(), (n1 > 2).sum()])
    total = n1.sum()
    p1 = np.maximum(n1 - d1[np.minimum(n1, 3)], 0) / total + kinds1 @ d1[1:] / total / UNITS if total else np.full(UNITS, 1 / UNITS)
    back2 = np.where(sum2 > 0, kinds2 @ d2[1:] / np.maximum(sum2, 1), 1.0)
    model = Model(d3, d2, sum2, back2, p1, share / max(share.sum(), 1), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # the least count that no more than TOP trigrams have
    left, least = TOP, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("n").desc()).limit(TOP).collect():
        if (left := left - r.m) < 0:
            break
        least = r.n
    if least is not None:
        many = counts.where(F.col("n") >= least).select("key", "n", F.expr(f"key div {UNITS}").alias("uv"), (F.col("key") % (UNITS * UNITS)).alias("vw"))
        wanted = F.broadcast(many.select("uv").distinct())  # TOP rows at most
        of = counts.select(F.expr(f"key div {UNITS}").alias("uv"), "n").join(wanted, "uv", "left_semi").groupBy("uv").agg(*_kinds()).withColumnRenamed("n", "c")
        top = many.join(of, "uv").join(pairs.select("vw", F.col("n").alias("m")), "vw").toPandas().sort_values("key")
        model.top = top["key"].to_numpy(np.int64)
        model.top_logp = model.logp(model.top, top["n"].to_numpy(np.int64), top[["c", "n1", "n2", "n3"]].to_numpy(np.int64), top["m"].to_numpy(np.int64))
    return Tables(counts, pairs), model


def look_up(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns (after the first, the sorted key) of each key's row, zeros if there is none, and whether there is one."""
    if not len(known):
        return np.zeros((len(keys), known.shape[1] - 1), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(known[:, 0], keys), len(known) - 1)
    there = known[i, 0] == keys
    return np.where(there[:, None], known[i, 1:], 0), there


ROW = "shard long, kind int, batch string, body binary"
NAMES = ["shard", "kind", "batch", "body"]


def _row(shard: int, kind: int, batch: str | None, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), pa.array([batch], pa.string()), pa.array([body], pa.binary())], NAMES)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: compresses better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)


#: Kinds of rows that a shard gets: two tables, then what documents ask, then what is known of the documents.
COUNTS, LOWER, PAIRS, META = range(4)


def contexts(counts: np.ndarray) -> np.ndarray:
    """(uv, n, n1, n2, n3) of sorted rows (key, n)."""
    uv, n = counts[:, 0] // UNITS, counts[:, 1]
    head = np.flatnonzero(np.diff(uv, prepend=-1))
    if not len(head):
        return np.zeros((0, 5), np.int64)
    return np.stack([uv[head], *(np.add.reduceat(x.astype(np.int64), head) for x in (n, n == 1, n == 2, n > 2))], axis=1)


def perplexities(df: DataFrame, tables: Tables, model: Model, path: str, shards: int | None = None) -> DataFrame:
    """doc_id, lang, n_units, perplexity of each row of (doc_id, text, lang)."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = model.splits(shards)

    def place(v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix((v * (1 << 20) + part).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def shard_of(uv: np.ndarray) -> np.ndarray:
        u, v = uv // UNITS, uv % UNITS
        return place(v, (mix(u.astype(np.uint64)) % splits[v].astype(np.uint64)).astype(np.int64))

    def packer(kind: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            zip_ = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
                if kind == LOWER:  # a copy for each shard that has a part of v
                    v = rows[:, 0] // UNITS
                    n = splits[v]
                    rows, part = np.repeat(rows, n, axis=0), counting(n)
                    s = place(np.repeat(v, n), part)
                else:
                    s = shard_of(rows[:, 0] // UNITS)
                order = np.lexsort((rows[:, 0], s))
                for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                    if len(part):
                        columns = rows[part]
                        columns[:, 0] = _delta(columns[:, 0])
                        yield _row(int(s[part[0]]), kind, None, zip_.compress(_planes(columns)))

        return pack

    def pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, task = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        top = np.stack([model.top, model.top_logp], axis=1)
        for number, batch in enumerate(pieces(batches, "text", 16 << 20)):
            name = f"{task}-{number}"
            n, local, keys, docs = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found, times = np.unique(trigrams(path, text or ""), return_counts=True)
                logp, there = look_up(top, found)
                n.append(int(times.sum()))
                local.append(int((logp[:, 0] * times).sum()))
                rest, times = found[~there], times[~there]
                keys.append(np.repeat(rest, times))
                docs.append(np.full(int(times.sum()), i, dtype=np.int32))
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            s = shard_of(keys // UNITS)
            order = np.lexsort((docs, keys, s))
            for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                if len(part):
                    distinct, times = np.unique(keys[part], return_counts=True)
                    body = [len(distinct).to_bytes(8, "little"), len(n).to_bytes(8, "little"), _planes(_delta(distinct)), _planes(times.astype(np.int32)), _planes(docs[part].astype(np.uint16 if len(n) <= 1 << 16 else np.int32))]
                    yield _row(int(s[part[0]]), PAIRS, name, zip_.compress(b"".join(body)))
            meta = pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array(n, pa.int64()), pa.array(local, pa.int64())], names=["doc_id", "lang", "n", "sum"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as out:
                out.write_batch(meta)
            yield _row((task * 31 + number) % shards, META, name, zip_.compress(sink.getvalue().to_pybytes()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        parts: list[list[np.ndarray]] = [[np.zeros((0, 2), np.int64)] for _ in (COUNTS, LOWER)]
        known: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                kind, name, body = batch.column("kind")[i].as_py(), batch.column("batch")[i].as_py(), batch.column("body")[i].as_py()
                if kind == META:
                    yield _row(0, META, name, body)
                    continue
                raw = unzip.decompress(body)
                if kind < PAIRS:
                    part = _numbers(raw, np.dtype((np.void, 16)), len(raw) // 16, 0).view(np.int64).reshape(-1, 2)
                    part[:, 0] = np.cumsum(part[:, 0])
                    parts[kind].append(part)
                    continue
                if not known:  # tables come first
                    for p in parts:
                        all_ = np.concatenate(p)
                        known.append(all_[np.argsort(all_[:, 0], kind="stable")])
                    known.insert(1, contexts(known[0]))
                    parts = []
                n, rows = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
                distinct, times = np.cumsum(_numbers(raw, np.int64, n, 16)), _numbers(raw, np.int32, n, 16 + 8 * n)
                docs = _numbers(raw, np.uint16 if rows <= 1 << 16 else np.int32, int(times.sum()), 16 + 12 * n)
                c, context, n2 = (look_up(k, x)[0] for k, x in zip(known, (distinct, distinct // UNITS, distinct % (UNITS * UNITS)), strict=True))
                logp = np.repeat(model.logp(distinct, c[:, 0], context, n2[:, 0]), times)
                sums = np.bincount(docs, logp, rows).astype(np.int64)  # exact: whole numbers far below 2 ** 53
                yield _row(0, PAIRS, name, zip_.compress(sums.tobytes()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        sums: dict[str, np.ndarray] = {}
        metas: dict[str, bytes] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                kind, name, body = batch.column("kind")[i].as_py(), batch.column("batch")[i].as_py(), batch.column("body")[i].as_py()
                if kind == META:
                    metas[name] = body
                else:
                    part = np.frombuffer(unzip.decompress(body), dtype=np.int64)
                    sums[name] = sums[name] + part if name in sums else part
        for name, body in metas.items():
            meta = next(iter(pa.ipc.open_stream(unzip.decompress(body))))
            n, total = meta.column("n").to_numpy(), meta.column("sum").to_numpy() + sums.get(name, 0)
            with np.errstate(over="ignore"):
                ppl = np.exp(-total / UNIT / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*meta.columns[:2], meta.column("n"), pa.array(ppl, pa.float64(), mask=n == 0)], ["doc_id", "lang", "n_units", "perplexity"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(pack_documents, ROW)
    for kind, t in ((COUNTS, tables.counts), (LOWER, tables.pairs)):
        rows = rows.union(t.select(*(F.col(c).cast("long") for c in t.columns)).mapInArrow(packer(kind), ROW))
    scored = rows.repartition(shards, "shard").sortWithinPartitions("kind").mapInArrow(score, ROW)
    return scored.repartition(shards, "batch").mapInArrow(add_up, "doc_id long, lang string, n_units long, perplexity double")


def judge(df: DataFrame, labels: DataFrame, path: str | None = None, quantile: float = QUANTILE, shards: int | None = None) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold, kept of each row of (doc_id, text, lang)."""
    path = path or vocabulary()
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = table(good.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).alias("held")), "op7-trusted")
    taught = good.where("NOT held").select("doc_id")
    # ids are distinct; the optimiser would push a semi join below the bitmap
    tables, model = learn(possible(df, taught).join(taught.hint("shuffle_hash"), "doc_id"), path)
    found = table(perplexities(df, tables, model, path, shards), "op7-perplexities")
    held = found.join(good.where("held").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    of = held.where("lang IS NOT NULL").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    common = held.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    limit = F.coalesce(F.col("own"), F.lit(common).cast("double"), F.lit(float("inf")))
    return found.join(of, "lang", "left").select("doc_id", "lang", "n_units", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERY = ("op7_quality_kneser_ney", query)
