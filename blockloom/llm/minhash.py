"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of `width` words (A-Z lower-cased; with fewer words, the whole sequence). Under
each of `perms` hash permutations both the least and the greatest value are kept, so a signature of 2 x perms values costs
perms evaluations. `bands` bands of `rows` values propose candidates; a link needs a Jaccard similarity of `percent` or more
on the full sets. With 80 permutations, 32 bands of 5, a pair at 0.8 is missed with probability 3e-6, at 0.85 with 1e-8.

How links are found without all pairs of a bucket: equal sets are one node (the least id). In each bucket every member is
first compared with three hubs (least id, greatest id, least hash of the id) and linked members become components. Where a
bucket still holds members of different components, its members go through an exact prefix and position filter
(`possible`) that leaves next to no pairs below the threshold; what passes is compared too. No link between candidates of
different components is left unchecked.

Scale: the texts are shuffled once, compressed, and only for candidates; buckets, links and components are tables of ids.
Hot keys (a large group of copies, a hub) sit on the side of sort-merge joins that adaptive execution may split.

Defined results: null texts and texts without words have an empty set, are linked with nothing and kept; rows with a null
id likewise (their component is null); rows that repeat an id with its text share its component; different texts of one id are
judged apart: each has the least id that it reaches itself, and is kept if that is its own; every input row comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.journal import numbered
from .common import MIX_1, PHI, documents, gram_hashes, joined, mix, pieces, spans, table, utf8, word_hashes
from .components import components

WIDTH = 4
PERCENT = 80
PERMS, BANDS, ROWS = 80, 32, 5
SLOTS = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data, at = joined(texts)
    data = _LOWER[data]
    words = word_hashes(data, *(s := spans(data)))
    bounds = np.searchsorted(s[0], at)
    grams = gram_hashes(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * PHI)
    return x[:n], x[n:] | np.uint64(1)


def min_max(values: np.ndarray, at: np.ndarray, perms: int) -> np.ndarray:
    """(sets x 2 perms): least and greatest value of each set under each permutation. at: where each set starts; none is empty."""
    xor, mul = _seeds(perms)
    out = np.empty((len(at), 2 * perms), dtype=np.uint64)
    for p in range(perms):
        t = (values ^ xor[p]) * mul[p]
        t ^= t >> np.uint64(32)
        t *= MIX_1
        out[:, 2 * p] = np.minimum.reduceat(t, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(t, at)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * PHI + signature[:, b * rows + r])
        out[:, b] = key
    return out


def sketches(df: DataFrame, width: int = WIDTH, perms: int = PERMS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (128 bits that stand for the set), bands (null for an empty set)."""
    if bands * rows > 2 * perms:
        raise ValueError("the bands need more values than the signature has")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            sets = shingle_sets(utf8(batch.column("text")), width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(n)
            s = np.zeros((len(sets), 2), dtype=np.uint64)
            keys: list = [None] * len(sets)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                s[full, 0], s[full, 1] = np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ PHI), at)
                for i, k in zip(full, band_keys(min_max(values, at, perms), bands, rows).view(np.int64), strict=True):
                    keys[i] = k
            signed = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "bands"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def _packed(df: DataFrame) -> DataFrame:
    """doc_id, z: the compressed text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([zip_.compress(t) for t in utf8(batch.column("text"))], pa.binary())], ["doc_id", "z"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, z binary")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        last, b_set = None, None
        for batch in batches:
            zs = batch.column("za").to_pylist()
            sets = [x for i in range(0, len(zs), 500) for x in shingle_sets([unzip.decompress(z) for z in zs[i : i + 500]], width)]
            keep = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                if b != last:
                    last, b_set = b, shingle_sets([unzip.decompress(batch.column("zb")[i].as_py())], width)[0]
                both = len(np.intersect1d(sets[i], b_set, assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[i]) + len(b_set) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
    return two.select("a", "b", "za", "zb").mapInArrow(check, "a long, b long")


def _unpacked_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    unzip, zs = zstandard.ZstdDecompressor(), batch.column("z").to_pylist()
    return [x for i in range(0, len(zs), 500) for x in shingle_sets([unzip.decompress(z) for z in zs[i : i + 500]], width)]


def possible(nodes: DataFrame, width: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """Pairs (a, b), a > b, of nodes (node, component, z) of different components that may be similar enough: an exact filter.

    Every set is put in one order, rare shingles first (counts by hash slot, `slots` numbers at most, are broadcast). Sets that
    are similar enough share a shingle among the first of both, and the first such one leaves enough of both sets behind it.
    Members of a group that each have words of their own fail that at once, so groups do not turn into pairs.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for s in _unpacked_sets(batch, width):
                np.add.at(held, (s % np.uint64(slots)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["slot", "n"])

    seen = nodes.select("z").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(slots, dtype=np.int64)
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    del seen
    shared = nodes.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                tokens, sizes, places = [], [], []
                sets = _unpacked_sets(batch, width)
                for s in sets:
                    n = len(s)
                    p = n - -(-percent * n // 100) + 1
                    best = np.lexsort((s, order[(s % np.uint64(slots)).astype(np.int64)]))[:p]
                    tokens.append(s[best].view(np.int64))
                    sizes.append(len(best))
                    places.append(np.arange(len(best)))
                take = pa.array(np.repeat(np.arange(len(sets)), sizes))
                columns = [pa.array(np.concatenate(tokens)), batch.column("node").take(take), batch.column("component").take(take), pa.array(np.repeat([len(s) for s in sets], sizes), pa.int64()), pa.array(np.concatenate(places), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "component", "n", "place"])

    rows = table(nodes.mapInArrow(first, "token long, node long, component long, n long, place long"), "op9-first")
    x = rows.alias("x")  # the larger set
    y = rows.where(F.expr(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}")).alias("y")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.node") < F.col("x.node"))))
        & (100 * F.col("y.n") >= percent * F.col("x.n")) & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n"))),
    ).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _numbered_texts(df: DataFrame) -> DataFrame | None:
    """The rows with an id, with `_number`, which tells the texts of an id apart and rises with the id; None if every id has one text only."""
    named, of = df.where("doc_id IS NOT NULL"), F.xxhash64("text")
    if named.groupBy("doc_id").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo < hi").isEmpty():
        return None
    at = F.struct(F.col("doc_id").cast("long").alias("id"), of.alias("text")).alias("_at")
    numbers = table(numbered(named.select(at).distinct(), "_at", "_number"), "op9-numbers")
    return table(named.select("*", at).join(numbers, "_at").drop("_at"), "op9-numbered")


def near_duplicates(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, perms: int = PERMS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text)."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbers = _numbered_texts(df)
    if numbers is None:
        return _judged(df, width, percent, perms, bands, rows)
    found = _judged(numbers.select(F.col("_number").alias("doc_id"), "text"), width, percent, perms, bands, rows)
    ids = numbers.select("_number", "doc_id").distinct()
    own = found.join(ids.select(F.col("_number").alias("_own"), F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_own"))
    led = own.join(ids.select(F.col("_number").alias("_least"), F.col("doc_id").alias("_lead")), F.col("component_id") == F.col("_least"))
    out = led.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("_lead").alias("component_id"), (F.col("_id") == F.col("_lead")).alias("kept"))
    return out.union(_judged(df.where("doc_id IS NULL"), width, percent, perms, bands, rows))


def _judged(df: DataFrame, width: int, percent: int, perms: int = PERMS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates, where rows that share an id share their text."""
    sk = table(sketches(df, width, perms, bands, rows), "op9-sketches")
    named = sk.where("doc_id IS NOT NULL AND n > 0")
    nodes = table(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("bands").alias("bands")), "op9-nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    me = F.struct("node", "n")
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(me).alias("h1"), F.max(me).alias("h2"), F.min_by(me, F.xxhash64("node")).alias("h3")).where("c > 1").drop("c")
    members = table(keyed.join(hubs, "key"), "op9-members")

    def able(n1, n2):
        return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)

    hub = F.explode(F.array("h1", "h2", "h3"))
    stars = members.select("node", "n", hub.alias("h")).where((F.col("node") != F.col("h.node")) & able(F.col("n"), F.col("h.n")))
    stars = table(stars.select(F.greatest("node", "h.node").alias("a"), F.least("node", "h.node").alias("b")).distinct(), "op9-stars")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = table(_packed(df).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "op9-texts")
    links = table(confirmed(stars, texts, width, percent), "op9-links")

    of = components(links, "a", "b")
    tagged = members.select("key", "node", "n").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tagged = table(tagged, "op9-tagged")
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = tagged.join(mixed, "key", "left_semi").select("node", "component").distinct()
    left = table(left.join(texts, F.col("node") == texts["doc_id"]).select("node", "component", "z"), "op9-open")
    across = table(possible(left, width, percent).join(stars, ["a", "b"], "left_anti"), "op9-across")
    more = table(confirmed(across, texts, width, percent), "op9-more")
    if not more.isEmpty():
        of = components(links.union(more), "a", "b")

    final = nodes.select("s1", "s2", "node").join(of, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    found = sk.select("doc_id", "n", "s1", "s2").join(final, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows (all columns) of which one stays for each group of near duplicates: the least id, once. Different texts of one id are judged apart."""
    named, unnamed = df.where("doc_id IS NOT NULL"), df.where("doc_id IS NULL")
    rows = _numbered_texts(df)
    if rows is not None:
        gone = _judged(rows.select(F.col("_number").alias("doc_id"), "text"), width, percent).where("NOT kept").select(F.col("doc_id").alias("_number"))
        return rows.join(gone, "_number", "left_anti").dropDuplicates(["_number"]).select(*df.columns).union(unnamed)
    gone = _judged(df.select("doc_id", "text"), width, percent).where("NOT kept").select("doc_id")
    return named.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(*df.columns).union(unnamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERY = ("op9_minmax_hash", query)
