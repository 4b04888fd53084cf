"""Literal fixtures, round trips and properties of the operators."""

import hashlib
import lzma
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.functions import codecs, hashing, sharding, values
from blockloom.operators import addressing, cluster, journal, metrics, rechunk, snapshot, store
from blockloom.sources import headers, shared, volumes


def blocks_of(spark, data: bytes, size: int):
    rows = [(i // size, bytearray(data[i : i + size])) for i in range(0, len(data), size)]
    return spark.createDataFrame(rows, "block_index bigint, content binary")


def as_dict(df):
    return {r.block_index: bytes(r.content) for r in df.collect()}


# golden bytes (fixed values): block sizes 2 and 8
SMALL = bytes([0, 1, 2, 3, 0, 0, 4, 5, 6, 7, 8, 9, 0, 0, 0, 0, 0, 0, 1, 2, 3, 0, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0, 6, 0, 7, 0, 8, 0, 0, 9, 0, 1, 0, 2, 0, 3])


@pytest.mark.parametrize(("source", "target"), [(2, 8), (8, 2), (2, 2), (8, 8), (2, 16), (16, 4)])
def test_rechunk_keeps_the_bytes(spark, source, target):
    out = as_dict(rechunk.rechunk(blocks_of(spark, SMALL, source).where(~store.is_zero(F.col("content"))), source, target))
    whole = bytearray(len(SMALL) + target)
    for i, c in out.items():
        assert len(c) == target and any(c)
        whole[i * target : i * target + target] = c
    assert bytes(whole[: len(SMALL)]) == SMALL


def test_deflate_undoes_inflate(spark):
    rng = random.Random(4)
    data = bytes(rng.choice([0, 0, 1, 7]) for _ in range(4 * 97))
    rows = blocks_of(spark, data, 4).where(~store.is_zero(F.col("content")))
    assert as_dict(rechunk.deflate(rechunk.inflate(rows, 4, 8), 4, 8)) == as_dict(rows)


# extents and rates (fixed values)
@pytest.mark.parametrize(
    ("last", "source", "target", "content", "size"),
    [(0, 512, 512, b"\1", 512), (1, 512, 512, b"\1", 1024), (4, 512, 512, b"\1", 2560), (1, 512, 1024, b"\1", 1024), (2, 512, 1024, b"\1", 2048), (9, 128, 1024, b"\1", 2048),
     (0, 4, 2, bytes([0, 1, 0, 0]), 2), (0, 8, 2, bytes([0, 1, 1, 0, 0, 0, 1, 0]), 8), (1, 8, 2, bytes([0, 1, 1, 0, 0, 1, 0, 0]), 14)],
)
def test_extent(spark, last, source, target, content, size):
    rows = spark.createDataFrame([(last, bytearray(content))], "block_index bigint, content binary")
    assert snapshot.extent(rows, source, target).first().size == size


def test_adjacent_unique(spark):
    rows = spark.createDataFrame(list(enumerate([1, 1, 4, 2, 2, 2, 3])), "i int, v int")
    assert [r.v for r in journal.adjacent_unique(rows, "v", "i").orderBy("i").collect()] == [1, 4, 2, 3]


@pytest.mark.parametrize(("sizes", "seconds", "iops", "kibs"), [([2048], 0, 1, 2), ([1024, 1024, 2048], 1, 3, 4), ([1024] * 3, 30, 0.1, 0.1), ([4096] * 5, 5, 1, 4), ([2**63 - 1] * 2, 1, 2, 2 * (2**63 - 1) / 1024), ([], 30, 0, 0)])
def test_io_rates(spark, sizes, seconds, iops, kibs):
    r = metrics.io_rates(spark.createDataFrame([(x,) for x in sizes], "bytes bigint"), float(seconds)).first()
    assert r.iops == pytest.approx(iops) and r.kibs == pytest.approx(kibs)


def test_hashes_and_codecs(spark):
    rows = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,)], "c binary")
    key = bytes(range(32))
    out = rows.select(
        "c", hashing.blake2b_256()("c").alias("plain"), hashing.blake2b_256(b"\1")("c").alias("keyed"), codecs.xz_decompress(codecs.xz_compress(F.col("c"))).alias("xz"),
        codecs.gzip_decompress(codecs.gzip_compress(F.col("c"))).alias("gz"), codecs.decrypt(codecs.encrypt(F.col("c"), key), key).alias("aes"),
    ).collect()
    for r in out:
        if r.c is None:
            assert r.plain is r.keyed is r.xz is r.gz is r.aes is None
        else:
            assert bytes(r.plain) == hashlib.blake2b(r.c, digest_size=32).digest() and bytes(r.keyed) == hashlib.blake2b(r.c, digest_size=32, key=b"\1").digest()
            assert r.xz == r.gz == r.aes == r.c
    with pytest.raises(ValueError):
        codecs.encrypt(F.col("c"), bytes(32))


def test_jump_hash_and_fallback(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * sharding.JUMP_MULTIPLIER + 1) % 2**64
            j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
        return b

    keys = [0, 1, 2, 77, 2**40 + 3, 2**62]
    for n in (1, 4, 15, 64):
        rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_hash(F.col("k"), n).alias("b")).collect()
        assert all(r.b == jump(r.k, n) for r in rows)
    alive = [True, False, True, False]
    for r in spark.range(40).select("id", sharding.shard_by_index(F.col("id"), alive).alias("s")).collect():
        assert alive[r.s] and (r.s == r.id % 4 or not alive[r.id % 4])
    with pytest.raises(ValueError):
        sharding.shard_by_index(F.col("id"), [False])


def test_values(spark):
    r = spark.range(1).select(
        values.version_pack(F.lit("1.2.3-alpha")).alias("v"), values.version_pack(F.lit("x")).alias("bad"), values.version_text(F.lit(66051).cast("bigint")).alias("t"), values.server_list(F.lit(" a:1@3, ,b:2")).alias("s"),
        values.next_power_of_two(F.lit(33).cast("bigint")).alias("p"), values.state_name(F.lit(4)).alias("rip"), values.valid_address(F.lit("localhost:99")).alias("ok"), values.valid_block_size(F.lit(768)).alias("no"),
    ).first()
    assert r.v == 66051 and r.bad is None and r.t == "1.2.3" and [(x.address, x.db) for x in r.s] == [("a:1", 3), ("b:2", 0)]
    assert (r.p, r.rip, r.ok, r.no) == (64, "rip", True, False)


def test_snapshot_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = blocks_of(spark, bytes(rng.choice([0, 3]) for _ in range(8 * 50)), 8).where(~store.is_zero(F.col("content")))
    root = f"file://{tmp_path}"
    for name in ("one", "two"):
        try:
            known = snapshot.read(spark, root, "one")[1]
        except Exception:
            known = None
        map_, fresh = snapshot.export(rows, 8, 16, known, b"k" * 8)
        if known is not None:
            assert fresh.isEmpty()
        snapshot.write(root, name, map_, fresh)
    assert [r.snapshot for r in snapshot.listed(spark, root, "^t").collect()] == ["two"]
    assert as_dict(snapshot.restore(*snapshot.read(spark, root, "two"), 16, 8, b"k" * 8)) == as_dict(rows)
    with pytest.raises(Exception, match="corrupt"):
        snapshot.restore(*snapshot.read(spark, root, "two"), 16, 8, b"other").collect()
    with pytest.raises(Exception, match="too large"):
        snapshot.fits(rows, 8, 8, 8).collect()


def test_contents_of_an_export_travel_once(spark, tmp_path):
    """Blocks are put together once for map and contents; known contents and copies go where rows are dealt by ranges of the hash."""
    rows = spark.range(400).select(F.col("id").alias("block_index"), F.concat(F.lit("c"), (F.col("id") % 90).cast("string")).cast("binary").alias("content"))
    _, before = snapshot.export(rows.where("block_index < 40"), 8, 8)
    snapshot.write(str(tmp_path), "one", *snapshot.export(rows.where("block_index < 40"), 8, 8))
    map_, fresh = snapshot.export(rows, 8, 8, snapshot.read(spark, str(tmp_path), "one")[1])
    for part in (map_, fresh):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == plan.count("Exchange rangepartitioning") == (part is fresh) and "Python" not in plan
    assert before.count() == 40 and sorted(bytes(r.content) for r in fresh.collect()) == sorted(f"c{i}".encode() for i in range(40, 90)) and map_.count() == 400


def test_blocks_and_journal_on_disk(spark, tmp_path):
    image = tmp_path / "disk.img"
    image.write_bytes(b"ab" + bytes(4) + b"cde")
    rows = volumes.read_image(spark, str(image), 2)
    assert {r.block_index: bytes(r.content) for r in rows.collect()} == {0: b"ab", 3: b"cd", 4: b"e"}
    image.write_bytes(b"ab" + bytes(4) + b"cd")
    assert {r.block_index: bytes(r.content) for r in volumes.read_image(spark, str(image), 2, 4).collect()} == {0: b"ab", 3: b"cd"}
    rows = spark.createDataFrame([("disk", i, bytearray(c)) for i, c in ((0, b"ab"), (3, b"cd"), (4, b"e"))], "volume string, block_index bigint, content binary")
    volumes.write_blocks(rows, str(tmp_path / "blocks"))
    assert volumes.read_blocks(spark, str(tmp_path / "blocks"), "disk").count() == 3
    assert volumes.delete_volume(spark, str(tmp_path / "blocks"), "disk") and not volumes.delete_volume(spark, str(tmp_path / "blocks"), "disk")
    day = 86_400_000_000_000
    log = spark.createDataFrame([("v", i, i, 1, i * day // 4, None, bytearray(b"x")) for i in range(1, 13)], "volume string, seq bigint, block_index bigint, op tinyint, ts bigint, hash binary, data binary")
    volumes.write_journal(log, str(tmp_path / "log"))
    part = volumes.read_journal(spark, str(tmp_path / "log"), "v", day, 2 * day)
    assert sorted(r.seq for r in part.collect()) == [4, 5, 6, 7, 8]
    assert "PartitionFilters: [" in part._jdf.queryExecution().toString() and volumes.last_sequence(log).first().last_seq == 12


def test_config_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(volumes.config_document("vdisk", {"a": {"size": 3}, "b": {"size": 4}}))
    assert {(r.id, r.size) for r in volumes.read_config(spark, str(tmp_path / "c.json"), "vdisk", "size: int").collect()} == {("a", 3), ("b", 4)}


def test_config_documents_are_whole(spark, tmp_path):
    """Documents that share a file are all read; those written are one a file, of bounded length, and lose no entry of an id that comes twice."""
    (tmp_path / "two.json").write_text('\n{"vdisk": {"a": {"size": 3}}}\n' + volumes.config_document("vdisk", {"b": {"size": 4}}) + "\n{'vdisk': {'c': {'size': 5}}}")
    assert sorted(map(tuple, volumes.read_config(spark, str(tmp_path / "two.json"), "vdisk", "size: int").collect())) == [("a", 3), ("b", 4), ("c", 5)]
    rows = spark.range(500).select(F.concat(F.lit("v"), (F.col("id") % 400).cast("string")).alias("id"), F.col("id").cast("int").alias("size"))
    volumes.write_config(rows, str(tmp_path / "many"), "vdisk", 50)
    found = [x.read_text() for x in (tmp_path / "many").glob("part-*")]
    assert len(found) > 10 and all(x.count("vdisk") == 1 and x.count("size") < 100 for x in found)
    assert sorted(map(tuple, volumes.read_config(spark, str(tmp_path / "many"), "vdisk", "size: int").collect())) == sorted(map(tuple, rows.collect()))


def test_image_files_share_folders(spark, tmp_path):
    """A file a text, in folders for many files each."""
    volumes.write_images(spark.range(2500).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")), str(tmp_path / "images"), 1000)
    folders = [x for x in (tmp_path / "images").iterdir() if x.is_dir()]
    found = [x.read_bytes() for f in folders for x in f.glob("part-*")]
    assert len(folders) == 3 and sorted(found) == sorted(f"text {i}\0".encode() for i in range(2500))
    rows = volumes.read_image(spark, str(tmp_path / "images"), 4).where("block_index = 1")
    assert sorted(bytes(r.content).strip(b"\0") for r in rows.collect()) == sorted(f" {i}"[:4].encode() for i in range(2500))


def test_partial_writes(spark):
    r = spark.createDataFrame([(bytearray(b"ab"), None)], "c binary, n binary").select(
        addressing.merge_write(F.col("c"), F.lit(b"xy"), F.lit(3), 6).alias("w"), addressing.merge_write(F.col("n"), F.lit(b"xy"), F.lit(0), 4).alias("e"),
        addressing.merge_zeroes(F.col("c"), F.lit(1), F.lit(2), 4).alias("z"), addressing.merge_zeroes(F.col("n"), F.lit(1), F.lit(2), 4).alias("zn"), addressing.padded_read(F.col("c"), F.lit(1), 3).alias("r"),
    ).first()
    assert (bytes(r.w), bytes(r.e), bytes(r.z), r.zn, bytes(r.r)) == (b"ab\0xy\0", b"xy\0\0", b"a\0\0\0", None, b"b\0\0")


def test_pieces_by_ranges_of_blocks(spark):
    """The same pieces; they are made behind the shuffle, where blocks are counted without another."""
    n = addressing.RANGE * 8
    rows = spark.createDataFrame([(0, 1), (n - 3, 9), (n * 2 - 1, n * 3), (n, 0), (n * 7, 8), (None, 4)], "offset bigint, length bigint")
    names = ("block_index", "block_offset", "piece_length")
    made = addressing.ranged_pieces(rows, 8)
    assert sorted(map(tuple, made.select(*names).collect())) == sorted(map(tuple, addressing.split_requests(rows, 8).select(*names).collect()))
    plan = made.groupBy("block_range", "block_index").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]


def test_zipped_clusters(spark):
    a = spark.createDataFrame([(0, "a", 0), (1, "b", 0)], "server_index int, address string, db int")
    assert {(r.address, r.target_address) for r in cluster.zipped(a, a).collect()} == {("a", "a"), ("b", "b")}
    with pytest.raises(Exception, match="differ in size"):
        cluster.zipped(a, a.where("server_index = 0")).collect()


def test_overlay_null_hides_the_base(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "block_index bigint, content string")
    over = spark.createDataFrame([(2, None), (3, "c")], "block_index bigint, content string")
    assert {r.block_index: r.content for r in store.overlay(base, over).collect()} == {1: "a", 2: None, 3: "c"}


def test_seq_bound_reaches_the_scan(spark, sf_dir):
    rows = journal.bounded(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"), "event_id", 5, 9)
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_id,5)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def arrivals(spark, seqs):
    return spark.createDataFrame([("v", s, i) for i, s in enumerate(seqs)] + [("w", 1, 0)], "volume string, seq bigint, arrival bigint")


@pytest.mark.parametrize("chunk", [1_000_000, 1, 2, 3])
@pytest.mark.parametrize(
    ("seqs", "verdicts"),
    [
        ([1, 3, 2, 3], "accept early accept accept"),
        ([1, 2, 2, 1, 3], "accept accept duplicate duplicate accept"),
        ([2, 3, 1, 4, 2, 3, 4], "early early accept early accept accept accept"),
        ([0, None, 1, 1], "duplicate None accept duplicate"),
    ],
)
def test_arrivals(spark, seqs, verdicts, chunk):
    got = journal.accepted(arrivals(spark, seqs), chunk=chunk)
    assert [str(r.verdict) for r in got.where("volume = 'v'").orderBy("arrival").collect()] == verdicts.split()
    assert got.where("volume = 'w' AND verdict = 'accept'").count() == 1 and got.columns == ["volume", "seq", "arrival", "verdict"]


def test_numbers_are_dense_when_written(spark, tmp_path):
    n = 2_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("x"))
    journal.numbered(rows, "x", "n", 8).write.parquet(str(tmp_path / "numbered"))
    got = spark.read.parquet(str(tmp_path / "numbered"))
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (n, 1, n)
    assert [tuple(r) for r in journal.numbered(spark.createDataFrame([(5, 7, 9)], "_at int, _part int, _start int"), "_at", "n").collect()] == [(5, 7, 9, 1)]
    assert got.select("n", F.lag("x").over(Window.orderBy("n")).alias("b"), "x").where("b > x").isEmpty()


def test_neighbours_without_a_partition(spark):
    """A5's fixture: adjacent repeats of 1, 1, 4, 2, 2, 2, 3."""
    rows = spark.createDataFrame(list(enumerate([1, 1, 4, 2, 2, 2, 3])), "i bigint, x bigint")
    assert [r.x for r in journal.adjacent_unique(rows, "x", "i").orderBy("i").collect()] == [1, 4, 2, 3]
    assert [tuple(r) for r in journal.gaps(spark.createDataFrame([(1,), (2,), (6,), (7,)], "seq bigint")).collect()] == [(2, 6, 3)]


def test_forced_flush_waits_for_its_row(spark):
    """A flush asked for at row 5 comes when row 5 does; the timer runs from the first row and from every flush on."""
    rows = spark.createDataFrame([("v", i, float(t)) for i, t in enumerate([0, 1, 2, 3, 4, 5, 40, 41, 42], 1)], "volume string, seq bigint, ts double")
    force = spark.createDataFrame([("v", 5)], "volume string, seq bigint")

    def made(**more):
        return sorted((r.first_seq, r.last_seq) for r in journal.flushed(rows, 25, 25, **more).collect())

    assert made() == [(1, 6), (7, 9)] and made(forced=force) == [(1, 5), (6, 6), (7, 9)]
    assert made(after=spark.createDataFrame([("v", 2)], "volume string, seq bigint")) == [(3, 6), (7, 9)]
    assert sorted((r.first_seq, r.n) for r in journal.flushed(rows, 2, 25).collect()) == [(1, 2), (3, 2), (5, 2), (7, 2), (9, 1)]


def test_catching_up_checks_the_end(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a"), (2, 2, 1, "b"), (3, 1, 2, None)], "seq bigint, block_index bigint, op int, data string")
    state = spark.createDataFrame([(1, "a")], "block_index bigint, data string")
    assert [tuple(r) for r in journal.caught_up(state, rows, 1, 3).collect()] == [(2, "b")]
    with pytest.raises(ValueError, match="end at 4"):
        journal.caught_up(state, rows, 1, 4)


def test_overlay_store(spark):
    """A bit is never unset: after a delete the template's block does not come back."""
    base, over, none = (spark.createDataFrame(x, "block_index bigint, content string") for x in ([(1, "a"), (2, "b")], [], []))
    base, over, touched = store.overlay_write(base, over, none.select("block_index"), spark.createDataFrame([(2, "x")], "block_index bigint, content string"))
    gone = spark.createDataFrame([(2,), (1,)], "block_index bigint")
    assert {r.block_index for r in base.collect()} == {1} and {tuple(r) for r in over.collect()} == {(2, "x")} and {r.block_index for r in touched.collect()} == {2}
    base, over = store.overlay_delete(base, over, touched, gone)
    assert base.isEmpty() and over.isEmpty() and touched.count() == 1


def test_bitmaps(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 63, 64, 1000, 32_768, 2**40)], "block_index bigint")
    back = store.from_bitmap(store.bitmap_of_bytes(store.bitmap_bytes(store.to_bitmap(rows), 4), 4))
    assert sorted(r.block_index for r in back.collect()) == [0, 63, 64, 1000, 32_768, 2**40]


def test_shards_with_few_servers_alive(spark):
    alive = [i == 41 for i in range(64)]
    assert {r.s for r in spark.range(500).select(sharding.shard_by_index(F.col("id"), alive).alias("s")).collect()} == {41}


def test_codecs_hold_a_slice_of_a_batch_in_python(spark):
    content = pa.array([None, b"", *(bytes([i % 251]) * 2000 for i in range(10_000))])
    tracemalloc.start()
    try:
        there = codecs._mapped(bytes)(content)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert there.equals(content) and peak < content.nbytes / 10
    rows = spark.createDataFrame([(1, bytearray(b"abc" * 999)), (2, bytearray()), (3, None)], "i int, c binary")
    for there, back in codecs.COMPRESSIONS.values():
        assert [tuple(r) for r in rows.select("i", back(there(F.col("c"))).alias("c")).orderBy("i").collect()] == [(1, b"abc" * 999), (2, b""), (3, None)]


def test_xz_sets_up_no_more_than_the_content_needs(spark):
    content = bytes(range(256)) * 40
    z = bytes(spark.range(1).select(codecs.xz_compress(F.lit(content)).alias("z")).first().z)
    assert lzma.LZMADecompressor(memlimit=1 << 20).decompress(z) == content and len(z) <= len(lzma.compress(content))


def test_erasure_codes():
    rng = random.Random(6)
    for k, m in ((1, 1), (4, 2), (16, 4), (3, 5)):
        code = codecs.Erasure(k, m)
        for size in (0, 1, 17, 400):
            content = rng.randbytes(size)
            shards = code.encode(content)
            lost = rng.sample(range(k + m), m)
            assert len(shards) == k + m and code.decode([None if i in lost else s for i, s in enumerate(shards)]) == content
    with pytest.raises(ValueError, match="too few"):
        codecs.Erasure(4, 2).decode([None] * 3 + code.encode(b"x")[:3])


def test_totals_and_counts_of_copies(spark):
    rows = spark.range(300).select(F.col("id").alias("block_index"))
    made = cluster.copied_counts(cluster.cloned(rows, 3, 2, 128), 128)
    assert sorted(map(tuple, made.collect())) == [(0, 0, 1), (1, 1, 1), (2, 0, 1)] and cluster.total(made).first().n == 3
    with pytest.raises(Exception, match="nothing was copied"):
        cluster.total(made.where("false")).collect()
    assert [cluster.clone_case(3, x) for x in (None, 3, 4)] == ["same cluster", "same count", "reshard"]


def test_sources_by_name():
    assert volumes.source("image") is volumes.read_image
    with pytest.raises(KeyError, match="no source ftp"):
        volumes.source("ftp")
    with pytest.raises(ValueError, match="taken"):
        volumes.register("image", volumes.read_blocks)


def test_default_snapshot_id_and_clock(spark):
    import time

    r = spark.range(1).select(snapshot.snapshot_id(F.lit("v")).alias("s"), values.now_ns().alias("t")).first()
    assert abs(int(r.s.split("_")[1]) - time.time()) < 60 and abs(r.t / 1e9 - time.time()) < 60


def test_blocks_that_are_too_long_fail(spark):
    with pytest.raises(Exception, match="more than 4 bytes"):
        spark.range(1).select(addressing.merge_write(F.lit(b"abcde"), F.lit(b"x"), F.lit(0), 4)).collect()


def test_header_that_does_not_fit_fails(spark):
    map_ = spark.createDataFrame([(i, f"h{i}") for i in (1, 70_000, 3)], "block_index bigint, hash string")
    made = snapshot.header(map_, "s", 4096, "v", 1)
    assert made.count() == 2 and {tuple(r) for r in snapshot.header_rows(made).collect()} == {tuple(r) for r in map_.collect()}
    with pytest.raises(Exception, match="invalid header"):
        snapshot.header_rows(made.withColumn("map", F.col("map").withField("c", F.lit(9)))).collect()


def test_bencoded_headers(spark):
    x = {"b": [1, -2, "abc"], "a": {"c": ""}}
    assert headers.bencode(x) == b"d1:ad1:c0:e1:bli1ei-2e3:abcee" and headers.bdecode(headers.bencode(x)) == x
    for bad in (b"", b"i1", b"3:ab", b"x", b"i1ei2e", b"d1:ae"):
        with pytest.raises(ValueError):
            headers.bdecode(bad)
    map_ = spark.createDataFrame([(i, f"h{i}") for i in (1, 7, 3)], "block_index bigint, hash string")
    made = headers.to_bytes(snapshot.header(map_, "s", 4096, "v", 1), "xz", b"k" * 32)
    assert {tuple(r) for r in snapshot.header_rows(headers.of_bytes(made, "xz", b"k" * 32)).collect()} == {tuple(r) for r in map_.collect()}
    with pytest.raises(Exception):
        headers.of_bytes(made, "xz", b"j" * 32).collect()


def test_written_tables_can_be_dropped(spark):
    held = shared.table(spark.range(3), "dropped")
    assert held.count() == 3
    shared.drop(held)
    with pytest.raises(Exception):
        spark.read.parquet(shared.table_path(held))
