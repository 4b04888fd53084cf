"""Queries over stores, codecs, snapshots, servers, requests and configuration as systems: what a write, a copy, an export or a change does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, hashing, values
from ..operators import addressing, cluster, config, snapshot, store
from ..sources import bindings as b
from ..sources import headers
from ..sources import volumes as files
from ..sources.shared import scratch
from .volumes import CO, RULES, SV, VO, B, X

# stores


def dedup_changes(s, d):
    """A write over an older index: every fifth block becomes zeros, which deletes it."""
    rows = b.blocks(s, d).select("block_index", "hash", F.when(F.col("block_index") % 5 != 0, F.col("content").cast("binary")).otherwise(F.lit(bytes(8))).alias("content"))
    changes, _ = store.dedup_write(rows.where("block_index % 2 = 0").select("block_index", "content"))
    return store.applied(rows.select("block_index", F.lit("old").alias("hash")), changes, "block_index")


def new_contents(s, d):
    """What a store that holds the contents of odd blocks takes of all."""
    rows = b.blocks(s, d)
    return store.dedup_write(rows.select("block_index", "content"), rows.where("block_index % 2 = 1").select("hash").distinct())[1].select("hash")


def plain_write(s, d):
    rows = b.pieces(s, d)
    written = rows.where("block_index % 3 = 0").select("block_index", F.when(F.col("block_index") % 2 == 0, F.lit(b"new")).otherwise(F.lit(bytes(4))).alias("content"))
    return store.plain_write(rows, written, "block_index").select("block_index", F.sha2("content", 256).alias("digest"))


def _overlay(s, d):
    rows = b.blocks(s, d).select("block_index", "content")
    over = rows.where("block_index % 5 = 0").withColumn("content", F.lit("mine"))
    return rows.where("block_index % 5 <> 0"), over, over.select("block_index")


def overlay_write(s, d):
    written = b.blocks(s, d).where("block_index % 3 = 0").select("block_index", F.when(F.col("block_index") % 2 == 0, F.lit("new")).alias("content"))
    base, over, touched = store.overlay_write(*_overlay(s, d), written)
    return (base.select(F.lit("base").alias("part"), "block_index").union(over.select(F.lit("overlay"), "block_index")).union(touched.select(F.lit("touched"), "block_index")))


def overlay_delete(s, d):
    base, over = store.overlay_delete(*_overlay(s, d), b.blocks(s, d).where("block_index % 2 = 0"))
    return base.select(F.lit("base").alias("part"), "block_index").union(over.select(F.lit("overlay"), "block_index"))


def bitmap_roundtrip(s, d):
    """Packed, gzipped, and read back."""
    packed = store.to_bitmap(b.requests(s, d).select(F.expr("offset div 4096").alias("block_index")))
    return store.from_bitmap(store.bitmap_of_bytes(store.bitmap_bytes(packed)))


def bitmap_test(s, d):
    packed = store.to_bitmap(b.blocks(s, d).where("block_index % 3 = 0").select("block_index"))
    return store.test_bits(b.blocks(s, d).select("block_index"), packed)


def point_reads(s, d):
    wanted = b.read(s, d, "events").select(F.col("user_id").alias("block_index")).distinct()
    return store.read_blocks(b.blocks(s, d).where("block_index % 4 <> 0"), wanted).select("block_index", F.char_length("content").cast("bigint").alias("n_chars"))


def template_by_index(s, d):
    rows = b.blocks(s, d).select("block_index", "content")
    found = store.with_template(rows.select("block_index"), rows.where("block_index % 3 = 0"), rows.where("block_index % 2 = 0"), "block_index")
    return found.select("block_index", "origin", F.char_length("content").cast("bigint").alias("n_chars"))


def volume_exists(s, d):
    keys = b.read(s, d, "orders").select((F.col("o_orderkey") % 13).alias("server_index"), F.concat(F.lit("v"), (F.col("o_custkey") * 2).cast("string")).alias("volume"))
    return store.existing(b.read(s, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("volume")), keys)


def migrate_keys(s, d):
    k = F.col("c_custkey")
    prefix = F.element_at(F.array(*map(F.lit, ("", "lba:", "", "nondedup:", "semidedup:bitmap:", "tlog:"))), (k % 6 + 1).cast("int"))
    keys = b.read(s, d, "customer").select(F.concat(prefix, "c_name").alias("key"))
    return store.migrated_keys(keys.union(keys), "lba", "[0-7]$")


# hashes and codecs


def blake2b_groups(s, d):
    """The first block of each digest: the first of each content."""
    rows = b.blocks(s, d).select("block_index", hashing.blake2b_256()(F.col("content").cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("block_index").alias("first_index"), F.count("*").alias("n"), F.first(F.octet_length("digest")).alias("width")).drop("digest")


def keyed_hashes(s, d):
    """Two owners' digests of one content differ, one owner's agree."""
    c = F.col("content").cast("binary")
    one, two = (hashing.blake2b_256(hashing.snapshot_key(k, 0))(c) for k in (b"a" * 32, b"b" * 32))
    return b.blocks(s, d).select(one.alias("one"), two.alias("two")).agg(F.count_distinct("one").alias("n_one"), F.count_distinct("two").alias("n_two"), F.count_if(F.col("one") == F.col("two")).alias("n_same"))


def nil_hashes(s, d):
    digest = F.when(F.col("block_index") % 3 == 0, F.lit(bytes(32))).when(F.col("block_index") % 3 == 1, F.unhex("hash"))
    rows = b.blocks(s, d).select("block_index", digest.alias("h"))
    return rows.select("block_index", hashing.is_nil(F.col("h")).alias("nil"), hashing.same_hash(F.col("h"), F.lit(None).cast("binary")).alias("same_as_none"), hashing.hash_path(F.substring("h", 1, 20)).isNull().alias("no_path"))


def _there_and_back(name):
    def query(s, d):
        there, back = codecs.COMPRESSIONS[name]
        return b.blocks(s, d).select("block_index", F.sha2(back(there(F.col("content").cast("binary"))), 256).alias("digest"))

    return query


gzip_roundtrip, xz_roundtrip, lz4_roundtrip = map(_there_and_back, ("gzip", "xz", "lz4"))


def aes_roundtrip(s, d):
    """nonce, ciphertext and tag are 28 bytes more than the content."""
    key, c = bytes(range(1, 33)), F.col("content").cast("binary")
    rows = b.blocks(s, d).select("block_index", codecs.encrypt(c, key).alias("z"), F.octet_length(c).alias("n"))
    return rows.select("block_index", F.sha2(codecs.decrypt(F.col("z"), key), 256).alias("digest"), (F.octet_length("z") - F.col("n")).alias("more"))


def erasure_roundtrip(s, d):
    """Four data and two parity shards, of which two, each time others, are lost."""
    i = F.col("block_index")
    rows = b.blocks(s, d).select("block_index", codecs.erasure_encode(F.col("content").cast("binary"), 4, 2).alias("shards"))
    left = F.transform("shards", lambda x, at: F.when((at != i % 6) & (at != (i % 6 + 1 + i % 5) % 6), x))
    return rows.select("block_index", F.sha2(codecs.erasure_decode(left, 4, 2), 256).alias("digest"), F.size("shards").alias("n_shards"))


# values


def server_strings(s, d):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit(" 10.0.0."), k, F.lit(":1@"), (F.col("s_suppkey") % 4).cast("string"), F.lit(" , ,host:"), k)
    rows = b.read(s, d, "supplier").select("s_suppkey", F.posexplode(values.server_list(text)).alias("place", "server"))
    return rows.select("s_suppkey", "place", "server.address", "server.db")


def service_addresses(s, d):
    k = F.col("s_suppkey")
    text = F.element_at(F.array(F.lit("unix:/tmp/a"), F.lit("http://h/x"), F.concat(F.lit("h:"), k.cast("string")), F.lit("no port"), F.lit("h:123456")), (k % 5 + 1).cast("int"))
    return b.read(s, d, "supplier").select("s_suppkey", values.valid_address(text).alias("valid"))


def enum_names(s, d):
    rows = b.volumes(s, d).select("volume", "type", values.type_name(F.col("type")).alias("name"))
    return rows.select("volume", "name", values.type_code(F.col("name")).alias("code"), values.state_name(F.col("type") % 6).alias("state"))


def error_status(s, d):
    text = F.element_at(F.array(*map(F.lit, ("i/o timeout", "unexpected EOF", "invalid server", "LOADING temporary", "?"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = b.read(s, d, "events").select(F.when(F.col("event_type") == "error", text).alias("message"))
    return rows.select(values.status_of_error(F.col("message")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def reply_values(s, d):
    """Replies as servers give them, as bytes: numbers, flags, lists of numbers, and keys with values."""
    i = F.col("event_id").cast("string")
    rows = b.read(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", i.cast("binary")).alias("r"), F.array(i, F.lit("a"), F.lit("-7"), F.lit("b")).alias("kv"))
    pairs = values.as_pairs(F.col("kv"))
    return rows.select("event_id", values.as_long(F.col("r")).alias("number"), values.as_flag(F.col("r")).alias("flag"), F.element_at(values.as_longs(F.array("r", F.lit(b"5"))), 2).alias("second"), F.size(pairs).alias("n_pairs"), F.try_element_at(pairs, F.lit(-7).cast("bigint")).alias("of_7"))


# snapshots


def snapshot_roundtrip(s, d):
    """Exported at 2,400 bytes a block, in two sessions of which the second finds its contents there, written, read and imported at 600."""
    rows, root = b.pieces(s, d), scratch(s, "snapshots")
    first = snapshot.export(rows.where("block_index % 2 = 0"), 600, 2400, key=b"k" * 32)
    snapshot.write(root, "half", *first)
    map_, fresh = snapshot.export(rows, 600, 2400, snapshot.read(s, root, "half")[1], b"k" * 32)
    snapshot.write(root, "whole", map_, fresh)
    back = snapshot.restore(*snapshot.read(s, root, "whole"), 2400, 600, b"k" * 32)
    return back.select("block_index", F.sha2(F.hex("content"), 256).alias("digest"))


def snapshot_listing(s, d):
    rows, root = b.blocks(s, d).select("block_index", F.col("content").cast("binary").alias("content")).where("block_index < 50"), scratch(s, "snapshots")
    for name in ("v1_100", "v1_200", "v2_100"):
        snapshot.write(root, name, *snapshot.export(rows, 600, 600))
    return snapshot.listed(s, root, "^v1_")


def snapshot_fits(s, d):
    return snapshot.fits(b.pieces(s, d), 600, 2400, 1 << 62)


def snapshot_json(s, d):
    return snapshot.describe_json(b.blocks(s, d).select("block_index", "hash"), 4096)


def snapshot_headers(s, d):
    """An export asked for each order: a header may be there, be readable, and have another block size; some are forced."""
    k = F.col("o_orderkey")
    made = snapshot.header_choice(k % 2 == 0, k % 3 != 0, F.lit(512) * (1 + k % 2), F.lit(512) * (1 + k % 5 % 2), k % 7 == 0)
    return b.read(s, d, "orders").select(made.alias("choice")).groupBy("choice").agg(F.count("*").alias("n"))


def snapshot_header_bytes(s, d):
    """The header's parts, bencoded, compressed and encrypted, and read back."""
    made = snapshot.header(b.blocks(s, d).select("block_index", "hash"), "snap", 4096, "vol", 1 << 30, 128)
    back = headers.of_bytes(headers.to_bytes(made, "lz4", b"k" * 32), "lz4", b"k" * 32)
    return snapshot.header_rows(back)


def snapshot_ids(s, d):
    return b.read(s, d, "orders").select("o_orderkey", snapshot.snapshot_id(F.concat(F.lit("v"), F.col("o_custkey").cast("string")), F.col("o_orderdate").cast("timestamp")).alias("snapshot"))


# files


def record_files(s, d):
    """Records of an index and 600 bytes, gzipped, and read back."""
    path = scratch(s, "records")
    files.write_records(b.pieces(s, d).select("block_index", F.rpad("content", 600, bytes(1)).alias("content")).withColumn("block_index", F.col("block_index") % 10_000_000), path)
    return files.source("records")(s, path, 600).select("block_index", F.sha2(F.hex("content"), 256).alias("digest"))


def image_files(s, d):
    """Every text of a multiple of five as an image file of its own, read in blocks of 512 bytes."""
    path = scratch(s, "images")
    files.write_images(b.read(s, d, "documents").where("doc_id % 5 = 0 AND text <> ''").select("text"), path)
    blocks = files.source("image")(s, path, 512)
    return blocks.groupBy("block_index").agg(F.count("*").alias("n"))


def block_files(s, d):
    path = scratch(s, "blocks")
    rows = b.pieces(s, d).select(F.concat(F.lit("v"), (F.col("block_index") % 3).cast("string")).alias("volume"), "block_index", "content")
    files.write_blocks(rows, path)
    files.delete_volume(s, path, "v2")
    return files.source("blocks")(s, path, "v1", "v2").select("volume", "block_index", F.octet_length("content").cast("bigint").alias("n_bytes"))


def journal_files(s, d):
    """A journal on disk, read from 10 January 2024 to the 20th."""
    path, day = scratch(s, "journal"), 86_400_000_000_000
    rows = b.volume_journal(s, d).select("volume", "seq", "block_index", F.col("op").cast("tinyint").alias("op"), (F.col("ts") * 1000).alias("ts"), F.lit(None).cast("binary").alias("hash"), F.col("data").cast("binary").alias("data"))
    files.write_journal(rows, path)
    return files.source("journal")(s, path, "v3", 19_732 * day, 19_742 * day).select("volume", "seq", "block_index")


def config_documents(s, d):
    path = scratch(s, "config")
    files.write_config(b.volumes(s, d).select(F.col("volume").alias("id"), "block_size", "size_gib"), path, "vdisk", 10_000)
    return files.source("config")(s, path, "vdisk", "block_size: bigint, size_gib: int")


# servers and copies


def server_counts(s, d):
    return cluster.counts(b.servers(s, d))


def server_pairs(s, d):
    rows = b.servers(s, d).where("cluster IN ('n1', 'n2')").select("cluster", "server_index", "address", "db")
    least = rows.groupBy("cluster").count().agg(F.min("count")).first()[0]
    left, right = (rows.where((F.col("cluster") == c) & (F.col("server_index") < least)) for c in ("n1", "n2"))
    return cluster.zipped(left, right).select("server_index", "address", "target_address", "db", "target_db")


def usable_servers(s, d):
    return cluster.operational(b.servers(s, d)).select("cluster", "server_index", "usable")


def _lba(s, d):
    return b.requests(s, d).select(F.expr("offset div 4096").alias("block_index")).distinct()


def clone_deduped(s, d):
    """Sectors of 128 indices, from 13 servers to 8."""
    return cluster.copied_counts(cluster.cloned(_lba(s, d), 13, 8, 128), 128)


def clone_plain(s, d):
    return cluster.copied_counts(cluster.cloned(_lba(s, d), 13, 13))


def clone_overlay(s, d):
    """A semi-deduplicated volume: the sectors of its base, and the blocks and bits of its overlay."""
    rows = _lba(s, d)
    base, over = rows.where("block_index % 5 <> 0"), rows.where("block_index % 5 = 0")
    bits = store.to_bitmap(over)
    return (cluster.copied_counts(cluster.cloned(base, 13, 8, 128), 128).withColumn("part", F.lit("base")).unionByName(cluster.copied_counts(cluster.cloned(over, 13, 8)).withColumn("part", F.lit("overlay")))
            .unionByName(bits.agg(F.count("*").alias("n")).select(F.lit(0).cast("bigint").alias("source_server"), F.lit(0).cast("bigint").alias("target_server"), "n", F.lit("bits").alias("part"))))


def clone_total(s, d):
    return cluster.total(cluster.copied_counts(cluster.cloned(_lba(s, d), 13, 8, 128), 128))


def ordered_replies(s, d):
    rows = b.read(s, d, "events")
    replies = rows.where("event_type <> 'error'").repartition(5, "user_id").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("reply"))
    return cluster.correlated(rows.select(F.col("event_id").alias("ordinal")), replies)


def action_batches(s, d):
    rows = b.read(s, d, "events").select((F.col("user_id") % 8).alias("server_index"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("action"))
    return cluster.batches(rows, 100).select("server_index", "batch", F.size("actions").cast("bigint").alias("n"), F.sha2(F.array_join("actions", ","), 256).alias("digest"))


# requests


def _commands(s, d):
    cmd = F.element_at(F.array(*map(F.lit, (*addressing.COMMANDS, "bogus"))), (F.col("request_id") % 7 + 1).cast("int"))
    return b.requests(s, d).withColumn("cmd", cmd)


def request_checks(s, d):
    """A read-only volume with blocks of 1,024 bytes."""
    return addressing.violations(_commands(s, d), 50_000_000, True, 20_000, 1024).groupBy("cmd", "violation").agg(F.count("*").alias("n"))


def store_commands(s, d):
    """Which of the commands that stores are sent change them."""
    name = F.element_at(F.array(*map(F.lit, (*values.STORE_COMMANDS, "PING"))), (F.col("event_id") % (len(values.STORE_COMMANDS) + 1) + 1).cast("int"))
    return b.read(s, d, "events").select(values.writes(name).alias("writes")).groupBy("writes").agg(F.count("*").alias("n"))


def trim_effects(s, d):
    return addressing.effective(_commands(s, d)).groupBy("cmd").agg(F.count("*").alias("n"))


# configuration


def _composed(s, d):
    return config.composed(b.volumes(s, d), b.nbd(s, d), b.clusters(s, d))


def volume_backends(s, d):
    return config.backends(_composed(s, d))


def exported_volumes(s, d):
    served = b.read(s, d, "customer").select(F.concat(F.lit("s"), (F.col("c_custkey") % 8).cast("string")).alias("server"), F.when(F.col("c_custkey") % 9 == 0, F.lit("gone")).otherwise(F.col("c_name")).alias("volume"))
    return config.exported(served, b.volumes(s, d))


def config_same(s, d):
    """Each cluster against a copy; of those with a server 5, that one has moved in the copy."""
    rows = b.clusters(s, d)
    copy = F.transform("servers", lambda x, i: F.struct(x["address"].alias("address"), F.when(i == 5, 99).otherwise(x["db"]).alias("db"), x["state"].alias("state")))
    return rows.select("cluster_id", config.same(F.col("servers"), copy).alias("same"))


def delete_targets(s, d):
    return config.all_servers(_composed(s, d)).select("volume", F.size("all_servers").cast("bigint").alias("n"), F.element_at("all_servers", 1)["address"].alias("first"))


def config_import(s, d):
    rows = b.read(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey")
    want = rows.select("key", F.when(F.col("c_custkey") % 4 == 0, "new").otherwise(F.col("value")).alias("value"))
    return config.imported(rows.where("c_custkey % 3 <> 0"), want)


def clone_actions(s, d):
    rows = b.volumes(s, d).join(b.nbd(s, d), "volume").select("volume", "type", "tlog_cluster", F.substring_index("volume", "#", -1).cast("bigint").alias("k"))
    other = rows.select((F.col("k") - 6).alias("k"), F.col("type").alias("target_type"), F.col("tlog_cluster").alias("target_tlog"))
    pairs = rows.select("k", "volume", F.col("type").alias("source_type"), F.col("tlog_cluster").alias("source_tlog")).join(other, "k")
    store_of = {"source_store": (F.col("k") % 4).cast("string"), "target_store": ((F.col("k") + 6) % 4 % 3).cast("string")}
    return config.clone_action(pairs.withColumns(store_of)).select("volume", "action")


def journaled_volumes(s, d):
    rows = b.nbd(s, d)
    kept = config.with_journal(b.volumes(s, d), rows.where("tlog_cluster IS NOT NULL")).withColumn("journal", F.lit(True))
    return kept.union(config.without_journal(b.volumes(s, d), rows.where("tlog_cluster IS NOT NULL")).withColumn("journal", F.lit(False))).select("volume", "journal")


def journals_valid(s, d):
    return config.journals_valid(_composed(s, d))


def config_errors(s, d):
    found = config.violations(_composed(s, d)).select("primary_cluster", F.explode_outer("violations").alias("message"))
    return config.collected_errors(found, "primary_cluster")


def composition_watch(s, d):
    role = F.element_at(F.array(*map(F.lit, config.ROLES)), (F.col("event_id") % 3 + 1).cast("int"))
    value = F.when(F.col("event_type") != "error", F.concat(F.lit("c"), (F.expr("event_id div 2") % 3).cast("string")))
    events = b.read(s, d, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("volume"), "event_id", role.alias("role"), value.alias("value"))
    return config.composition_changes(events, "event_id")


_NAMES = """dedup_changes new_contents plain_write overlay_write overlay_delete bitmap_roundtrip bitmap_test point_reads template_by_index volume_exists migrate_keys
blake2b_groups keyed_hashes nil_hashes gzip_roundtrip xz_roundtrip lz4_roundtrip aes_roundtrip erasure_roundtrip server_strings service_addresses enum_names error_status reply_values
snapshot_roundtrip snapshot_listing snapshot_fits snapshot_json snapshot_headers snapshot_header_bytes snapshot_ids record_files image_files block_files journal_files config_documents
server_counts server_pairs usable_servers clone_deduped clone_plain clone_overlay clone_total ordered_replies action_batches request_checks store_commands trim_effects
volume_backends exported_volumes config_same delete_targets config_import clone_actions journaled_volumes journals_valid config_errors composition_watch"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_TEXTS = f"WITH {B} SELECT block_index, hash AS digest FROM b"
_LBA = "l AS (SELECT DISTINCT CAST(l_orderkey * 4096 + l_linenumber * 512 AS BIGINT) // 4096 AS i FROM lineitem)"
_CMD = "r AS (SELECT CAST(l_orderkey * 4096 + l_linenumber * 512 AS BIGINT) AS o, CAST(l_quantity * 512 AS BIGINT) AS n, ['read', 'write', 'disconnect', 'flush', 'trim', 'write_zeroes', 'bogus'][l_orderkey % 7 + 1] AS cmd FROM lineitem)"
SQL = {
    "dedup_changes": f"WITH {B} SELECT block_index, CASE WHEN block_index % 2 = 0 THEN hash ELSE 'old' END AS hash FROM b WHERE block_index % 10 <> 0 AND (content <> '' OR block_index % 2 = 1)",
    "new_contents": f"WITH {B} SELECT DISTINCT hash FROM b WHERE content <> '' AND hash NOT IN (SELECT hash FROM b WHERE block_index % 2 = 1)",
    "plain_write": f"WITH {X} SELECT block_index, CASE WHEN block_index % 3 = 0 THEN sha256('new') ELSE sha256(unhex(h)) END AS digest FROM x WHERE block_index % 3 <> 0 OR block_index % 2 = 0",
    "overlay_write": "WITH i AS (SELECT doc_id AS i FROM documents) SELECT 'base' AS part, i AS block_index FROM i WHERE i % 5 <> 0 AND i % 3 <> 0 UNION ALL SELECT 'overlay', i FROM i WHERE CASE WHEN i % 3 = 0 THEN i % 2 = 0 ELSE i % 5 = 0 END UNION ALL SELECT 'touched', i FROM i WHERE i % 5 = 0 OR i % 3 = 0",
    "overlay_delete": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'overlay' ELSE 'base' END AS part, doc_id AS block_index FROM documents WHERE doc_id % 2 <> 0",
    "bitmap_roundtrip": f"WITH {_LBA} SELECT i AS block_index FROM l",
    "bitmap_test": "SELECT doc_id AS block_index, doc_id % 3 = 0 AS is_set FROM documents",
    "point_reads": "SELECT block_index, length(text) AS n_chars FROM (SELECT DISTINCT user_id AS block_index FROM events) LEFT JOIN documents ON doc_id = block_index AND doc_id % 4 <> 0",
    "template_by_index": "SELECT doc_id AS block_index, CASE WHEN doc_id % 3 = 0 THEN 'primary' WHEN doc_id % 2 = 0 THEN 'template' END AS origin, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN length(text) END AS n_chars FROM documents",
    "volume_exists": "SELECT 'v' || c_custkey AS volume, c_custkey IN (SELECT o_custkey * 2 FROM orders) AS found FROM customer",
    "migrate_keys": "SELECT c_name AS old_key, 'lba:' || c_name AS new_key FROM customer WHERE c_custkey % 6 IN (0, 2) AND regexp_matches(c_name, '[0-7]$')",
    "blake2b_groups": "SELECT min(doc_id) AS first_index, count(*) AS n, 32 AS width FROM documents GROUP BY text",
    "keyed_hashes": "SELECT count(DISTINCT text) AS n_one, count(DISTINCT text) AS n_two, 0 AS n_same FROM documents",
    "nil_hashes": "SELECT doc_id AS block_index, doc_id % 3 <> 1 AS nil, doc_id % 3 <> 1 AS same_as_none, true AS no_path FROM documents",
    "gzip_roundtrip": _TEXTS,
    "xz_roundtrip": _TEXTS,
    "lz4_roundtrip": _TEXTS,
    "aes_roundtrip": f"WITH {B} SELECT block_index, hash AS digest, 28 AS more FROM b",
    "erasure_roundtrip": f"WITH {B} SELECT block_index, hash AS digest, 6 AS n_shards FROM b",
    "server_strings": "SELECT s_suppkey, 0 AS place, '10.0.0.' || s_suppkey || ':1' AS address, CAST(s_suppkey % 4 AS INT) AS db FROM supplier UNION ALL SELECT s_suppkey, 1, 'host:' || s_suppkey, 0 FROM supplier",
    "service_addresses": "SELECT s_suppkey, s_suppkey % 5 < 3 AS valid FROM supplier",
    "enum_names": f"WITH {VO} SELECT volume, CASE type WHEN 49 THEN 'boot' WHEN 50 THEN 'db' WHEN 4 THEN 'cache' WHEN 8 THEN 'tmp' END AS name, CASE WHEN type <> 7 THEN type END AS code, ['online', 'offline', 'repair', 'respread', 'rip', 'unknown'][type % 6 + 1] AS state FROM vo",
    "error_status": "SELECT CASE WHEN event_type <> 'error' THEN 0 ELSE [401, 402, 400, 421, 422][event_id % 5 + 1] END AS status, count(*) AS n FROM events GROUP BY 1",
    "reply_values": "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id END AS number, CASE WHEN event_type <> 'error' THEN event_id <> 0 END AS flag, 5 AS second, 2 AS n_pairs, 'b' AS of_7 FROM events",
    "snapshot_roundtrip": f"WITH {X} SELECT block_index, sha256(rpad(h, 1200, '0')) AS digest FROM x",
    "snapshot_listing": "SELECT unnest(['v1_100', 'v1_200']) AS snapshot",
    "snapshot_fits": f"WITH {X} SELECT (max(block_index) // 4 + 1) * 2400 AS size FROM x",
    "snapshot_json": f"""WITH {B} SELECT '{{"n_blocks":' || count(*) || ',"snapshot_bytes":' || count(*) * 4096 || ',"volume_bytes":' || (max(block_index) + 1) * 4096 || ',"n_distinct":' || count(DISTINCT hash) || '}}' AS json FROM b""",
    "snapshot_headers": "WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT CASE WHEN k % 2 <> 0 THEN 'new' WHEN k % 3 = 0 THEN CASE WHEN k % 7 = 0 THEN 'new' ELSE 'error: unreadable' END WHEN k % 5 % 2 = 0 THEN 'reuse' WHEN k % 7 = 0 THEN 'new' ELSE 'error: incompatible block size' END AS choice, count(*) AS n FROM o GROUP BY 1",
    "snapshot_header_bytes": f"WITH {B} SELECT block_index, hash FROM b",
    "snapshot_ids": "SELECT o_orderkey, 'v' || o_custkey || '_' || CAST(epoch(o_orderdate) AS BIGINT) AS snapshot FROM orders",
    "record_files": f"WITH {X} SELECT block_index % 10000000 AS block_index, sha256(rpad(h, 1200, '0')) AS digest FROM x",
    "image_files": "SELECT CAST(i AS BIGINT) AS block_index, count(*) AS n FROM (SELECT unnest(range((octet_length(encode(text)) + 1 + 511) // 512)) AS i, octet_length(encode(text)) AS l FROM documents WHERE doc_id % 5 = 0 AND text <> '') WHERE i * 512 < l GROUP BY 1",
    "block_files": f"WITH {X} SELECT 'v1' AS volume, block_index, length(h) // 2 AS n_bytes FROM x WHERE block_index % 3 = 1",
    "journal_files": "SELECT 'v3' AS volume, seq, user_id AS block_index FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS seq FROM events WHERE user_id % 10 = 3) WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'",
    "config_documents": f"WITH {VO} SELECT volume AS id, block_size, size_gib FROM vo",
    "server_counts": f"WITH {SV} SELECT cluster, count(*) AS n_servers, count(*) FILTER (state = 'online') AS n_online, count(*) FILTER (state = 'offline') AS n_failing, count(*) FILTER (state = 'rip') AS n_rip FROM sv GROUP BY 1",
    "server_pairs": f"WITH {SV} SELECT server_index, a.address, z.address AS target_address, a.db, z.db AS target_db FROM sv a JOIN sv z USING (server_index) WHERE a.cluster = 'n1' AND z.cluster = 'n2'",
    "usable_servers": f"WITH {SV} SELECT cluster, server_index, CASE state WHEN 'online' THEN true WHEN 'rip' THEN false END AS usable FROM sv",
    "clone_deduped": f"WITH {_LBA} SELECT u % 13 AS source_server, u % 8 AS target_server, count(*) AS n FROM (SELECT DISTINCT i // 128 AS u FROM l) GROUP BY 1, 2",
    "clone_plain": f"WITH {_LBA} SELECT i % 13 AS source_server, i % 13 AS target_server, count(*) AS n FROM l GROUP BY 1, 2",
    "clone_overlay": f"WITH {_LBA} SELECT u % 13 AS source_server, u % 8 AS target_server, count(*) AS n, 'base' AS part FROM (SELECT DISTINCT i // 128 AS u FROM l WHERE i % 5 <> 0) GROUP BY 1, 2 UNION ALL SELECT i % 13, i % 8, count(*), 'overlay' FROM l WHERE i % 5 = 0 GROUP BY 1, 2 UNION ALL SELECT 0, 0, count(DISTINCT i // 64), 'bits' FROM l WHERE i % 5 = 0",
    "clone_total": f"WITH {_LBA} SELECT count(DISTINCT i // 128) AS n FROM l",
    "ordered_replies": "SELECT event_id AS ordinal, CASE WHEN event_type <> 'error' THEN user_id END AS reply FROM events",
    "action_batches": "SELECT server_index, batch, count(*) AS n, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM (SELECT *, user_id % 8 AS server_index, (row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1) // 100 AS batch FROM events) GROUP BY 1, 2",
    "request_checks": f"WITH {_CMD} SELECT cmd, CASE WHEN cmd = 'bogus' THEN 'unknown command' WHEN cmd IN ('flush', 'disconnect') THEN NULL WHEN cmd IN ('write', 'write_zeroes', 'trim') THEN 'read only' WHEN n > 20000 THEN 'too long' WHEN o < 0 OR o + n > 50000000 THEN 'out of bounds' WHEN o % 1024 <> 0 OR n % 1024 <> 0 THEN 'not aligned' END AS violation, count(*) AS n FROM r GROUP BY 1, 2",
    "store_commands": "SELECT CASE WHEN event_id % 11 IN (1, 2, 6, 7) THEN true WHEN event_id % 11 < 10 THEN false END AS writes, count(*) AS n FROM events GROUP BY 1",
    "trim_effects": f"WITH {_CMD} SELECT cmd, count(*) AS n FROM r WHERE cmd IN ('write', 'write_zeroes') GROUP BY 1",
    "volume_backends": f"WITH {CO} SELECT volume, CASE WHEN type & 1 <> 0 THEN 'deduped' ELSE 'nondeduped' END AS storage, type & 32 <> 0 AND tc IS NOT NULL AS with_template, type & 16 <> 0 AND tlog IS NOT NULL AS with_journal, sc IS NOT NULL AS with_slave FROM c",
    "exported_volumes": f"WITH {VO} SELECT 's' || (k % 8) AS server, volume, block_size, CAST(size_gib AS BIGINT) * 1073741824 AS size_bytes FROM vo WHERE k % 9 <> 0",
    "config_same": f"WITH {SV} SELECT cluster AS cluster_id, count(*) <= 5 AS same FROM sv GROUP BY 1",
    "delete_targets": f"WITH {CO} SELECT volume, pn + coalesce(sn, 0) AS n, (SELECT address FROM sv WHERE cluster = pc AND server_index = 0) AS first FROM c",
    "config_import": "SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'written' WHEN c_custkey % 4 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM customer",
    "clone_actions": f"WITH {VO} SELECT a.volume, CASE WHEN NOT (z.type & 16 <> 0 AND z.tlog IS NOT NULL) THEN 'skip' WHEN NOT (a.type & 16 <> 0 AND a.tlog IS NOT NULL) THEN 'generate' WHEN a.k % 4 = (a.k + 6) % 4 % 3 THEN 'reference' ELSE 'full' END AS action FROM vo a JOIN vo z ON z.k = a.k + 6",
    "journaled_volumes": f"WITH {VO} SELECT volume, tlog IS NOT NULL AS journal FROM vo",
    "journals_valid": f"WITH {CO} SELECT count(*) AS n FROM c WHERE type & 16 <> 0 AND tlog IS NOT NULL",
    "config_errors": f"WITH {CO} SELECT pc AS primary_cluster, string_agg(DISTINCT m, '; ' ORDER BY m) AS errors FROM (SELECT pc, unnest({RULES}) AS m FROM c) GROUP BY 1",
    "composition_watch": "WITH e AS (SELECT 'v' || user_id AS volume, event_id, event_id % 3 AS r, 'c' || (event_id // 2 % 3) AS value FROM events WHERE event_type <> 'error'), l AS (SELECT volume, event_id, last_value(CASE WHEN r = 0 THEN value END IGNORE NULLS) OVER w AS \"primary\", last_value(CASE WHEN r = 1 THEN value END IGNORE NULLS) OVER w AS template, last_value(CASE WHEN r = 2 THEN value END IGNORE NULLS) OVER w AS slave FROM e WINDOW w AS (PARTITION BY volume ORDER BY event_id ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, row_number() OVER x AS n, lag(\"primary\") OVER x AS a, lag(template) OVER x AS t, lag(slave) OVER x AS z FROM l WHERE \"primary\" IS NOT NULL WINDOW x AS (PARTITION BY volume ORDER BY event_id)) SELECT volume, event_id, \"primary\", template, slave FROM v WHERE n = 1 OR \"primary\" IS DISTINCT FROM a OR template IS DISTINCT FROM t OR slave IS DISTINCT FROM z",
}
