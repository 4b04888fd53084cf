"""Queries over blocks, snapshots, requests, servers and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, sharding, values
from ..operators import addressing, cluster, config, rechunk, snapshot, store
from ..operators.journal import numbered
from ..sources import bindings as b


def _hex(df):
    return df.withColumn("content", F.hex("content"))


def content_dedup(s, d):
    lba, fresh = store.dedup_write(b.blocks(s, d).select("block_index", "content"))
    return fresh.select("hash", F.octet_length("content").cast("bigint").alias("n_bytes"))


def dedup_ratio(s, d):
    return store.dedup_stats(b.blocks(s, d))


def dedup_groups(s, d):
    return store.shared_contents(b.blocks(s, d))


def dedup_read(s, d):
    rows = b.blocks(s, d)
    lba, fresh = store.dedup_write(rows.select("block_index", "content"))
    return store.dedup_read(lba, fresh).select("block_index", F.char_length("content").cast("bigint").alias("n_chars"))


def zero_elision(s, d):
    """Every third block is made of zero bytes."""
    rows = b.blocks(s, d).select("block_index", F.when(F.col("block_index") % 3 == 0, F.lit(bytes(16))).otherwise(F.col("content").cast("binary")).alias("content"))
    return store.without_zero(rows).select("block_index", F.octet_length("content").cast("bigint").alias("n_bytes"))


def _stores(s, d):
    rows = b.blocks(s, d)
    every = rows.select("hash", "content", "block_index").groupBy("hash").agg(F.min("block_index").alias("first"), F.min("content").alias("content"))
    return rows.select("block_index", "hash"), every.where("first % 3 = 0").select("hash", "content"), every.where("first % 2 = 0").select("hash", "content")


def template_fallback(s, d):
    return store.with_template(*_stores(s, d)).select("block_index", "hash", "origin", F.char_length("content").cast("bigint").alias("n_chars"))


def template_copyback(s, d):
    return store.copy_back(*_stores(s, d)).select("hash")


def overlay_read(s, d):
    rows = b.journal(s, d)
    base = rows.where("seq <= 5000").groupBy("block_index").agg(F.max_by("data", "seq").alias("content"))
    over = rows.where("seq > 5000").groupBy("block_index").agg(F.max_by("data", "seq").alias("content"))
    return store.overlay(base, over)


def list_indices_union(s, d):
    rows = b.blocks(s, d)
    return store.union_indices(rows.where("block_index % 2 = 0"), rows.where("block_index % 3 = 0"))


def list_volumes_regex(s, d):
    keys = b.read(s, d, "customer").select(values.storage_key("lba", F.col("c_name")).alias("key")).union(b.read(s, d, "supplier").select(F.concat(F.lit("other:"), "s_name").alias("key")))
    return store.volumes(keys.select(values.volume_of_key(F.col("key")).alias("volume")).where("volume IS NOT NULL"), "[05]$").orderBy("volume")


def lba_sectors(s, d):
    packed = store.to_sectors(b.blocks(s, d).select("block_index", "hash"))
    return packed.select("sector", F.sha2(F.array_join(F.transform("hashes", lambda h: F.coalesce(h, F.lit("-"))), ","), 256).alias("digest"))


def lba_unpack(s, d):
    return store.from_sectors(store.to_sectors(b.blocks(s, d).select("block_index", "hash")))


def orphan_contents(s, d):
    rows = b.blocks(s, d)
    return store.orphans(rows.select("hash").distinct(), rows.where("block_index % 4 <> 0")).select("hash")


def upsert_blocks(s, d):
    rows = b.blocks(s, d).select("block_index", "hash")
    return store.upsert(rows, rows.where("block_index % 5 = 0").withColumn("hash", F.lit("new")), "block_index")


def delete_blocks(s, d):
    rows = b.blocks(s, d).select("block_index", "hash")
    return store.deleted(rows, rows.where("block_index % 7 = 0"))


def inflate_blocks(s, d):
    return _hex(rechunk.inflate(b.pieces(s, d), 600, 4)).select("block_index", F.sha2("content", 256).alias("digest"))


def deflate_blocks(s, d):
    return _hex(rechunk.deflate(b.pieces(s, d), 100, 6))


def rechunk_roundtrip(s, d):
    back = rechunk.deflate(rechunk.inflate(b.pieces(s, d), 600, 4), 600, 4)
    return _hex(back).select("block_index", F.sha2("content", 256).alias("digest"))


def snapshot_describe(s, d):
    return snapshot.describe(b.blocks(s, d).select("block_index", "hash"), 4096)


def snapshot_header_rows(s, d):
    return snapshot.header_rows(snapshot.header(b.blocks(s, d).select("block_index", "hash"), "snap", 4096, "vol", 1 << 30))


def import_extent(s, d):
    rows = b.pieces(s, d)
    return (snapshot.extent(rows, 600, 600).select(F.lit("equal").alias("case"), "size")
            .union(snapshot.extent(rows, 600, 2400).select(F.lit("larger").alias("case"), "size"))
            .union(snapshot.extent(rows, 600, 50).select(F.lit("smaller").alias("case"), "size")))


def split_requests(s, d):
    made = addressing.ranged_pieces(b.requests(s, d), 4096)
    return made.groupBy("block_range", "block_index").agg(F.count("*").alias("n"), F.sum("piece_length").alias("total"), F.min("block_offset").alias("least_offset")).drop("block_range")


def request_violations(s, d):
    return addressing.violations(b.requests(s, d), 50_000_000, most=20_000).groupBy("violation").agg(F.count("*").alias("n"))


def padded_read(s, d):
    rows = b.blocks(s, d).select("block_index", F.col("content").cast("binary").alias("content"))
    return rows.select("block_index", F.hex(addressing.padded_read(F.col("content"), F.lit(100), 64)).alias("bytes"))


def merge_write(s, d):
    rows = b.pieces(s, d)
    return rows.select("block_index", F.hex(addressing.merge_write(F.col("content"), F.lit(b"0123456789"), F.col("block_index") % 500, 600)).alias("bytes"))


def merge_zeroes(s, d):
    rows = b.pieces(s, d).select("block_index", F.when(F.col("block_index") % 4 != 0, F.col("content")).alias("content"))
    return rows.select("block_index", F.hex(addressing.merge_zeroes(F.col("content"), F.col("block_index") % 500, F.lit(20), 600)).alias("bytes"))


def index_islands(s, d):
    return addressing.islands(b.requests(s, d).select((F.expr("offset div 4096")).alias("block_index")))


def shard_by_hash(s, d):
    return b.blocks(s, d).groupBy(sharding.shard_by_hash(F.col("hash"), 13).alias("shard")).agg(F.count("*").alias("n"))


ALIVE = [i not in (3, 7) for i in range(13)]


def shard_by_index(s, d):
    return b.blocks(s, d).select("block_index", sharding.shard_by_index(F.col("block_index"), ALIVE).alias("shard"))


def jump_hash(s, d):
    return b.read(s, d, "events").select("event_id", sharding.jump_hash(F.col("event_id"), 13).alias("bucket"))


def clone_reshard(s, d):
    return cluster.moved(b.blocks(s, d), 13, 8)


def _states(s, d):
    """events as state changes of 8 servers: errors take one down, purchases up; one event in 97 decommissions."""
    state = F.when(F.col("event_id") % 997 == 13, "rip").when(F.col("event_type") == "error", "offline").otherwise("online")
    return b.read(s, d, "events").select((F.col("user_id") % 8).alias("server_index"), state.alias("state"), F.col("event_id").alias("seq"))


def server_state_fold(s, d):
    return cluster.states(_states(s, d), "seq").select("server_index", "state", "seq")


def first_online_server(s, d):
    return cluster.first_online(b.servers(s, d))


def assigned_servers(s, d):
    """Every supplier is a server of one large cluster."""
    k = F.col("s_suppkey")
    servers = b.read(s, d, "supplier").select(k.alias("server_index"), F.concat(F.lit("10.0.0."), k.cast("string")).alias("address"), F.when(k % 4 == 2, "offline").otherwise("online").alias("state"))
    rows = b.blocks(s, d).select("block_index", (F.col("block_index") % servers.count()).alias("server_index"))
    return cluster.assigned(rows, servers).groupBy("address", "state").agg(F.count("*").alias("n"))


def _composed(s, d):
    return config.composed(b.volumes(s, d), b.nbd(s, d), b.clusters(s, d))


def _n(name):
    return F.when(F.col(name).isNotNull(), F.size(name).cast("bigint")).alias(name)


def config_compose(s, d):
    made = config.storage_type(_composed(s, d))
    return made.select("volume", _n("primary_servers"), _n("template_servers"), _n("slave_servers"), "storage", "journal", "template")


def config_violations(s, d):
    return config.violations(_composed(s, d)).select("volume", F.array_join("violations", "; ").alias("violations"))


def config_watch(s, d):
    rows = b.read(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    return config.changes(rows, "user_id", "value", "event_id").select("user_id", "event_id", "value")


def hash_integrity(s, d):
    """One content in eleven is damaged on purpose: the check has to find these."""
    rows = b.blocks(s, d)
    bad = rows.withColumn("content", F.when(F.col("block_index") % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return store.corrupted(bad).select("block_index")


def hash_paths(s, d):
    return b.blocks(s, d).select("block_index", hashing.hash_path(F.unhex("hash")).alias("path"))


def versions(s, d):
    text = F.concat_ws(".", (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string"), (F.col("doc_id") % 5).cast("string"))
    rows = b.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("-beta"))).otherwise(text).alias("t"))
    return rows.select("doc_id", values.version_pack(F.col("t")).alias("packed"), values.version_text(values.version_pack(F.col("t"))).alias("version"))


def block_sizes(s, d):
    x = F.col("p_partkey").cast("bigint")
    return b.read(s, d, "part").select("p_partkey", values.valid_block_size(x * 64).alias("valid"), values.next_power_of_two(x).alias("power"))


def dense_numbers(s, d):
    return numbered(b.read(s, d, "customer").select("c_name"), "c_name", "n")


_NAMES = """content_dedup dedup_ratio dedup_groups dedup_read zero_elision template_fallback template_copyback overlay_read list_indices_union list_volumes_regex lba_sectors lba_unpack orphan_contents
upsert_blocks delete_blocks inflate_blocks deflate_blocks rechunk_roundtrip snapshot_describe snapshot_header_rows import_extent split_requests request_violations padded_read merge_write merge_zeroes
index_islands shard_by_hash shard_by_index jump_hash clone_reshard server_state_fold first_online_server assigned_servers config_compose config_violations config_watch hash_integrity hash_paths
versions block_sizes dense_numbers"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

B = "b AS (SELECT doc_id AS block_index, text AS content, sha256(text) AS hash FROM documents)"
#: Blocks of 600 bytes as upper-case hex: two digits a byte.
X = "x AS (SELECT doc_id * 65536 + o AS block_index, substr(h, CAST(o * 1200 + 1 AS BIGINT), 1200) AS h FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range((octet_length(encode(text)) + 599) // 600)) AS o FROM documents WHERE text <> ''))"
P = X + ", p AS (SELECT block_index, rpad(h, 1200, '0') AS h FROM x)"
INFLATED = P + ", g AS (SELECT DISTINCT block_index // 4 AS big FROM p), i AS (SELECT big AS block_index, string_agg(coalesce(h, repeat('0', 1200)), '' ORDER BY o) AS h FROM (SELECT big, o, h FROM g CROSS JOIN range(4) t(o) LEFT JOIN p ON p.block_index = big * 4 + o) GROUP BY big)"
STORES = B + ", e AS (SELECT hash, min(block_index) AS first, min(content) AS content FROM b GROUP BY hash), p AS (SELECT * FROM e WHERE first % 3 = 0), t AS (SELECT * FROM e WHERE first % 2 = 0)"
REQ = "r AS (SELECT CAST(l_orderkey * 4096 + l_linenumber * 512 AS BIGINT) AS o, CAST(l_quantity * 512 AS BIGINT) AS n FROM lineitem)"
JUMP = """WITH RECURSIVE keys AS ({0}), g(key, k, b, j, n) AS (SELECT key, CAST(key AS HUGEINT), -1::BIGINT, 0::DOUBLE, 0 FROM keys UNION ALL
SELECT key, k2, CAST(j AS BIGINT), floor((j + 1) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592 AS DOUBLE) + 1))), n + 1 FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM g) WHERE j < 13)
SELECT key, b AS bucket FROM g WHERE j >= 13"""
_ALIVE = " ".join(f"WHEN {i} THEN {str(a).lower()}" for i, a in enumerate(ALIVE))
#: Servers, clusters and volumes as bindings derives them from supplier and customer.
SV = """sv AS (SELECT 'n' || s_nationkey AS cluster, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS server_index, CASE WHEN s_suppkey % 13 <> 12 THEN '10.0.0.' || s_suppkey || ':16379' ELSE '' END AS address,
CAST(s_suppkey % 5 - CASE WHEN s_suppkey % 29 = 28 THEN 9 ELSE 0 END AS INT) AS db, CASE WHEN s_suppkey % 17 = 3 THEN 'rip' WHEN s_suppkey % 4 = 2 THEN 'offline' ELSE 'online' END AS state FROM supplier)"""
CL = SV + ", cl AS (SELECT cluster AS id, count(*) AS n, bool_or(state <> 'rip' AND (NOT regexp_matches(address, '^[^ :]+:[0-9]{1,5}$') OR db < 0)) AS bad FROM sv GROUP BY 1)"
VO = """vo AS (SELECT c_custkey AS k, c_name AS volume, [49, 50, 4, 8, 7][c_custkey % 5 + 1] AS type, CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 512 * [1, 2, 4, 8][c_custkey % 4 + 1] END AS block_size, CAST(c_custkey % 11 AS INT) AS size_gib, 'n' || c_nationkey AS pc,
CASE WHEN c_custkey % 3 = 0 THEN 'n' || ((c_nationkey + 1) % 25) END AS tc, CASE WHEN c_custkey % 4 = 0 THEN 'n' || ((c_nationkey + 2) % 25) END AS sc, CASE WHEN c_custkey % 2 = 0 THEN 't' || (c_custkey % 3) END AS tlog FROM customer)"""
CO = f"{CL}, {VO}, c AS (SELECT vo.*, p.n AS pn, p.bad AS pbad, t.n AS tn, t.bad AS tbad, s.n AS sn, s.bad AS sbad FROM vo JOIN cl p ON p.id = pc LEFT JOIN cl t ON t.id = tc LEFT JOIN cl s ON s.id = sc)"
RULES = "list_filter([CASE WHEN block_size & (block_size - 1) <> 0 THEN 'block size' END, CASE WHEN size_gib <= 0 THEN 'size' END, CASE WHEN type = 7 THEN 'type' END, CASE WHEN pbad THEN 'primary servers' END, CASE WHEN tc IS NOT NULL AND coalesce(tbad, true) THEN 'template servers' END, CASE WHEN sc IS NOT NULL AND coalesce(sbad, true) THEN 'slave servers' END, CASE WHEN sn < pn THEN 'fewer slave servers than primary servers' END], lambda v: v IS NOT NULL)"
SQL = {
    "content_dedup": f"WITH {B} SELECT hash, min(octet_length(encode(content))) AS n_bytes FROM b WHERE content <> '' GROUP BY hash",
    "dedup_ratio": f"WITH {B} SELECT count(*) AS n_blocks, count(DISTINCT hash) AS n_distinct FROM b",
    "dedup_groups": f"WITH {B} SELECT hash, count(*) AS n, min(block_index) AS first_index FROM b GROUP BY hash HAVING count(*) > 1",
    "dedup_read": f"WITH {B} SELECT block_index, length(content) AS n_chars FROM b WHERE content <> ''",
    "zero_elision": f"WITH {B} SELECT block_index, octet_length(encode(content)) AS n_bytes FROM b WHERE block_index % 3 <> 0 AND content <> ''",
    "template_fallback": f"WITH {STORES} SELECT block_index, b.hash, CASE WHEN p.hash IS NOT NULL THEN 'primary' WHEN t.hash IS NOT NULL THEN 'template' END AS origin, length(coalesce(p.content, t.content)) AS n_chars FROM b LEFT JOIN p USING (hash) LEFT JOIN t USING (hash)",
    "template_copyback": f"WITH {STORES} SELECT hash FROM t WHERE hash NOT IN (SELECT hash FROM p)",
    "overlay_read": "WITH j AS (SELECT event_id + 1 AS seq, user_id AS block_index, CASE WHEN event_type <> 'error' THEN props END AS data FROM events), ba AS (SELECT block_index, arg_max_null(data, seq) AS c FROM j WHERE seq <= 5000 GROUP BY 1), ov AS (SELECT block_index, arg_max_null(data, seq) AS c FROM j WHERE seq > 5000 GROUP BY 1) SELECT coalesce(ba.block_index, ov.block_index) AS block_index, CASE WHEN ov.block_index IS NOT NULL THEN ov.c ELSE ba.c END AS content FROM ba FULL JOIN ov ON ba.block_index = ov.block_index",
    "list_indices_union": "SELECT doc_id AS block_index FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "list_volumes_regex": "SELECT DISTINCT c_name AS volume FROM customer WHERE regexp_matches(c_name, '[05]$')",
    "lba_sectors": f"WITH {B}, s AS (SELECT DISTINCT block_index // 128 AS sector FROM b) SELECT sector, sha256(string_agg(coalesce(hash, '-'), ',' ORDER BY o)) AS digest FROM s CROSS JOIN range(128) t(o) LEFT JOIN b ON block_index = sector * 128 + o GROUP BY sector",
    "lba_unpack": f"WITH {B} SELECT block_index, hash FROM b",
    "orphan_contents": f"WITH {B} SELECT DISTINCT hash FROM b WHERE hash NOT IN (SELECT hash FROM b WHERE block_index % 4 <> 0)",
    "upsert_blocks": f"WITH {B} SELECT block_index, CASE WHEN block_index % 5 = 0 THEN 'new' ELSE hash END AS hash FROM b",
    "delete_blocks": f"WITH {B} SELECT block_index, hash FROM b WHERE block_index % 7 <> 0",
    "inflate_blocks": f"WITH {INFLATED} SELECT block_index, sha256(h) AS digest FROM i",
    "deflate_blocks": f"WITH {P} SELECT * FROM (SELECT block_index * 6 + o AS block_index, substr(h, CAST(o * 200 + 1 AS BIGINT), 200) AS content FROM p CROSS JOIN range(6) t(o)) WHERE content <> repeat('0', 200)",
    "rechunk_roundtrip": f"WITH {P} SELECT block_index, sha256(h) AS digest FROM p WHERE h <> repeat('0', 1200)",
    "snapshot_describe": f"WITH {B} SELECT count(*) AS n_blocks, count(*) * 4096 AS snapshot_bytes, (max(block_index) + 1) * 4096 AS volume_bytes, count(DISTINCT hash) AS n_distinct FROM b",
    "snapshot_header_rows": f"WITH {B} SELECT block_index, hash FROM b",
    "import_extent": f"WITH {P}, l AS (SELECT * FROM p ORDER BY block_index DESC LIMIT 1) SELECT 'equal' AS \"case\", (block_index + 1) * 600 AS size FROM l UNION ALL SELECT 'larger', (block_index // 4 + 1) * 2400 FROM l UNION ALL SELECT 'smaller', max(block_index * 12 + o + 1) * 50 FROM l CROSS JOIN range(12) t(o) WHERE substr(h, CAST(o * 100 + 1 AS BIGINT), 100) <> repeat('0', 100)",
    "split_requests": f"WITH {REQ}, y AS (SELECT o, n, unnest(range(o // 4096, (o + n - 1) // 4096 + 1)) AS block_index FROM r WHERE n > 0) SELECT block_index, count(*) AS n, CAST(sum(least(o + n, (block_index + 1) * 4096) - greatest(o, block_index * 4096)) AS BIGINT) AS total, min(greatest(o, block_index * 4096) - block_index * 4096) AS least_offset FROM y GROUP BY 1",
    "request_violations": f"WITH {REQ} SELECT CASE WHEN n > 20000 THEN 'too long' WHEN o < 0 OR o + n > 50000000 THEN 'out of bounds' END AS violation, count(*) AS n FROM r GROUP BY 1",
    "padded_read": "SELECT doc_id AS block_index, rpad(substr(hex(encode(text)), 201, 128), 128, '0') AS bytes FROM documents",
    "merge_write": f"WITH {P} SELECT block_index, substr(h, 1, CAST(block_index % 500 * 2 AS BIGINT)) || '30313233343536373839' || substr(h, CAST(block_index % 500 * 2 + 21 AS BIGINT)) AS bytes FROM p",
    "merge_zeroes": f"WITH {P} SELECT block_index, CASE WHEN block_index % 4 <> 0 THEN substr(h, 1, CAST(block_index % 500 * 2 AS BIGINT)) || repeat('0', 40) || substr(h, CAST(block_index % 500 * 2 + 41 AS BIGINT)) END AS bytes FROM p",
    "index_islands": f"WITH {REQ}, d AS (SELECT DISTINCT o // 4096 AS x FROM r), g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS k FROM d) SELECT min(x) AS first_index, max(x) AS last_index, max(x) - min(x) + 1 AS n_blocks FROM g GROUP BY k",
    "shard_by_hash": f"WITH {B} SELECT CAST(('0x' || hash[1:2]) AS BIGINT) % 13 AS shard, count(*) AS n FROM b GROUP BY 1",
    "shard_by_index": f"WITH j AS (SELECT key, bucket FROM ({JUMP.format('SELECT DISTINCT doc_id + t AS key FROM documents CROSS JOIN range(16) r(t)')})), a AS (SELECT doc_id, CASE doc_id % 13 {_ALIVE} END AS up FROM documents), f AS (SELECT doc_id, arg_min(bucket, t) AS s FROM documents CROSS JOIN range(16) r(t) JOIN j ON key = doc_id + t WHERE CASE bucket {_ALIVE} END GROUP BY 1) SELECT doc_id AS block_index, CASE WHEN up THEN doc_id % 13 ELSE s END AS shard FROM a JOIN f USING (doc_id)",
    "jump_hash": f"SELECT key AS event_id, bucket FROM ({JUMP.format('SELECT event_id AS key FROM events')})",
    "clone_reshard": f"WITH {B} SELECT CAST(('0x' || hash[1:2]) AS BIGINT) % 13 AS old_shard, CAST(('0x' || hash[1:2]) AS BIGINT) % 8 AS new_shard, count(*) AS n_blocks FROM b GROUP BY 1, 2",
    "server_state_fold": "WITH e AS (SELECT user_id % 8 AS server_index, CASE WHEN event_id % 997 = 13 THEN 'rip' WHEN event_type = 'error' THEN 'offline' ELSE 'online' END AS state, event_id AS seq FROM events), f AS (SELECT *, coalesce(max(CASE WHEN state = 'rip' THEN 1 ELSE 0 END) OVER (PARTITION BY server_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM e), g AS (SELECT *, lag(state) OVER (PARTITION BY server_index ORDER BY seq) AS b FROM f WHERE dead = 0) SELECT server_index, state, seq FROM g WHERE state IS DISTINCT FROM b",
    "first_online_server": f"WITH {SV} SELECT cluster, arg_min(address, server_index) FILTER (state = 'online') AS address, count(*) FILTER (state = 'online') AS n_online FROM sv GROUP BY 1",
    "assigned_servers": "SELECT '10.0.0.' || s_suppkey AS address, CASE WHEN s_suppkey % 4 = 2 THEN 'offline' ELSE 'online' END AS state, count(*) AS n FROM documents JOIN supplier ON doc_id % (SELECT count(*) FROM supplier) = s_suppkey GROUP BY 1, 2",
    "config_compose": f"WITH {CO} SELECT volume, pn AS primary_servers, tn AS template_servers, sn AS slave_servers, CASE WHEN type & 1 <> 0 THEN 'deduped' ELSE 'nondeduped' END AS storage, type & 16 <> 0 AS journal, type & 32 <> 0 AS template FROM c",
    "config_violations": f"WITH {CO} SELECT volume, array_to_string({RULES}, '; ') AS violations FROM c",
    "config_watch": "SELECT user_id, event_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT user_id, event_id, event_type AS value FROM events WHERE event_type <> 'error')) WHERE value IS DISTINCT FROM b",
    "hash_integrity": "SELECT doc_id AS block_index FROM documents WHERE doc_id % 11 = 0",
    "hash_paths": f"WITH {B} SELECT block_index, upper(hash[1:4]) || '/' || upper(hash[5:8]) || '/' || upper(hash[9:]) AS path FROM b",
    "versions": "SELECT doc_id, (doc_id % 7) * 65536 + (doc_id % 11) * 256 + doc_id % 5 AS packed, (doc_id % 7) || '.' || (doc_id % 11) || '.' || (doc_id % 5) AS version FROM documents",
    "block_sizes": "SELECT p_partkey, p_partkey * 64 >= 512 AND (CAST(p_partkey AS BIGINT) * 64) & (CAST(p_partkey AS BIGINT) * 64 - 1) = 0 AS valid, CAST(CASE WHEN p_partkey <= 1 THEN 1 ELSE pow(2, ceil(log2(p_partkey))) END AS BIGINT) AS power FROM part",
    "dense_numbers": "SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer",
}
