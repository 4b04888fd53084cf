"""The tables of the engine (explicit schemas; nothing is inferred)."""

BLOCKS = "volume string, block_index bigint, content binary"
LBA = "volume string, block_index bigint, hash binary"
CONTENT = "hash binary, content binary"
JOURNAL = "volume string, seq bigint, block_index bigint, op tinyint, ts bigint, hash binary, data binary"
SERVERS = "cluster string, server_index int, address string, db int, state string"
REQUESTS = "request_id bigint, offset bigint, length bigint"
SET, DELETE = 1, 2
SECTOR = 128
SEGMENT = 25
