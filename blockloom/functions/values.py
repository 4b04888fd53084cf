"""Small value functions: versions, storage keys, server strings, enums, bit tests, sizes, status codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of storage keys (fixed values).
PREFIXES = {"lba": "lba:", "nondedup": "nondedup:", "bitmap": "semidedup:bitmap:", "journal": "tlog:"}
#: Bits of a volume type (fixed values): boot, database, cache, temporary.
TYPES = {"boot": 1 | 16 | 32, "db": 2 | 16 | 32, "cache": 4, "tmp": 8}
#: Commands that block stores are sent, and whether they change anything (fixed values).
STORE_COMMANDS = {"GET": False, "SET": True, "DEL": True, "EXISTS": False, "SCAN": False, "HGET": False, "HSET": True, "HDEL": True, "HKEYS": False, "HSCAN": False}
#: States of a storage server, by number (fixed values).
STATES = ("online", "offline", "repair", "respread", "rip")


def storage_key(kind: str, volume: Column) -> Column:
    return F.concat(F.lit(PREFIXES[kind]), volume)


def volume_of_key(key: Column) -> Column:
    """The volume that an index or block key names, null for other keys."""
    return F.when(key.rlike("^(lba:|nondedup:).+$"), F.regexp_extract(key, "^(lba:|nondedup:)(.+)$", 2))


def version_pack(version: Column) -> Column:
    """'1.2.3-label' -> 1 << 16 | 2 << 8 | 3; the label does not take part in comparisons. Null if it is no version."""
    part = [F.regexp_extract(version, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})(-.{1,8})?$", i) for i in (1, 2, 3)]
    packed = F.shiftleft(part[0].try_cast("bigint"), 16).bitwiseOR(F.shiftleft(part[1].try_cast("bigint"), 8)).bitwiseOR(part[2].try_cast("bigint"))
    return F.when(part[0] != "", packed)


def version_text(packed: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(packed, s).bitwiseAND(255).cast("string") for s in (16, 8, 0)))


def server_fields(text: Column) -> Column:
    """'address[@db]' -> struct(address, db); db defaults to 0."""
    db = F.regexp_extract(text, r"@(\d+)$", 1)
    return F.struct(F.regexp_replace(F.trim(text), r"@\d+$", "").alias("address"), F.when(db == "", 0).otherwise(db.try_cast("int")).alias("db"))


def server_list(text: Column) -> Column:
    """A comma-separated list; blanks and empty entries are dropped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), server_fields)


def valid_block_size(size: Column) -> Column:
    return (size >= 512) & (size.bitwiseAND(size - 1) == 0)


def next_power_of_two(x: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(1).cast("bigint"), lambda a, _: F.when(a < x, F.when(a < (1 << 61), a * 2).otherwise(a)).otherwise(a))


def valid_address(text: Column) -> Column:
    return text.rlike(r"^(unix:.+|/.+|https?://\S+|[^\s:]+:\d{1,5})$")


def type_name(kind: Column) -> Column:
    """boot, db, cache or tmp; null for any other number."""
    out = F.lit(None).cast("string")
    for name, bits in TYPES.items():
        out = F.when(kind == bits, name).otherwise(out)
    return out


def type_code(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for text, bits in TYPES.items():
        out = F.when(name == text, bits).otherwise(out)
    return out


def now_ns() -> Column:
    """The UTC epoch in nanoseconds (to the microsecond)."""
    return F.unix_micros(F.current_timestamp()) * 1000


def as_long(reply: Column) -> Column:
    """A server's reply read as a number: null stays null, text that is none fails the query."""
    return reply.cast("string").cast("bigint")


def as_flag(reply: Column) -> Column:
    return as_long(reply) != 0


def as_longs(replies: Column) -> Column:
    return F.transform(replies, as_long)


def as_pairs(replies: Column) -> Column:
    """A flat list of keys and values as a map from numbers to values; an odd one out is an error."""
    n = F.size(replies)
    even = F.when(n % 2 == 0, n).otherwise(F.raise_error(F.lit("keys and values don't pair up")).cast("int"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(even - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i < even))
    return F.map_from_arrays(F.transform(at, lambda i: as_long(F.get(replies, i))), F.transform(at, lambda i: F.get(replies, i + 1)))


def writes(command: Column) -> Column:
    """Whether a store's command changes it; null for an unknown one."""
    return F.when(command.isin(*(c for c, w in STORE_COMMANDS.items() if w)), True).when(command.isin(*STORE_COMMANDS), False)


def has_bits(kind: Column, bits: int) -> Column:
    return kind.bitwiseAND(bits) != 0


def state_name(code: Column) -> Column:
    out = F.lit("unknown")
    for i, name in enumerate(STATES):
        out = F.when(code == i, name).otherwise(out)
    return out


def status_of_error(message: Column) -> Column:
    """What an error means for a server: timeout 401, disconnected 402, invalid configuration 400, temporary 421, unknown 422."""
    out = F.lit(422)
    for code, pattern in ((421, "(?i)temporar"), (400, "(?i)invalid|config"), (402, "(?i)eof|reset|refused|closed"), (401, "(?i)time-?out|deadline")):
        out = F.when(message.rlike(pattern), code).otherwise(out)
    return F.when(message.isNull(), 0).otherwise(out)
