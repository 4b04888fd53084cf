"""Content hashes. sha2 stays in the JVM; BLAKE2b (plain or keyed) has no built-in and runs over Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def blake2b_256(key: bytes = b""):
    """A pandas UDF: binary -> 32-byte digest, null for null. A key makes equal contents of two owners differ."""

    @F.pandas_udf("binary")
    def digest(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else hashlib.blake2b(x, digest_size=32, key=key).digest())

    return digest


def snapshot_key(crypto_key: bytes | None, compression: int) -> bytes:
    """The key of a snapshot's hashes: the crypto key followed by the compression's number, or that number alone."""
    return (crypto_key or b"") + bytes([compression])


def hash_path(digest: Column) -> Column:
    """AA BB CC... -> AABB/CCDD/rest, upper-case hex; null for anything that has not 32 bytes."""
    path = F.concat_ws("/", F.hex(F.substring(digest, 1, 2)), F.hex(F.substring(digest, 3, 2)), F.hex(F.substring(digest, 5, 28)))
    return F.when(F.octet_length(digest) == 32, path)


def is_nil(digest: Column) -> Column:
    """No hash: null, or 32 zero bytes."""
    return digest.isNull() | (digest == F.lit(bytes(32)))


def same_hash(a: Column, b: Column) -> Column:
    """Equal hashes; nil ones equal each other in either form."""
    return F.when(is_nil(a) | is_nil(b), is_nil(a) & is_nil(b)).otherwise(a == b)


def first_byte(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 2), 16, 10).cast("bigint")
