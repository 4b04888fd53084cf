"""Snapshot headers as bytes: bencoded, compressed and, with a key, encrypted; and read back, checked."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import COMPRESSIONS, decrypt, encrypt

FIELDS = "id string, bs bigint, src struct<id: string, bs: bigint, sz: bigint>, map struct<c: bigint, i: array<bigint>, h: array<string>>"


def bencode(x: int | str | bytes | list | dict) -> bytes:
    """Integers as i1e, strings as 3:abc, lists as l...e, dictionaries by sorted keys as d...e."""
    if isinstance(x, bool) or x is None:
        raise TypeError("only integers, strings, lists and dictionaries can be bencoded")
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, str):
        x = x.encode()
    if isinstance(x, bytes):
        return b"%d:%s" % (len(x), x)
    if isinstance(x, dict):
        return b"d" + b"".join(bencode(k) + bencode(x[k]) for k in sorted(x)) + b"e"
    return b"l" + b"".join(map(bencode, x)) + b"e"


def bdecode(raw: bytes):
    """The value that raw holds, all of it; ValueError for anything else. Strings come back as text."""

    def value(at: int):
        kind = raw[at : at + 1]
        if kind == b"i":
            end = raw.index(b"e", at)
            return int(raw[at + 1 : end]), end + 1
        if kind.isdigit():
            colon = raw.index(b":", at)
            end = colon + 1 + int(raw[at:colon])
            if end > len(raw):
                raise ValueError("a string ends too early")
            return raw[colon + 1 : end].decode(), end
        if kind not in (b"l", b"d"):
            raise ValueError(f"no value at byte {at}")
        out, at = [], at + 1
        while raw[at : at + 1] != b"e":
            x, at = value(at)
            out.append(x)
        return (out if kind == b"l" else dict(zip(out[::2], out[1::2], strict=True))), at + 1

    found, end = value(0)
    if end != len(raw):
        raise ValueError("bytes are left over")
    return found


def _encode(text: Column) -> Column:
    @F.pandas_udf("binary")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda t: bencode(json.loads(t)))

    return apply(text)


def _decode(raw: Column) -> Column:
    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda t: json.dumps(bdecode(bytes(t))))

    return apply(raw)


def to_bytes(header: DataFrame, compression: str = "xz", key: bytes | None = None) -> DataFrame:
    """(part, bytes) of the rows that operators.snapshot.header makes."""
    raw = COMPRESSIONS[compression][0](_encode(F.to_json(F.struct("id", "bs", "src", "map"))))
    return header.select("part", (encrypt(raw, key) if key else raw).alias("bytes"))


def of_bytes(rows: DataFrame, compression: str = "xz", key: bytes | None = None) -> DataFrame:
    """The header's rows again; another key, another compression or damaged bytes fail the query."""
    raw = decrypt(F.col("bytes"), key) if key else F.col("bytes")
    made = F.from_json(_decode(COMPRESSIONS[compression][1](raw)), FIELDS, {"mode": "FAILFAST"})
    return rows.select("part", made.alias("x")).select("part", "x.*")
