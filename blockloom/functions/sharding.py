"""Which server owns a block: by index, by hash, by jump consistent hash, with fallback past dead servers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier of the generator in Lamping and Veach, "A fast, minimal memory, consistent hash algorithm" (fixed value).
JUMP_MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into 0 .. buckets - 1. Keys that have landed take no further part."""
    at = np.zeros(len(keys), dtype=np.int64)
    rows, state, reach = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys))
    while len(rows):
        at[rows] = reach.astype(np.int64)
        state = state * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        reach = np.floor((at[rows] + 1) * (2.0**31 / ((state >> np.uint64(33)).astype(np.float64) + 1)))
        go = reach < buckets
        rows, state, reach = rows[go], state[go], reach[go]
    return at


def jump_hash(key: Column, buckets: int) -> Column:
    """Jump consistent hash of a bigint. The generator needs unsigned 64-bit wraparound, which bigint lacks under ANSI rules, so batches of keys go through numpy."""

    @F.pandas_udf("bigint")
    def land(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), buckets))

    return land(key)


def shard_by_index(index: Column, alive: list[bool]) -> Column:
    """index mod n; past a dead server, the jump hash of index, index + 1, ... until one is alive, however many tries that takes."""
    if not any(alive):
        raise ValueError("no server is alive")
    n, up = len(alive), np.array(alive)
    home = F.pmod(index, F.lit(n))
    if all(alive):
        return home

    @F.pandas_udf("bigint")
    def other(keys: pd.Series) -> pd.Series:
        key = keys.fillna(-1).to_numpy(np.int64)
        out = np.full(len(key), -1, dtype=np.int64)
        rows = np.flatnonzero(key >= 0)  # -1: its own server is alive
        step = 0
        while len(rows):
            out[rows] = jump(key[rows] + step, n)
            rows, step = rows[~up[out[rows]]], step + 1
        return pd.Series(out)

    own = F.get(F.array(*map(F.lit, alive)), home.cast("int"))
    return F.when(own, home).otherwise(other(F.when(~own, index)))


def shard_by_hash(hex_digest: Column, servers: int) -> Column:
    from .hashing import first_byte

    return first_byte(hex_digest) % servers
