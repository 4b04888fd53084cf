"""Compression, encryption and erasure coding of block contents. AES-GCM is built in (nonce, ciphertext, tag); the others run over Arrow batches."""

from __future__ import annotations

import gzip
import lzma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values that are Python objects at once.
SLICE = 128


def _mapped(f):
    """f over contents as Arrow has them: of a batch, a slice at a time is in Python objects."""

    def apply(content: pa.Array) -> pa.Array:
        parts = [pa.array([f(x.as_buffer()) if x.is_valid else None for x in content.slice(at, SLICE)], content.type) for at in range(0, len(content), SLICE)]
        return pa.concat_arrays(parts) if parts else content

    return apply


def _udf(f):
    apply = _mapped(f)

    @F.arrow_udf("binary")
    def udf(content: pa.Array) -> pa.Array:
        return apply(content)

    return udf


def _xz(content: pa.Buffer) -> bytes:
    """A dictionary as long as the content (a power of two, 8 MB at most) gives what the preset's 8 MB give, which would cost more to set up than a block to compress."""
    size = 1 << min(23, max(12, (content.size - 1).bit_length()))
    return lzma.compress(content, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])


def xz_compress(content: Column) -> Column:
    return _udf(_xz)(content)


def xz_decompress(content: Column) -> Column:
    return _udf(lzma.decompress)(content)


def gzip_compress(content: Column) -> Column:
    return _udf(lambda x: gzip.compress(x, mtime=0))(content)


def gzip_decompress(content: Column) -> Column:
    return _udf(gzip.decompress)(content)


def lz4_compress(content: Column) -> Column:
    """An LZ4 frame, the content's length (8 bytes, little-endian) before it."""
    return _udf(lambda x: x.size.to_bytes(8, "little") + pa.compress(x, codec="lz4", asbytes=True))(content)


def lz4_decompress(content: Column) -> Column:
    return _udf(lambda x: pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="lz4", asbytes=True))(content)


COMPRESSIONS = {"lz4": (lz4_compress, lz4_decompress), "xz": (xz_compress, xz_decompress), "gzip": (gzip_compress, gzip_decompress)}


class Erasure:
    """Reed-Solomon code over GF(256) (polynomial 0x11D): k data shards and m parity shards, any k of which give the content.

    The code's matrix is the identity over a Cauchy matrix, so every k of its rows are independent.
    """

    def __init__(self, k: int, m: int):
        if k < 1 or m < 1 or k + m > 256:
            raise ValueError("k and m are at least 1 and 256 together at most")
        self.k, self.m = k, m
        power = [1]
        for _ in range(254):
            power.append(power[-1] << 1 ^ (0x11D if power[-1] & 0x80 else 0))
        self.exp = np.array(power + power, dtype=np.uint8)
        self.log = np.zeros(256, dtype=np.int64)
        self.log[self.exp[:255]] = np.arange(255)
        x, y = np.arange(k, k + m), np.arange(k)
        self.rows = np.concatenate([np.eye(k, dtype=np.uint8), self.inverse_of(x[:, None] ^ y[None, :])])

    def inverse_of(self, a: np.ndarray) -> np.ndarray:
        return self.exp[(255 - self.log[a]) % 255]

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a == 0) | (b == 0), np.uint8(0), self.exp[self.log[a] + self.log[b]])

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), b.shape[1]), dtype=np.uint8)
        for i in range(a.shape[1]):
            out ^= self.times(a[:, i : i + 1], b[i : i + 1])
        return out

    def encode(self, content: bytes) -> list[bytes]:
        """k + m shards of one length; the content's length (8 bytes) comes first."""
        raw = len(content).to_bytes(8, "little") + content
        width = -(-len(raw) // self.k)
        data = np.frombuffer(raw.ljust(width * self.k, b"\0"), dtype=np.uint8).reshape(self.k, width)
        return [x.tobytes() for x in np.concatenate([data, self.product(self.rows[self.k :], data)])]

    def decode(self, shards: list[bytes | None]) -> bytes:
        """The content from any k shards; missing ones are null."""
        there = [i for i, s in enumerate(shards) if s is not None][: self.k]
        if len(there) < self.k:
            raise ValueError("too few shards")
        left, right = self.rows[there].copy(), np.eye(self.k, dtype=np.uint8)
        for i in range(self.k):  # Gauss-Jordan
            swap = i + int(np.flatnonzero(left[i:, i])[0])
            for side in (left, right):
                side[[i, swap]] = side[[swap, i]]
            scale = self.inverse_of(left[i, i])
            left[i], right[i] = self.times(left[i], scale), self.times(right[i], scale)
            for j in range(self.k):
                if j != i and left[j, i]:
                    by = left[j, i]
                    left[j] ^= self.times(left[i], by)
                    right[j] ^= self.times(right[i], by)
        raw = self.product(right, np.stack([np.frombuffer(shards[i], dtype=np.uint8) for i in there])).tobytes()
        return raw[8 : 8 + int.from_bytes(raw[:8], "little")]


def erasure_encode(content: Column, k: int, m: int) -> Column:
    """An array of k + m shards."""
    code = Erasure(k, m)

    @F.pandas_udf("array<binary>")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda c: None if c is None else code.encode(bytes(c)))

    return apply(content)


def erasure_decode(shards: Column, k: int, m: int) -> Column:
    code = Erasure(k, m)

    @F.pandas_udf("binary")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else code.decode([None if c is None else bytes(c) for c in s]))

    return apply(shards)


def valid_key(key: bytes) -> bool:
    return len(key) == 32 and any(key)


def encrypt(content: Column, key: bytes) -> Column:
    if not valid_key(key):
        raise ValueError("a key has 32 bytes that are not all zero")
    return F.aes_encrypt(content, F.lit(key), F.lit("GCM"))


def decrypt(content: Column, key: bytes) -> Column:
    if not valid_key(key):
        raise ValueError("a key has 32 bytes that are not all zero")
    return F.aes_decrypt(content, F.lit(key), F.lit("GCM"))
