"""Checksums that Spark's own hash functions do not provide.

Spark's ``crc32`` uses the IEEE polynomial and ``xxhash64`` the seed 42; the storage
format needs CRC-32C and XXH64 with seed 0, so both are Arrow-batched pandas UDFs.
"""

import functools
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.lru_cache(maxsize=1)
def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


LANE = 256


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit states, given by the images of its 32 unit vectors."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.lru_cache(maxsize=64)
def _zeros(log2: int) -> np.ndarray:
    """The map that appends ``2**log2`` zero bytes to a state."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if log2 == 0:
        return _table()[units & np.uint32(0xFF)] ^ (units >> np.uint32(8))
    half = _zeros(log2 - 1)
    return _times(half, half)


def _shift(state: int, n: int) -> int:
    value, log2 = np.array([state], np.uint32), 0
    while n:
        if n & 1:
            value = _times(_zeros(log2), value)
        n, log2 = n >> 1, log2 + 1
    return int(value[0])


def crc32c(data: bytes, state: int = 0) -> int:
    """CRC-32C (Castagnoli) of ``data``, continuing from ``state``.

    Long data is cut into lanes of ``LANE`` bytes whose checksums advance together, one byte of
    each lane a step; lanes then join in pairs, since appending zeros is a linear map.
    """
    table, crc = _table(), state ^ 0xFFFFFFFF
    lanes = 1 << max(len(data) // LANE, 1).bit_length() - 1
    if lanes >= 8:
        block = np.frombuffer(data, np.uint8, lanes * LANE).reshape(lanes, LANE)
        columns, states = np.ascontiguousarray(block.T), np.zeros(lanes, np.uint32)
        states[0] = crc
        for column in columns:
            states = table[(states ^ column) & np.uint32(0xFF)] ^ (states >> np.uint32(8))
        log2 = LANE.bit_length() - 1
        while len(states) > 1:
            states, log2 = _times(_zeros(log2), states[::2]) ^ states[1::2], log2 + 1
        crc, data = int(states[0]), data[lanes * LANE :]
        if len(data) >= 8 * LANE:
            return crc32c(data, crc ^ 0xFFFFFFFF)
    small = _small()
    for byte in data:
        crc = small[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@functools.lru_cache(maxsize=1)
def _small() -> list[int]:
    return _table().tolist()


def crc32c_many(values: list[bytes | None]) -> list[int | None]:
    """CRC-32C of many short values: all advance together, longest first, a byte each step."""
    given = [i for i, v in enumerate(values) if v is not None]
    order = sorted(given, key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    states, table = np.full(len(order), 0xFFFFFFFF, np.uint32), _table()
    flat, start = np.frombuffer(b"".join(values[i] for i in order), np.uint8), np.r_[0, sizes.cumsum()][:-1].astype(np.int64)
    steps = int(sizes[min(len(sizes) - 1, 8)]) if len(sizes) else 0  # beyond, a few long values go by lanes
    for at in range(steps):
        n = int(np.searchsorted(-sizes, -at, side="left"))
        part = states[:n]
        states[:n] = table[(part ^ flat[start[:n] + at]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out: list[int | None] = [None] * len(values)
    for i, state, size in zip(order, states.tolist(), sizes.tolist()):
        out[i] = crc32c(values[i][steps:], state ^ 0xFFFFFFFF) if size > steps else state ^ 0xFFFFFFFF
    return out


class Digest:
    """A checksum that is fed piece by piece."""

    def __init__(self, algo: int):
        import xxhash

        self.algo, self.crc, self.xx = algo, 0, xxhash.xxh64(seed=0)

    def update(self, data: bytes) -> None:
        if self.algo == 0:
            self.crc = crc32c(data, self.crc)
        else:
            self.xx.update(data)

    def value(self) -> int:
        return self.crc if self.algo == 0 else self.xx.intdigest()


def xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=0)


def checksum(algo: int, data: bytes) -> int:
    return crc32c(data) if algo == 0 else xxh64(data)


def placement_checksum(stream_id: str, partition: int) -> int:
    """Checksum that spreads the partitions of a stream over key prefixes."""
    name = stream_id.strip("/").encode()
    return crc32c(struct.pack(">I", len(name)) + name + struct.pack(">I", partition))


@F.pandas_udf(T.LongType())
def crc32c_col(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c_many([None if b is None else bytes(b) for b in data]), dtype="Int64")


@F.pandas_udf(T.StringType())
def xxh64_hex_col(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else f"{xxh64(bytes(b)):016x}")


@F.pandas_udf(T.StringType())
def bucket_col(stream_id: pd.Series, partition: pd.Series) -> pd.Series:
    """Three lowercase hex digits: the low 12 bits of the placement checksum."""
    return pd.Series([f"{placement_checksum(s, int(p)) & 0xFFF:03x}" for s, p in zip(stream_id, partition)])
