"""CRC-32C over payloads (O-62): Spark's own crc32 has another polynomial."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = int(TABLE[(crc ^ b) & 0xFF]) ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """All payloads at once, one byte place after another, over those that reach so far."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    sizes = lengths[order]
    crc = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -i, side="left"))
        crc[:live] = TABLE[(crc[:live] ^ data[starts[:live] + i]) & 0xFF] ^ crc[:live] >> 8
    out = np.empty(len(payloads), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        known = s.notna()
        out = pd.Series([None] * len(s), dtype="Int64")
        if known.any():
            out[known.to_numpy()] = crc32c_many([bytes(x) for x in s[known]]).astype(np.int64)
        yield out


def crc32c_column(payload: Column) -> Column:
    """Checksum of a binary column as an unsigned number; null for null."""
    return F.pandas_udf(_crc32c, T.LongType())(payload.cast("binary"))
