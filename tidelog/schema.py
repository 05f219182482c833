"""Limits, error codes, names and record types of the log."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of requests and of the store.
MAX_PAYLOAD = 1 << 20
MAX_WAIT_MS = 30_000
MAX_FETCH_BYTES = 4 << 20
MAX_ENTRIES = 16
MAX_PARTITIONS = 16
MAX_TOPICS = 64
MAX_GROUPS = 64
MAX_MEMBERS = 32
DEFAULT_WAIT_MS = 5_000
DEFAULT_FETCH_BYTES = 1 << 20
RECORD_OVERHEAD = 12  # bytes a record costs in a response besides its payload
DISK_OVERHEAD = 8  # bytes a record costs in a log file besides its payload
SESSION_TIMEOUT_MS = 2_000
RING = 50

# Error codes.
CODES = {
    1: "UNKNOWN_TOPIC",
    2: "TOPIC_EXISTS",
    3: "BAD_PARTITION",
    4: "INVALID_NAME",
    5: "MSG_TOO_LARGE",
    6: "FRAME_TOO_LARGE",
    7: "MALFORMED",
    8: "CAP_EXCEEDED",
    9: "FETCH_TOO_WIDE",
    10: "SHUTTING_DOWN",
    11: "WRITE_FAILED",
    12: "STALE_GENERATION",
    13: "UNKNOWN_MEMBER",
}
NUMBER = {name: code for code, name in CODES.items()}

#: Anchored at the very ends: `$` would let a final newline pass.
NAME_PATTERN = r"\A[a-z0-9][a-z0-9._-]{0,127}\z"
_NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,127}")

RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class LogError(Exception):
    """A rejected request: code says why, and nothing was written."""

    def __init__(self, name: str, message: str = ""):
        super().__init__(f"{name}: {message}" if message else name)
        self.name, self.code = name, NUMBER[name]


def valid_name(name: str) -> bool:
    return _NAME.fullmatch(name) is not None


def check_name(name: str) -> str:
    if not valid_name(name):
        raise LogError("INVALID_NAME", repr(name))
    return name


def name_ok(name: Column) -> Column:
    return name.rlike(NAME_PATTERN)


def record_cost(payload: Column) -> Column:
    """Bytes a record takes of a fetch budget."""
    return F.octet_length(payload).cast("bigint") + RECORD_OVERHEAD
