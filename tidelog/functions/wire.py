"""The protocol's frames and message bodies, described by tables and coded by one interpreter (O-64)."""

from __future__ import annotations

import struct
from typing import Any

from tidelog.schema import LogError

VERSION = 1
# Frame limits, and each message's number and fields in order. A list is a counted repetition.
MAX_REQUEST_FRAME = (1 << 20) + (4 << 10)
MAX_RESPONSE_FRAME = (4 << 20) + (64 << 10)
CURSORS = [("partition", "u32"), ("offset", "u64")]
POSITIONS = [("partition", "u32"), ("next", "u64")]
MEMBER = [("group", "str"), ("member", "str"), ("generation", "u64")]
MESSAGES: dict[str, tuple[int, list]] = {
    "Produce": (1, [("topic", "str"), ("partition", "u32"), ("payload", "blob")]),
    "ProduceResp": (2, [("offset", "u64")]),
    "Fetch": (3, [("topic", "str"), ("entries", CURSORS), ("max_wait_ms", "u32"), ("max_bytes", "u32")]),
    "FetchResp": (4, [("groups", [("partition", "u32"), ("records", [("offset", "u64"), ("payload", "blob")])])]),
    "CreateTopic": (5, [("topic", "str"), ("partitions", "u32")]),
    "CreateTopicResp": (6, []),
    "ListTopics": (7, []),
    "ListTopicsResp": (8, [("topics", [("name", "str"), ("partitions", "u32")])]),
    "JoinGroup": (9, [("group", "str"), ("topic", "str")]),
    "JoinGroupResp": (10, [("member", "str"), ("generation", "u64"), ("assigned", POSITIONS)]),
    "Heartbeat": (11, MEMBER),
    "HeartbeatResp": (12, [("flags", "u8")]),
    "CommitOffsets": (13, [*MEMBER, ("entries", POSITIONS)]),
    "CommitOffsetsResp": (14, []),
    "LeaveGroup": (15, MEMBER[:2]),
    "LeaveGroupResp": (16, []),
    "GroupFetch": (17, [*MEMBER, ("entries", CURSORS), ("max_wait_ms", "u32"), ("max_bytes", "u32")]),
    "Error": (255, [("code", "u16"), ("message", "str")]),
}
BY_NUMBER = {n: name for name, (n, _) in MESSAGES.items()}
NUMBERS = {"u8": ">B", "u16": ">H", "u32": ">I", "u64": ">Q"}
COUNTED = {"str": ">H", "blob": ">I"}


def _put(kind: Any, value: Any) -> bytes:
    if isinstance(kind, list):
        return struct.pack(">I", len(value)) + b"".join(_put_fields(kind, v) for v in value)
    if kind in NUMBERS:
        return struct.pack(NUMBERS[kind], value)
    raw = value.encode("utf-8", "surrogateescape") if kind == "str" else bytes(value)
    return struct.pack(COUNTED[kind], len(raw)) + raw


def _put_fields(fields: list, message: dict) -> bytes:
    return b"".join(_put(kind, message[name]) for name, kind in fields)


class _Body:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise LogError("MALFORMED", "the body ends inside a field")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, kind: Any) -> Any:
        if isinstance(kind, list):
            n = self.get("u32")
            return [self.fields(kind) for _ in range(n)]  # each takes bytes, so a false count ends soon
        if kind in NUMBERS:
            return struct.unpack(NUMBERS[kind], self.take(struct.calcsize(NUMBERS[kind])))[0]
        raw = self.take(struct.unpack(COUNTED[kind], self.take(struct.calcsize(COUNTED[kind])))[0])
        return raw.decode("utf-8", "surrogateescape") if kind == "str" else raw

    def fields(self, fields: list) -> dict:
        return {name: self.get(kind) for name, kind in fields}


def encode(name: str, message: dict | None = None) -> bytes:
    return _put_fields(MESSAGES[name][1], message or {})


def decode(name: str, data: bytes) -> dict:
    """The message; a body too short or too long is MALFORMED."""
    body = _Body(data)
    out = body.fields(MESSAGES[name][1])
    if body.at != len(data):
        raise LogError("MALFORMED", f"{len(data) - body.at} bytes too many")
    return out


def frame(name: str, message: dict | None = None) -> bytes:
    body = encode(name, message)
    return struct.pack(">IBB", 2 + len(body), VERSION, MESSAGES[name][0]) + body


def unframe(data: bytes, most: int = MAX_REQUEST_FRAME) -> tuple[str, dict, bytes]:
    """(message name, message, what follows the frame)."""
    if len(data) < 4:
        raise LogError("MALFORMED", "no frame length")
    length = struct.unpack(">I", data[:4])[0]
    if length < 2:
        raise LogError("MALFORMED", f"frame length {length}")
    if 4 + length > most:
        raise LogError("FRAME_TOO_LARGE", str(4 + length))
    if len(data) < 4 + length:
        raise LogError("MALFORMED", "cut frame")
    if data[4] != VERSION:
        raise LogError("MALFORMED", f"version {data[4]}")
    if data[5] not in BY_NUMBER:
        raise LogError("MALFORMED", f"type {data[5]}")
    name = BY_NUMBER[data[5]]
    return name, decode(name, data[6 : 4 + length]), data[4 + length :]
