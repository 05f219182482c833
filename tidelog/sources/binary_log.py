"""Import of binary partition logs (O-08, O-50..O-52): records of length, CRC-32C and payload, big-endian,
beside a frontier file of length and CRC-32C that says how many bytes are acknowledged."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.checksum import crc32c, crc32c_many

SCHEMA = "partition int, offset bigint, payload binary, acknowledged boolean"


class Refused(RuntimeError):
    """Acknowledged data is damaged: nothing is guessed."""


def record(payload: bytes) -> bytes:
    return struct.pack(">II", len(payload), crc32c(payload)) + payload


def frontier(length: int) -> bytes:
    head = struct.pack(">Q", length)
    return head + struct.pack(">I", crc32c(head))


def _records(log: bytes, at_once: int = 4096) -> Iterator[tuple[int, bytes | None]]:
    """(start, payload) of each record; a last one with None where a record is cut or its checksum is wrong.
    Checksums are computed for many records at once."""
    at, held = 0, []

    def checked() -> Iterator[tuple[int, bytes | None]]:
        for (start, payload, crc), got in zip(held, crc32c_many([p for _, p, _ in held]).tolist(), strict=True):
            yield start, payload if got == crc else None
            if got != crc:
                return

    while at < len(log):
        size, crc = struct.unpack(">II", log[at : at + 8]) if at + 8 <= len(log) else (len(log), 0)
        if at + 8 + size <= len(log):
            held.append((at, log[at + 8 : at + 8 + size], crc))
            at += 8 + size
            if len(held) < at_once and at < len(log):
                continue
            cut = False
        else:
            cut = True
        last: tuple[int, bytes | None] = (0, b"")
        for last in checked():
            yield last
        if last[1] is None:
            return
        if cut:
            yield at, None
            return
        held = []


def parse(log: bytes, mark: bytes | None) -> Iterator[tuple[bytes, bool]]:
    """(payload, acknowledged) of each record. Valid records past the frontier are kept but unacknowledged;
    there, the first invalid one ends the log. Any damage before the frontier is refused."""
    if not mark:
        if log:
            raise Refused("records without a frontier")
        durable = 0
    else:
        if len(mark) != 12 or crc32c(mark[:8]) != struct.unpack(">I", mark[8:])[0]:
            raise Refused("damaged frontier")
        durable = struct.unpack(">Q", mark[:8])[0]
        if durable > len(log):
            raise Refused("frontier beyond the log")
    for at, payload in _records(log):
        if at < durable and (payload is None or at + 8 + len(payload) > durable):
            raise Refused(f"damaged record at byte {at}")
        if payload is None:
            return
        yield payload, at < durable


def read_binary(spark: SparkSession, topic_path: str) -> DataFrame:
    """partition, offset, payload, acknowledged of <topic_path>/<partition>/{log,frontier}. One task reads one
    partition's files, as its records have no other place to start from than the first byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(topic_path)
    named = files.select(F.regexp_extract("path", r"/([0-9]+)/(?:log|frontier)\z", 1).alias("p"), F.regexp_extract("path", r"/(log|frontier)\z", 1).alias("kind"), "content").where("p <> ''")
    both = named.groupBy(F.col("p").cast("int").alias("partition")).agg(F.max(F.when(F.col("kind") == "log", F.col("content"))).alias("log"), F.max(F.when(F.col("kind") == "frontier", F.col("content"))).alias("mark"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, log, mark in b.itertuples(index=False):
                rows = [(p, o, payload, ok) for o, (payload, ok) in enumerate(parse(bytes(log or b""), bytes(mark) if mark else None))]
                yield pd.DataFrame(rows, columns=["partition", "offset", "payload", "acknowledged"])

    return both.mapInPandas(run, SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One message for each line of text (O-09)."""
    return spark.read.text(path).select(F.col("value").cast("binary").alias("payload"))
