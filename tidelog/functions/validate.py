"""Request validation in a fixed order, the first failure deciding (O-60, O-61), as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import schema as S


def produce_code(name: Column, known: Column, partition: Column, partitions: Column, payload_bytes: Column) -> Column:
    """0, or the code of a rejected produce: name, size, topic, partition."""
    return (
        F.when(~F.coalesce(S.name_ok(name), F.lit(False)), S.NUMBER["INVALID_NAME"])
        .when(payload_bytes > S.MAX_PAYLOAD, S.NUMBER["MSG_TOO_LARGE"])
        .when(~F.coalesce(known, F.lit(False)), S.NUMBER["UNKNOWN_TOPIC"])
        .when((partition < 0) | (partition >= partitions), S.NUMBER["BAD_PARTITION"])
        .otherwise(0)
    )


def fetch_code(name: Column, entries: Column, max_wait_ms: Column, max_bytes: Column, known: Column, partitions: Column, highest: Column) -> Column:
    """0, or the code of a rejected fetch: name, no entry, too many entries, wait, bytes, topic, partition."""
    return (
        F.when(~F.coalesce(S.name_ok(name), F.lit(False)), S.NUMBER["INVALID_NAME"])
        .when(entries == 0, S.NUMBER["MALFORMED"])
        .when(entries > S.MAX_ENTRIES, S.NUMBER["FETCH_TOO_WIDE"])
        .when((max_wait_ms > S.MAX_WAIT_MS) | (max_bytes > S.MAX_FETCH_BYTES), S.NUMBER["CAP_EXCEEDED"])
        .when(~F.coalesce(known, F.lit(False)), S.NUMBER["UNKNOWN_TOPIC"])
        .when(highest >= partitions, S.NUMBER["BAD_PARTITION"])
        .otherwise(0)
    )


def create_code(name: Column, partitions: Column, exists: Column, topics: Column) -> Column:
    """0, or the code of a rejected create: name, partition count, duplicate, number of topics."""
    return (
        F.when(~F.coalesce(S.name_ok(name), F.lit(False)), S.NUMBER["INVALID_NAME"])
        .when((partitions < 1) | (partitions > S.MAX_PARTITIONS), S.NUMBER["CAP_EXCEEDED"])
        .when(exists, S.NUMBER["TOPIC_EXISTS"])
        .when(topics >= S.MAX_TOPICS, S.NUMBER["CAP_EXCEEDED"])
        .otherwise(0)
    )


def env_int(value: Column, default: int, least: int = 1, most: int = 1 << 20) -> Column:
    """A whole number from a setting's text, or the default where it is missing, no number or out of bounds."""
    n = F.when(value.rlike(r"\A[+-]?[0-9]{1,18}\z"), F.try_to_number(value, F.lit("S999999999999999999"))).cast("bigint")
    return F.when(n.between(least, most), n).otherwise(F.lit(default).cast("bigint"))
