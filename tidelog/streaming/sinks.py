"""Streams into the log, and group consumption with a fenced commit at each batch's end (O-11, O-20, O-21, O-25, O-42)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelog.operators.fold import Coordinator
from tidelog.sources.store import Store


def append_stream(rows: DataFrame, store: Store, topic: str, order: list[str], name: str) -> DataStreamWriter:
    """Each micro-batch is one append, so the trigger's interval is the group commit. A batch that runs again
    after a failure finds its name in the manifest and appends nothing."""
    return rows.writeStream.foreachBatch(lambda batch, i: store.append(topic, batch, order, applied=f"{name}-{i}") and None)


def consume_stream(rows: DataFrame, groups: Coordinator, group: str, member: str, generation: int, now: Callable[[], int], handle: Callable[[DataFrame], None]) -> DataStreamWriter:
    """handle sees each batch of the member's records; then the next offsets are committed. The fence holds
    before the batch and again with the commit: a stale member's batch ends the query with code 12 or 13."""

    def batch(frame: DataFrame, _: int) -> None:
        groups.fence(group, member, generation)
        frame = frame.persist()
        handle(frame)
        following = {r[0]: r[1] for r in frame.groupBy("partition").agg(F.max("offset") + 1).collect()}  # a row for each partition
        frame.unpersist()
        if following:
            groups.commit(group, member, generation, following, now())

    return rows.writeStream.foreachBatch(batch)


def tick_counts(rows: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: records by event-time window, with a watermark for late ones."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("records")).select("window.start", "window.end", "records")


def dedupe_stream(rows: DataFrame, key: list[str], ts: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first of each key; for ever, or within a watermark where ts is given, which bounds the state."""
    return rows.dropDuplicates(key) if ts is None else rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
