"""Measures of the client programs (O-70..O-83)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first sighting of each key; the rank limit is applied before the shuffle."""
    along = Window.partitionBy(*key).orderBy(arrival)
    return rows.withColumn("_nth", F.row_number().over(along)).where("_nth = 1").drop("_nth")


def duplicates(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Per bucket: sightings of a key after its first. Counted by key first, so no distinct set is built."""
    return rows.groupBy(*by, *key).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.sum("_n").alias("seen"), F.sum(F.col("_n") - 1).alias("duplicates"))


def nearest_rank(value: str, percent: int) -> Column:
    """The smallest value with at least percent % of all values at or below it; 0 of none."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def rates(rows: DataFrame, by: str, ts: str, payload: str) -> DataFrame:
    """Acknowledged records, records and MB (10^6) a second, by bucket, between its first and last record."""
    out = rows.groupBy(by).agg(F.count("*").alias("acked"), F.sum(F.octet_length(payload).cast("bigint")).alias("bytes"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("_us"))
    secs = F.col("_us") / 1e6
    return out.select(by, "acked", "bytes", F.round(F.when(secs > 0, F.col("acked") / secs).otherwise(0.0), 6).alias("per_sec"), F.round(F.when(secs > 0, F.col("bytes") / 1e6 / secs).otherwise(0.0), 9).alias("mb_per_sec"))


def spread(rows: DataFrame, value: str) -> DataFrame:
    """Smallest, largest and unweighted mean over iterations."""
    return rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))


def in_iterations(rows: DataFrame, bounds: DataFrame, at: str) -> DataFrame:
    """Rows with the iteration in which they completed; iteration 0 is the warm-up and drops out."""
    b = bounds.where("iteration > 0")
    return rows.join(F.broadcast(b), (F.col(at) >= F.col("begins")) & (F.col(at) < F.col("ends"))).drop("begins", "ends")  # a row for each iteration


def counter_deltas(snapshots: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    along = Window.partitionBy(*by).orderBy(order)
    return snapshots.withColumn("delta", F.col(value) - F.lag(value).over(along))


def decode_header(payload_hex: Column) -> dict[str, Column]:
    """Three big-endian unsigned 64-bit numbers at bytes 0, 8, 16 (values below 2^63), from a hex string."""
    field = lambda i: F.conv(F.substring(payload_hex, 16 * i + 1, 16), 16, 10).cast("bigint")
    return {"producer": field(0), "seq": field(1), "sent_ns": field(2)}


def running_total(rows: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """Adds total: the sum of value up to each row, by a whole-number order. Blocks of the order are summed up on
    their own, so that only one row for each block meets all others in one task."""
    own = F.floor(F.col(order) / block)
    along = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_block", own)
    sums = marked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(sums.select("_block", before.alias("_before")), "_block").withColumn("total", F.col("_before") + F.sum(value).over(along)).drop("_block", "_before")


def tick_totals(rows: DataFrame, tick: str, partition: str) -> DataFrame:
    """Per tick: new records, the running total, and the partitions they came to."""
    per = rows.groupBy(tick).agg(F.count("*").alias("new"), F.array_join(F.array_sort(F.collect_set(partition)), ",").alias("partitions"))
    return running_total(per, tick, "new")


def consumed_frontier(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("partition").cast("bigint").alias("partition")).agg((F.max("offset") + 1).alias("next_offset"))


def sticky_cap(samples: DataFrame, order: str, size: str, cap: int) -> DataFrame:
    """Paused from the first sample at or above the cap on, for good: one minimum decides for all samples."""
    first = samples.where(F.col(size) >= cap).agg(F.min(order)).scalar()
    return samples.withColumn("paused", F.coalesce(F.col(order) >= first, F.lit(False)))


def feed_snapshot(log: DataFrame, ring: DataFrame) -> DataFrame:
    """The snapshot's data as one row: produced, next offsets by partition, recent records, oldest first."""
    parts = consumed_frontier(log).agg(F.array_sort(F.collect_list(F.struct("partition", "next_offset"))).alias("partitions"))
    recent = ring.agg(F.array_sort(F.collect_list(F.struct("event_id", "partition", "offset", "payload"))).alias("recent"))
    return log.agg(F.count("*").alias("produced")).select("produced", parts.scalar().alias("partitions"), recent.scalar().alias("recent"))


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.2f GB", n / (1 << 30)))


def uptime(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
