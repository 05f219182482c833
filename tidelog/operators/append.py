"""Offsets, frontiers and round-robin placement (O-20, O-22, O-53, O-63)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DISK_OVERHEAD

BLOCK_BITS = 16
WHOLE = ("byte", "short", "integer", "long")


def round_robin(sequence: Column, partitions: int) -> Column:
    """The producer's choice of partition: never a hash of a key."""
    return F.pmod(sequence, F.lit(partitions)).cast("int")


def assign_offsets(rows: DataFrame, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """Adds offset: dense by partition in the given order, from base (partition, next_offset) or 0.

    There are few partitions, so rows are numbered by blocks, runs of 2**BLOCK_BITS values of the first order
    column where it is a whole number: a block's rows come after those of all blocks before it, of which only
    counts are summed up. Other orders are numbered partition by partition.
    """
    known = None if base is None else base.select("partition", F.col("next_offset").alias("_base"))
    if rows.schema[order[0]].dataType.typeName() not in WHOLE:
        rows = rows.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1).cast("bigint"))
    else:
        block = F.coalesce(F.shiftright(F.col(order[0]).cast("bigint"), BLOCK_BITS), F.lit(-(1 << 62)))
        marked = rows.withColumn("_block", block)
        counts = marked.groupBy("partition", "_block").agg(F.count("*").alias("_n"))
        along = Window.partitionBy("partition").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        before = counts.select("partition", "_block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
        nth = F.row_number().over(Window.partitionBy("partition", "_block").orderBy(*order)) - 1
        rows = marked.withColumn("_nth", nth).join(before, ["partition", "_block"]).withColumn("offset", F.col("_nth") + F.col("_before")).drop("_nth", "_before", "_block")
    if known is None:
        return rows
    return rows.join(F.broadcast(known), "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("_base", F.lit(0))).drop("_base")  # 16 rows at most


def offset_density(log: DataFrame) -> DataFrame:
    """Per partition: rows, first and last offset, and whether they are exactly 0..n-1."""
    out = log.groupBy("partition").agg(F.count("*").alias("records"), F.countDistinct("offset").alias("offsets"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    dense = (F.col("first_offset") == 0) & (F.col("last_offset") == F.col("records") - 1) & (F.col("offsets") == F.col("records"))
    return out.withColumn("dense", dense).withColumn("partition", F.col("partition").cast("bigint"))


def byte_frontier(log: DataFrame) -> DataFrame:
    """Bytes of each partition's log file, and the next offset."""
    size = F.octet_length("payload").cast("bigint") + DISK_OVERHEAD
    return log.groupBy(F.col("partition").cast("bigint").alias("partition")).agg(F.sum(size).alias("frontier_bytes"), (F.max("offset") + 1).alias("next_offset"))


def frontier_capped(log: DataFrame, frontier: DataFrame) -> DataFrame:
    """What readers may see: offsets below the partition's frontier. frontier: partition, next_offset."""
    limit = frontier.select(F.col("partition"), F.col("next_offset").alias("_next"))
    return log.join(F.broadcast(limit), "partition").where(F.col("offset") < F.col("_next")).drop("_next")  # a row for each partition
