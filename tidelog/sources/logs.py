"""Views of the driver's tables as partitioned logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.append import assign_offsets, round_robin
from tidelog.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log(rows: DataFrame, partition: Column, order: list[str], payload: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return assign_offsets(rows.select(partition.cast("int").alias("partition"), payload.alias("payload"), *order, *[k for k in keep if k not in order]), order)


def event_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """partition, offset, payload, event_id, ts: events dealt round robin, in id order."""
    return as_log(table(spark, sf_dir, "events"), round_robin(F.col("event_id"), partitions), ["event_id"], F.concat_ws("|", "event_type", "props"), ("ts", "user_id", "event_type", "value"))


def conversation_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    return as_log(table(spark, sf_dir, "conversations"), round_robin(F.col("conv_id"), partitions), ["conv_id", "turn"], F.col("text"))


def lineitem_log(spark: SparkSession, sf_dir: str, partitions: int = 16) -> DataFrame:
    """All columns order the rows: no subset of them is unique."""
    rows = table(spark, sf_dir, "lineitem")
    return as_log(rows, round_robin(F.col("l_orderkey"), partitions), rows.columns, F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]))
