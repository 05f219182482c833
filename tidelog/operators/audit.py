"""Audits of what was written, read and acknowledged (O-50, O-53..O-57)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containment(journal: DataFrame, fetched: DataFrame, on: list[str], surplus_pattern: str) -> DataFrame:
    """Journaled rows that weren't fetched, and fetched rows beyond the journal that don't look like ours."""
    lost = journal.join(fetched, on, "left_anti").select(F.lit("lost").alias("problem"), *on)
    foreign = fetched.join(journal, on, "left_anti").where(~F.col("payload").rlike(surplus_pattern)).select(F.lit("foreign").alias("problem"), *on)
    return lost.union(foreign)


def coverage(produced: DataFrame, parts: list[DataFrame], on: list[str]) -> DataFrame:
    """One row: how many distinct rows were produced and covered by the union of parts, and how many are missing."""
    union = parts[0].select(*on)
    for p in parts[1:]:
        union = union.union(p.select(*on))
    seen = union.distinct().withColumn("_seen", F.lit(1))
    both = produced.select(*on).distinct().join(seen, on, "left")
    return both.agg(F.count("*").alias("produced"), F.count("_seen").alias("covered"), F.coalesce(F.sum(F.when(F.col("_seen").isNull(), 1)), F.lit(0)).cast("bigint").alias("missing"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two registries has, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def commits_behind(journal: DataFrame, recovered: DataFrame) -> DataFrame:
    """Positions that came back smaller than acknowledged. Both: partition, next_offset; must be empty."""
    j = journal.select("partition", F.col("next_offset").alias("journaled"))
    return j.join(recovered, "partition", "left").where(F.coalesce("next_offset", F.lit(0)) < F.col("journaled"))


def damage(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Partitions whose stored rows aren't what the manifest acknowledged: partition, acknowledged, problem.

    Rows past the frontier are unacknowledged and don't count."""
    limit = manifest.select("partition", F.col("next_offset").alias("acknowledged"))
    seen = log.join(F.broadcast(limit), "partition").where(F.col("offset") < F.col("acknowledged")).groupBy("partition").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    both = limit.join(seen, "partition", "left")
    n = F.coalesce("n", F.lit(0))
    problem = F.when(n < F.col("acknowledged"), "missing").when(n > F.col("d"), "repeated").when((F.col("acknowledged") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("acknowledged") - 1)), "gap")
    return both.select("partition", "acknowledged", problem.alias("problem")).where(F.col("problem").isNotNull())
