"""Seeks, byte-budgeted fetches, rings (O-01..O-04, O-12..O-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.schema import DEFAULT_FETCH_BYTES, MAX_FETCH_BYTES, RECORD_OVERHEAD, RING, record_cost

#: More records than any response can hold: each costs at least RECORD_OVERHEAD bytes.
MOST_RECORDS = MAX_FETCH_BYTES // RECORD_OVERHEAD + 1


def seek(log: DataFrame, partition: int, start: int, frontier: int | None = None) -> DataFrame:
    """Records of one partition from an offset up to the frontier; partition and offset reach the scan as filters."""
    out = log.where((F.col("partition") == partition) & (F.col("offset") >= start))
    return out if frontier is None else out.where(F.col("offset") < frontier)


def within_budget(records: DataFrame, max_bytes: int, by: list[str], order: str = "offset") -> DataFrame:
    """The first record always; then while the running cost stays within the budget."""
    along = Window.partitionBy(*by).orderBy(order)
    out = records.withColumn("_cum", F.sum(record_cost(F.col("payload"))).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(along))
    return out.where((F.col("_nth") == 1) | (F.col("_cum") <= max_bytes))


def fetch_one(log: DataFrame, partition: int, start: int, max_bytes: int = DEFAULT_FETCH_BYTES) -> DataFrame:
    """A fetch of one entry. No response holds MOST_RECORDS, so the scan is bounded from above as well."""
    near = seek(log, partition, start).where(F.col("offset") < start + MOST_RECORDS)
    return within_budget(near, max_bytes, ["partition"]).drop("_cum", "_nth")


def entries_frame(spark: SparkSession, entries: list[tuple[int, int]]) -> DataFrame:
    rows = ", ".join(f"({i}, {p}, {o}L)" for i, (p, o) in enumerate(entries))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, partition, start)")


def _taken(max_bytes: int) -> Column:
    """How many records each entry serves, by folding over the entries in request order: the response's first
    record may exceed the budget; a record that doesn't fit ends its own entry only."""
    kind = "struct<budget:bigint,served:boolean,taken:array<int>>"
    zero = F.struct(F.lit(max_bytes).cast("bigint").alias("budget"), F.lit(False).alias("served"), F.array().cast("array<int>").alias("taken")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        cums = e["cums"]
        fit = F.size(F.filter(cums, lambda c: c <= s["budget"]))
        oversize = (~s["served"]) & (F.size(cums) > 0) & (F.coalesce(F.get(cums, F.lit(0)), F.lit(0)) > s["budget"])
        k = F.when(s["budget"] <= 0, F.lit(0)).when(oversize, F.lit(1)).otherwise(fit)
        spent = F.when(k > 0, F.coalesce(F.get(cums, k - 1), F.lit(0))).otherwise(F.lit(0))
        return F.struct((s["budget"] - spent).cast("bigint").alias("budget"), (s["served"] | (k > 0)).alias("served"), F.concat(s["taken"], F.array(k.cast("int"))).alias("taken")).cast(kind)

    return F.aggregate("entries", zero, step, lambda s: s["taken"])


def fetch_many(log: DataFrame, entries: list[tuple[int, int]], max_bytes: int = DEFAULT_FETCH_BYTES) -> DataFrame:
    """A fetch of up to 16 entries under one budget: ord, partition, offset, payload.

    Each entry is first cut on its own, which leaves at most MOST_RECORDS rows of it; the fold then sees one
    array of running costs for each entry.
    """
    spark = log.sparkSession
    wanted = entries_frame(spark, entries)
    parts = sorted({p for p, _ in entries})
    near = log.where(F.col("partition").isin(*parts))  # literals prune the scan; an inline table wouldn't
    rows = near.join(F.broadcast(wanted), "partition").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + MOST_RECORDS))
    rows = within_budget(rows, max_bytes, ["ord"])
    cums = rows.groupBy("ord").agg(F.array_sort(F.collect_list("_cum")).alias("cums"))
    folded = wanted.join(cums, "ord", "left").select("ord", F.coalesce("cums", F.array().cast("array<bigint>")).alias("cums"))
    taken = folded.agg(F.array_sort(F.collect_list(F.struct("ord", "cums"))).alias("entries")).select(_taken(max_bytes).alias("taken"))
    each = taken.select(F.posexplode("taken").alias("ord", "take"))
    return rows.join(F.broadcast(each), "ord").where(F.col("_nth") <= F.col("take")).select("ord", "partition", "offset", "payload")


def grouped_response(served: DataFrame, entries: list[tuple[int, int]]) -> DataFrame:
    """One row for each entry in request order, with an empty array where nothing was served."""
    groups = served.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("offset", "payload"))).alias("records"))
    empty = F.array().cast("array<struct<offset:bigint,payload:string>>")
    return entries_frame(served.sparkSession, entries).join(groups, "ord", "left").select("ord", "partition", F.coalesce("records", empty).alias("records"))


def response_counts(served: DataFrame, entries: list[tuple[int, int]]) -> DataFrame:
    """Records served for each entry, empty ones included."""
    counts = served.groupBy("ord").agg(F.count("*").alias("n"))
    return entries_frame(served.sparkSession, entries).join(counts, "ord", "left").select(F.col("ord").cast("bigint").alias("ord"), F.col("partition").cast("bigint").alias("partition"), F.coalesce("n", F.lit(0)).cast("bigint").alias("records"))


def last_ring(log: DataFrame, arrival: str, n: int = RING) -> DataFrame:
    """The n latest records, oldest first."""
    return log.orderBy(F.desc(arrival)).limit(n).orderBy(arrival)


def first_per_partition(log: DataFrame) -> DataFrame:
    """The first record of each partition, as one aggregation without a sort."""
    return log.groupBy(F.col("partition").cast("bigint").alias("partition")).agg(F.min("offset").alias("offset"), F.min_by("payload", "offset").alias("payload"))
