"""Operator 4: sharding by sampled splitters.

Rows are ordered by a 63-bit key: the upper part hashes the text, the lower half the id, so that equal texts
lie together and even a text that a third of all rows share spreads over many keys. Rows drawn with a
chance in proportion to their size give the splitters of many fine ranges; ranges that turn out overfull
are subdivided by splitters of their own until none is. Exact sums over the ranges then cut the order into
shards of equal bytes, and a running sum inside each range places every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidelog.llm.scratch import materialise, modest_batches, partitions

SHARDS = 16
#: Sampled keys for each range (their number bounds what the driver holds), and when a range is overfull.
SAMPLES_EACH, OVERFULL, MOST_ROUNDS = 32, 4.0, 8
#: Bytes of text for each file that is written.
FILE_BYTES = 128 << 20


def _ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds range: the number of splitters at or below the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(splitters, key, side="right").astype(np.int32))], names=[*b.schema.names, "range"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("range", IntegerType())]))


def _sample(rows: DataFrame, total: int, wanted: int, seed: int) -> np.ndarray:
    """Sorted keys of about `wanted` rows, each drawn with a chance in proportion to its size."""
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return np.sort(rows.where(chance < F.col("size") * (wanted / max(total, 1))).select("key").toArrow()["key"].to_numpy())


def splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Keys that cut rows (key, doc_id, size) into at least `ranges` ranges of about equal size."""
    keys = _sample(rows, total, ranges * SAMPLES_EACH, 1)
    cuts = np.unique(keys[SAMPLES_EACH::SAMPLES_EACH])
    for seed in range(2, MOST_ROUNDS):
        sizes = {r[0]: r for r in _ranges(rows, cuts).groupBy("range").agg(F.sum("size"), F.min("key"), F.max("key")).collect()}
        over = {r: v for r, v in sizes.items() if v[1] > OVERFULL * total / ranges and v[2] < v[3]}
        if not over:
            break
        again = _ranges(rows, cuts).where(F.col("range").isin(list(over)))
        more = _sample(again, sum(v[1] for v in over.values()), len(over) * SAMPLES_EACH, seed)
        cuts = np.unique(np.concatenate([cuts, more[SAMPLES_EACH // 8 :: SAMPLES_EACH // 8], [v[3] for v in over.values()]]))
    return cuts


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, _row) of each row, _row being its place in the whole order; with carry
    also the row itself as a struct (_whole)."""
    spark = docs.sparkSession
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("_whole")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    upper = F.shiftleft(F.shiftright(number(text.cast("binary")), 1), 32)
    lower = number(F.concat(F.lit("id "), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).cast("binary"))
    made = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), upper.bitwiseOR(lower).alias("key"), *whole), "sizes")
    total = made.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(made.select("key", "doc_id", "size"), total, max(4 * shards, 4 * partitions(spark)))
    ranged = _ranges(made, cuts)
    sums = _ranges(made.select("key", "size"), cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()  # a row for each range
    before, row = 0, 0
    places = []
    for r in sums:
        places.append((r[0], before, row))
        before, row = before + r[1], row + r[2]
    along = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    known = spark.createDataFrame(places or [(0, 0, 0)], "range int, _bytes long, _rows long")
    at = ranged.withColumn("_in", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_nth", F.row_number().over(along) - 1).join(F.broadcast(known), "range")
    at = at.withColumn("shard", F.least(F.floor((F.col("_bytes") + F.col("_in")) * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")).withColumn("_row", F.col("_rows") + F.col("_nth"))
    return materialise(at.select("doc_id", "size", "text_crc32", "shard", "_row", *["_whole"] * carry), "placed")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs, under the law `bytes`.

    Size is the text's UTF-8 bytes plus 1 (a null text's: 1; its checksum is that of no bytes). A row belongs
    to the shard in which its first byte lies when all rows, in key order, are cut into equal parts: shards
    differ by less than the two rows at their ends. Equal texts are neighbours, so a group is cut only where
    a shard ends. slot counts a shard's rows from 0. Equal rows take neighbouring places in any order; a
    null id is ordered as one more id; an empty table gives no rows. Other columns are not read.
    """
    placed = _placed(docs, shards, id_col, text_col)
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
#: Not among the queries' SQL, as grown_shard is null throughout; a test holds the query against it.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, strlen(t) + 1 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b,
  CAST('0x' || md5(t)[1:8] AS BIGINT) // 2 * 4294967296 + CAST('0x' || md5('id ' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS key FROM d),
c AS (SELECT doc_id, size, key, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(CAST({_CRC}[(xor(c, y) & 255) + 1] AS BIGINT), c >> 8)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM x),
r AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(floor(CAST(before * {SHARDS} AS DOUBLE) / CAST(total AS DOUBLE)), {SHARDS - 1}) AS INTEGER) AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of docs as Parquet under path/shard=N, in as many files as their bytes ask for; a shard's
    rows are in the order of their slots within each file and from file to file by name. Every row is written
    once, with any id, null and repeated ones too; a column of docs that is named shard gives way to the shard.
    An empty table writes no rows.
    """
    modest_batches(docs.sparkSession)
    placed = _placed(docs, shards, id_col, text_col, carry=True)
    files = partitions(docs.sparkSession, placed.agg(F.sum("size")).first()[0] or 0, FILE_BYTES)
    rows = placed.repartitionByRange(files, "_row").sortWithinPartitions("shard", "_row")
    rows.select(*[F.col("_whole")[c].alias(c) for c in docs.columns if c.lower() != "shard"], "shard").write.partitionBy("shard").parquet(path)
