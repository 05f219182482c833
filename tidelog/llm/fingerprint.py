"""Operator 5: document fingerprints by a quartile bucket digest.

Hashed byte triplets are counted in BUCKETS buckets; each bucket's count is coded by the quartile of all
counts it lies in (two bits), and the length by its logarithm. Two digests differ by the sum of their
buckets' steps, opposite quartiles counting double, and a little for the lengths; likeness is one minus
that difference over LIMIT, at least 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textops as X
from tidelog.llm.scratch import materialise, modest_batches, partitions

BUCKETS = 256
#: The mean difference of two unrelated digests: 1.625 for each bucket.
LIMIT = 1.625 * BUCKETS
_TABLES = (X.fmix(np.arange(1, 769, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.uint16).reshape(3, 256)
_STEP = np.array([0, 1, 2, 6])
_SLICE = 4 << 20


def digest(data: bytes) -> str:
    """Hex: a byte of length code, then two bits for each bucket. Fewer than three bytes have no triplets."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(raw) - 2, 0), _SLICE):
        b = raw[at : at + _SLICE + 2]
        counts += np.bincount(_TABLES[0][b[:-2]] ^ _TABLES[1][b[1:-1]] ^ _TABLES[2][b[2:]], minlength=BUCKETS)
    order = np.sort(counts)
    q = order[BUCKETS // 4 - 1 :: BUCKETS // 4][:3]
    codes = np.searchsorted(q, counts, side="left").astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(math.log1p(len(raw)) / math.log(1.1)))
    return f"{length:02x}{packed.tobytes().hex()}"


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return int(fingerprint[:2], 16), np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 for ones as different as unrelated texts'."""
    (m, x), (n, y) = _codes(a), _codes(b)
    difference = int(_STEP[np.abs(x - y)].sum()) + max(0, abs(m - n) - 2)
    return max(0.0, 1.0 - difference / LIMIT)


def _row(text: str, own: str, following: str, following_digest: str) -> tuple[int, str, str, str, float, float]:
    n = len(text)
    part = n // 3
    edited = (text[: n - part] + following[:part]).encode()
    edited_digest = digest(edited)
    return n, hashlib.sha256(edited).hexdigest(), own, edited_digest, likeness(own, edited_digest), likeness(own, following_digest)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
DONE, TAIL, HEAD = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose next document lies in the same partition are done; the first and last texts go on."""
    part = TaskContext.get().partitionId()
    before = None

    def batch(rows: list[tuple], kind: int, texts: list[str | None]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"])

    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py() or ""
            own = digest(text.encode())
            if before is None:
                yield batch([(i, None, None, own, None, None, None)], HEAD, [text])
            else:
                rows.append((before[0], *_row(before[1], before[2], text, own)))
            before = (i, text, own)
        if rows:
            yield batch(rows, DONE, [None] * len(rows))
        X.release()
    if before is not None:
        yield batch([(before[0], None, None, before[2], None, None, None)], TAIL, [before[1]])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *_row(text, own, following, digest(following.encode()))) for i, text, own, following in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=COLUMNS.replace(",", "").split()[::2])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The next document is the one below by id; behind the smallest comes the largest. The edited text has the
    last third of the code points replaced by as many first ones of the next document's text, or all it has.
    Null texts are empty. Null ids come last; rows with equal ids follow each other by text. A single
    document is its own next one; an empty table gives no rows. Other columns are not read.

    Texts move once, dealt out by ranges of ids and, as an id may have many rows, of the texts' beginnings; of
    each range only the first and last text move again, to meet their neighbours'.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    modest_batches(docs.sparkSession)
    order, beginning = F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 8)
    total = text.agg(F.sum(F.octet_length("text"))).first()[0]
    dealt = text.repartitionByRange(partitions(spark, total or 0), order, beginning).sortWithinPartitions(order, "text")
    made = materialise(dealt.mapInArrow(_neighbours, COLUMNS + ", kind int, part int, text string"), "fingerprints")
    heads = made.where(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next"))
    along = Window.orderBy("part")  # numbers only, one for each partition
    after = heads.select(F.col("next_part").alias("part")).select("part", F.coalesce(F.lead("part").over(along), F.first("part").over(along)).alias("next_part"))
    tails = made.where(F.col("kind") == TAIL).select("doc_id", "text", "fingerprint", "part").join(after, "part").join(heads.hint("merge"), "next_part")
    ends = tails.select("doc_id", "text", "fingerprint", "next").mapInArrow(_ends, COLUMNS)
    return made.where(F.col("kind") == DONE).drop("kind", "part", "text").union(ends)


_LISTS = _TABLES.tolist()
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS k, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, length(t) AS n, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS following, coalesce(lead(k) OVER (ORDER BY k), 1) AS next FROM d),
x AS (SELECT k, 0 AS kind, t FROM e UNION ALL SELECT k, 1, left(t, n - n // 3) || left(following, n // 3) FROM e),
b AS (SELECT k, kind, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: CAST('0x' || p AS INTEGER)) AS b FROM x),
g AS (SELECT k, kind, unnest(list_transform(range(1, len(b) - 1), lambda i: xor(xor({_LISTS[0]}[b[i] + 1], {_LISTS[1]}[b[i + 1] + 1]), {_LISTS[2]}[b[i + 2] + 1]))) AS bucket FROM b),
c AS (SELECT k, kind, bucket, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT x.k, x.kind, list(coalesce(c.n, 0) ORDER BY r.bucket) AS counts FROM x CROSS JOIN (SELECT unnest(range(256)) AS bucket) r LEFT JOIN c ON c.k = x.k AND c.kind = x.kind AND c.bucket = r.bucket GROUP BY 1, 2),
q AS (SELECT *, list_sort(counts) AS s FROM f),
codes AS (SELECT k, kind, list_transform(counts, lambda v: CAST(v > s[64] AS INTEGER) + CAST(v > s[128] AS INTEGER) + CAST(v > s[192] AS INTEGER)) AS code FROM q),
digests AS (SELECT k, kind, t, code, least(255, CAST(round(ln(1 + strlen(t)) / ln(1.1::DOUBLE)) AS INTEGER)) AS size FROM codes JOIN x USING (k, kind)),
named AS (SELECT *, printf('%02x', size) || array_to_string(list_transform(range(0, 64), lambda j: printf('%02x', code[4 * j + 1] + 4 * code[4 * j + 2] + 16 * code[4 * j + 3] + 64 * code[4 * j + 4])), '') AS fingerprint FROM digests),
pairs AS (SELECT e.doc_id, e.n, sha256(y.t) AS edited_sha256, o.fingerprint, y.fingerprint AS edited_fingerprint, o.code AS a, y.code AS b, z.code AS c, abs(o.size - y.size) AS to_edited, abs(o.size - z.size) AS to_next
  FROM e JOIN named o ON o.k = e.k AND o.kind = 0 JOIN named y ON y.k = e.k AND y.kind = 1 JOIN named z ON z.k = e.next AND z.kind = 0)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][abs(a[i] - b[i]) + 1])) + greatest(0, to_edited - 2) AS DOUBLE) / {LIMIT}::DOUBLE) AS near_edited,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][abs(a[i] - c[i]) + 1])) + greatest(0, to_next - 2) AS DOUBLE) / {LIMIT}::DOUBLE) AS near_next
FROM pairs
"""
