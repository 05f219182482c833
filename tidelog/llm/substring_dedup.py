"""Operator 7: removal of passages that an earlier document holds, by fixed-block anchors.

1. Index: each document's non-overlapping blocks of BLOCK words (at word 0, BLOCK, 2 BLOCK, ...) go by hash
   to slices. A slice keeps two bit sets: blocks that occur, and blocks that occur more than once. Their size
   follows the number of blocks up to a fixed bound; beyond it more false hits pass, never fewer true ones.
2. Probe: every rolling window of BLOCK words of every document looks itself up; at an anchor's own place the
   second bit set counts. Any WINDOW = 2 BLOCK - 1 words that occur in two documents hold a whole block of
   either, so each side hits the other's anchor.
3. Extend: hits grow to all WINDOW-word windows around them. These are matched for the smallest document that
   has them, by keys of 96 bits over the words' hashes; runs of confirmed windows are the maximal repeats.
   Of windows that occur many times in one chunk of documents only the smallest document's are sent on: the
   others are already known to have an earlier one. A task remembers such windows from chunk to chunk. So a
   passage in a third of all documents loads no task.
4. The confirmed words go back to their documents, which are the only rows that carry texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textops as X
from tidelog.llm.scratch import MOST_PARTITIONS, materialise, modest_batches, partitions

WINDOW, BLOCK = 13, 7
#: Index size: bits for each block, most bits in all (256 MB), bits of one slice, and bits set for a block.
BITS_EACH, MOST_BITS, SLICE_BITS, PROBES = 12, 1 << 31, 1 << 20, 4
#: Windows that a task remembers as repeated; without them more is sent, and the result is the same.
REMEMBERED = 200_000
#: Bytes of text that are probed at once.
CHUNK = 2 << 20
NULL_ID = np.iinfo(np.int64).max


def _slots(h: np.ndarray, slices: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slice of each hash and its bits there."""
    where = (h >> np.uint64(40)) % np.uint64(slices)
    a, b = X.fmix(h ^ np.uint64(0xA24BAED4963EE407)), X.fmix(h ^ np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return where.astype(np.int64), [((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(bits) for i in range(PROBES)]


def _words(column: pa.Array, lo: int, hi: int, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part = data[offs[lo] : offs[hi]]
    starts, ends, word_offs = X.ws_words(part, offs[lo : hi + 1] - offs[lo])
    return X.segment_hash(part, starts, ends), word_offs


def _anchors(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offs, data = X.string_view(b.column(0))
            for lo, hi in X.chunks(offs, 4 << 20):
                words, word_offs = _words(b.column(0), lo, hi, offs, data)
                at, counts = X.window_starts(word_offs, BLOCK)
                long = np.repeat(np.diff(word_offs) >= WINDOW, counts)
                inside = at - np.repeat(word_offs[:-1], counts)
                h = X.window_hash(words, at[long & (inside % BLOCK == 0)], BLOCK)
                where = ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                names, lengths = np.unique(where, return_counts=True)
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array(names), X.binary(h[order], lengths)], names=["slice", "blocks"])
            X.release()

    return run


def _index(slices: int, bits: int):
    """The two bit sets of each slice in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for s, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(blocks)
        for s, blocks in held.items():
            h, n = np.unique(np.frombuffer(b"".join(blocks), np.uint64), return_counts=True)
            rows = []
            for chosen, size in ((h, bits), (h[n > 1], bits // 4)):
                on = np.zeros(size, np.uint8)
                for at in _slots(chosen, slices, size)[1]:
                    on[at.astype(np.int64)] = 1
                rows.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([rows[0]], pa.binary()), pa.array([rows[1]], pa.binary())], names=["slice", "once", "more"])

    return run


def _has(index: np.ndarray, h: np.ndarray, slices: int, bits: int) -> np.ndarray:
    where, slots = _slots(h, slices, bits)
    out = np.ones(len(h), bool)
    live = np.arange(len(h))
    for at in slots:
        at = at[live].astype(np.int64)
        ok = (index[where[live] * (bits // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
        out[live[~ok]] = False
        live = live[ok]
    return out


FIELDS = ("ids", "keys", "counts", "pos", "hashes", "checks")
ROW = "part int, kind int, " + ", ".join(f"{f} binary" for f in FIELDS)


def _pack(part: np.ndarray, kind: int, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray, hashes: np.ndarray | None = None, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part: its documents (runs in order), the windows' places, hashes and checks."""
    order = np.lexsort((pos, doc, part))
    part, doc, pos = part[order], doc[order], pos[order]
    new_doc = np.ones(len(part), bool)
    new_doc[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new_doc)
    counts = np.diff(np.append(heads, len(part))).astype(np.uint32)
    names, docs_each = np.unique(part[heads], return_counts=True)
    rows_each = np.unique(part, return_counts=True)[1]
    hashed = [X.binary(h[order], rows_each) if h is not None else pa.array([b""] * len(names), pa.binary()) for h in (hashes, checks)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), kind, np.int32)), X.binary(ids[doc[heads]], docs_each), X.binary(keys[doc[heads]], docs_each), X.binary(counts, docs_each), X.binary(pos.astype(np.uint32), rows_each), *hashed],
        names=["part", "kind", *FIELDS],
    )


def _groups(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, and where each group begins in it."""
    order = np.lexsort((check, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, np.flatnonzero(new)


def _least(h: np.ndarray, check: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window the smallest owner of an equal one."""
    order, heads = _groups(h, check)
    out = np.empty(len(h), np.int64)
    if len(h):
        out[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(h))))
    return out


class _Repeated:
    """Windows that a task has met repeatedly, with the smallest document of each."""

    def __init__(self):
        self.h, self.check, self.id = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def least(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The document remembered for each window; one after all others where there is none."""
        out = np.full(len(h), NULL_ID)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            found = (self.h[at] == h) & (self.check[at] == check)
            out[found] = self.id[at[found]]
        return out

    def add(self, h: np.ndarray, check: np.ndarray, least: np.ndarray) -> None:
        if not len(h):
            return
        h, check, ids = np.append(h, self.h), np.append(check, self.check), np.append(least, self.id)
        order = np.lexsort((ids, h))
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        chosen = order[first]
        if len(chosen) > REMEMBERED:
            chosen = np.sort(chosen)[:REMEMBERED]  # the latest ones come first
            chosen = chosen[np.argsort(h[chosen], kind="stable")]
        self.h, self.check, self.id = h[chosen], check[chosen], ids[chosen]


def _probe(index, slices: int, bits: int, parts: int):
    """Windows around hits: those to be matched by part (kind 0), and those already confirmed (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = (np.frombuffer(x, np.uint8) for x in index.value)
        known = _Repeated()
        for b in batches:
            offs, data = X.string_view(b.column(2))
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            keys = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in X.chunks(offs, CHUNK):
                words, word_offs = _words(b.column(2), lo, hi, offs, data)
                at, counts = X.window_starts(word_offs, BLOCK)
                inside = at - np.repeat(word_offs[:-1], counts)
                h = X.window_hash(words, at, BLOCK)
                own = inside % BLOCK == 0
                hit = np.zeros(len(words) + 1, np.int32)
                hit[at[~own]] = _has(once, h[~own], slices, bits)
                hit[at[own]] = _has(more, h[own], slices, bits // 4)
                sums = np.concatenate([[0], np.cumsum(hit)])
                at, counts = X.window_starts(word_offs, WINDOW)
                near = sums[at + WINDOW - BLOCK + 1] > sums[at]
                doc = np.repeat(np.arange(lo, hi), counts)[near]
                pos = (at - np.repeat(word_offs[:-1], counts))[near]
                if not len(pos):
                    continue
                h, check = X.window_hash(words, at[near], WINDOW), X.window_check(words, at[near], WINDOW)
                least = np.minimum(_least(h, check, ids[doc]), known.least(h, check))
                later = ids[doc] > least
                known.add(h[later], check[later], least[later])
                ask = ~later
                part = (h % np.uint64(parts)).astype(np.int64)
                yield from _pack(part[ask], 0, doc[ask], pos[ask], ids, keys, h[ask], check[ask])
                if later.any():
                    yield from _pack(np.full(int(later.sum()), int(part[later][0])), 1, doc[later], pos[later], ids, keys)
            X.release()

    return run


def _unpack(rows: dict[str, list[bytes]]) -> tuple[np.ndarray, ...]:
    """ids and keys of documents, each window's document among them, place, hash and check."""
    joined = {k: b"".join(v) for k, v in rows.items()}
    counts = np.frombuffer(joined["counts"], np.uint32)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.frombuffer(joined["ids"], np.int64), np.frombuffer(joined["keys"], np.int64), doc, np.frombuffer(joined["pos"], np.uint32), np.frombuffer(joined["hashes"], np.uint64), np.frombuffer(joined["checks"], np.uint32)


def _confirm(buckets: int):
    """Windows of which a smaller document has one, by the bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, dict[str, list[bytes]]] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["kind"]:
                    ids, keys, doc, pos, *_ = _unpack({k: [row[k]] for k in FIELDS})
                    yield from _pack(_bucket(keys, buckets)[doc], 1, doc, pos, ids, keys)
                else:
                    held = asked.setdefault(row["part"], {k: [] for k in FIELDS})
                    for k, v in held.items():
                        v.append(row[k])
        for part in list(asked):
            ids, keys, doc, pos, h, check = _unpack(asked.pop(part))
            later = ids[doc] > _least(h, check, ids[doc])
            if later.any():
                yield from _pack(_bucket(keys, buckets)[doc][later], 1, doc[later], pos[later], ids, keys)

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)).astype(np.int64) % buckets


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _cut(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in right.to_pylist():
            counts = np.frombuffer(row["counts"], np.uint32)
            places = np.split(np.frombuffer(row["pos"], np.uint32), np.cumsum(counts)[:-1])
            for i, key, at in zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["keys"], np.int64).tolist(), places, strict=True):
                gone.setdefault((i, key), []).append(at)
        out: list[list] = [[], [], [], [], []]
        for i, key, text in zip(left["doc_id"].to_pylist(), left["_key"].to_pylist(), left["text"].to_pylist(), strict=True):
            words = text.encode().split() if text is not None else []
            n = len(words)
            if at := gone.get((NULL_ID if i is None else i, key)):
                at = np.concatenate(at).astype(np.int64)
                edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + WINDOW, minlength=n + 1)[: n + 1]
                words = list(compress(words, (np.cumsum(edge)[:n] == 0).tolist()))
            kept = b" ".join(words)
            for column, value in zip(out, (i, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, RESULT, strict=True)], schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of docs.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of 13 words over it
    also starts in a document with a smaller id; windows are judged on the input. Null and empty texts have
    no words; an empty table gives no rows; a text of any length is one row. Rows that share an id, repeated
    rows among them, never remove each other's words; a null id counts as the largest.
    Other columns are not read, whatever their names. with_text=False leaves kept_text null.
    """
    spark = docs.sparkSession
    modest_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark, total)
    slices = max(1, min(-(-total * BITS_EACH // (6 * BLOCK)), MOST_BITS) // SLICE_BITS)
    sets = text.select("text").mapInArrow(_anchors(slices), "slice long, blocks binary").repartition(min(n, slices), "slice").mapInArrow(_index(slices, SLICE_BITS), "slice long, once binary, more binary")
    once, more = np.zeros((slices, SLICE_BITS // 8), np.uint8), np.zeros((slices, SLICE_BITS // 32), np.uint8)
    for row in sets.toLocalIterator():
        once[row[0]], more[row[0]] = np.frombuffer(row[1], np.uint8), np.frombuffer(row[2], np.uint8)
    index = spark.sparkContext.broadcast((once.tobytes(), more.tobytes()))
    keyed = text.select("doc_id", F.xxhash64("text", F.coalesce("doc_id", F.lit(0))).alias("_key"), "text")
    buckets = max(n, -(-total // (8 << 20)))
    deal = min(buckets, MOST_PARTITIONS)
    asked = keyed.mapInArrow(_probe(index, slices, SLICE_BITS, 4 * n), ROW)
    found = materialise(asked.repartition(n, "part").mapInArrow(_confirm(buckets), ROW), "repeats")
    bucket = F.pmod(F.shiftrightunsigned("_key", 20), F.lit(buckets)).cast("int")
    left = keyed.withColumn("part", bucket).repartition(deal, "part").groupBy("part")
    right = found.select("part", "ids", "keys", "counts", "pos").repartition(deal, "part").groupBy("part")
    out = left.cogroup(right).applyInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM starts),
earliest AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM win JOIN earliest USING (g) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (g.pos IS NULL) AS kept FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
