"""Operator 9: a compression classifier of text quality.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed in blocks under
either; what the good one saves against the bad one, by byte, is the evidence. A logistic curve, fitted on
labelled documents that neither dictionary has seen, turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.language_id import held_out
from tidelog.llm.scratch import modest_batches

#: Labelled documents to learn from for each class, about; more are sampled by a hash of the id.
PER_CLASS = 1200
DICTIONARY_BYTES, BLOCK, LEVEL = 112_640, 512, 3
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]  # of the evidence, and a constant


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class Evidence:
    """Bytes that the good dictionary saves against the bad one for each byte of the whole text."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (good, bad)
        ]
        for s in self.sides:
            s.compress(b"warm")

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode()
        if not data:
            return 0.0
        good, bad = (sum(len(side.compress(b)) for b in _blocks(data)) for side in self.sides)
        return (bad - good) / len(data)


def _dictionary(texts: list[str]) -> bytes:
    """Content of a dictionary trained on the blocks; where they are too few to train on, the blocks."""
    blocks = [b for t in texts for b in _blocks(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method, a little regularised, classes as frequent as they are."""
    design = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    penalty = np.diag([1e-6, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Learns from labelled rows outside the held-out quarter, about per_class of either class, chosen by a
    hash of the id (of several labels of one id the larger one counts; labels without a document count nothing); half of them build the dictionaries, half the curve; a class's only document does both. None if a class
    has no document with a text."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1)")
    known = known.where(F.coalesce(~held_out(F.col("_id")), F.lit(False))).groupBy("_id").agg(F.max("_y").alias("_y"))
    sizes = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(((F.col("_y") == 1) & (share < per_class / sizes[1])) | ((F.col("_y") == 0) & (share < per_class / sizes[0])))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = text.join(F.broadcast(chosen), "_id").select("_id", "_y", "text").orderBy(F.xxhash64("_id", F.lit(17)), "_id").toArrow().to_pylist()  # about 2 * per_class rows
    half = [[r for r in rows if r["_y"] == y] for y in (0, 1)]
    if not all(half):
        return None
    learn = [[r["text"] for r in side[::2]] for side in half]
    bad, good = _dictionary(learn[0]), _dictionary(learn[1])
    evidence = Evidence(good, bad)
    x = [np.array([evidence(r["text"]) for r in side[1::2] or side]) for side in half]
    weight = sizes[1] / len(half[1]) / (sizes[0] / len(half[0]))  # the sample has the classes at other shares
    w, c = _logistic(np.concatenate(x), np.concatenate([np.zeros(len(x[0])), np.ones(len(x[1]))]))
    return Model(good, bad, (w, c + float(np.log(weight))))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, from whole texts alone.

    Null and empty texts get the score of no evidence; without a model every score is 0.5. Every row is
    scored on its own, repeated ones alike; a null id isn't held out; an empty table gives no rows. Other columns
    are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        evidence = Evidence(m.good, m.bad) if m else None
        for b in batches:
            x = np.array([evidence(t.as_py()) if evidence else 0.0 for t in b.column(2)])
            w, c = m.weights if m else (0.0, 0.0)
            s = 1 / (1 + np.exp(-np.clip(w * x + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
