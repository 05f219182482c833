"""Operator 6: language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language has several centroids from
spherical k-means over a bounded sample of labelled documents; the nearest centroid by cosine names the
language, and a text is rejected whose cosine is below a part (NEAR) of what is typical of that language's texts
with as many different n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textops as X
from tidelog.llm.scratch import modest_batches

DIMS = 4096
#: Documents to learn from for each language, about; a larger corpus is sampled by a hash of the id.
PER_LANGUAGE = 800
#: And about as many for all languages together, but FEW for each however many languages there are.
MOST_DOCUMENTS, FEW = 4000, 4
CENTROIDS = 3
SHARPNESS = 25.0
#: A text is rejected below this part of its language's typical cosine; below a part that falls with the
#: size where it has fewer than 2**FULL different n-grams, as cosines of short texts scatter.
NEAR, FULL = 0.45, 8
#: Typical cosines are learned by log2 of different n-grams, from whole texts and beginnings of these lengths.
SIZES = int(np.log2(DIMS)) + 1
BEGINNINGS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # by language and log2 of different n-grams: the cosine below which a text is rejected


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, count of each hashed 1-, 2- and 3-gram of bytes) by chunk; whole texts, lower-cased, with
    a blank for each run of other characters than letters, so that markup and junk say nothing."""
    offs, data = X.string_view(pc.replace_substring_regex(pc.utf8_lower(column), r"\PL+", " "))
    for lo, hi in X.chunks(offs, 1 << 20, 256):
        part = data[offs[lo] : offs[hi]].astype(np.uint32)
        n = hi - lo
        out = np.zeros(n * DIMS)
        row = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(offs[lo : hi + 1]))
        for k in (1, 2, 3):
            if len(part) < k:
                break
            gram = part[: len(part) - k + 1].copy()
            for j in range(1, k):
                gram = gram * np.uint32(257) + part[j : len(part) - k + 1 + j]
            gram = ((gram * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)) % np.uint32(DIMS)
            a, e = row[: len(gram)], row[k - 1 :]
            inside = a == e
            out += np.bincount(a[inside] + gram[inside], minlength=n * DIMS)
        yield lo, out.reshape(n, DIMS)
    X.release()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(c.astype(np.float32)) * idf.astype(np.float32))


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the vector farthest from all."""
    centres = _unit(v.mean(0, keepdims=True))
    while len(centres) < min(k, len(v)):
        centres = np.vstack([centres, v[(v @ centres.T).max(1).argmin()][None]])
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(1)
        centres = _unit(np.stack([v[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def _size(c: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((c > 0).sum(1), 1))


def _least(sample: pa.ChunkedArray, label: np.ndarray, owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """NEAR of the median cosine to their own language of learned texts and their beginnings, by language and
    size; sizes that no text has are interpolated."""
    size, cosine, language = [], [], []
    for length in (*BEGINNINGS, None):
        for lo, c in counts(sample if length is None else pc.utf8_slice_codeunits(sample, 0, length)):
            of = label[lo : lo + len(c)]
            each = np.where(owner == of[:, None], vectors(c, idf) @ centroids.T, -1).max(1)
            some = each > 0
            size.append(_size(c)[some])
            cosine.append(each[some])
            language.append(of[some])
    sizes, cosines, languages = (np.concatenate(x) for x in (size, cosine, language))
    out = np.zeros((owner.max() + 1, SIZES))
    for i in range(len(out)):
        own = languages == i
        at = np.rint(sizes[own]).astype(int)
        known = np.unique(at)
        if len(known):
            out[i] = np.interp(np.arange(SIZES), known, [NEAR * min(1, k / FULL) * np.median(cosines[own][at == k]) for k in known])
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from text and lang of rows outside the held-out quarter, about per_language rows for each
    language (chosen by a hash of the id), one at least. Every language is learned; the model takes 48 KB
    for each at most. None without such rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30))
    known = rows.groupBy("lang").agg(F.count("*").alias("_n"), F.min("_share").alias("_first"))
    sizes = known.collect()  # a row for each language
    if not sizes:
        return None
    per_language = max(FEW, min(per_language, MOST_DOCUMENTS / len(sizes)))
    chosen = (F.col("_share") < per_language / F.col("_n")) | (F.col("_share") == F.col("_first"))
    sample = rows.join(F.broadcast(docs.sparkSession.createDataFrame(sizes, known.schema)), "lang").where(chosen).select("lang", "text").toArrow()
    labels = np.array(sample["lang"].to_pylist())
    c = np.concatenate([x for _, x in counts(sample["text"])]).astype(np.float32) if len(labels) else np.zeros((0, DIMS), np.float32)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1
    v = vectors(c, idf)
    owner, centres = [], []
    languages = sorted(set(labels.tolist()))
    for i, name in enumerate(languages):
        own = _cluster(v[labels == name], CENTROIDS)
        centres.append(own)
        owner += [i] * len(own)
    if not centres:
        return None
    centroids = np.concatenate(centres).astype(np.float32)
    least = _least(sample["text"], np.searchsorted(languages, labels), np.array(owner), centroids, idf)
    return Model(languages, np.array(owner), centroids, idf.astype(np.float32), least)


def predict(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and cosine of the nearest centroid of each text, and whether the text is rejected."""
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names = np.full(len(column), UNKNOWN, object)
    score, nearest, rejected = np.zeros(len(column)), np.zeros(len(column)), np.ones(len(column), bool)
    if model is not None:
        for lo, c in counts(column):
            cosine = vectors(c, model.idf) @ model.centroids.T
            each = np.stack([cosine[:, model.owner == i].max(1) for i in range(len(model.languages))], 1).astype(np.float64)
            odds = np.exp(SHARPNESS * (each - each.max(1, keepdims=True)))
            at = slice(lo, lo + len(c))
            names[at] = np.array(model.languages, object)[each.argmax(1)]
            score[at], nearest[at] = 1 / odds.sum(1), each.max(1)
            size = _size(c)
            down = np.minimum(size.astype(int), SIZES - 2)
            least = model.least[each.argmax(1)]
            rows, part = np.arange(len(c)), size - down
            rejected[at] = nearest[at] < least[rows, down] * (1 - part) + least[rows, down + 1] * part
    names[~letters], score[~letters], nearest[~letters], rejected[~letters] = UNKNOWN, 0.0, 0.0, True
    return names.tolist(), score, nearest, rejected


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine, rejected) for each row of docs, from whole texts alone.

    A null text, or one without a letter, is `und`, score 0, and rejected; so is everything without a model.
    lang_pred is else always a learned language: rejected says that the text's cosine is below NEAR of what is
    typical of that language for as many different n-grams. A null id isn't held out; of languages that are as
    near the first by name is taken; repeated rows get equal results, an empty table none. Other columns are not
    read.
    """
    modest_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in batches:
            names, score, cosine, out = predict(m, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(cosine), pa.array(out)], names=["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs, with the same columns, without the rows whose text is rejected."""
    modest_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in batches:
            yield b.filter(pa.array(~predict(m, b.column(place).cast(pa.string()))[3]))

    return docs.mapInArrow(run, docs.schema)
