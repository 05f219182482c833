"""Operator 3: best-fit packing of token sequences by minimum bin slack.

Texts are tokenised where they lie; what moves on is a row of a few numbers for each piece. The packing
itself only needs how many pieces there are of each length, which is at most CAPACITY numbers however
many documents there are. For one bin after another a bitset subset-sum finds the fullest combination of
the lengths at hand that holds the longest of them; it is removed as many times as the counts allow,
which uses up at least one length, so there are at most CAPACITY such patterns. Each slot of a pattern
takes a run of the pieces of its length, by rank, and a search by length and rank finds every piece its place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textops as X
from tidelog.llm.scratch import materialise, modest_batches, partitions

CAPACITY = 2048
END_ID = 0
#: Pre-tokens whose ids a Python worker keeps; the store starts anew beyond.
KEPT_WORDS = 250_000
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = 0, 1, 2, 3, 9
#: Endings that the vocabulary's pre-tokenizer splits off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary, equal to those of the tokenizers library.

    Pre-tokens are cut in bulk over code points; each distinct one is encoded once. They are found again by
    hash and then compared themselves: one that differs from the known one of its hash is encoded on its own.
    Classes of code points are asked of the library's own pre-tokenizer. A text that holds a special token's
    string goes through the library as a whole.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.at = array("I"), array("q", [0])
        self.points, self.points_at = array("I"), array("q", [0])

    def _classify(self, points: np.ndarray) -> np.ndarray:
        got = self.classes[points]
        if (got == _UNKNOWN).any():
            one = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
            for p in np.unique(points[got == _UNKNOWN]).tolist():
                c = chr(p)
                self.classes[p] = _LETTER if one("a" + c) else _NUMBER if one("1" + c) else _OTHER if one("!" + c) else _SPACE
            got = self.classes[points]
        return got

    def _starts(self, points: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of one class with at most one blank before; of several white
        spaces before a word all but the last; all of those that end a text."""
        n = len(points)
        kind = self._classify(points)
        cut = np.zeros(n + 1, bool)
        cut[doc_at] = True
        cut[n] = True
        first = cut[:n]
        space = kind == _SPACE
        prev = np.empty(n, np.uint8)
        prev[0] = _UNKNOWN
        prev[1:] = kind[:-1]
        prev[first] = _UNKNOWN
        after_blank = np.zeros(n, bool)
        after_blank[1:] = points[:-1] == 32
        after_blank &= ~first
        last = np.ones(n, bool)
        last[:-1] = ~space[1:]
        start = np.where(space, (prev != _SPACE) | (last & ~cut[1:]), (prev != kind) & ~after_blank)
        start |= first
        quote = np.flatnonzero((points == 39) & start)
        for e in ENDINGS:
            if not len(quote):
                break
            size = len(e)
            fits = quote + size < n
            for j, c in enumerate(e):
                fits &= (points[np.minimum(quote + 1 + j, n - 1)] == ord(c)) & ~first[np.minimum(quote + 1 + j, n - 1)]
            hit = quote[fits]
            start[hit + 1] = False
            after = hit[hit + 1 + size < n] + 1 + size
            start[after[~space[after]]] = True
            quote = quote[~fits]
        return np.flatnonzero(start)

    def _ids(self, points: np.ndarray) -> list[int]:
        return self.bpe._encode_single_piece(points.tobytes().decode("utf-32-le"))

    def _differs(self, slots: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pre-tokens that aren't the known ones of their slots."""
        at, size = np.array(self.points_at), ends - starts
        out = at[slots + 1] - at[slots] != size
        same = np.flatnonzero(~out)
        size = size[same]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum()))
        known = np.frombuffer(self.points, np.uint32)[inside + np.repeat(at[slots[same]] - first, size)]
        other = known != points[inside + np.repeat(starts[same] - first, size)]
        if other.any():
            out[same[np.logical_or.reduceat(other, first)]] = True
        return np.flatnonzero(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        doc_at = np.concatenate([[0], np.cumsum(lengths)])
        starts = self._starts(points, doc_at[:-1][lengths > 0])
        ends = np.append(starts[1:], len(points))
        folded = (points ^ (points >> np.uint32(16))).astype("<u2").view(np.uint8)
        names, where, which = np.unique(X.segment_hash(folded, 2 * starts, 2 * ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS or len(self.points) > 16 * KEPT_WORDS:
            self._reset()
        slots = list(map(self.known.get, names.tolist()))
        for i, s in enumerate(slots):
            if s is None:
                w = where[i]
                slots[i] = self.known[int(names[i])] = len(self.at) - 1
                own = points[starts[w] : ends[w]]
                self.flat.extend(self._ids(own))
                self.at.append(len(self.flat))
                self.points.frombytes(own.tobytes())
                self.points_at.append(len(self.points))
        slots = np.array(slots)[which]
        differs = self._differs(slots, points, starts, ends)
        at = np.array(self.at)
        flat = np.array(self.flat, np.uint32)
        if len(differs):
            own = [self._ids(points[starts[i] : ends[i]]) for i in differs.tolist()]
            at = np.append(at, len(flat) + np.cumsum([len(x) for x in own]))
            flat = np.append(flat, np.array([y for x in own for y in x], np.uint32))
            slots[differs] = len(self.at) - 1 + np.arange(len(own))
        lo, size = at[slots], at[slots + 1] - at[slots]
        ends_out = np.cumsum(size)
        gather = np.arange(int(ends_out[-1])) + np.repeat(lo - ends_out + size, size)
        ids = flat[gather]
        by_doc = np.concatenate([[0], ends_out])[np.searchsorted(starts, doc_at)]
        return ids, np.diff(by_doc)

    def runs(self, texts: list[str | None], chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text in order; a null text has no ids."""
        held: list[str] = []
        lo = size = 0
        for i, t in enumerate([*texts, None]):
            if i == len(texts) or size + len(t or "") > chunk or (t and any(s.decode() in t for s in self.special)):
                ids, counts = self.encode(held)
                ends = np.cumsum(counts)
                for j, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    yield lo + j, ids[e - c : e]
                held, lo, size = [], i, 0
                if i == len(texts):
                    return
                if t and any(s.decode() in t for s in self.special):
                    yield i, np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                    lo = i + 1
                    continue
            held.append(t or "")
            size += len(t or "")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: tuple[str, str]) -> Encoder:
    """One for each Python worker, which goes on from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(*vocabulary)
    return _encoders[vocabulary]


def _pieces(vocabulary: tuple[str, str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            texts, names = b.column(1).to_pylist(), b.column(0)
            for i, ids in enc.runs(texts):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                first = len(ids) % CAPACITY or CAPACITY
                cuts = [0, *range(first, len(ids), CAPACITY), len(ids)]
                for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, v in zip(out, (i, k, a, e - a, zlib.crc32(ids[a:e].tobytes()), ids[a:e].tolist() if with_ids else None), strict=True):
                        column.append(v)
            X.release()
            kinds = (None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds[1:], strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with how many of each) whose sum is the largest that fits in room, long ones preferred.

    Lengths join from the longest down until some sum fills the room; of the shorter ones among them as few
    as possible are taken, so that short pieces are left to fill later bins.
    """
    goal = (1 << (room + 1)) - 1
    reach = 1
    steps = []
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        left, size = most, 1
        while left:  # 1, 2, 4, ... copies at once
            take = min(size, left)
            reach |= (reach << (take * length)) & goal
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    t = reach.bit_length() - 1
    chosen = {}
    for length, most, before in reversed(steps):
        for copies in range(min(most, t // length) + 1):
            if before >> (t - copies * length) & 1:
                if copies:
                    chosen[length] = copies
                t -= copies * length
                break
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, how many, first sequence, offset), and the number of sequences."""
    left = {k: v for k, v in histogram.items() if v}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    while left:
        top = max(left)
        left[top] -= 1
        chosen = fullest(left, capacity - top)
        left[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(left[k] // v for k, v in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                out.append((length, rank[length], times, sequences, offset))
                rank[length] += times
                offset += length
            left[length] -= times * chosen[length]
            if not left[length]:
                del left[length]
        sequences += times
    return out, sequences


def _places(segments: list[tuple[int, int, int, int, int]]):
    """Finds each piece's segment by its length and rank. There are a few thousand segments at most."""
    known = np.array(sorted(segments), np.int64).reshape(-1, 5)
    first = known[:, 0] << 48 | known[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b["_rank"].to_numpy()
            at = known[np.searchsorted(first, b["length"].to_numpy() << 48 | rank, side="right") - 1]
            columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])], names=[*columns, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: tuple[str, str] | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): a row for each piece of each row of docs.

    A document is its text's ids and END_ID; only one of more than CAPACITY ids is cut, so that all pieces
    but the first are full. Null and empty texts are END_ID alone. Rows with equal or null ids are packed
    each on its own; which of several equal pieces gets which place is open. An empty table gives no rows.
    Other columns are not read. with_ids=False leaves ids null.
    """
    spark = docs.sparkSession
    modest_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialise(text.mapInArrow(_pieces(vocabulary, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>"), "pieces")
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # CAPACITY rows at most
    segments, _ = plan(histogram)
    n = partitions(spark, 64 * sum(histogram.values()))
    dealt = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    before = dealt.groupBy("length", "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece"))).join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1)
    return ranked.mapInArrow(_places(segments), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>, sequence_id long, offset long")
