"""Operator 2: near-duplicates by an inverted join over MinHash signature coordinates.

1. One pass over the texts gives each document its distinct shingles' count, a 128-bit digest of the
   set, and a signature of K coordinates. Documents with one digest are one node.
2. Each node is posted under its coordinate-value pairs. Two sets at the wanted similarity agree in at
   least MATCH of K coordinates (fewer has a chance of about 1e-6 at 0.8), and so share one of the
   L - MATCH + 1 rarest of the L pairs that a node shares with anybody: only this prefix is posted, and
   the rest is skipped to for the count, on the signatures themselves. A posting of more than BLOCK
   nodes is met block against block, so no task holds an unbounded one and none is dropped.
3. A posting gives only a spanning forest of its candidates, never all pairs; components of that graph
   hold every link. In a component links are confirmed on the full sets: nodes are expanded, smaller
   parts first, until all that is left lies in one part, where no further link could change anything.
   Components of more than BLOCK nodes are again met block against block.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textops as X
from tidelog.llm.components import connected_components
from tidelog.llm.scratch import materialise, modest_batches, partitions

K, MATCH, BLOCK = 32, 14, 1024
#: Bits of the set of documents whose texts are read again: 32 MB at most.
MOST_BITS = 1 << 28
_MASKS = X.fmix(np.arange(101, 101 + K, dtype=np.uint64))
_ODD = X.fmix(np.arange(301, 301 + K, dtype=np.uint64)) | np.uint64(1)


def word_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by chunk; A-Z is lower-cased."""
    offs, data = X.string_view(column)
    for lo, hi in X.chunks(offs):
        part = X.ascii_lower(data[offs[lo] : offs[hi]])
        starts, ends, word_offs = X.ws_words(part, offs[lo : hi + 1] - offs[lo])
        yield lo, X.shingle_sets(X.segment_hash(part, starts, ends), word_offs, shingle)
    X.release()


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = X.fmix((X.fmix(s ^ np.uint64(0x5851F42D4C957F2D))).sum(keepdims=True) + np.uint64(len(s)))
        b = np.bitwise_xor.reduce(X.fmix(s * np.uint64(0x2545F4914F6CDD1D)), keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K coordinate-value tokens of each non-empty set: hash of (coordinate, minimum)."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), K), np.uint64)
    for k in range(K):
        x = (flat ^ _MASKS[k]) * _ODD[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        out[:, k] = X.fmix(np.minimum.reduceat(x, at) + _MASKS[k])
    return out


SIGNED = "doc_id long, n long, h1 long, h2 long, sig binary"


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, sets in word_sets(b.column(1), shingle):
                n = np.array([len(s) for s in sets])
                digests = np.array([_digest(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
                full = np.flatnonzero(n)
                lengths = np.where(n > 0, K, 0)
                sig = _signatures([sets[i] for i in full]) if len(full) else np.zeros((0, K), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(sets)).cast(pa.int64()), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), X.binary(sig.reshape(-1), lengths)],
                    names=["doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _explode_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), K)
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], names=["token", "node"])


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index of each row's part in a boolean adjacency matrix."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            new = np.zeros(len(adjacent), bool)
            new[i] = True
            while new.any():
                root[new] = i
                new = adjacent[new].any(0) & (root < 0)
    return root


def _candidates(percent: int):
    """Spanning forest of the candidates of each posting (or pair of a posting's blocks)."""

    def one(t: pa.Table) -> pa.Table:
        nodes, n = t["node"].to_numpy(), t["n"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(len(nodes), K).astype(np.uint16)
        order = np.argsort(nodes)
        nodes, n, sig = nodes[order], n[order], sig[order]
        near = np.zeros((len(nodes), len(nodes)), bool)
        for lo in range(0, len(nodes), 128):
            hi = min(lo + 128, len(nodes))
            same = np.zeros((hi - lo, len(nodes)), np.uint8)
            for k in range(K):
                same += sig[lo:hi, k, None] == sig[None, :, k]
            short, long = np.minimum(n[lo:hi, None], n[None]), np.maximum(n[lo:hi, None], n[None])
            near[lo:hi] = (same >= MATCH) & (100 * short >= percent * long)
        root = _forest(near)
        on = root != np.arange(len(nodes))
        return pa.table({"u": pa.array(nodes[on]), "v": pa.array(nodes[root[on]])})

    return one


def _grouped(one, keys: tuple[str, ...], schema: pa.Schema):
    """mapInArrow over a partition sorted by keys: one(rows of a key) for each run. Only one run is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            marks = np.stack([t[k].to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
            for a, e in zip(cuts, cuts[1:], strict=False):
                key = tuple(marks[:, a])
                if held and key != last:
                    yield from one(pa.concat_tables(held)).cast(schema).combine_chunks().to_batches()
                    held = []
                held.append(t.slice(a, e - a))
                last = key
        if held:
            yield from one(pa.concat_tables(held)).cast(schema).combine_chunks().to_batches()

    return run


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _by_group(df: DataFrame, keys: tuple[str, ...], one, n: int) -> DataFrame:
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_grouped(one, keys, EDGE), "u long, v long")


def _in_blocks(df: DataFrame, size: str, node: str) -> DataFrame:
    """Adds i and j: all rows of a group of up to BLOCK get (0, 0); of a larger one each row gets its
    block's pairs with every block. Rows of one block meet in every pair that the block is in."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("_blocks")).cast("int")
    return (
        df.withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("i", F.least("_own", "_other"))
        .withColumn("j", F.greatest("_own", "_other"))
        .drop("_blocks", "_own", "_other")
    )


def _sets(shingle: int):
    """Sets of the wanted documents; a row whose text is not the one of the node's digest is another document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo, sets in word_sets(b.column(1), shingle):
                take = [i for i, s in enumerate(sets) if _digest(s) == (h1[lo + i], h2[lo + i])]
                if take:
                    rows = b.take(pa.array([lo + i for i in take]))
                    chosen = [sets[i] for i in take]
                    lengths = np.array([len(s) for s in chosen])
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(4), rows.column(5), X.binary(np.concatenate(chosen), lengths)], names=["node", "comp", "csize", "items"])

    return run


def linked_parts(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Parts of the graph of all links with 100 * intersection >= percent * union; the part's smallest index."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    _, item = np.unique(flat, return_inverse=True)
    by_item = np.argsort(item, kind="stable")
    owners = owner[by_item]
    at = np.concatenate([[0], np.cumsum(np.bincount(item))])
    first = np.concatenate([[0], np.cumsum(n)])
    part = np.arange(m)
    waiting = np.ones(m, bool)
    nxt = int(np.argsort(n, kind="stable")[m // 2])
    while True:
        waiting[nxt] = False
        ids = item[first[nxt] : first[nxt + 1]]
        lengths = at[ids + 1] - at[ids]
        ends = np.cumsum(lengths)
        hits = owners[np.arange(ends[-1]) + np.repeat(at[ids] - ends + lengths, lengths)]
        both = np.bincount(hits, minlength=m)
        near = 100 * both >= percent * (n[nxt] + n - both)
        joined = np.unique(part[near])
        part[np.isin(part, joined)] = joined.min()
        left = np.flatnonzero(waiting)
        if not len(left):
            return part
        names, sizes = np.unique(part[left], return_counts=True)
        if len(names) == 1:
            return part
        nxt = int(left[part[left] == names[sizes.argmin()]][0])


def _links(percent: int):
    def one(t: pa.Table) -> pa.Table:
        nodes, where = np.unique(t["node"].to_numpy(), return_index=True)
        items = t["items"]
        part = linked_parts([np.frombuffer(items[int(i)].as_py(), np.uint64) for i in where], percent)
        on = part != np.arange(len(nodes))
        return pa.table({"u": pa.array(nodes[on]), "v": pa.array(nodes[part[on]])})

    return one


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose node may be among the wanted ones, by one bit set of 16 bits a node: few others pass, so that
    few texts move. It never takes more than MOST_BITS; beyond that more rows pass, never fewer."""
    bits = 1 << 12
    while bits < min(16 * wanted.count(), MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("node", F.lit(23)), F.lit(bits))
    words = wanted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("word"))
    every = wanted.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    kept = materialise(every.agg(F.array_sort(F.collect_list(F.struct("id", "word"))).alias("a")).select(F.col("a.word").alias("words")), "bits").scalar()
    word = F.get(kept, F.shiftright(place, 6).cast("int"))
    return rows.withColumn("_at", place).where(F.expr("_at IS NOT NULL")).where(word.bitwiseAND(F.expr("shiftleft(1L, CAST(_at % 64 AS INT))")) != 0).drop("_at")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles, or its whole sequence if it is shorter. Documents are linked where 100 * intersection >=
    percent * union; component_id is the smallest id reachable. Null and empty texts have no shingles and
    no links. Rows that share an id and a text are one document and get equal results; a null id is linked
    to nothing, has a null component_id, and is kept. An empty table gives no rows. A text of any length is
    one set. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    modest_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(text.mapInArrow(_sign(shingle), SIGNED), "signed")
    n = partitions(spark, 8 * (signed.agg(F.sum("n")).first()[0] or 0))
    full = signed.where("n > 0 and doc_id is not null")
    nodes = materialise(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "nodes")
    tokens = nodes.select("node", "sig").mapInArrow(_explode_tokens, "token long, node long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared.hint("merge"), "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own")).where(F.size("own") >= MATCH)
    prefix = own.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - MATCH + 1)).alias("p")).select("node", "p.token", "p.df")
    postings = prefix.join(nodes.select("node", "n", "sig"), "node")
    spans = _by_group(_in_blocks(postings, "df", "node").select("token", "i", "j", "node", "n", "sig"), ("token", "i", "j"), _candidates(percent), n)
    groups = connected_components(spans, "candidates")
    sized = groups.join(groups.groupBy("label").agg(F.count("*").alias("csize")), "label").select("node", F.col("label").alias("comp"), "csize")
    wanted = materialise(sized.join(nodes.select("node", "h1", "h2"), "node"), "wanted")
    found = _likely(text.withColumnRenamed("doc_id", "node"), wanted).join(wanted, "node").select("node", "text", "h1", "h2", "comp", "csize").mapInArrow(_sets(shingle), "node long, comp long, csize long, items binary")
    links = _by_group(_in_blocks(found, "csize", "node"), ("comp", "i", "j"), _links(percent), n)
    labels = connected_components(links, "links")
    names = nodes.join(labels, "node", "left").select("h1", "h2", "n", F.coalesce("label", "node").alias("component_id"))
    rows = signed.select("doc_id", "n", "h1", "h2")
    some = rows.where("n > 0 and doc_id is not null").join(names, ["h1", "h2", "n"])
    none = rows.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n", "component_id").union(none.select("doc_id", "n", "component_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose document is linked to one with a smaller id, directly or over others. It
    decides by id: of rows that share one all go if any of them is such a copy; null ids stay."""
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")


LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON other = u),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM smallest LEFT JOIN n USING (doc_id)
"""
