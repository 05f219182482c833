"""Operator 1 [native]: benchmark decontamination by a broadcast hash set of test n-grams.

Test items and documents are normalised alike (A-Z lower-cased, words of letters, digits and non-ASCII
characters). The items' windows of N words form the hash set: an array of buckets, each with the few windows
whose hash falls into it, that goes to the tasks as one value. Every rolling window of a document is looked up
there inside its own row, from hashes of the words that are computed once; what is found is compared word by
word. So neither texts nor windows leave the scan. A set of more than BROADCAST_BYTES isn't broadcast: windows
are then joined by hash, and what matches meets its document again, where the words are compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import bind
from tidelog.llm.scratch import materialise

N = 8
HITS = "array<struct<s:int,k:int,items:array<string>>>"
BROADCAST_BYTES = 32 << 20
#: Words and what is between them after lower-casing; and the same in a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """What lies between separators: far cheaper than to extract the words, of which Spark copies the text."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.filter(F.split(lowered, SEPARATOR), lambda x: x != ""), F.array().cast("array<string>"))


def _paired(x: Column, y: Column, windows: Column, shift: int) -> Column:
    """Hashes of the first of x with those of y from shift on, as many as there are windows."""
    many = F.greatest(windows, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), many), F.slice(y, F.lit(shift + 1), many), lambda a, b: F.xxhash64(a, b))


def _windows(w: Column, lengths: list[int], f) -> Column:
    """f({k: hashes of all windows of k words of w, by their first word}), from the hashes of words by doubling:
    a window's hash is that of its halves' hashes, or of its powers of two."""

    def window(powers: dict[int, Column], k: int) -> Column:
        parts = [1 << b for b in range(k.bit_length() - 1, -1, -1) if k >> b & 1]
        out, done = powers[parts[0]], parts[0]
        for part in parts[1:]:
            out, done = _paired(out, powers[part], F.size(powers[1]) - (done + part - 1), done), done + part
        return out

    def grown(powers: dict[int, Column]) -> Column:
        top = max(powers)
        if 2 * top > max(lengths, default=1):
            return f({k: window(powers, k) for k in lengths})
        twice = _paired(powers[top], powers[top], F.size(powers[1]) - (2 * top - 1), top)
        return bind(twice, lambda x: grown(powers | {2 * top: x}))

    return bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: grown({1: h}))


def grams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, gram, items): each distinct window of the items with the ids, as strings, that have it.
    Items without words or with a null id have none; an item of fewer than n words is one window."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), n).alias("gram"))
    hashed = _windows(F.col("gram"), list(range(1, n + 1)), lambda windows: F.coalesce(*[F.when(F.size("gram") == k, windows[k][0]) for k in windows]))
    return each.groupBy("gram").agg(F.collect_set("item").alias("items")).select(hashed.alias("hash"), "gram", "items")


def _buckets(found: DataFrame, count: int) -> tuple[Column, int]:
    """The hash set as one literal value, and its number of buckets: four or more for each window. (PySpark's own
    lit builds arrays of arrays from one expression for each element, and a subquery can't stand in a lambda.)"""
    buckets = 64
    while buckets < 4 * count:
        buckets *= 2
    kept = found.select(F.col("hash").bitwiseAND(F.lit(buckets - 1)).alias("id"), F.struct("hash", "gram", "items").alias("g")).groupBy("id").agg(F.collect_list("g").alias("gs"))
    every = found.sparkSession.range(buckets).join(kept, "id", "left").select("id", F.coalesce("gs", F.array().cast(kept.schema["gs"].dataType)).alias("gs"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("id", "gs"))).alias("all")).select(F.transform("all", lambda x: x["gs"]).alias("all"))
    jvm = found.sparkSession.sparkContext._jvm
    value = one._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, one._jdf.schema().apply(0).dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal)), buckets


def _looked_up(rows: DataFrame, found: DataFrame, lengths: list[int], count: int) -> DataFrame:
    """Adds _hits, (s, k, items) of each window that is in the set, inside the row."""
    known, buckets = _buckets(found, count)

    bucket = lambda x: F.get(known, x.bitwiseAND(F.lit(buckets - 1)).cast("int"))

    def found_in(w: Column) -> Column:
        return _windows(w, lengths, lambda windows: F.flatten(F.concat(F.array(F.array().cast(HITS)), *[of_length(w, x, k) for k, x in windows.items()])))

    def of_length(w: Column, windows: Column, k: int) -> Column:
        def at(x: Column) -> Column:
            equal = F.filter(bucket(x["hash"]), lambda g: (g["hash"] == x["hash"]) & (g["gram"] == F.slice(w, x["s"] + 1, k)))
            return F.transform(equal, lambda g: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), g["items"].alias("items")))

        filled = F.transform(windows, lambda x, i: F.when(F.exists(bucket(x), lambda g: g["hash"] == x), F.struct(i.alias("s"), x.alias("hash"))))
        return F.transform(F.filter(filled, lambda x: x.isNotNull()), at)

    return _summed(rows, bind(F.col("_w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found_in(w).alias("hits"))))


def _summed(rows: DataFrame, met: Column) -> DataFrame:
    """doc_id, _carry, n_words, positions, items from a struct of n_words and hits. It is unfolded by a
    generator, which keeps it from being computed anew for each use of its parts."""

    def parts(m: Column) -> Column:
        places = F.flatten(F.transform(m["hits"], lambda h: F.sequence(h["s"] + 1, h["s"] + h["k"])))
        items = F.flatten(F.transform(m["hits"], lambda h: h["items"]))
        return F.struct(m["n_words"].alias("n_words"), F.array_sort(F.array_distinct(places)).alias("positions"), F.array_sort(F.array_distinct(items)).alias("items"))

    return rows.select("doc_id", "_carry", F.inline(F.array(bind(met, parts))))


def _joined(rows: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by a join on hashes. Rows are written first, so that their numbers stay what they are."""
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = rows.sparkSession.createDataFrame([], "_row long, k int, s int, hash long")
    for k in lengths:
        windows = _windows(F.col("_w"), [k], lambda found: next(iter(found.values())))
        each = each.union(rows.select("_row", F.lit(k), F.posexplode(windows)))
    met = each.join(found, "hash").where(F.col("k") == F.size("gram"))
    by_row = met.groupBy("_row").agg(F.collect_list(F.struct("s", "k", "gram", "items")).alias("_met"))
    equal = F.filter("_met", lambda m: m["gram"] == F.slice("_w", m["s"] + 1, m["k"]))
    hits = F.transform(equal, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["items"].alias("items")))
    return _summed(rows.join(by_row, "_row", "left"), F.struct(F.size("_w").cast("long").alias("n_words"), F.coalesce(hits, F.array().cast(HITS)).alias("hits")))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, the columns of carry, n_words, positions (from 1) of hit words, items.

    carry columns come back as _carry struct. Every row is judged on its own, whatever its id.
    """
    found = materialise(grams(benchmark, n), "grams")
    lengths = sorted((r[0] for r in found.select(F.size("gram")).distinct().collect()), reverse=True)  # n values at most
    size, count = found.agg(F.sum(F.length(F.to_json("gram")) + F.length(F.to_json("items")) + 64), F.count("*")).first()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.lit(1).alias("_"), *carry).alias("_carry"), words(F.col(text_col).cast("string")).alias("_w"))
    return _looked_up(rows, found, lengths, count) if (size or 0) <= BROADCAST_BYTES else _joined(rows, found, lengths)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Null and empty texts have no words, no hits, and the digest of an empty list; an empty table gives no rows.
    Rows with equal or null ids, and repeated rows, are judged each on its own; repeated items count once; an
    empty benchmark hits nothing. A text of any length is one row whose work grows with its words. Only the id
    and text columns of either table are read, whatever the others are named.
    """
    return hits(docs, benchmark, n, (), id_col, text_col).select(
        "doc_id",
        "n_words",
        F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the same columns, without contaminated documents and without the hit words of the others.

    A document with windows of least_items or more items goes; in one with fewer, each run of hit words goes
    with the separators after its words. A document all of whose words are hit goes as well. Documents
    without a hit come back as they are, null and empty ones included.
    """
    found = hits(docs, benchmark, n, tuple(f"`{c}`" for c in docs.columns), id_col, text_col).where(F.size("items") < least_items)
    found = found.where((F.size("positions") == 0) | (F.size("positions") < F.col("n_words")))
    text = F.col(f"_carry.`{text_col}`").cast("string")
    found = found.withColumn("_sep", F.when(F.size("positions") > 0, F.split(text, ANY_CASE, -1))).withColumn("_word", F.when(F.size("positions") > 0, F.filter(F.split(text, BETWEEN), lambda x: x != "")))
    p = F.col("positions")
    firsts = F.array_sort(F.array_except(p, F.transform(p, lambda x: x + 1)))
    lasts = F.array_sort(F.array_except(p, F.transform(p, lambda x: x - 1)))
    found = found.withColumn("_unit", F.zip_with("_word", F.slice("_sep", F.lit(2), F.size("_word")), lambda w, s: F.concat(w, s)))
    gaps = F.zip_with(F.concat(F.array(F.lit(1)), F.transform(lasts, lambda x: x + 1)), F.concat(F.transform(firsts, lambda x: x - 1), F.array(F.size("_unit"))), lambda a, e: F.slice(F.col("_unit"), a, F.greatest(e - a + 1, F.lit(0))))
    cut = F.concat(F.col("_sep")[0], F.array_join(F.flatten(gaps), ""))
    kept = F.when(F.size("positions") == 0, text).otherwise(cut)
    return found.select(*[(kept.cast(docs.schema[c].dataType) if c == text_col else F.col(f"_carry.`{c}`")).alias(c) for c in docs.columns])


LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, unnest(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda i: w[i:i + {N - 1}])) AS gram
  FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT len(gram) AS k FROM g),
win AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, k WHERE len(w) >= k),
hit AS (SELECT win.doc_id, i, k, item FROM win JOIN g ON g.gram = w[i:i + k - 1] AND len(g.gram) = k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
