"""The ten operators against brute force, on a small corpus with every awkward row."""

import bisect
import hashlib
import itertools
import math
import os
import random
import re
import string
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from tidelog.llm import arrays, decontaminate, fingerprint, language_id, near_dedup, packing, pii, quality, queries, scratch, sharding, substring_dedup, textops, token_counts
from tidelog.llm import components
from tidelog.llm.components import connected_components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def make_corpus():
    rng = random.Random(3)
    v = vocabulary(rng)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    base, passage = say(120).split(), say(20)
    rows = []
    for i in range(40):
        rows.append((i, say(rng.randrange(1, 80))))
    for i in range(40, 60):  # near copies of one text, and a chain of them
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = "zz%d" % i
        rows.append((i, " ".join(w)))
    for i in range(60, 75):  # one passage in many texts
        rows.append((i, f"{say(15)}\n{passage}\t {say(10)}"))
    rows += [(75, rows[5][1]), (76, rows[5][1].upper()), (77, ""), (78, None), (79, "  \n\t "), (80, "one two three"), (81, "ONE two Three"), (82, "a" * 5000), (83, " ".join(["same"] * 60)), (84, "😀 1 2 !"), (85, "12 34.5 !?"), (86, "x"), (87, "\x00 \x0b nul"), (88, say(3000))]
    rows += [(80, "one two three"), (None, "no id here at all"), (None, None)]
    return rows


CORPUS = make_corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in CORPUS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns named as the operators' own ones."""
    names = ("_row", "kind", "part", "key", "size", "node", "token", "hash", "range", "_key", "n", "start", "shard", "words")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def bag(rows):
    return sorted(map(repr, rows))


def ws(text):
    return (text or "").encode().split()


# --- 1 -----------------------------------------------------------------------------------------------------

ITEMS = [(1, " ".join(CORPUS[88][1].split()[100:130])), (2, CORPUS[60][1].split("\n")[1]), (2, "x"), (3, "One, TWO; three!"), (10, "one two three"), (5, None), (6, ""), (None, "x"), (7, " ".join(CORPUS[88][1].upper().split()[200:209]))]


def brute_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    grams = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 7)):
                grams.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def test_contamination(spark, docs, clashing, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_contamination(CORPUS, ITEMS)
    assert any(x[5] for x in want)
    for frame in (docs, clashing):
        assert bag(map(tuple, decontaminate.contamination(frame, items).collect())) == bag(want)
    assert bag(map(tuple, decontaminate.contamination(docs, items.where("false")).collect())) == bag(brute_contamination(CORPUS, []))
    assert decontaminate.contamination(nothing, items).count() == 0


def test_contamination_without_a_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bag(map(tuple, decontaminate.contamination(docs, items).collect())) == bag(brute_contamination(CORPUS, ITEMS))


def test_decontamination_cuts_or_drops(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "q r s t u v w x")], "item_id long, text string")
    rows = [(1, "Start: A b, c d e f g h i! End."), (2, "a b c d e f g h and q r s t u v w x"), (3, "clean, text"), (4, None), (5, "a b c d e f g h"), (6, "é a b c d e f g h - a b c d e f g h z")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, hit string")
    got = decontaminate.decontaminate(frame, items)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=lambda r: r[0]) == [(1, "Start: End."), (3, "clean, text"), (4, None), (6, "é z")]


# --- 2 -----------------------------------------------------------------------------------------------------


def brute_near(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in ws((t or "").translate(LOWER))]
        sets[i, t] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    named = {i: s for (i, _), s in sets.items() if i is not None}
    label = {i: i for i in named}
    changed = True
    while changed:
        changed = False
        for a in named:
            for b in named:
                x, y = named[a], named[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(sets[i, t]), label.get(i), i is None or label[i] == i) for i, t in rows]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(docs, clashing, nothing, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    want = brute_near(CORPUS, 4, 80)
    assert len({x[2] for x in want}) < len(want) - 10
    assert bag(map(tuple, near_dedup.near_duplicates(docs, 4, 80).collect())) == bag(want)
    if block > 4:
        assert bag(map(tuple, near_dedup.near_duplicates(clashing, 4, 80).collect())) == bag(want)
        assert near_dedup.near_duplicates(nothing, 4, 80).count() == 0
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns and bag(r.doc_id for r in kept.collect()) == bag(x[0] for x in brute_near(CORPUS, 5, 80) if x[3])


def test_linked_parts_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        m = int(rng.integers(1, 40))
        sets = [np.unique(rng.integers(0, 14, int(rng.integers(1, 14)))).astype(np.uint64) for _ in range(m)]
        label = list(range(m))
        for a in range(m):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = label[a], label[b]
                    label = [min(x, y) if z in (x, y) else z for z in label]
        assert near_dedup.linked_parts(sets, 80).tolist() == label


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    edges = [(i, 1000) for i in range(50)] + [(1000, 1001), (1001, 1002)] + [(2000 + i, 1999) for i in range(10)] + [(2000, 3000), (3000, 2999)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys([*range(50), 1000, 1001, 1002], 0) | dict.fromkeys([*range(1999, 2010), 2999, 3000], 1999)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def doubled(n):
    """Two different words of n letters, made by replacing a by ab and b by ba."""
    word = "a"
    while len(word) < n:
        word = word.translate({97: "ab", 98: "ba"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("size", [16, 512, 1024, 2048, 4096])
def test_words_made_by_doubling_are_told_apart(spark, size):
    x, y = doubled(size)
    assert x != y
    tail = " ".join(f"w{i}" for i in range(12))
    frame = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, x), (4, y), (5, f"{x} b c"), (6, f"{y} b c")], "doc_id long, text string").coalesce(1)
    rows = [tuple(r) for r in frame.collect()]
    assert bag(map(tuple, near_dedup.near_duplicates(frame, 4, 80).collect())) == bag(brute_near(rows, 4, 80))
    assert bag(map(tuple, substring_dedup.remove_repeats(frame).collect())) == bag(brute_repeats(rows))
    library = packing.encoder(packing.default_vocabulary()).library
    ids = {r.doc_id: r.ids for r in packing.pack(frame.where("doc_id in (3, 4)")).collect()}
    assert ids == {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in ((3, x), (4, y))}


def test_segment_hash_is_of_the_bytes_alone():
    rng = random.Random(14)
    words = list({bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(2000)})
    seen = []
    for order in (words, words[::-1]):
        data = np.frombuffer(b"".join(order), np.uint8)
        ends = np.cumsum([len(w) for w in order])
        starts = ends - [len(w) for w in order]
        seen.append(dict(zip(order, textops.segment_hash(data, starts, ends).tolist(), strict=True)))
    assert seen[0] == seen[1] and len(set(seen[0].values())) == len(words)


# --- 3 -----------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    enc = packing.encoder(packing.default_vocabulary())
    rng = random.Random(4)
    texts = [t for _, t in CORPUS] + ["it's we'll 'tis ''s 's's I'M don't  '", " 's  x", "a  b   c\n\n d \n", " x 　y z", "<|endoftext|> a<|endoftext|>", "٣٤ ½ x² १२", "👩‍👩‍👧 flag🇩🇪", "\r\n\t", "'re", "a'", "1'd2'll"]
    texts += ["".join(rng.choice("a B1'sdtrel \n\té!?-。٣ ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = {i: ids.tolist() for i, ids in enc.runs(texts, chunk=5000)}
    for i, t in enumerate(texts):
        assert got[i] == enc.library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_compares_what_hashes_alike(monkeypatch):
    """With a hash that tells nothing apart every pre-token but the first one is encoded on its own."""
    monkeypatch.setattr(textops, "segment_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    enc = packing.Encoder(*packing.default_vocabulary())
    texts = [t for i, t in CORPUS if i != 88]
    for i, ids in enc.runs(texts, chunk=3000):
        assert ids.tolist() == enc.library.encode(texts[i] or "", add_special_tokens=False).ids, repr(texts[i])


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for k in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, k)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - k)
    return len(rooms)


def test_real_lengths_take_no_more_sequences_than_best_fit(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    lengths = []
    for _, ids in packing.encoder(packing.default_vocabulary()).runs([r.text for r in rows]):
        n = len(ids) + 1
        lengths += [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * (n % packing.CAPACITY > 0)
    _, sequences = packing.plan({k: lengths.count(k) for k in set(lengths)})
    assert sequences == -(-sum(lengths) // packing.CAPACITY) == best_fit_decreasing(lengths, packing.CAPACITY) == 481


def test_packing(docs, clashing, nothing):
    enc = packing.encoder(packing.default_vocabulary())
    for frame in (docs, clashing):
        rows = packing.pack(frame).collect()
        pieces, ends = {}, {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0) and r.length == len(r.ids) <= packing.CAPACITY and (r.piece == 0 or r.length == packing.CAPACITY)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            ends[r.sequence_id] = r.offset + r.length
            pieces.setdefault(r.doc_id, []).append((r.start, r.piece, r.ids))
        assert max(ends.values()) <= packing.CAPACITY
        total = sum(ends.values())
        assert len(ends) <= -(-total // packing.CAPACITY) + 1
        want = {}
        for i, t in CORPUS:
            want.setdefault(i, []).extend(enc.library.encode(t or "", add_special_tokens=False).ids + [0])
        assert {i: len(x) for i, x in want.items()} == {i: sum(len(p[2]) for p in x) for i, x in pieces.items()}
        assert [x for _, _, p in sorted(pieces[88]) for x in p] == want[88] and len(pieces[88]) > 1
    assert packing.pack(nothing).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + j * k for s in sums for j in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in got.items())
    segments, n = packing.plan({2048: 10**9, 1000: 5, 48: 3, 1048: 4})
    assert n == 10**9 + 5 and sum(s[2] for s in segments) == 10**9 + 12


@pytest.mark.parametrize("times", [1, 50])
@pytest.mark.parametrize("mean, spread", [(5.5, 1.2), (6.2, 0.9)])
def test_plan_uses_hardly_more_sequences_than_the_ids_need(times, mean, spread):
    rng = random.Random(5)
    histogram = {}
    for _ in range(20_000):
        length = min(packing.CAPACITY, max(1, int(rng.lognormvariate(mean, spread))))
        histogram[length] = histogram.get(length, 0) + times
    segments, n = packing.plan(histogram)
    need = -(-sum(k * v for k, v in histogram.items()) // packing.CAPACITY)
    assert need <= n <= need + need // 10_000
    ranks, filled = {}, np.zeros(n, np.int64)
    for length, first, many, sequence, offset in segments:
        assert first == ranks.get(length, 0) and (filled[sequence : sequence + many] == offset).all()
        ranks[length] = first + many
        filled[sequence : sequence + many] += length
    assert ranks == histogram and filled.max() <= packing.CAPACITY
    assert packing.fullest({2: 9, 3: 9, 5: 9}, 10) == {5: 2}


# --- 4 -----------------------------------------------------------------------------------------------------


def check_shards(rows, corpus, shards):
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_sharding(docs, clashing, nothing):
    for frame in (docs, clashing):
        sizes = check_shards(sharding.shard(frame, 4).collect(), CORPUS, 4)
        longest = max(len((t or "").encode()) + 1 for _, t in CORPUS)
        assert max(sizes) - min(sizes) <= 2 * longest
    assert sharding.shard(nothing).count() == 0


def test_sharding_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(sharding.ORACLE).df()
    got = queries.QUERIES["op4_sharding"](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].drop(columns="grown_shard").itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and got.grown_shard.isna().all()


def test_written_shards_hold_every_row_in_order(spark, clashing, nothing, tmp_path):
    path = tmp_path / "shards"
    sharding.write_shards(clashing, str(path), 4)
    want, got = sharding.shard(clashing, 4).collect(), []
    for s in range(4):
        files = sorted((path / f"shard={s}").glob("*.parquet"))
        got += [(s, r["doc_id"], r["text"]) for f in files for r in pq.ParquetFile(f).read().to_pylist()]
    assert bag((i, t) for _, i, t in got) == bag(CORPUS)
    order = [(r.shard, r.doc_id, r.size) for r in sorted(want, key=lambda r: (r.shard, r.slot))]
    assert [(s, i, len((t or "").encode()) + 1) for s, i, t in got] == order
    assert spark.read.parquet(str(path)).columns == [c for c in clashing.columns if c != "shard"] + ["shard"]
    sharding.write_shards(nothing, str(tmp_path / "none"), 4)
    assert not list((tmp_path / "none").glob("shard=*"))


def test_a_text_of_half_of_all_rows_is_cut_evenly(spark):
    corpus = [(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)]
    sizes = check_shards(sharding.shard(spark.createDataFrame(corpus, "doc_id long, text string")).collect(), corpus, 16)
    assert max(sizes) - min(sizes) <= 20


# --- 5 -----------------------------------------------------------------------------------------------------


def brute_fingerprints(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n, following = len(t), order[(k + 1) % len(order)][1]
        edited = (t[: n - n // 3] + following[: n // 3]).encode()
        a, b, c = fingerprint.digest(t.encode()), fingerprint.digest(edited), fingerprint.digest(following.encode())
        want.append((i, n, hashlib.sha256(edited).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    return want


def test_fingerprints(docs, clashing, nothing):
    want = brute_fingerprints(CORPUS)
    for frame in (docs, clashing):
        assert bag(map(tuple, fingerprint.fingerprints(frame).collect())) == bag(want)
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(docs.where("doc_id = 86")).first()
    assert one.near_next == 1.0 and one.n_chars == 1


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    rng = random.Random(23)
    v = vocabulary(rng)
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(30)))) for i in [7] * 80 + [None] * 60 + list(range(40))] + [(7, "again")] * 5
    monkeypatch.setattr(fingerprint, "partitions", lambda *_: 9)
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert bag(map(tuple, out.collect())) == bag(brute_fingerprints(rows))


@pytest.mark.parametrize("name", ["op5_fingerprints", "op8_token_counts"])
def test_query_equals_sql(spark, docs, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    made = str(tmp_path / "documents.parquet")
    docs.select("doc_id", "text").write.parquet(made)  # nulls, ties, repeated rows, long words and texts
    for root, files in (("/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet"), (str(tmp_path), f"{made}/*.parquet")):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{files}'")
        got = queries.QUERIES[name](spark, root)
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert bag(map(tuple, got.collect())) == bag(want) and want


def plain_digest(data):
    """The quartile digest by plain numbers, a triplet at a time."""
    mask = 2**64 - 1

    def mixed(x):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            x = (x ^ x >> shift) * factor & mask
        return x

    tables = [[mixed(256 * t + b + 1) % 256 for b in range(256)] for t in range(3)]
    counts = [0] * 256
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        counts[tables[0][a] ^ tables[1][b] ^ tables[2][c]] += 1
    quartiles = [sorted(counts)[k] for k in (63, 127, 191)]
    codes = [sum(n > q for q in quartiles) for n in counts]
    packed = bytes(codes[k] | codes[k + 1] << 2 | codes[k + 2] << 4 | codes[k + 3] << 6 for k in range(0, 256, 4))
    return bytes([min(255, round(math.log(1 + len(data)) / math.log(1.1)))]).hex() + packed.hex(), codes, len(data)


def test_digest_and_likeness_equal_plain_ones():
    rng = random.Random(16)
    datas = [(t or "").encode() for _, t in CORPUS[::4]] + [b"", b"ab", b"abc", bytes(rng.randrange(256) for _ in range(5000))]
    plain = [plain_digest(d) for d in datas]
    assert [fingerprint.digest(d) for d in datas] == [p[0] for p in plain]
    for a in plain:
        for b in plain[::3]:
            steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1], b[1], strict=True))
            lengths = abs(int(a[0][:2], 16) - int(b[0][:2], 16))
            assert fingerprint.likeness(a[0], b[0]) == max(0.0, 1.0 - (steps + max(0, lengths - 2)) / (1.625 * 256))


def test_likeness_is_bounded_and_orders(monkeypatch):
    rng = random.Random(2)
    v = vocabulary(rng)
    a = " ".join(rng.choice(v) for _ in range(400)).encode()
    near, far = a[:-200] + b"other words at the end", " ".join(rng.choice(vocabulary(rng)) for _ in range(100)).encode()
    x, y, z = map(fingerprint.digest, (a, near, far))
    assert fingerprint.likeness(x, x) == 1.0 > fingerprint.likeness(x, y) > fingerprint.likeness(x, z) >= 0.0
    whole = fingerprint.digest(a * 3)
    monkeypatch.setattr(fingerprint, "_SLICE", 100)
    assert fingerprint.digest(a * 3) == whole  # long texts are counted slice by slice


# --- 6, 9: held-out accuracy ---------------------------------------------------------------------------------

TONGUES = {"aa": "the of and tion ing er re on at en".split(), "bb": "der die und ung keit schaft ein zu ver be".split(), "cc": "los que ción ado mente por las es de la".split()}


def speak(rng, tongue, n):
    return " ".join("".join(rng.choice(TONGUES[tongue]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark, docs, nothing):
    rng = random.Random(7)
    rows = [(i, speak(rng, t := rng.choice(list(TONGUES)), rng.randrange(5, 60)), t) for i in range(600)] + [(700, None, "aa"), (701, "12 ... !", "bb"), (702, "", None), (None, "the and of", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    got = language_id.identify(frame, model).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {700, 701, 702} and all(r.rejected for r in got if r.lang_pred == "und")
    kept = language_id.drop_rejected(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= set(range(600)) and not {700, 701, 702} & {r.doc_id for r in kept.collect()}
    assert language_id.fit(nothing) is None and language_id.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def plain_grams(text):
    """Counts of hashed 1-, 2- and 3-grams of a text's bytes, a gram at a time."""
    data = regex.sub(r"\PL+", " ", text.lower()).encode()
    out = {}
    for k in (1, 2, 3):
        for i in range(len(data) - k + 1):
            x = 0
            for b in data[i : i + k]:
                x = (x * 257 + b) & 0xFFFFFFFF
            d = (x * 2654435761 + k * 40503 & 0xFFFFFFFF) >> 20
            out[d] = out.get(d, 0) + 1
    return out


def plain_unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {d: x / norm for d, x in v.items()} if norm else v


def plain_cosine(a, b):
    return sum(x * b.get(d, 0.0) for d, x in a.items())


def plain_mean(vs):
    out = {}
    for v in vs:
        for d, x in v.items():
            out[d] = out.get(d, 0.0) + x / len(vs)
    return plain_unit(out)


def plain_centroids(vs, k, rounds):
    """Spherical k-means from the mean and the farthest vectors."""
    centres = [plain_mean(vs)]
    while len(centres) < min(k, len(vs)):
        centres.append(min(vs, key=lambda v: max(plain_cosine(v, c) for c in centres)))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for v in vs:
            groups[max(range(len(centres)), key=lambda i: plain_cosine(v, centres[i]))].append(v)
        centres = [plain_mean(g) if g else c for g, c in zip(groups, centres, strict=True)]
    return centres


def test_language_equals_plain_centroids(spark):
    rng = random.Random(21)
    rows = [(i, speak(rng, t := rng.choice(list(TONGUES)), rng.randrange(3, 25)), t) for i in range(90)]
    rows += [(200, None, "aa"), (201, "12 ... !", None), (202, "", None), (203, "Ünïcödé ПРИВЕТ 中国 der und", None), (204, "x", None), (205, speak(rng, "bb", 700), None), (3, "die und", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, n) for i, t, n in rows if n and t and zlib.crc32(str(i).encode()) % 4 != 2]
    grams = [plain_grams(t) for t, _ in learned]
    df = {}
    for g in grams:
        for d in g:
            df[d] = df.get(d, 0) + 1
    idf = lambda d: math.log((1 + len(grams)) / (1 + df.get(d, 0))) + 1
    vector = lambda g: plain_unit({d: math.sqrt(n) * idf(d) for d, n in g.items()})
    centres = {n: plain_centroids([vector(g) for g, (_, m) in zip(grams, learned, strict=True) if m == n], 3, 12) for n in sorted(TONGUES)}
    got = language_id.identify(frame, language_id.fit(frame)).collect()
    by_row = {(r[0], i): r for i, r in enumerate(rows)}
    assert len(got) == len(by_row)
    want = []
    for i, t, _ in rows:
        if not t or not regex.search(r"\p{L}", t):
            want.append((i, "und", 0.0, 0.0))
            continue
        v = vector(plain_grams(t))
        each = {n: max(plain_cosine(v, c) for c in cs) for n, cs in centres.items()}
        best = max(each, key=each.get)
        want.append((i, best, 1 / sum(math.exp(25 * (x - each[best])) for x in each.values()), each[best]))
    key = lambda x: (x[0], x[3])
    for r, w in zip(sorted(((r.doc_id, r.lang_pred, r.score, r.cosine) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], abs=2e-4) and r[3] == pytest.approx(w[3], abs=1e-4)


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(11)
    ids = iter(i for i in range(5000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(next(ids), speak(rng, "aa", 3), f"l{k:03}") for k in range(260) for _ in range(1 + 2 * (k < 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    everything = sorted({r[2] for r in rows})
    assert language_id.fit(frame).languages == everything
    monkeypatch.setattr(language_id, "MOST_DOCUMENTS", 10)
    monkeypatch.setattr(language_id, "FEW", 0.01)
    assert language_id.fit(frame).languages == everything


def test_language_rejects_what_it_never_learned(spark):
    rng = random.Random(10)
    rows = [(i, speak(rng, t := rng.choice(list(TONGUES)), rng.randrange(5, 200)), t) for i in range(600)]
    rows += [(600 + i, "zq " + speak(rng, "aa", 1) if i % 2 else "xkcd qqq", "aa") for i in range(8)]  # junk that is labelled
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    nonsense = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    foreign = ["Suomen kieli on uralilainen kieli jota puhutaan pääasiassa Suomessa ja sen lähialueilla", "Türkçe dünyada en çok konuşulan dillerden biridir ve birçok ülkede kullanılmaktadır", nonsense(string.ascii_lowercase, 100), nonsense(string.ascii_letters + string.digits, 300), nonsense("0123456789abcdef", 100), "これは日本語の文章です"]
    clean = [speak(rng, t, n) for t in TONGUES for n in (1, 2, 3, 5, 20, 500) for _ in range(5)] + ["the " * 3000, "der"]
    frame = spark.createDataFrame(list(enumerate(foreign + clean)), "doc_id long, text string")
    assert {r.doc_id for r in language_id.drop_rejected(frame, model).collect()} == set(range(len(foreign), len(foreign + clean)))
    assert {r.doc_id for r in language_id.identify(frame, model).collect() if r.rejected} == set(range(len(foreign)))


def test_language_never_sees_the_held_out_quarter(spark):
    rng = random.Random(8)
    rows = [(i, speak(rng, "aa", 30), "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else "aa") for i in range(200)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["aa"]


def test_quality(spark, docs, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        text = speak(rng, "aa", rng.randrange(30, 90))
        rows.append((i, text if good else " | ".join(text.split()) + " $$$ ###"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(900, None), (901, "")]
    truth = {i: q for i, q, _ in labels}
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (950, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, known)
    got = quality.score(frame, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.THRESHOLD) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert quality.fit(frame, known.where("quality = 1")) is None and quality.fit(frame, known.where("false")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5} and quality.score(nothing, model).count() == 0


def test_quality_equals_plain_compression(spark, docs):
    import zstandard

    rng = random.Random(22)
    rows = [(i, speak(rng, "aa", rng.randrange(20, 90)) if i % 3 else " | ".join(speak(rng, "bb", 40).split())) for i in range(200)]
    rows = [(i, "" if i == 10 else t) for i, t in rows]
    labels = [(i, int(i % 3 > 0)) for i, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))

    def evidence(text):
        data, saved = (text or "").encode(), 0
        for side, sign in ((model.bad, 1), (model.good, -1)):
            for lo in range(0, len(data), 512):
                made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(side), write_content_size=False, write_checksum=False, write_dict_id=False)
                saved += sign * len(made.compress(data[lo : lo + 512]))
        return saved / len(data) if data else 0.0

    logistic = lambda x, w, c: 1 / (1 + math.exp(-max(-30.0, min(30.0, w * x + c))))
    want = {}
    for i, t in [*rows, *CORPUS]:
        want.setdefault((i, t), logistic(evidence(t), *model.weights))
    for part in (frame, docs):
        got = [(r.doc_id, r.score, r.predicted) for r in quality.score(part, model).collect()]
        expected = [(i, want[i, t]) for i, t in (rows if part is frame else CORPUS)]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        for r, w in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
            assert r[0] == w[0] and r[1] == pytest.approx(w[1], rel=1e-9) and r[2] == int(w[1] >= 0.7)


def test_logistic_curve_is_where_the_gradient_vanishes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-0.02, 0.05, 200), rng.normal(0.04, 0.05, 400)])
    y = np.concatenate([np.zeros(200), np.ones(400)])
    w, c = quality._logistic(x, y)
    off = y - 1 / (1 + np.exp(-(w * x + c)))
    assert w > 0 and abs(off.sum()) < 1e-3 and abs((off * x).sum()) < 1e-3


@pytest.mark.parametrize("good, bad", [(1, 1), (3, 1), (1, 3), (2, 3), (3, 3)])
def test_quality_from_a_few_labels(spark, good, bad):
    rng = random.Random(12)
    ids = iter(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    labels = [(next(ids), y, 0) for y in [1] * good + [0] * bad]
    rows = [(i, speak(rng, "aa" if y else "bb", 200)) for i, y, _ in labels]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert min(score[i] for i, y, _ in labels if y) > max(score[i] for i, y, _ in labels if not y)


# --- 7 -----------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=13):
    big = 2**63 - 1
    first = {}
    for i, t in rows:
        w = ws(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, big), big if i is None else i)
    out = []
    for i, t in rows:
        w = ws(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_repeats(docs, clashing, nothing):
    want = brute_repeats(CORPUS)
    assert sum(x[2] > 0 for x in want) > 20
    for frame in (docs, clashing):
        assert bag(map(tuple, substring_dedup.remove_repeats(frame).collect())) == bag(want)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_with_a_full_index(docs, monkeypatch):
    """An index far beyond its bound only lets more windows through to the exact match."""
    monkeypatch.setattr(substring_dedup, "SLICE_BITS", 64)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 64)
    assert bag(map(tuple, substring_dedup.remove_repeats(docs).collect())) == bag(brute_repeats(CORPUS))


def test_repeats_that_a_task_remembers(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 500)
    for most in (200_000, 3, 0):
        monkeypatch.setattr(substring_dedup, "REMEMBERED", most)
        assert bag(map(tuple, substring_dedup.remove_repeats(docs.coalesce(1)).collect())) == bag(brute_repeats(CORPUS))


def test_remembered_windows_are_compared_whole():
    known = substring_dedup._Repeated()
    h, check = np.array([7, 9, 9], np.uint64), np.array([1, 2, 3], np.uint32)
    known.add(h[:2], check[:2], np.array([5, 4]))
    assert known.least(h, check).tolist() == [5, 4, substring_dedup.NULL_ID]


# --- 8 -----------------------------------------------------------------------------------------------------


def greedy(word, initial, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = inner if at else initial
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in pieces), 0)
        if not size:
            return None
        n, at = n + 1, at + size
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(6)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5)))
        initial, inner = {piece() for _ in range(rng.randrange(1, 8))}, {piece() for _ in range(rng.randrange(1, 8))}
        a = token_counts.Automaton(initial, inner)
        for _ in range(100):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            want = greedy(w, initial, inner)
            assert a[w] == (1 if want is None else want), (w, initial, inner)


def test_token_counts(docs, clashing, nothing):
    initial, inner = map(set, token_counts.byte_level_pieces(token_counts.default_vocabulary()))
    assert len(inner) > 256 and all(bytes([b]) in inner for b in range(256) if b != 32)
    small = [(i, t) for i, t in CORPUS if i != 88 and len(t or "") < 4000]
    want = []
    for i, t in small:
        each = [greedy(w, initial, inner) or 1 for w in ws(t)]
        want.append((i, len(each), sum(each), max(each, default=0)))
    for frame in (docs, clashing):
        got = [tuple(r) for r in token_counts.token_counts(frame).collect() if r.doc_id not in (82, 88)]
        assert bag(got) == bag(want)
    assert token_counts.token_counts(nothing).count() == 0


def test_token_counts_cover_every_script(spark, tmp_path):
    initial, inner = map(set, token_counts.byte_level_pieces(token_counts.default_vocabulary(), lone_blank=True))
    assert b"" in initial
    every = {b" " + p for p in initial} | inner
    words = "считать так россия привет 中国 日本語 한국어 สวัสดีครับ Հայ नमस्ते 😀 🀄 € hello \x00 \x7f 中国人民共和国中央人民政府".split()
    texts = [*words, " ".join(words), "", None]
    want = []
    for i, t in enumerate(texts):
        each = [greedy(b" " + w, every, every) for w in ws(t)]
        want.append((i, len(each), sum(each), max(each, default=0)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert bag(map(tuple, queries.op8_token_counts(spark, str(tmp_path)).collect())) == bag(want)


def test_automaton_with_an_empty_initial_piece():
    rng = random.Random(7)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5)))
        initial, inner = {piece() for _ in range(rng.randrange(1, 8))} | {b""}, {piece() for _ in range(rng.randrange(1, 8))}
        a = token_counts.Automaton(initial, inner)
        for _ in range(100):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            want = greedy(b" " + w, {b" " + p for p in initial}, inner)
            assert a[w] == (1 if want is None else want), (w, initial, inner)


# --- 10 ----------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PII = [
    "mail a.b@c.de and 😀 1.2.3.4.5.6.7.8, 300.1.1.1, 1.2.3.400", "x@y.z%q@r.s a@b.c@d.e @ a@b a@b. .@-.-", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "+1 (017) 555-7713, 97.51.17.173 +1 2 +123456789012345678 ++49 30 1234567", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" version 2.0", "é1.1.1.1 0001.002.3.4", None, "", "5" * 3000 + " " + "a" * 3000 + "@b.co", "1." * 2000, "card 4111111111111111, call 0171 5550 1234", " 378282246310005 \n+44 20 7946 0958", "a\ufdd0b@c.de \ufdd0 1.2.3.4 \ufdd0", "a@b.co " * 300 + "1.2.3.4",
]


def brute_spans(text):
    found = []
    for nth, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), nth, kind, m.end()))
    return sorted(found)


def test_personal_data(spark, docs, nothing):
    frame = spark.createDataFrame([(i % 9, t) for i, t in enumerate(PII)], "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("text_", F.col("text"))
    want = []
    for i, t in enumerate(PII):
        s = brute_spans(t)
        counts = [sum(x[1] == k for x in s) for k in range(4)]
        want.append((i % 9, *counts, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in s).encode()).hexdigest()))
    got = pii.personal_data(frame).collect()
    assert bag(tuple(r)[:6] for r in got) == bag(want)
    by_digest = {(r.doc_id, r.base_sha256): r.spans.split(",") for r in got}
    for (i, t), w in zip(enumerate(PII), want, strict=True):
        spans = by_digest[i % 9, w[5]]
        assert {f"{k}:{a}:{e}" for a, _, k, e in brute_spans(t)} <= set(spans)
    usual = [t for t in PII if t and len(t) < 200]
    added = pii.personal_data(spark.createDataFrame(list(enumerate(usual)), "doc_id long, text string")).collect()
    assert any(x.startswith("secret:") for r in added for x in r.spans.split(","))
    assert pii.personal_data(nothing).count() == 0 and pii.personal_data(docs).count() == len(CORPUS)


def test_redaction(spark):
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(PII)], "doc_id long, text string, kind int")
    got = pii.redact(frame)
    assert got.columns == frame.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert len(texts) == len(PII) and texts[6] is None and texts[7] == ""
    assert texts[0].startswith("mail [EMAIL] and 😀 [IP].[IP], 300.1.1.1") and texts[3].startswith("[PHONE], [IP] +1 2") and texts[5] == "é[IP] [IP]"
    assert not any(brute_spans(t) for t in texts.values())


def plain_candidates(text):
    """(start, end, kind, length class, votes) of every match, base ones by their plain patterns."""
    out = []
    for kind in pii.KINDS:
        pattern = PLAIN.get(kind) or pii.PATTERNS[kind]
        before = 0
        for m in re.finditer(pattern, text or ""):
            match, gap = m.group(), text[before : m.start()][-pii.CONTEXT :].lower()
            before = m.end()
            d = re.sub("[^0-9]", "", match)
            valid = {"ip": lambda: all(int(x) <= 255 for x in match.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}.get(kind, lambda: True)()
            pattern_vote = (1 if valid else -1) if kind in pii.KINDS[:4] else (1 if 9 <= len(d) <= 19 else -1 if len(d) < 8 else 0) if kind == "number" else 1 if re.fullmatch("[0-9a-fA-F]{32,}", match) else -1 if not d else 0
            gazetteer = {
                "email": lambda: int(match.rsplit(".", 1)[-1].lower() in pii.DOMAINS),
                "ip": lambda: -1 if re.match(r"0*(?:0|127|255)\.", match) else 1,
                "phone": lambda: 1 if re.search(pii.CALLING, d) else -1,
                "secret": lambda: 0,
            }.get(kind, lambda: int(bool(re.search(pii.ISSUERS, d))))()
            context = 1 if re.search(pii.NEAR_YES, gap, re.ASCII) else -1 if re.search(pii.NEAR_NO, gap, re.ASCII) else 0
            if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+(?:\.[0-9]+){1,2}", match):
                shape = -1
            elif kind == "secret":
                shape = 1 if len(set(match)) >= 10 else -1 if len(set(match)) <= 5 else 0
            else:
                shape = -1 if kind in ("card", "number") and len(set(d)) <= 3 else 0
            n = len(match)
            out.append((m.start(), m.end(), kind, 0 if n < 12 else 1 if n < 24 else 2, (pattern_vote, gazetteer, context, shape), valid))
    return out


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_chances(rows):
    """EM over votes and a logistic classifier on its soft labels, on one row for each match, by numpy."""
    votes = np.array([v for _, _, v in rows])
    soft = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(40):
        prior = np.clip(soft.mean(), 0.01, 0.99)
        odds = np.full(len(rows), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            side = [np.array([4.0, 2.0, 1.0]), np.array([1.0, 2.0, 4.0])]
            for x in (-1, 0, 1):
                at = votes[:, j] == x
                side[0][x + 1] += (1 - soft[at]).sum()
                side[1][x + 1] += soft[at].sum()
            rate = np.log(side[1] / side[1].sum()) - np.log(side[0] / side[0].sum())
            odds += rate[votes[:, j] + 1]
        soft = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    names = sorted({("kind", k) for k, _, _ in rows} | {("long", n) for _, n, _ in rows} | {(j, x) for _, _, v in rows for j, x in enumerate(v) if x}, key=str)
    design = np.array([[1.0] + [float((k if a == "kind" else n if a == "long" else v[a]) == b) for a, b in names] for k, n, v in rows])
    w = np.zeros(design.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= 2.0 * (design.T @ (p - soft) / len(rows) + 1e-4 * w)
    return 1 / (1 + np.exp(-design @ w))


def test_added_spans_equal_a_plain_em(spark):
    texts = [t for t in PII if not t or len(t) < 500]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = [(i, c) for i, t in enumerate(texts) for c in plain_candidates(t)]
    chance = plain_chances([(c[2], c[3], c[4]) for _, c in found])
    assert all(abs(p - 0.5) > 1e-6 for p in chance)
    want = {i: [] for i in range(len(texts))}
    base = {i: [(a, nth, k, e) for a, nth, k, e in brute_spans(t)] for i, t in enumerate(texts)}
    for (i, (a, e, kind, _, _, _)), p in zip(found, chance, strict=True):
        if kind in pii.KINDS[4:] and p >= 0.5 and not any(x < e and a < y for x, _, _, y in base[i]):
            want[i].append((a, pii.KINDS.index(kind), kind, e))
    assert sum(map(len, want.values())) > 5
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r.spans == ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(base[r.doc_id] + want[r.doc_id])), texts[r.doc_id]


def test_running_folds(spark):
    rng = random.Random(13)
    rows = [(i, [rng.randrange(50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 1000])]
    frame = spark.createDataFrame(rows, "i int, x array<bigint>")
    got = frame.select("i", arrays.running(F.col("x"), lambda a, b: a + b).alias("s"), arrays.running(F.col("x"), F.greatest).alias("m"), F.flatten(arrays.blocks(F.col("x"))).alias("b")).collect()
    for r in got:
        x = rows[r.i][1]
        assert r.s == list(itertools.accumulate(x)) and r.m == list(itertools.accumulate(x, max)) and r.b == x


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Unset", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Cluster)
    table = scratch.materialise(spark.range(3), "three")
    path = table._scratch_path
    assert table.count() == 3 and os.path.exists(path)
    scratch.discard(table)
    assert not os.path.exists(path)


def test_columns_that_clash_with_the_models(spark):
    rng = random.Random(15)
    rows = [(i, speak(rng, t := rng.choice(list(TONGUES)), 30), t) for i in range(200)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ("_n", "_first", "_share", "_id", "_y", "score", "held_out", "quality", "cosine", "rejected")
    clash = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    labels = spark.createDataFrame([(i, int(t == "aa"), 0) for i, _, t in rows], "doc_id long, quality int, toxic int")
    wide = labels.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_id", "_y", "text", "score"))])
    for run in (lambda d, x: language_id.identify(d, language_id.fit(d)), lambda d, x: quality.score(d, quality.fit(d, x))):
        assert bag(map(tuple, run(plain, labels).collect())) == bag(map(tuple, run(clash, wide).collect()))
    assert sorted(r.doc_id for r in language_id.drop_rejected(clash, language_id.fit(clash)).collect()) == sorted(r.doc_id for r in language_id.drop_rejected(plain, language_id.fit(plain)).collect())


def test_long_rows_are_counted_like_short_ones(spark):
    initial, inner = map(set, token_counts.byte_level_pieces(token_counts.default_vocabulary(), lone_blank=True))
    texts = ["a" * 5000, CORPUS[88][1] * 3, "é" * 4000 + " x " * 2000]
    want = []
    for i, t in enumerate(texts):
        each = [greedy_bounded(w, initial, inner) for w in ws(t)]
        want.append((i, len(each), sum(each), max(each)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bag(map(tuple, token_counts.token_counts(frame, lone_blank=True).collect())) == bag(want)


def greedy_bounded(word, initial, inner):
    """Greedy pieces, no piece being longer than the longest of the vocabulary; the empty initial piece counts."""
    longest = max(map(len, initial | inner))
    n = at = 0
    pieces = initial
    while at < len(word):
        size = next((s for s in range(min(longest, len(word) - at), -1, -1) if word[at : at + s] in pieces), None)
        n, at, pieces = n + 1, at + size, inner
    return n


def test_shape_sees_the_whole_of_a_long_opaque_string(spark):
    texts = ["a" * 70 + "0123456789bcdefghij", "a" * 80 + "1", "0123456789bcdefghij" + "a" * 70]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("kind = 'secret'")
    assert {r.doc_id: r["shape"] for r in found.collect()} == {0: 1, 1: -1, 2: 1}


def test_labelers_learn_what_is_reliable():
    patterns = [("card", 1, (1, 1, 1, 0), 500), ("card", 1, (-1, 0, 0, -1), 2000), ("number", 1, (1, 1, 1, 0), 40), ("number", 0, (-1, 0, -1, -1), 400), ("secret", 2, (1, 0, 1, 1), 30)]
    m = pii.learn(patterns)
    chance = lambda k, long, v: sum(m.weights.get(f, 0) for f in pii._features(k, long, v))
    assert m.reliability["pattern"][1][2] > 0.8 > m.reliability["pattern"][0][2]
    assert chance("number", 1, (1, 1, 1, 0)) > 0 > chance("number", 0, (-1, 0, -1, -1)) and chance("secret", 2, (1, 0, 1, 1)) > 0
