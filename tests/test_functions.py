"""Budgets, assignment, the coordinator, codecs, imports and reports against plain models."""

import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import report
from tidelog import schema as S
from tidelog.functions import checksum, wire
from tidelog.operators import scan
from tidelog.operators.fold import Coordinator
from tidelog.schema import LogError
from tidelog.sources import binary_log as B


def model_fetch(log, entries, budget):
    out, served = [], False
    for ord_, (p, start) in enumerate(entries):
        for offset, size in log.get(p, []):
            if offset < start:
                continue
            cost = size + S.RECORD_OVERHEAD
            if budget <= 0 or (served and cost > budget):
                break
            out.append((ord_, offset))
            budget -= cost
            served = True
    return out


def test_shared_budget_equals_the_record_loop(spark):
    rng = random.Random(5)
    for _ in range(12):
        log = {p: [(o, rng.choice([0, 5, 30, 200])) for o in range(rng.randrange(8))] for p in range(4)}
        frame = spark.createDataFrame([(p, o, bytearray(n)) for p, r in log.items() for o, n in r] or [(9, 0, bytearray())], "partition int, offset bigint, payload binary")
        entries = [(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 6))]
        budget = rng.choice([0, 1, 30, 60, 150, 400, 1000])
        got = sorted((r.ord, r.offset) for r in scan.fetch_many(frame, entries, budget).collect())
        assert got == model_fetch(log, entries, budget), (log, entries, budget)


def test_seek_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).select(F.col("id").alias("offset"), (F.col("id") % 4).cast("int").alias("partition"), F.lit("x").alias("payload")).write.partitionBy("partition").parquet(path)
    plan = scan.seek(spark.read.parquet(path), 1, 500)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan and "GreaterThanOrEqual(offset,500)" in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("jlsbd"), st.integers(1, 6), st.integers(0, 900)), max_size=60))
def test_every_generation_is_an_exact_partition(events):
    c, now, mine = Coordinator(2000), 0, {}
    for op, conn, wait in events:
        now += wait
        before = c.groups["g"].generation if "g" in c.groups else 0
        c.sweep(now)
        try:
            if op == "j":
                mine[conn] = c.join(conn, "g", "t", 5, now)[:2]
            elif op == "d":
                c.drop(conn)
            elif conn in mine:
                {"l": lambda: c.leave("g", mine[conn][0]), "s": lambda: c.commit("g", *mine[conn], {0: 1}, now), "b": lambda: c.heartbeat("g", mine[conn][0], now)}[op]()
        except LogError as e:
            assert e.code in (12, 13)
        if g := c.groups.get("g"):
            assert g.generation >= before
            if g.members:
                assert sorted(p for m in g.members.values() for p in m.owned) == list(range(5))
                sizes = [len(g.members[k].owned) for k in sorted(g.members)]
                assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


def test_members_sort_as_text():
    c = Coordinator()
    for i in range(11):
        c.join(i, "g", "t", 12, 0)
    assert [m for m, x in sorted(c.groups["g"].members.items()) if 0 in x.owned] == ["m1"] and 2 in c.groups["g"].members["m10"].owned


def test_checksum_vectors(spark):
    assert checksum.crc32c(b"123456789") == 0xE3069283 and checksum.crc32c(b"") == 0 and checksum.crc32c(bytes(32)) == 0x8A9136AA
    data = [b"", b"a", b"123456789", bytes(range(256))]
    assert checksum.crc32c_many(data).tolist() == [checksum.crc32c(x) for x in data]
    frame = spark.createDataFrame([(bytearray(x),) for x in data] + [(None,)], "p binary")
    assert [r[0] for r in frame.coalesce(1).select(checksum.crc32c_column(F.col("p"))).collect()] == [*[checksum.crc32c(x) for x in data], None]


EXAMPLES = {"u8": 1, "u16": 12, "u32": 7, "u64": 2**63 + 5, "str": "orders", "blob": b"\x00\xff"}


def example(fields):
    return {n: [example(k), example(k)] if isinstance(k, list) else EXAMPLES[k] for n, k in fields}


@pytest.mark.parametrize("name", sorted(wire.MESSAGES))
def test_messages_round_trip_and_are_strict(name):
    message = example(wire.MESSAGES[name][1])
    body = wire.encode(name, message)
    assert wire.decode(name, body) == message and wire.unframe(wire.frame(name, message) + b"next") == (name, message, b"next")
    for cut in range(len(body)):
        with pytest.raises(LogError):
            wire.decode(name, body[:cut])
    with pytest.raises(LogError):
        wire.decode(name, body + b"\x00")


def test_frames_that_are_refused():
    for data, code in ((b"\x00\x00\x00\x01", 7), (b"\x00\x00\x00\x02\x02\x01", 7), (b"\xff\xff\xff\xff", 6), (b"\x00\x00\x00\x02\x01\x63", 7)):
        with pytest.raises(LogError) as e:
            wire.unframe(data)
        assert e.value.code == code
    with pytest.raises(LogError):
        wire.decode("Fetch", wire.encode("Produce", {"topic": "t", "partition": 2**32 - 1, "payload": b""}))


def test_binary_import(spark, tmp_path):
    good = B.record(b"keep1") + B.record(b"keep2")
    assert list(B.parse(good + b"\xde\xad\xbe", B.frontier(len(good)))) == [(b"keep1", True), (b"keep2", True)]
    assert list(B.parse(good + B.record(b"unacked"), B.frontier(len(good))))[-1] == (b"unacked", False)
    assert list(B.parse(b"", None)) == [] and list(B.parse(b"", b"")) == []
    flipped = bytes([*good[:-1], good[-1] ^ 1])
    for log, mark in ((flipped, B.frontier(len(good))), (good, B.frontier(len(good) + 1)), (good, B.frontier(len(good) - 1)), (good, B.frontier(len(good))[:-1] + b"\x00"), (good, None)):
        with pytest.raises(B.Refused):
            list(B.parse(log, mark))
    for p, payload in ((0, good), (1, b"")):
        (tmp_path / "t" / str(p)).mkdir(parents=True)
        (tmp_path / "t" / str(p) / "log").write_bytes(payload)
        (tmp_path / "t" / str(p) / "frontier").write_bytes(B.frontier(len(payload)))
    got = B.read_binary(spark, str(tmp_path / "t")).orderBy("offset").collect()
    assert [(r.partition, r.offset, bytes(r.payload), r.acknowledged) for r in got] == [(0, 0, b"keep1", True), (0, 1, b"keep2", True)]
    (tmp_path / "lines.txt").write_text("a\nbb\n")
    assert [bytes(r.payload) for r in B.read_lines(spark, str(tmp_path / "lines.txt")).collect()] == [b"a", b"bb"]


def test_report_round_trip(tmp_path):
    its = [report.iteration(10.0, [1.0, 2.0, 3.0, 4.0], [2.0, 5.0], 1024), report.iteration(10.0, [1.5] * 3, [], 1024)]
    assert its[0]["ack_p50_ms"] == 2.0 and its[0]["ack_p99_ms"] == 4.0 and its[1]["e2e_p99_ms"] == 0.0
    with pytest.raises(ValueError):
        report.build("t", "", its)
    root = tmp_path / "measured"
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    root.mkdir()
    git("init", "-q")
    with pytest.raises(RuntimeError):
        report.build("t", "a box", its, root=str(root))
    (root / "f").write_text("1")
    git("add", "f")
    git("commit", "-qm", "one")
    r = report.build("t", "a box", its, root=str(root), caveats=["closed loop"])
    assert len(r["commit"]) == 12
    (root / "f").write_text("2")
    assert report.provenance(str(root)) == r["commit"] + "-dirty"
    path = report.write(r, str(tmp_path))
    assert path.name == report.file_name(r)
    section = report.render(__import__("json").loads(path.read_text()))
    text = f"head\n{report.BEGIN}\nold\n{report.END}\ntail\n"
    assert report.splice(text, section) == f"head\n{section}\ntail\n" and report.splice(report.splice(text, section), section) == report.splice(text, section)
    with pytest.raises(ValueError):
        report.splice("no marks", section)
    with pytest.raises(RuntimeError):
        report.provenance("/")


def test_running_total_by_blocks(spark):
    from tidelog.operators import analytics as A

    rows = spark.range(100).select(F.col("id").alias("tick"), (F.col("id") % 7).alias("new")).where("tick % 5 <> 0")
    got = {r.tick: r.total for r in A.running_total(rows, "tick", "new", block=8).collect()}
    total, want = 0, {}
    for t in (t for t in range(100) if t % 5):
        total += t % 7
        want[t] = total
    assert got == want
    assert A.running_total(rows.where("false"), "tick", "new").count() == 0


def test_audits_of_empty_and_unacknowledged_logs(spark):
    from tidelog.operators import append, audit

    log = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "partition int, offset bigint, payload string")
    manifest = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "partition int, next_offset bigint")
    assert audit.damage(log, manifest).count() == 0  # what lies past the frontier doesn't count
    assert [(r.partition, r.problem) for r in audit.damage(log.where("partition = 0"), manifest).collect()] == [(1, "missing")]
    assert audit.damage(log.where("false"), manifest.where("partition = 2")).count() == 0
    assert [tuple(r) for r in append.byte_frontier(log).orderBy("partition").collect()] == [(0, 18, 2), (1, 9, 1)]


def test_assignment_of_more_members_than_partitions(spark):
    from tidelog.operators import group

    members = spark.createDataFrame([("g", m) for m in ("m1", "m2", "m10")], "grp string, member string")
    assert sorted((r.member, r.partition) for r in group.range_assignment(members, ["grp"], 2).collect()) == [("m1", 0), ("m10", 1)]
    assert sorted((r.member, r.partition) for r in group.range_assignment(members, ["grp"], 5).collect()) == [("m1", 0), ("m1", 1), ("m10", 2), ("m10", 3), ("m2", 4)]


def model_holdings(lives, partitions):
    """Who holds what in each generation, from the lives alone: (generation, member) -> partitions."""
    log = sorted([(a, 1, m) for m, a, z in lives] + [(z, 0, m) for m, a, z in lives])
    out = {}
    for generation, (moment, _, _) in enumerate(log, 1):
        live = sorted(m for m, a, z in lives if a <= moment < z)
        each, extra = divmod(partitions, len(live) or 1)
        for i, m in enumerate(live):
            start = i * each + min(i, extra)
            out[generation, m] = list(range(start, start + each + (i < extra)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["m1", "m10", "m2", "m3", "m30", "m4", "m5"]), st.integers(0, 5), st.integers(0, 5)), max_size=25), st.integers(0, 5))
def test_holdings_fold_equals_every_generation_by_itself(steps, partitions):
    from tidelog.operators import group

    lives, ends = [], {}
    for m, wait, length in steps:  # lives of one member come one after the other, some of them without length
        start = ends.get(m, 0) + wait
        lives.append((m, start, start + length))
        ends[m] = start + length + (length == 0)
    state, got = group.Holdings(partitions), {}
    for moment, joined, m, counts in sorted([(a, 1, m, a < z) for m, a, z in lives] + [(z, 0, m, a < z) for m, a, z in lives]):
        for member, first, last, held in state.happened(moment, joined, m, counts):
            for generation in range(first, last + 1):
                assert (generation, member) not in got
                got[generation, member] = held
    assert got == model_holdings(lives, partitions) and not state.begun


def lives_of(spark, rows):
    names = ", ".join(f"('{g}', '{m}', {a}, {z})" for g, m, a, z in rows)
    at = lambda c: f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {c})"
    return spark.sql(f"SELECT grp, member, {at('a')} AS first_beat, {at('z')} AS dead_at FROM VALUES {names} AS t(grp, member, a, z)")


def test_assignment_of_generations_makes_no_row_for_each_live_member(spark, monkeypatch):
    from tidelog.operators import group

    rows = [(g, f"m{i}", i % 9, 20 + i * 7 % 11) for g in "ab" for i in range(40)]
    assert group.holdings(lives_of(spark, rows), 4).count() < 4 * len(rows)
    monkeypatch.setattr(group, "STEP", 7)
    monkeypatch.setattr(group, "AT_ONCE", 11)
    runs = group.holdings(lives_of(spark, rows), 4).cache()
    assert runs.agg(F.max(F.col("last") - F.col("first"))).first()[0] == 6
    got = {(r.grp, r.generation, r.member): r.held for r in group.each_generation(runs).collect()}
    want = model_holdings([r[1:] for r in rows if r[0] == "a"], 4)
    assert got == {(g, *k): v for g in "ab" for k, v in want.items()} and len(want) > 1500
    runs.unpersist()
    assert group.holdings(lives_of(spark, rows).where("false"), 4).count() == 0
    unborn = lives_of(spark, rows).selectExpr("nullif(grp, 'b') AS grp", "member", "first_beat", "CAST(NULL AS TIMESTAMP_NTZ) AS dead_at")
    assert group.holdings(unborn, 4).count() == 0


def test_ownership_changes_come_from_runs(spark):
    from tidelog.operators import group

    runs = spark.createDataFrame([("g", "m", 1, 4, [0]), ("g", "m", 5, 9, [0]), ("g", "m", 10, 11, []), ("g", "m", 12, 20, [0]), ("g", "m", 21, 30, [2, 10]), ("h", "m", 3, 3, [0])], "grp string, member string, first bigint, last bigint, held array<bigint>")
    assert sorted(map(tuple, group.ownership_changes(runs).collect())) == [("g", "m", 1, "0"), ("g", "m", 21, "2,10"), ("h", "m", 3, "0")]


def test_liveness_is_strict(spark):
    from tidelog.operators import group

    beats = spark.sql("SELECT 'g' AS grp, 'm' AS member, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts FROM VALUES (0), (2), (5) AS t(s)")
    got = group.sessions(beats, "2 SECONDS").orderBy("session").collect()
    assert [(r.first_beat.second, r.last_beat.second, r.dead_at.second) for r in got] == [(0, 2, 4), (5, 5, 7)]


def test_offsets_by_blocks(spark, monkeypatch):
    from tidelog.operators import append

    monkeypatch.setattr(append, "BLOCK_BITS", 2)
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.choice([None, -5, -4, -1, 0, 3, 4, 100, 2**40]), i) for i in range(200)]
    base = spark.createDataFrame([(1, 1000)], "partition int, next_offset bigint")
    for order in (["a", "b"], ["c", "b"]):
        frame = spark.createDataFrame([(*r, None if r[1] is None else f"{r[1] + 5:020}") for r in rows], "partition int, a bigint, b int, c string")
        want = {}
        for p in range(3):
            own = sorted((r for r in rows if r[0] == p), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            want |= {r[2]: i for i, r in enumerate(own)}
        got = append.assign_offsets(frame, order)
        assert {r.b: r.offset for r in got.collect()} == want and sorted(got.columns) == ["a", "b", "c", "offset", "partition"]
        assert {r.b: r.offset for r in append.assign_offsets(frame, order, base).collect()} == {r[2]: want[r[2]] + 1000 * (r[0] == 1) for r in rows}
    assert append.assign_offsets(frame.where("false"), ["a"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=12), st.integers(0, 400), st.integers(0, 255), st.integers(1, 5))
def test_records_are_read_like_one_by_one(payloads, at, flip, at_once):
    log = b"".join(map(B.record, payloads))
    if at < len(log):
        log = log[:at] + bytes([log[at] ^ flip]) + log[at + 1 :]
    want, start = [], 0
    while start < len(log):
        size = int.from_bytes(log[start : start + 4], "big") if start + 8 <= len(log) else len(log)
        payload = log[start + 8 : start + 8 + size]
        if len(payload) < size or checksum.crc32c(payload) != int.from_bytes(log[start + 4 : start + 8], "big"):
            want.append((start, None))
            break
        want.append((start, payload))
        start += 8 + size
    assert list(B._records(log, at_once)) == want
