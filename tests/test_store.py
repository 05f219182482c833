"""Acceptance scenarios of the durable log, its groups, and what happens when writes fail."""

import io

import pytest

from tidelog import cli
from tidelog import schema as S
from tidelog.client import Admin, Broker, Consumer, GroupConsumer, Producer
from tidelog.schema import LogError
from tidelog.sources.faults import Fault, ScriptedFiles
from tidelog.sources.store import Files, Store


def rows(spark, items):
    return spark.createDataFrame([(p, bytearray(x.encode()), i) for i, (p, x) in enumerate(items)], "partition int, payload binary, n int")


def code(f, *a, **k):
    with pytest.raises(LogError) as e:
        f(*a, **k)
    return e.value.code


def test_offsets_are_dense_across_restarts(spark, tmp_path):
    root = str(tmp_path / "log")
    b = Broker(spark, root)
    Admin(b).create_topic("t", 2)
    assert [r.offset for r in b.store.append("t", rows(spark, [(0, "one"), (0, "or"), (0, "three")]), ["n"]).orderBy("offset").collect()] == [0, 1, 2]
    again = Broker(spark, root)
    assert Producer(again).produce("t", 0, b"after") == 3
    assert Consumer(again).fetch("t", 0, 2) == [(2, b"three"), (3, b"after")]
    assert Consumer(again).fetch("t", 1, 0) == [] and Consumer(again).fetch("t", 0, 2**63) == []
    assert again.store.frontier("t") == [4, 0] and again.store.manifest("t").bytes == [8 * 4 + 15, 0]


def test_unnamed_files_are_never_read(spark, tmp_path):
    root = str(tmp_path / "log")

    class Stops(Files):
        stop = False

        def write_new(self, path, text):
            if self.stop and "_manifest" in path:
                raise OSError("stopped between data and manifest")
            super().write_new(path, text)

    files = Stops(spark)
    s = Store(spark, root, files)
    s.create_topic("t", 1)
    s.append("t", rows(spark, [(0, "kept")]), ["n"])
    files.stop = True
    assert code(s.append, "t", rows(spark, [(0, "lost")]), ["n"]) == 11
    assert code(s.append, "t", rows(spark, [(0, "more")]), ["n"]) == 11  # sticky until opened anew
    assert s.log("t").count() == 1
    anew = Store(spark, root)
    assert len(list((tmp_path / "log" / "t" / "data").iterdir())) == 1
    assert anew.append("t", rows(spark, [(0, "next")]), ["n"]).first().offset == 1


def test_damage_refuses_the_store(spark, tmp_path):
    import shutil

    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 1)
    s.append("t", rows(spark, [(0, "a"), (0, "b")]), ["n"])
    s.append("t", rows(spark, [(0, "c")]), ["n"])
    shutil.rmtree(next((tmp_path / "log" / "t" / "data").glob("000000000002*/partition=0")))
    with pytest.raises(RuntimeError, match="damaged"):
        Store(spark, str(tmp_path / "log"))


def test_leftover_topic_goes(spark, tmp_path):
    (tmp_path / "log" / "half" / "data").mkdir(parents=True)
    assert Store(spark, str(tmp_path / "log")).topics_by_name == {} and not (tmp_path / "log" / "half").exists()


def test_a_stream_batch_is_appended_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 1)
    for _ in range(2):
        s.append("t", rows(spark, [(0, "x")]), ["n"], applied="q-0")
    assert s.frontier("t") == [1]


def test_every_code(spark, tmp_path):
    b = Broker(spark, str(tmp_path / "log"), clock=lambda: 0)
    admin, s = Admin(b), b.store
    admin.create_topic("t", 4)
    assert code(s.fetch, "ghost", [(0, 0)]) == 1 and code(Producer(b).produce, "ghost", 0, b"") == 1
    assert code(admin.create_topic, "t", 1) == 2
    assert code(Producer(b).produce, "t", 4, b"") == 3 and code(s.fetch, "t", [(0, 0), (9, 0)], 1) == 3
    assert [code(admin.create_topic, n, 1) for n in ("", "A", "a\n", "-a", "a" * 129, "é")] == [4] * 6
    assert code(Producer(b).produce, "ghost", 0, bytes(S.MAX_PAYLOAD + 1)) == 5
    assert code(s.fetch, "t", []) == 7
    assert code(s.fetch, "t", [(0, 0)], S.MAX_WAIT_MS + 1) == 8 and code(s.fetch, "t", [(0, 0)], 1, S.MAX_FETCH_BYTES + 1) == 8
    assert code(admin.create_topic, "u", 0) == 8 and code(admin.create_topic, "u", 17) == 8
    assert code(s.fetch, "t", [(0, 0)] * 17) == 9
    c = GroupConsumer(b, "g", "t")
    assert code(b.groups.commit, "g", c.member, 99, {}, 0) == 12 and code(b.groups.commit, "g", "m99", 99, {}, 0) == 13
    b.stop()
    assert code(Producer(b).produce, "t", 0, b"") == 10
    assert s.fetch("t", [(0, 0), (1, 5)]) == [(0, []), (1, [])]


def test_groups_take_over_and_resume(spark, tmp_path):
    now = [0]
    b = Broker(spark, str(tmp_path / "log"), clock=lambda: now[0])
    Admin(b).create_topic("t", 4)
    b.store.append("t", rows(spark, [(n % 4, f"msg-{n}") for n in range(40)]), ["n"])
    one, two = GroupConsumer(b, "g", "t"), GroupConsumer(b, "g", "t")
    assert two.generation == 2 and two.assignment() == [2, 3]
    assert {p for p, _, _ in one.poll()} == {0, 1} and one.generation == 2
    one.commit()
    assert code(b.groups.commit, "g", two.member, 2, {0: 1}, 0) == 12  # another member's partition
    two.abandon()
    seen = one.poll()
    assert one.generation == 3 and one.assignment() == [0, 1, 2, 3] and {p for p, _, _ in seen} == {2, 3} and len(seen) == 20
    one.commit()
    other = GroupConsumer(b, "h", "t")
    assert len(other.poll()) == 40
    one.close()
    anew = Broker(spark, str(tmp_path / "log"), clock=lambda: now[0])
    back = GroupConsumer(anew, "g", "t")
    assert back.cursors == dict.fromkeys(range(4), 10) and back.poll() == []


def test_silent_members_are_swept_strictly(spark, tmp_path):
    now = [0]
    b = Broker(spark, str(tmp_path / "log"), clock=lambda: now[0])
    Admin(b).create_topic("t", 2)
    one, two = GroupConsumer(b, "g", "t"), GroupConsumer(b, "g", "t")
    now[0] = S.SESSION_TIMEOUT_MS
    b.sweep()
    assert len(b.groups.groups["g"].members) == 2
    one.beat()
    now[0] += 1
    b.sweep()
    assert list(b.groups.groups["g"].members) == [one.member] and b.groups.groups["g"].generation == 3
    assert code(two.commit) == 13
    assert two.poll() == [] and two.generation == 4 and two.member == "m3"


def test_positions_that_cannot_be_read_refuse_the_group(spark, tmp_path):
    b = Broker(spark, str(tmp_path / "log"))
    Admin(b).create_topic("t", 1)
    at = tmp_path / "log" / "_groups" / "g"
    at.mkdir(parents=True)
    (at / "000000000001.json").write_text("{")
    assert code(GroupConsumer, b, "g", "t") == 7 and code(GroupConsumer, b, "g", "t") == 7
    GroupConsumer(b, "h", "t")
    Admin(b).create_topic("u", 1)
    assert code(GroupConsumer, b, "h", "u") == 7


def test_command_line(spark, tmp_path):
    def say(*argv, text=""):
        out = io.StringIO()
        assert cli.run(spark, ["--data", str(tmp_path / "log"), *argv], io.StringIO(text), out) == 0
        return out.getvalue()

    say("create-topic", "t", "--partitions", "2")
    assert say("topics") == "t\t2\n"
    assert say("produce", "t", "-p", "1", text="a\nb\n") == "0\n1\n"
    assert say("produce", "t", "-m", "c") == "0\n"
    assert say("consume", "t", "-p", "1", "-o", "1") == "1\tb\n"
    assert say("consume", "t", "-g", "g") == "0\t0\tc\n1\t0\ta\n1\t1\tb\n"
    assert say("consume", "t", "-g", "g") == ""
    assert cli.run(spark, ["--data", str(tmp_path / "log"), "consume", "t", "-g", "g", "-o", "1"]) == 2
    assert cli.run(spark, ["--data", str(tmp_path / "log"), "produce", "ghost", "-m", "x"]) == 1


def test_a_reader_that_opens_inside_an_append_takes_nothing(spark, tmp_path):
    root = str(tmp_path / "log")

    class Watched(Files):
        opened = 0

        def write_new(self, path, text):
            if "_manifest" in path and self.exists(f"{root}/t/data"):
                Watched.opened += 1
                assert Store(spark, root).log("t").count() == Watched.opened - 1
            super().write_new(path, text)

    s = Store(spark, root, Watched(spark))
    s.create_topic("t", 1)
    for i in range(2):
        s.append("t", rows(spark, [(0, f"r{i}")]), ["n"])
    assert Watched.opened == 2 and [bytes(r.payload) for r in Store(spark, root).log("t").orderBy("offset").collect()] == [b"r0", b"r1"]


def test_clean_takes_what_nobody_can_name_any_more(spark, tmp_path):
    root = str(tmp_path / "log")
    s = Store(spark, root)
    s.create_topic("t", 1)
    s.append("t", rows(spark, [(0, "a")]), ["n"])
    (tmp_path / "log" / "t" / "data" / "000000000009-dead").mkdir()

    class Slow(Files):
        def write_new(self, path, text):
            if "_manifest" in path and len(self.list(f"{root}/t/data")) > 1:
                assert s.clean("t") == 0 and s.clean("t", older_than=-10) == 2  # the dead writer's and this one's
            super().write_new(path, text)

    assert code(Store(spark, root, Slow(spark)).append, "t", rows(spark, [(0, "b")]), ["n"]) == 11
    assert [bytes(r.payload) for r in Store(spark, root).log("t").collect()] == [b"a"]
    assert Store(spark, root).append("t", rows(spark, [(0, "c")]), ["n"]).first().offset == 1


def test_compaction_keeps_offsets_and_scans_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 2)
    for i in range(3):
        s.append("t", rows(spark, [(0, f"a{i}"), (1, f"b{i}")]), ["n"])
    before = sorted(map(tuple, s.log("t").collect()))
    assert s.log("t")._jdf.queryExecution().toString().count("FileScan") == 1
    s.compact("t", records_each=2)
    assert len(s.manifest("t").batches) == 1 and sorted(map(tuple, s.log("t").collect())) == before
    assert s.clean("t", older_than=-10) == 3
    anew = Store(spark, str(tmp_path / "log"))
    anew.audit("t")
    assert anew.frontier("t") == [3, 3] and anew.fetch("t", [(1, 2)], 1) == [(1, [(2, b"b2")])]
    assert anew._within_reach("t", [(0, 3)]).count() == 0 and len(anew._within_reach("t", [(0, 2)]).inputFiles()) == len(list((tmp_path / "log" / "t" / "data").glob("*/partition=0/*.parquet")))


def test_an_audit_sees_a_changed_payload(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 1)
    s.append("t", rows(spark, [(0, "abcd"), (0, "efgh")]), ["n"])
    s.audit("t")
    folder = next((tmp_path / "log" / "t" / "data").glob("*/partition=0"))
    spark.sql("SELECT id AS offset, CAST('abcd' AS BINARY) AS payload, 0 AS p FROM range(2)").coalesce(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(RuntimeError, match="damaged"):
        s.audit("t")
    m = s.manifest("t").following()
    m.batches[0]["size"] = s.files.size(str(folder.parent))
    s._put_manifest("t", m)
    Store(spark, str(tmp_path / "log"))
    with pytest.raises(RuntimeError, match="partition 0 changed"):
        s.audit("t")


def test_scripted_faults(spark, tmp_path):
    files = ScriptedFiles(spark, Fault("write_new", "_manifest", nth=3), Fault("write_new", "_topic", keep=5))
    s = Store(spark, str(tmp_path / "log"), files)
    assert code(s.create_topic, "t", 1) == 11 and s.topics_by_name == {} and [f.operation for f in files.unspent()] == ["write_new"]
    s.create_topic("t", 1)
    assert code(s.append, "t", rows(spark, [(0, "x")]), ["n"]) == 11 and files.unspent() == []
    assert s.log("t").count() == 0 and Store(spark, str(tmp_path / "log"), files).append("t", rows(spark, [(0, "y")]), ["n"]).count() == 1


def test_a_late_retry_of_a_stream_is_known(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 1)
    for name in ("q-0", "p-0", "q-1", "q-0", "p-0", "a-b-7"):
        s.append("t", rows(spark, [(0, name)]), ["n"], applied=name)
    assert s.frontier("t") == [4] and s.manifest("t").applied == {"q": 1, "p": 0, "a-b": 7}


def test_stop_waits_for_appends_but_not_for_ever(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    s.create_topic("t", 1)
    with s._work():
        assert not s.stop(seconds=0.1)
    assert s.stop(seconds=0.1) and code(s.produce, "t", 0, b"x") == 10


def test_lines_that_are_too_long(spark, tmp_path):
    assert list(cli._lines(io.StringIO("a\r\n\nb"))) == ["a", "", "b"]
    whole = "x" * cli.LINE_CAP
    given = cli._lines(io.StringIO(f"a\n{whole}y\n"))
    assert next(given) == "a" and code(lambda: next(given)) == 5


def test_group_consume_polls_on(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    b = Broker(spark, root)
    Admin(b).create_topic("t", 1)
    polls, poll = [], GroupConsumer.poll

    def counted(self):
        polls.append(1)
        if len(polls) == 2:
            self.broker.store.append("t", rows(spark, [(0, "late")]), ["n"])
        if len(polls) == 4:
            self.broker.stop()
        return poll(self) if len(polls) < 4 else []

    monkeypatch.setattr(GroupConsumer, "poll", counted)
    out = io.StringIO()
    assert cli.run(spark, ["--data", root, "consume", "t", "-g", "g", "-f"], io.StringIO(), out) == 0
    assert out.getvalue() == "0\t0\tlate\n" and len(polls) == 4
