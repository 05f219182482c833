"""The durable log: topics as Parquet, manifests as the commit point (O-20..O-26, O-50..O-52, O-90..O-93, O-103).

    <root>/<topic>/_topic.json                     name, partitions, time of making; written last when a topic is made
    <root>/<topic>/data/<batch>/partition=<p>/     records, ordered by offset; a batch is one append
    <root>/<topic>/_manifest/<version>.json        next offset by partition, and the batches that count
    <root>/_groups/<group>/<version>.json          topic and committed positions

A write puts its data first and then a new manifest version, by renaming a finished file to a name that must
not exist yet: readers take the highest version, so they see either all of an append or nothing. A manifest
keeps each batch's size and, by partition, its range of offsets and a checksum: opening holds sizes and ranges
against what is there, reads go to the files whose ranges they need, in one scan, and audit() reads it all.

Files that no manifest names are never read. Opening deletes nothing, as another writer may be about to name
them; an append that fails removes its own, and clean() what writers left that stopped for good.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import append, audit, scan
from tidelog.schema import LogError

GROUPS = "_groups"
#: How long a stop waits for what is under way; how old unnamed files are that clean() takes.
STOP_SECONDS, LEFTOVER_SECONDS = 5.0, 86_400.0


class Files:
    """File operations through Hadoop's file systems, so that a root may be on any of them. Tests override
    single calls to make them fail."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def age(self, path: str) -> float:
        """Seconds since the last change of a folder's own entries."""
        p, fs = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def write_new(self, path: str, text: str) -> None:
        """A finished file under a name that nobody has yet, or an error and no such file."""
        folder, _, name = path.rpartition("/")
        temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
        p, fs = self._at(temp)
        fs.mkdirs(p.getParent())
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.hsync() if hasattr(stream, "hsync") else None
        stream.close()
        target, _ = self._at(path)
        if fs.exists(target) or not fs.rename(p, target):
            fs.delete(p, False)
            raise OSError(f"{path} exists")


@dataclass
class Manifest:
    """batches: name, size (bytes of files), parts ({partition: [first offset, next offset, checksum]})."""

    version: int = 0
    next: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)
    batches: list[dict] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)  # the last batch of each stream, so that a retry is no second append

    def following(self) -> Manifest:
        return Manifest(self.version + 1, list(self.next), list(self.bytes), list(self.batches), dict(self.applied))


class Store:
    """Topics under a root. One writer for each topic; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, files: Files | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), files or Files(spark)
        self.degraded: set[tuple[str, int]] = set()
        self.stopping = False
        self._idle, self._busy = threading.Condition(), 0
        self.topics_by_name: dict[str, int] = {}
        self.open()

    # boot ----------------------------------------------------------------------------------------------

    def open(self) -> None:
        """Finds the topics. One that has no description isn't there yet; an empty folder of such a one goes.
        Damage refuses the whole store."""
        self.files.make(self.root)
        for name in self.files.list(self.root):
            at = f"{self.root}/{name}"
            if not S.valid_name(name):
                continue
            if not self.files.exists(f"{at}/_topic.json"):
                if not self.files.size(at) and not self.files.list(f"{at}/_manifest"):
                    self.files.remove(at)
                continue
            self.topics_by_name[name] = json.loads(self.files.read(f"{at}/_topic.json"))["partitions"]
            self._refuse(name, self._misfit(name, self.manifest(name)))

    def _misfit(self, topic: str, m: Manifest) -> list[str]:
        """What a manifest's ranges and sizes say against the files, without reading them."""
        reached = [0] * len(m.next)
        for b in m.batches:
            if self.files.size(f"{self.root}/{topic}/data/{b['name']}") != b["size"]:
                return [f"batch {b['name']} isn't as written"]
            for p, (lo, hi, _) in b["parts"].items():
                if lo != reached[int(p)]:
                    return [f"partition {p} gap"]
                reached[int(p)] = hi
        return [f"partition {p} missing" for p, (n, r) in enumerate(zip(m.next, reached, strict=True)) if n != r]

    def _refuse(self, topic: str, problems: list[str]) -> None:
        if problems:
            raise RuntimeError(f"{topic} is damaged: {', '.join(problems)}")

    def audit(self, topic: str) -> None:
        """Reads all: acknowledged records must be there, once, without a gap, and be what was written."""
        m = self.manifest(topic)
        self._refuse(topic, self._misfit(topic, m))
        if not any(m.next):
            return
        frontier = self.spark.createDataFrame([(p, n) for p, n in enumerate(m.next)], "partition int, next_offset bigint")
        rows = self._records(topic, m)
        self._refuse(topic, [f"partition {r.partition} {r.problem}" for r in audit.damage(rows, frontier).collect()])  # a row for each partition at most
        want = dict.fromkeys(map(str, range(len(m.next))), 0)
        for b in m.batches:
            for p, (_, _, checksum) in b["parts"].items():
                want[p] ^= checksum
        self._refuse(topic, [f"partition {r.partition} changed" for r in self._sums(rows).collect() if r.checksum != want[str(r.partition)]])

    def _sums(self, rows: DataFrame) -> DataFrame:
        """A row for each partition: first and next offset, file bytes, and a checksum whatever the order."""
        size = F.octet_length("payload").cast("bigint") + S.DISK_OVERHEAD
        return rows.groupBy("partition").agg(F.min("offset").alias("lo"), (F.max("offset") + 1).alias("hi"), F.sum(size).alias("bytes"), F.bit_xor(F.xxhash64("offset", "payload")).alias("checksum"))

    def clean(self, topic: str, older_than: float = LEFTOVER_SECONDS) -> int:
        """The writer's task: removes files that no manifest names and that nobody has written to for so long.
        A new manifest version comes first, so that an append begun before it can't name its files any more."""
        self.partitions(topic)
        folder = f"{self.root}/{topic}/data"
        old = [b for b in self.files.list(folder) if self.files.age(f"{folder}/{b}") >= older_than]
        m = self.manifest(topic).following()
        old = [b for b in old if b not in {x["name"] for x in m.batches}]
        if old:
            self._put_manifest(topic, m)
        for b in old:
            self.files.remove(f"{folder}/{b}")
        return len(old)

    def compact(self, topic: str, records_each: int = 1 << 20) -> None:
        """Rewrites a topic's batches as one, in pieces of records_each offsets. Offsets and positions stay; the
        old files stay for readers of older versions until clean() takes them."""
        with self._work():
            m = self.manifest(topic)
            if len(m.batches) < 2:
                return
            rows = self._records(topic, m).withColumn("_piece", F.floor(F.col("offset") / records_each))
            dealt = rows.repartition(max(1, -(-sum(m.next) // records_each)), "partition", "_piece").sortWithinPartitions("partition", "offset").drop("_piece")
            before = {str(p): [0, n] for p, n in enumerate(m.next) if n}
            batch = self._write(topic, m.version + 1, dealt)
            if {p: x[:2] for p, x in batch["parts"].items()} != before:
                self.files.remove(f"{self.root}/{topic}/data/{batch['name']}")
                raise RuntimeError(f"{topic} is damaged: its records aren't those of its manifest")
            following = m.following()
            following.batches = [batch]
            self._put_manifest(topic, following)

    @contextmanager
    def _work(self) -> Iterator[None]:
        """A step that a stop waits for."""
        with self._idle:
            self._running()
            self._busy += 1
        try:
            yield
        finally:
            with self._idle:
                self._busy -= 1
                self._idle.notify_all()

    # catalog -------------------------------------------------------------------------------------------

    def create_topic(self, name: str, partitions: int) -> None:
        self._running()
        S.check_name(name)
        if not 1 <= partitions <= S.MAX_PARTITIONS:
            raise LogError("CAP_EXCEEDED", f"{partitions} partitions")
        if name in self.topics_by_name:
            raise LogError("TOPIC_EXISTS", name)
        if len(self.topics_by_name) >= S.MAX_TOPICS:
            raise LogError("CAP_EXCEEDED", "topics")
        at = f"{self.root}/{name}"
        try:
            self._put_manifest(name, Manifest(1, [0] * partitions, [0] * partitions))
            self.files.write_new(f"{at}/_topic.json", json.dumps({"name": name, "partitions": partitions, "made_at": datetime.now(UTC).isoformat(timespec="seconds")}))
        except Exception as e:
            self.files.remove(at)
            raise LogError("WRITE_FAILED", str(e)) from e
        self.topics_by_name[name] = partitions

    def topics(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.topics_by_name.items()), "name string, partitions int")

    def partitions(self, topic: str) -> int:
        if topic not in self.topics_by_name:
            raise LogError("UNKNOWN_TOPIC", topic)
        return self.topics_by_name[topic]

    def check_partition(self, topic: str, partition: int) -> None:
        if not 0 <= partition < self.partitions(topic):
            raise LogError("BAD_PARTITION", f"{topic}/{partition}")

    def _running(self) -> None:
        if self.stopping:
            raise LogError("SHUTTING_DOWN")

    # manifests -----------------------------------------------------------------------------------------

    def _latest(self, folder: str) -> tuple[int, str | None]:
        versions = [int(n.removesuffix(".json")) for n in self.files.list(folder) if n.endswith(".json") and n[0] != "."]
        return (max(versions), self.files.read(f"{folder}/{max(versions):012d}.json")) if versions else (0, None)

    def manifest(self, topic: str) -> Manifest:
        _, text = self._latest(f"{self.root}/{topic}/_manifest")
        return Manifest(**json.loads(text)) if text else Manifest()

    def _put_manifest(self, topic: str, m: Manifest) -> None:
        self.files.write_new(f"{self.root}/{topic}/_manifest/{m.version:012d}.json", json.dumps(m.__dict__))

    # writes --------------------------------------------------------------------------------------------

    def append(self, topic: str, rows: DataFrame, order: list[str], applied: str | None = None) -> DataFrame:
        """Appends rows (partition, payload, and the columns of order) and gives them with their offsets, once
        they are durable. A row with a bad partition or too large a payload rejects all, before any write.
        applied names a stream's batch, as "stream-number": one at or below the stream's last changes nothing."""
        with self._work():
            return self._append(topic, rows, order, applied)

    def _append(self, topic: str, rows: DataFrame, order: list[str], applied: str | None) -> DataFrame:
        n = self.partitions(topic)
        m = self.manifest(topic)
        stream, _, number = (applied or "").rpartition("-")
        if applied is not None and int(number) <= m.applied.get(stream, -1):
            return self.spark.createDataFrame([], S.RECORD)
        payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
        rows = rows.select(F.col("partition").cast("int").alias("partition"), payload.alias("payload"), *order)
        checks = rows.groupBy("partition").agg(F.max(F.octet_length("payload")).alias("most")).collect()
        if any((r.most or 0) > S.MAX_PAYLOAD for r in checks):
            raise LogError("MSG_TOO_LARGE")
        for r in checks:
            if r.partition is None:
                raise LogError("BAD_PARTITION", "null")
            self.check_partition(topic, r.partition)
            if (topic, r.partition) in self.degraded:
                raise LogError("WRITE_FAILED", f"{topic}/{r.partition} rejects writes until it is opened anew")
        base = self.spark.createDataFrame([(p, x) for p, x in enumerate(m.next)], "partition int, next_offset bigint")
        batch = None
        try:
            numbered = append.assign_offsets(rows, order, base).select("offset", "payload", "partition")
            batch = self._write(topic, m.version + 1, numbered.repartition(n, "partition").sortWithinPartitions("partition", "offset"))
            following = m.following()
            following.batches.append(batch)
            for p, (_, hi, _) in batch["parts"].items():
                following.next[int(p)] = hi
            for p, size in batch.pop("bytes").items():
                following.bytes[p] += size
            if applied is not None:
                following.applied[stream] = int(number)
            self._put_manifest(topic, following)
        except Exception as e:
            if batch is not None and batch["name"] not in {b["name"] for b in self.manifest(topic).batches}:
                self.files.remove(f"{self.root}/{topic}/data/{batch['name']}")
            self.degraded |= {(topic, r.partition) for r in checks}
            raise LogError("WRITE_FAILED", str(e)) from e
        return self._read(topic, [batch]).select(F.lit(topic).alias("topic"), "partition", "offset", "payload")

    def _write(self, topic: str, version: int, rows: DataFrame) -> dict:
        """Writes rows as a batch and gives what a manifest says of it, and its file bytes by partition."""
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{topic}/data/{name}"
        rows.withColumn("p", F.col("partition")).write.partitionBy("partition").parquet(at)
        batch = {"name": name, "size": self.files.size(at), "parts": [f.removeprefix("partition=") for f in self.files.list(at) if f.startswith("partition=")]}
        found = self._sums(self._read(topic, [batch])).collect()  # a row for each partition
        return batch | {"parts": {str(r.partition): [r.lo, r.hi, r.checksum] for r in sorted(found, key=lambda r: r.partition)}, "bytes": {r.partition: r.bytes for r in found}}

    def produce(self, topic: str, partition: int, payload: bytes) -> int:
        """Appends one record and gives its offset."""
        S.check_name(topic)
        if len(payload) > S.MAX_PAYLOAD:
            raise LogError("MSG_TOO_LARGE", str(len(payload)))
        self.check_partition(topic, partition)
        one = self.spark.createDataFrame([(partition, bytearray(payload), 0)], "partition int, payload binary, n int")
        return self.append(topic, one, ["n"]).first().offset

    # reads ---------------------------------------------------------------------------------------------

    def _read(self, topic: str, batches: list[dict]) -> DataFrame:
        """Records of batches, or of those of their partitions that are listed, in one scan."""
        paths = [f"{self.root}/{topic}/data/{b['name']}/partition={p}" for b in batches for p in b["parts"]]
        if not paths:
            return self.spark.createDataFrame([], "offset bigint, payload binary, partition int")
        files = self.spark.read.schema("offset bigint, payload binary, p int").option("recursiveFileLookup", "true").parquet(*paths)
        return files.select("offset", "payload", F.col("p").alias("partition"))

    def _records(self, topic: str, m: Manifest) -> DataFrame:
        return self._read(topic, m.batches)

    def log(self, topic: str) -> DataFrame:
        """All acknowledged records as of now: topic, partition, offset, payload."""
        self.partitions(topic)
        return self._records(topic, self.manifest(topic)).select(F.lit(topic).alias("topic"), "partition", "offset", "payload")

    def _within_reach(self, topic: str, entries: list[tuple[int, int]]) -> DataFrame:
        """The log without the files that lie before or beyond what any of the entries can be served."""
        m, wanted = self.manifest(topic), {}
        for b in m.batches:
            parts = {p: x for p, x in b["parts"].items() if any(int(p) == q and o < x[1] and x[0] < o + scan.MOST_RECORDS for q, o in entries)}
            if parts:
                wanted[b["name"]] = b | {"parts": parts}
        return self._read(topic, list(wanted.values()))

    def frontier(self, topic: str) -> list[int]:
        self.partitions(topic)
        return self.manifest(topic).next

    def fetch(self, topic: str, entries: list[tuple[int, int]], max_wait_ms: int = 0, max_bytes: int = 0, check: Callable[[], None] = lambda: None, clock: Callable[[], float] = time.monotonic, tick: float = 0.05) -> list[tuple[int, list[tuple[int, bytes]]]]:
        """(partition, [(offset, payload)]) for each entry in request order. Parks until any entry has data or
        the wait is over; check runs before each attempt; at the end of the wait all groups are empty."""
        S.check_name(topic)
        self.check_fetch(entries, max_wait_ms, max_bytes)
        for p, _ in entries:
            self.check_partition(topic, p)
        deadline = clock() + (max_wait_ms or S.DEFAULT_WAIT_MS) / 1000
        while True:
            following = self.frontier(topic)
            if any(o < following[p] for p, o in entries):
                check()
                served = scan.fetch_many(self._within_reach(topic, entries), [(p, min(o, 2**62)) for p, o in entries], max_bytes or S.DEFAULT_FETCH_BYTES).collect()  # bounded by max_bytes
                groups: list[tuple[int, list]] = [(p, []) for p, _ in entries]
                for r in sorted(served, key=lambda r: (r.ord, r.offset)):
                    groups[r.ord][1].append((r.offset, bytes(r.payload)))
                return groups
            if self.stopping or clock() >= deadline:
                return [(p, []) for p, _ in entries]
            time.sleep(min(tick, max(0.0, deadline - clock())))

    @staticmethod
    def check_fetch(entries: list[tuple[int, int]], max_wait_ms: int, max_bytes: int) -> None:
        if not entries:
            raise LogError("MALFORMED", "no entries")
        if len(entries) > S.MAX_ENTRIES:
            raise LogError("FETCH_TOO_WIDE", str(len(entries)))
        if max_wait_ms > S.MAX_WAIT_MS or max_bytes > S.MAX_FETCH_BYTES:
            raise LogError("CAP_EXCEEDED")

    # positions -----------------------------------------------------------------------------------------

    def load_positions(self, group: str) -> tuple[str, dict[int, int]] | None:
        _, text = self._latest(f"{self.root}/{GROUPS}/{group}")
        if text is None:
            return None
        try:
            found = json.loads(text)
            return found["topic"], {int(k): int(v) for k, v in found["offsets"].items()}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise LogError("MALFORMED", f"positions of {group} can't be read") from e

    def save_positions(self, group: str, topic: str, offsets: dict[int, int], check: Callable[[], None]) -> None:
        """check runs again just before the new version gets its name: a fenced commit never becomes visible."""
        folder = f"{self.root}/{GROUPS}/{group}"
        version, _ = self._latest(folder)
        check()
        try:
            self.files.write_new(f"{folder}/{version + 1:012d}.json", json.dumps({"topic": topic, "offsets": {str(k): v for k, v in sorted(offsets.items())}}))
        except Exception as e:
            raise LogError("WRITE_FAILED", str(e)) from e

    def disk_bytes(self) -> int:
        return self.files.size(self.root)

    def stop(self, seconds: float = STOP_SECONDS, streams: tuple = ()) -> bool:
        """No more writes; parked fetches return empty; streams end. Waits for appends that are under way, but
        no longer than so many seconds, and says whether all of them came to an end."""
        self.stopping = True
        end = time.monotonic() + seconds
        for q in streams:
            q.stop()
        with self._idle:
            return self._idle.wait_for(lambda: not self._busy, max(0.0, end - time.monotonic()))
