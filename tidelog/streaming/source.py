"""The log as a Spark data source, for batch and stream (O-05, O-10, O-40, O-43): format "tidelog".

    spark.dataSource.register(TideLog)
    spark.readStream.format("tidelog").option("root", ...).option("topic", ...).load()

A stream's position is the next offset of each partition. Only what the newest manifest acknowledges is read,
by one task for each partition and batch of files whose range of offsets is wanted.

With maxRecordsPerPartition a stream takes no more than so many records of a partition at once. Spark doesn't tell
a source where a stream that starts again stands, so such a stream must have a `name`, under which each
committed position is kept in <root>/_streams; it is at most one batch behind Spark's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


@dataclass
class Slice(InputPartition):
    folder: str
    partition: int
    lo: int
    hi: int


class _Log:
    def __init__(self, options: dict):
        from pyarrow import fs

        self.topic = options["topic"]
        root = options["root"]
        self.files, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.at = f"{path.rstrip('/')}/{self.topic}"
        self.most = int(options.get("maxrecordsperpartition", 0))
        self.positions = f"{path.rstrip('/')}/_streams/{options['name']}.{self.topic}.json" if "name" in options else None
        if self.most and not self.positions:
            raise ValueError("maxRecordsPerPartition needs a name")

    def position(self) -> list[int] | None:
        from pyarrow import fs

        if self.positions is None or self.files.get_file_info(self.positions).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self.positions) as f:
            return json.loads(f.read())

    def keep_position(self, following: list[int]) -> None:
        if self.positions:
            folder, _, name = self.positions.rpartition("/")
            self.files.create_dir(folder, recursive=True)
            temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with self.files.open_output_stream(temp) as f:
                f.write(json.dumps(following).encode())
            self.files.move(temp, self.positions)

    def manifest(self) -> dict:
        from pyarrow import fs

        found = [f.path for f in self.files.get_file_info(fs.FileSelector(f"{self.at}/_manifest")) if f.base_name.endswith(".json") and f.base_name[0] != "."]
        with self.files.open_input_stream(max(found)) as f:
            return json.loads(f.read())

    def slices(self, start: list[int], end: list[int]) -> list[Slice]:
        return [
            Slice(f"{self.at}/data/{b['name']}/partition={p}", int(p), max(lo, start[int(p)]), min(hi, end[int(p)]))
            for b in self.manifest()["batches"]
            for p, (lo, hi, _) in b["parts"].items()
            if max(lo, start[int(p)]) < min(hi, end[int(p)])
        ]

    def read(self, s: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        rows = ds.dataset(s.folder, filesystem=self.files, format="parquet").to_batches(columns=["offset", "payload"], filter=(ds.field("offset") >= s.lo) & (ds.field("offset") < s.hi))
        for b in rows:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([s.partition] * b.num_rows, pa.int32()), b.column(0).cast(pa.int64()), b.column(1).cast(pa.binary())], names=["partition", "offset", "payload"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Slice]:
        log = _Log(self.options)
        end = log.manifest()["next"]
        return log.slices([0] * len(end), end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _Log(self.options).read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.last: list[int] | None = None

    def initialOffset(self) -> dict:
        n = len(_Log(self.options).manifest()["next"])
        start = json.loads(self.options.get("start", "{}"))
        self.last = [int(start.get(str(p), 0)) for p in range(n)]
        _Log(self.options).keep_position(self.last)
        return {"next": self.last}

    def latestOffset(self) -> dict:
        """The frontier; with maxRecordsPerPartition, no farther than so many records past the last offer or,
        in a stream that starts again, past the last committed position."""
        log = _Log(self.options)
        end = log.manifest()["next"]
        if log.most:
            before = self.last or log.position() or [0] * len(end)
            end = [min(e, b + log.most) for e, b in zip(end, before, strict=True)]
        self.last = end
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.last = end["next"]
        return _Log(self.options).slices(start["next"], end["next"])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _Log(self.options).read(partition)

    def commit(self, end: dict) -> None:
        _Log(self.options).keep_position(end["next"])


class TideLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return "partition int, offset bigint, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
