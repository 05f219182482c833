"""Command line: create-topic, topics, produce, consume.

    python -m tidelog.cli --data DIR create-topic NAME --partitions N
    python -m tidelog.cli --data DIR topics
    python -m tidelog.cli --data DIR produce TOPIC [-p PARTITION] [-m MESSAGE]      (lines of standard input without -m)
    python -m tidelog.cli --data DIR consume TOPIC [-p PARTITION] [-o OFFSET] [-f]
    python -m tidelog.cli --data DIR consume TOPIC -g GROUP [-f]

With -f consume goes on polling, else it ends with what is there.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from itertools import islice

from tidelog import schema as S
from tidelog.client import Admin, Broker, Consumer, GroupConsumer
from tidelog.schema import LogError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--data", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create-topic")
    c.add_argument("topic")
    c.add_argument("--partitions", type=int, default=1)
    sub.add_parser("topics")
    c = sub.add_parser("produce")
    c.add_argument("topic")
    c.add_argument("-p", "--partition", type=int, default=0)
    c.add_argument("-m", "--message", default="")
    c = sub.add_parser("consume")
    c.add_argument("topic")
    c.add_argument("-p", "--partition", type=int)
    c.add_argument("-o", "--offset", type=int)
    c.add_argument("-f", "--follow", action="store_true")
    c.add_argument("-g", "--group")
    return p


#: A line of standard input that is longer than a payload may be, and this much, ends the reading.
LINE_CAP = S.MAX_PAYLOAD + 1024
#: Lines that go into one append.
LINES_AT_ONCE = 1000


def _lines(stdin) -> Iterator[str]:
    """Lines without their ends. What comes before a line that is too long is given."""
    while line := stdin.readline(LINE_CAP + 1):
        if len(line.encode()) > LINE_CAP:
            raise LogError("MSG_TOO_LARGE", f"a line of more than {LINE_CAP} bytes")
        yield line.removesuffix("\n").removesuffix("\r")


def _follow(broker: Broker, a: argparse.Namespace, out) -> None:
    offset, reader = a.offset or 0, Consumer(broker)
    while True:
        records = reader.fetch(a.topic, a.partition or 0, offset, S.DEFAULT_WAIT_MS if a.follow else 1)
        for o, payload in records:
            print(f"{o}\t{payload.decode(errors='replace')}", file=out)
            offset = o + 1
        if not records and not a.follow:
            return


def _group(broker: Broker, a: argparse.Namespace, out) -> None:
    """Prints and commits batch by batch. A stale commit goes on after the rejoin; an unknown member ends."""
    c = GroupConsumer(broker, a.group, a.topic)
    while (records := c.poll()) or (a.follow and not broker.store.stopping):
        for p, o, payload in records:
            print(f"{p}\t{o}\t{payload.decode(errors='replace')}", file=out)
        try:
            if records:
                c.commit()
        except LogError as e:
            if e.name != "STALE_GENERATION":
                raise
    c.close()


def run(spark, argv: list[str], stdin=sys.stdin, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.command == "consume" and a.group and (a.partition is not None or a.offset is not None):
        print("-p and -o don't go with -g", file=sys.stderr)
        return 2
    try:
        broker = Broker(spark, a.data)
        if a.command == "create-topic":
            Admin(broker).create_topic(a.topic, a.partitions)
        elif a.command == "topics":
            for name, n in Admin(broker).topics():
                print(f"{name}\t{n}", file=out)
        elif a.command == "produce":
            lines = iter([a.message]) if a.message else _lines(stdin)
            while batch := list(islice(lines, LINES_AT_ONCE)):
                rows = spark.createDataFrame([(a.partition, bytearray(x.encode()), i) for i, x in enumerate(batch)], "partition int, payload binary, n int")
                for r in broker.store.append(S.check_name(a.topic), rows, ["n"]).orderBy("offset").toLocalIterator():
                    print(r.offset, file=out)
        elif a.group:
            _group(broker, a, out)
        else:
            _follow(broker, a, out)
    except LogError as e:
        print(f"error {e.code}: {e}", file=sys.stderr)
        return 1
    return 0


def main() -> int:
    from pyspark.sql import SparkSession

    return run(SparkSession.builder.appName("tidelog").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
