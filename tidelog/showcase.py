"""A live feed over a small log, its JSON snapshot and page, and the two-act demonstration (O-27, O-82, O-83, O-101, O-102)."""

from __future__ import annotations

import json
import resource
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

from tidelog import schema as S
from tidelog.client import Admin, Broker, GroupConsumer, Producer
from tidelog.schema import LogError

TOPIC, GROUP, PARTITIONS = "feed", "showcase", 4
LIVE, PAUSED = "live", "paused-at-cap"
# The cap in MiB where the setting names none, and the largest that it may name.
DEFAULT_CAP_MB, MOST_CAP_MB = 200, 1 << 20


def cap_setting(raw: str | None, default: int = DEFAULT_CAP_MB) -> int:
    """A positive whole number of MiB, up to MOST_CAP_MB, from a setting's text; anything else is the default."""
    try:
        n = int(raw or "")
    except ValueError:
        return default
    return n if 0 < n <= MOST_CAP_MB and raw.strip() == raw and "_" not in raw else default


class Feeder:
    """Three steps that the caller repeats: produce, consume, walk. A full disk or a refused write pauses
    producing for good; reading goes on."""

    def __init__(self, broker: Broker, cap_bytes: int = DEFAULT_CAP_MB << 20, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.broker, self.cap, self.now = broker, cap_bytes, now
        if TOPIC not in broker.store.topics_by_name:
            Admin(broker).create_topic(TOPIC, PARTITIONS)
        self.producer, self.consumer = Producer(broker), GroupConsumer(broker, GROUP, TOPIC)
        self.started, self.paused, self.n, self.disk = now(), False, 0, 0
        self.next, self.recent, self.owned = [0] * PARTITIONS, deque(maxlen=S.RING), self.consumer.assignment()

    def produce(self) -> None:
        """One message; only an acknowledged one counts."""
        if self.paused:
            return
        try:
            self.producer.produce(TOPIC, self.n % PARTITIONS, f"msg-{self.n}".encode())
        except LogError as e:
            self.paused |= e.name == "WRITE_FAILED"
            return
        self.n += 1

    def consume(self) -> int:
        records = self.consumer.poll()
        for p, o, payload in records:
            self.recent.append({"partition": p, "offset": o, "payload": payload.decode(errors="replace")})
            self.next[p] = max(self.next[p], o + 1)
        if records:
            try:
                self.consumer.commit()
            except LogError:
                pass  # the next poll joins again
        self.owned = self.consumer.assignment()
        return len(records)

    def walk(self) -> None:
        self.disk = self.broker.store.disk_bytes()
        self.paused |= self.disk >= self.cap

    def snapshot(self) -> dict:
        """The ten fields of the feed; lists are never null."""
        # The fields' names and order.
        return {
            "status": PAUSED if self.paused else LIVE,
            "uptimeSeconds": int((self.now() - self.started).total_seconds()),
            "produced": self.n,
            "partitions": [{"partition": p, "nextOffset": n} for p, n in enumerate(self.next)],
            "recent": list(self.recent),
            "assignment": self.owned,
            "diskBytes": self.disk,
            "diskCapBytes": self.cap,
            "memBytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
            "startedAt": self.started.isoformat(timespec="seconds").replace("+00:00", "Z"),
        }


PAGE = """<!doctype html><title>tidelog</title><pre id=f></pre><script>
const show = async () => { document.getElementById('f').textContent = JSON.stringify(await (await fetch('/feed')).json(), null, 1) };
show(); setInterval(show, 1000);</script>"""


def server(feeder: Feeder, port: int = 0) -> HTTPServer:
    """GET / is a page, GET /feed the snapshot; nothing else is there."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/": ("text/html; charset=utf-8", PAGE.encode()), "/feed": ("application/json", json.dumps(feeder.snapshot()).encode())}.get(self.path)
            self.send_response(200 if found else 404)
            if found:
                self.send_header("Content-Type", found[0])
                self.send_header("Cache-Control", "no-store")
            self.end_headers()
            self.wfile.write(found[1] if found else b"not found")

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def demo(broker: Broker, say: Callable[[str], None] = print, ticks: int = 5, per_tick: int = 20) -> set[str]:
    """Two consumers share four partitions; one dies without a word; the other takes over from the last
    committed offsets. Gives all payloads seen: none may be missing, some may come twice."""
    Admin(broker).create_topic("demo", 4)
    rows = broker.store.spark
    one, two = GroupConsumer(broker, "demo", "demo"), GroupConsumer(broker, "demo", "demo")
    seen: set[str] = set()
    n = 0
    for act in (1, 2):
        say(f"act {act}")
        if act == 2:
            two.abandon()
            say("consumer-2 is gone")
        owned = None
        for _ in range(ticks):
            batch = [(i % 4, bytearray(f"msg-{i}".encode()), i) for i in range(n, n + per_tick)]
            broker.store.append("demo", rows.createDataFrame(batch, "partition int, payload binary, n int"), ["n"])
            n += per_tick
            for name, c in (("consumer-1", one), ("consumer-2", two))[: 3 - act]:
                records = c.poll()
                if name == "consumer-1" and c.assignment() != owned:
                    owned = c.assignment()
                    say(f"{name} owns {','.join(map(str, owned))}")
                seen |= {payload.decode() for _, _, payload in records}
                say(f"{name} +{len(records)} (total {len(seen)}) on partitions {','.join(map(str, sorted({p for p, _, _ in records})))}")
                c.commit()
    say("nothing lost" if len(seen) == n else f"{n - len(seen)} lost")
    return seen
