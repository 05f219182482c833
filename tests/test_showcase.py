import json
import threading
import urllib.error
import urllib.request

import pytest

from tidelog import showcase
from tidelog.client import Broker


def test_settings():
    good = {"7": 7, "64": 64, "1048576": 1 << 20}
    bad = ("1048577", "-8", "00", " 9", "3e2", "1_000", "64MB", "9" * 30, "", None)
    assert {x: showcase.cap_setting(x) for x in (*good, *bad)} == good | dict.fromkeys(bad, 200)
    assert showcase.Feeder.__init__.__defaults__[0] == 200 * 1024 * 1024


def test_feed(spark, tmp_path):
    f = showcase.Feeder(Broker(spark, str(tmp_path / "log"), clock=lambda: 0), cap_bytes=1 << 40)
    for _ in range(3):
        f.produce()
    assert f.consume() == 3 and f.consume() == 0
    f.walk()
    web = showcase.server(f)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{web.server_port}"
        feed = json.load(urllib.request.urlopen(f"{at}/feed"))
        assert list(feed) == ["status", "uptimeSeconds", "produced", "partitions", "recent", "assignment", "diskBytes", "diskCapBytes", "memBytes", "startedAt"]
        assert feed["status"] == "live" and feed["produced"] == 3 and feed["assignment"] == [0, 1, 2, 3] and feed["diskBytes"] > 0
        assert feed["partitions"] == [{"partition": p, "nextOffset": n} for p, n in enumerate([1, 1, 1, 0])] and [r["payload"] for r in feed["recent"]] == ["msg-0", "msg-1", "msg-2"]
        assert b"/feed" in urllib.request.urlopen(at).read()
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/other")
    finally:
        web.shutdown()
    f.cap = f.disk
    f.walk()
    f.cap = 1 << 40
    f.walk()
    f.produce()
    assert f.snapshot()["status"] == "paused-at-cap" and f.n == 3


def test_demo(spark, tmp_path):
    lines = []
    seen = showcase.demo(Broker(spark, str(tmp_path / "log"), clock=lambda: 0), lines.append, ticks=1, per_tick=8)
    assert seen == {f"msg-{i}" for i in range(16)} and lines[-1] == "nothing lost"
    assert "consumer-1 owns 0,1" in lines and "consumer-1 owns 0,1,2,3" in lines
