"""The coordinator as a stateful streaming processor, keyed by group (O-30..O-38).

Control events (grp, seq, ts, conn_id, op, generation) change a group's state; a processing-time timer sweeps
silent members. The state is the same Coordinator as in the batch fold, kept as JSON between batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog import schema as S
from tidelog.operators.fold import OUTCOME, Coordinator, Group, Member, apply_event

COLUMNS = [x.split()[0] for x in OUTCOME.split(", ")]
KINDS = {"grp": "object", "seq": "Int64", "op": "object", "member": "object", "generation": "Int64", "code": "Int64", "rejoin": "object", "swept": "Int64", "owned": "object"}


def dump(c: Coordinator, name: str) -> str:
    return json.dumps({"ids": c._ids, "group": asdict(c.groups[name]) if name in c.groups else None})


def restore(text: str | None, name: str, timeout_ms: int) -> Coordinator:
    c = Coordinator(timeout_ms)
    if text:
        found = json.loads(text)
        c._ids = found["ids"]
        if g := found["group"]:
            members = {k: Member(**m) for k, m in g["members"].items()}
            c.groups[name] = Group(g["topic"], g["partitions"], g["generation"], members, {int(k): v for k, v in g["committed"].items()})
    return c


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype(KINDS)


class GroupProcessor(StatefulProcessor):
    def __init__(self, partitions: int, timeout_ms: int):
        self.partitions, self.timeout_ms = partitions, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("coordinator", "state string")

    def _load(self, name: str) -> Coordinator:
        return restore(self.state.get()[0] if self.state.exists() else None, name, self.timeout_ms)

    def _keep(self, c: Coordinator, name: str, now: int) -> None:
        self.state.update((dump(c, name),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        g = c.groups.get(name)
        if g and g.members:
            self.handle.registerTimer(max(now, min(m.last_beat for m in g.members.values()) + self.timeout_ms) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        c = self._load(name)
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, conn, op, generation in events[["seq", "conn_id", "op", "generation"]].itertuples(index=False):
            member, at, code, rejoin, swept, owned = apply_event(c, name, self.partitions, op, int(conn), now, None if pd.isna(generation) else int(generation), None)
            out.append((name, seq, op, member, at, code, rejoin, swept, owned))
        self._keep(c, name, now)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        name, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        c = self._load(name)
        dead = c.sweep(now)
        g = c.groups.get(name)
        self._keep(c, name, now)
        last = g.generation if g else 0
        yield _frame([(name, None, "sweep", m, last - len(dead) + i, 0, None, 1, "") for i, (_, m) in enumerate(dead, 1)])

    def close(self) -> None:
        pass


def membership_stream(control: DataFrame, partitions: int, timeout_ms: int = S.SESSION_TIMEOUT_MS) -> DataFrame:
    """Outcomes of a stream of control events. Needs the RocksDB state store; times are processing times."""
    return control.groupBy("grp").transformWithStateInPandas(GroupProcessor(partitions, timeout_ms), OUTCOME, "Append", "ProcessingTime")
