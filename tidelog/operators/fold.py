"""The group coordinator as a state machine (O-30..O-38), and its fold over control events.

The same transitions serve the in-process broker, the batch fold below and the streaming processor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tidelog import schema as S
from tidelog.schema import LogError


@dataclass
class Member:
    id: str
    conn: int
    generation: int
    last_beat: int
    owned: list[int] = field(default_factory=list)


@dataclass
class Group:
    topic: str
    partitions: int
    generation: int = 0
    members: dict[str, Member] = field(default_factory=dict)
    committed: dict[int, int] = field(default_factory=dict)

    def rebalance(self) -> None:
        """One more generation; partitions go in contiguous runs to members in text order."""
        self.generation += 1
        names = sorted(self.members)
        each, extra = divmod(self.partitions, len(names) or 1)
        start = 0
        for i, name in enumerate(names):
            count = each + (i < extra)
            self.members[name].owned = list(range(start, start + count))
            start += count


class Coordinator:
    """Groups, members and positions; times are milliseconds that the caller passes in."""

    def __init__(self, timeout_ms: int = S.SESSION_TIMEOUT_MS, load: Callable[[str], tuple[str, dict[int, int]] | None] | None = None, save: Callable[[str, str, dict[int, int], Callable[[], None]], None] | None = None):
        self.timeout_ms, self._load, self._save = timeout_ms, load, save
        self.groups: dict[str, Group] = {}
        self._broken: dict[str, LogError] = {}
        self._ids = 0

    def _group(self, name: str, topic: str, partitions: int) -> Group:
        """A group's positions are read once; a failed read sticks, and the topic on record wins."""
        if name in self._broken:
            raise self._broken[name]
        if name not in self.groups:
            if len(self.groups) >= S.MAX_GROUPS:
                raise LogError("CAP_EXCEEDED", "groups")
            try:
                found = self._load(name) if self._load else None
            except LogError as e:
                self._broken[name] = e
                raise
            bound, positions = found or (topic, {})
            self.groups[name] = Group(bound, partitions, committed=dict(positions))
        g = self.groups[name]
        if g.topic != topic:
            raise LogError("MALFORMED", f"group reads {g.topic}")
        return g

    def join(self, conn: int, name: str, topic: str, partitions: int, now: int) -> tuple[str, int, list[tuple[int, int]]]:
        """(member, generation, [(partition, next)]). A connection that already has a live member joins again
        as that member and bumps nothing."""
        g = self._group(name, topic, partitions)
        m = next((m for m in g.members.values() if m.conn == conn), None)
        if m is None:
            if len(g.members) >= S.MAX_MEMBERS:
                raise LogError("CAP_EXCEEDED", "members")
            self._ids += 1
            m = g.members[f"m{self._ids}"] = Member(f"m{self._ids}", conn, 0, now)
            g.rebalance()
        m.generation, m.last_beat = g.generation, now
        return m.id, g.generation, [(p, g.committed.get(p, 0)) for p in m.owned]

    def _member(self, name: str, member: str) -> tuple[Group, Member]:
        g = self.groups.get(name)
        if g is None or member not in g.members:
            raise LogError("UNKNOWN_MEMBER", member)
        return g, g.members[member]

    def heartbeat(self, name: str, member: str, now: int) -> bool:
        """Whether the member must join again; as long as it hasn't, every beat says so."""
        g, m = self._member(name, member)
        m.last_beat = now
        return m.generation != g.generation

    def fence(self, name: str, member: str, generation: int) -> str:
        """The group's topic, for a member of the current generation. Liveness isn't refreshed."""
        g, _ = self._member(name, member)
        if generation != g.generation:
            raise LogError("STALE_GENERATION", f"{generation}, now {g.generation}")
        return g.topic

    def commit(self, name: str, member: str, generation: int, offsets: dict[int, int], now: int) -> None:
        """Overlays positions. They may go back or past the end; only ownership and generation are checked.
        The record is written, the fence is checked again, and only then does the record become current."""
        self.fence(name, member, generation)
        g, m = self._member(name, member)
        if any(p not in m.owned for p in offsets):
            raise LogError("STALE_GENERATION", "partition of another member")
        m.last_beat = now
        merged = g.committed | offsets
        if self._save:
            self._save(name, g.topic, merged, lambda: self.fence(name, member, generation))
        g.committed = merged

    def leave(self, name: str, member: str) -> None:
        g, _ = self._member(name, member)
        del g.members[member]
        g.rebalance()

    def drop(self, conn: int) -> int:
        """All members of a lost connection die at once, one bump for each group."""
        hit = 0
        for g in self.groups.values():
            dead = [k for k, m in g.members.items() if m.conn == conn]
            for k in dead:
                del g.members[k]
            if dead:
                g.rebalance()
                hit += 1
        return hit

    def sweep(self, now: int) -> list[tuple[str, str]]:
        """Members silent for more than the timeout die, each with a bump of its own."""
        out = []
        for name, g in self.groups.items():
            for k in sorted(k for k, m in g.members.items() if now - m.last_beat > self.timeout_ms):
                del g.members[k]
                g.rebalance()
                out.append((name, k))
        return out


OUTCOME = "grp string, seq bigint, op string, member string, generation bigint, code bigint, rejoin boolean, swept bigint, owned string"


def apply_event(c: Coordinator, grp: str, partitions: int, op: str, conn: int, now: int, generation: int | None, offsets: dict[int, int] | None) -> tuple:
    """One control event at its time: (member, generation, code, rejoin, swept, owned)."""
    swept = len(c.sweep(now))
    g = c.groups.get(grp)
    m = next((m for m in g.members.values() if m.conn == conn), None) if g else None
    member, rejoin, code = (m.id if m else None), None, 0
    try:
        if op == "join":
            member, _, _ = c.join(conn, grp, "events", partitions, now)
        elif op == "conn_drop":
            c.drop(conn)
        elif member is None:
            raise LogError("UNKNOWN_MEMBER")
        elif op == "heartbeat":
            rejoin = c.heartbeat(grp, member, now)
        elif op == "commit":
            c.commit(grp, member, m.generation if generation is None else generation, offsets or {}, now)
        elif op == "leave":
            c.leave(grp, member)
        else:
            raise LogError("MALFORMED", op)
    except LogError as e:
        code = e.code
    g = c.groups.get(grp)
    owned = g.members[member].owned if g and member in g.members else []
    return member, g.generation if g else 0, code, rejoin, swept, ",".join(map(str, owned))


def membership(control: DataFrame, partitions: int, timeout_ms: int = S.SESSION_TIMEOUT_MS) -> DataFrame:
    """Outcomes of control events (grp, seq, ts, conn_id, op, generation), in seq order within each group.

    Groups are independent here, so member numbers count within a group. Events stream through in order;
    a group's memory is its state, of 32 members at most, not its events.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, c = None, Coordinator(timeout_ms)
        for b in batches:
            rows = []
            for grp, seq, ms, conn, op, generation in b[["grp", "seq", "ms", "conn_id", "op", "generation"]].itertuples(index=False):
                if grp != name:
                    name, c = grp, Coordinator(timeout_ms)
                member, now_at, code, rejoin, swept, owned = apply_event(c, grp, partitions, op, int(conn), int(ms), None if pd.isna(generation) else int(generation), None)
                rows.append((grp, seq, op, member, now_at, code, rejoin, swept, owned))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUTCOME.split(", ")])

    events = control.selectExpr("grp", "seq", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 AS BIGINT) AS ms", "conn_id", "op", "generation")
    n = int(control.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't joined into fewer tasks
    return events.repartition(n, "grp").sortWithinPartitions("grp", "seq").mapInPandas(run, OUTCOME)
