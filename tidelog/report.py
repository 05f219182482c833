"""Benchmark reports: shape, JSON file, Markdown, splice (O-28, O-29, O-72..O-76, O-100)."""

from __future__ import annotations

import json
import math
import subprocess
from datetime import UTC, datetime
from pathlib import Path

BEGIN, END = "<!-- bench:begin -->", "<!-- bench:end -->"
COLUMNS = (("msgs_per_sec", 1), ("mb_per_sec", 2), ("ack_p50_ms", 2), ("ack_p99_ms", 2), ("e2e_p50_ms", 2), ("e2e_p99_ms", 2), ("e2e_samples", None), ("produce_errors", None), ("duplicates", None))


def nearest_rank(ordered: list[float], percent: float) -> float:
    return ordered[max(1, math.ceil(percent / 100 * len(ordered))) - 1] if ordered else 0.0


def iteration(seconds: float, ack_ms: list[float], e2e_ms: list[float], message_size: int, errors: int = 0, duplicates: int = 0) -> dict:
    a, e, n = sorted(ack_ms), sorted(e2e_ms), len(ack_ms)
    return {
        "duration_seconds": seconds, "msgs_acked": n, "msgs_per_sec": n / seconds, "mb_per_sec": n * message_size / 1e6 / seconds,
        "ack_p50_ms": nearest_rank(a, 50), "ack_p99_ms": nearest_rank(a, 99), "e2e_p50_ms": nearest_rank(e, 50), "e2e_p99_ms": nearest_rank(e, 99),
        "e2e_samples": len(e), "produce_errors": errors, "duplicates": duplicates,
    }


def spread(iterations: list[dict]) -> dict:
    out = {}
    for k in ("msgs_per_sec", "ack_p99_ms", "e2e_p99_ms"):
        v = [i[k] for i in iterations]
        out[k] = {"min": min(v), "max": max(v), "mean": sum(v) / len(v)}
    return out


def provenance(root: str = ".") -> str:
    """The commit that is measured, marked if there are changes; without one there is no report."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    head = git("rev-parse", "--short=12", "HEAD")
    if head.returncode:
        raise RuntimeError("no revision: a report must name what it measured")
    return head.stdout.strip() + ("-dirty" if git("status", "--porcelain").stdout.strip() else "")


def file_name(report: dict) -> str:
    return f"{report['timestamp'][:10]}-{report['commit']}.json"


def write(report: dict, folder: str) -> Path:
    path = Path(folder) / file_name(report)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2) + "\n")
    return path


def build(title: str, hardware: str, iterations: list[dict], root: str = ".", **setup) -> dict:
    if not hardware:
        raise ValueError("hardware must be named")
    return {"title": title, "commit": provenance(root), "timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "hardware": hardware, **setup, "iterations": iterations, "spread": spread(iterations)}


def _shown(value: float, places: int | None) -> str:
    return str(value) if places is None else f"{value:.{places}f}"


def render(report: dict) -> str:
    """The report's section: a table of iterations, the spread, then every other field as a list."""
    head = ["iteration", *[k.replace("_per_sec", "/s").replace("_", " ") for k, _ in COLUMNS]]
    lines = [BEGIN, f"## Benchmarks: {report['title']}", "", f"| {' | '.join(head)} |", "|" + "---|" * len(head)]
    for n, it in enumerate(report["iterations"], 1):
        lines.append(f"| {' | '.join([str(n), *[_shown(it[k], p) for k, p in COLUMNS]])} |")
    lines += ["", "Least / most / mean over the iterations:", ""]
    for k, v in report["spread"].items():
        places = 1 if k == "msgs_per_sec" else 2
        lines.append(f"- {k.replace('_', ' ')}: " + " / ".join(_shown(v[x], places) for x in ("min", "max", "mean")))
    lines += ["", "Setup:", ""]
    lines += [f"- {k.replace('_', ' ')}: {v}" for k, v in report.items() if k not in ("title", "iterations", "spread", "caveats")]
    lines += ["", "Caveats:", "", *[f"- {c}" for c in report.get("caveats", [])]] if report.get("caveats") else []
    return "\n".join([*lines, END])


def splice(text: str, section: str) -> str:
    """text with what lies between the marks replaced; both marks must be there, once, in order."""
    if text.count(BEGIN) != 1 or text.count(END) != 1 or text.index(BEGIN) > text.index(END):
        raise ValueError("the marks of the section are missing or repeated")
    return text[: text.index(BEGIN)] + section + text[text.index(END) + len(END) :]
