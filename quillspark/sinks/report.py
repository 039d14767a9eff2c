"""Readable reports of collected rows: scores by document, findings by rule with their lines, differences with arrows, entities."""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from quillspark.sinks.encode import cell, to_table


def _by(rows: list, key: str) -> dict[Any, list]:
    out: dict[Any, list] = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def line_of(text: str, start: int) -> int:
    """Line of a byte offset, from 1."""
    return text.encode("utf-8", "surrogatepass")[:start].count(b"\n") + 1


def shorten(s: str, n: int) -> str:
    s = " ".join(s.split())
    return s if n <= 1 or len(s) <= n else s[:n - 1].rstrip(" ") + "…"


def scores(rows: list, id_col: str = "id") -> str:
    return "".join(f"{key}\n" + "".join(f"  {r['metric']}: {cell(r['score'])} ({r['level']})\n" for r in sorted(rs, key=lambda r: r["metric"])) for key, rs in _by(rows, id_col).items())


def findings(rows: list, texts: dict[Any, str], id_col: str = "id", width: int = 80) -> str:
    """Findings of each document grouped by rule, each with the line it starts on."""
    out = []
    for key, rs in _by(rows, id_col).items():
        out.append(f"{key}: {len(rs)} findings\n")
        for rule, hits in sorted(_by(rs, "rule").items()):
            out.append(f"  {rule} ({len(hits)})\n")
            for h in sorted(hits, key=lambda r: (r["start"], r["end"])):
                where = f"L{line_of(texts.get(key, ''), h['start'])}" if h["sentence"] else "document"
                out.append(f"    {where}: {h['message']} {shorten(h['excerpt'], width)}".rstrip() + "\n")
    return "".join(out)


def differences(rows: list) -> str:
    """Metric deltas; the arrow points up where the text became easier."""
    shown = [(r["metric"], r["before"], r["after"], r["delta"], "→" if not r["delta"] else "↑" if r["improved"] else "↓") for r in sorted(rows, key=lambda r: r["metric"])]
    return to_table(["metric", "before", "after", "delta", ""], shown)


def entities(rows: list) -> str:
    return to_table(["name", "type", "salience", "mentions"], [(r["name"], r["type"], r["salience"], r["mentions"]) for r in rows])
