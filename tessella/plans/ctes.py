"""SQL definitions of the domain tables, used only by the SQL twins."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with every domain table it needs, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = [f"{n} AS (\n{CTES[n]}\n)" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def roll(expr: str, col: str, n: int, mp: int | None = None) -> str:
    """A trailing aggregate that is null until ``mp`` values exist."""
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} >= {mp or n} THEN {expr} {w} END"
