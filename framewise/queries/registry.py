"""The registry that queries enter themselves in, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from framewise.binding import BINNED, BURSTS, FRAMES, MAPS, SPIKES

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_TABLES = {"fr": (FRAMES, ()), "fb": (BINNED, ("fr",)), "bu": (BURSTS, ("fr",)), "sp": (SPIKES, ("fr",)), "mp": (MAPS, ())}
CELL = "PARTITION BY cell ORDER BY frame"


def with_tables(names: str, body: str, more: str = "") -> str:
    """``body`` after the shared tables that it names and ``more`` of its own."""
    order: list[str] = []

    def add(n: str) -> None:
        for needed in _TABLES[n][1]:
            add(needed)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [_TABLES[n][0] for n in order] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def query(sql: str | None = None):
    def enter(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return enter


#: Bins over 0 of the maps, the bins that each can reach, and their components, numbered in row order.
CONNECTED = """RECURSIVE {tables},
on_ AS (SELECT map_id, ix, iy, ix * 8 + iy AS k FROM mp WHERE value > 0),
re(map_id, k, ix, iy, root) AS (SELECT map_id, k, ix, iy, k FROM on_ UNION SELECT n.map_id, n.k, n.ix, n.iy, re.root FROM re JOIN on_ n ON n.map_id = re.map_id AND {near}),
cp AS (SELECT map_id, ix, iy, dense_rank() OVER (PARTITION BY map_id ORDER BY root) AS component FROM (SELECT map_id, ix, iy, min(root) AS root FROM re GROUP BY ALL)),
ca AS (SELECT map_id, component, count(*) AS area FROM cp GROUP BY ALL)"""


def connected(body: str, diagonal: bool = False) -> str:
    near = "abs(n.ix - re.ix) <= 1 AND abs(n.iy - re.iy) <= 1" if diagonal else "abs(n.ix - re.ix) + abs(n.iy - re.iy) = 1"
    tables = with_tables("mp", "").removeprefix("WITH ").rstrip()
    return "WITH " + CONNECTED.format(tables=tables, near=near) + "\n" + body
