"""Terminal tables. Rows stream to the driver one partition at a time; widths come from one aggregation."""

from __future__ import annotations

import textwrap
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from vitrina.operators.catalog import column_widths

#: Widest content of a column, by heading.
MAX_WIDTHS = {"Producto": 20, "URL": 100, "Disponibilidad": 15}
PAGE_LINES = 50


def table_lines(table: DataFrame, title: str = "", max_widths: dict[str, int] | None = None) -> Iterator[str]:
    caps = {**MAX_WIDTHS, **(max_widths or {})}
    longest = column_widths(table).first().asDict()
    widths = {c: min(max(len(c), longest[c] or 0), caps.get(c, 1 << 30)) for c in table.columns}
    if title:
        yield f"\n{title}"
    yield "  ".join(c.ljust(widths[c]) for c in table.columns)
    yield "  ".join("-" * widths[c] for c in table.columns)
    for row in table.toLocalIterator():
        cells = [textwrap.wrap("" if v is None else str(v), widths[c]) or [""] for c, v in zip(table.columns, row, strict=True)]
        height = max(map(len, cells))
        for i in range(height):
            yield "  ".join((x[i] if i < len(x) else "").ljust(widths[c]) for c, x in zip(table.columns, cells, strict=True))
        if height > 1:
            yield ""


def paginate(lines: Iterator[str], ask: Callable[[str], str] = input, show: Callable[[str], None] = print, size: int = PAGE_LINES) -> None:
    """Show lines, asking after each page; q ends."""
    for i, line in enumerate(lines):
        if i and i % size == 0 and ask("-- more (q ends) -- ").strip().lower() == "q":
            return
        show(line)


def render_table(table: DataFrame, title: str = "") -> None:
    paginate(table_lines(table, title))
