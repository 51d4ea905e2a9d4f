"""HTML from columns: string expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, replace_all

#: Characters of HTML text and their references, the ampersand first.
FULL = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
LEGACY = {k: FULL[k] for k in ("&", "<", ">", '"')}


def escape(x: Column | str, table: dict[str, str] = FULL) -> Column:
    return replace_all(F.coalesce(col(x).cast("string"), F.lit("")), table)


def listing(items: Column) -> Column:
    """<ul> of an array of strings; empty for an empty array."""
    body = F.array_join(F.transform(items, lambda v: F.concat(F.lit("<li>"), escape(v), F.lit("</li>"))), "")
    return F.when(F.size(items) > 0, F.concat(F.lit("<ul>"), body, F.lit("</ul>"))).otherwise("")


def cell(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit('<span class="empty-cell">-</span>')).otherwise(escape(x))


def records_table(records: Column, headers: Sequence[tuple[str, str]]) -> Column:
    """Table of an array of structs of strings; columns that are blank in every record are left out."""
    filled = lambda k: F.exists(records, lambda r: F.trim(F.coalesce(r[k], F.lit(""))) != "")
    shown = {k: filled(k) for k, _ in headers}
    head = F.concat(*[F.when(shown[k], F.lit(f"<th>{label}</th>")).otherwise("") for k, label in headers])
    body = F.array_join(F.transform(records, lambda r: F.concat(F.lit("<tr>"), *[F.when(shown[k], F.concat(F.lit("<td>"), cell(r[k]), F.lit("</td>"))).otherwise("") for k, _ in headers], F.lit("</tr>"))), "")
    any_shown = F.lit(False)
    for k, _ in headers:
        any_shown = any_shown | shown[k]
    return F.when((F.size(records) > 0) & any_shown, F.concat(F.lit("<table><tr>"), head, F.lit("</tr>"), body, F.lit("</table>"))).otherwise("")


def key_value_table(entries: Column) -> Column:
    """Two-column table of an array of struct(key, value); blank values are left out."""
    kept = F.filter(entries, lambda e: ~F.trim(F.coalesce(e["value"], F.lit(""))).isin("", "-", "Check source", "Check source.", "Check source pages", "None"))
    body = F.array_join(F.transform(kept, lambda e: F.concat(F.lit("<tr><th>"), escape(e["key"]), F.lit("</th><td>"), escape(e["value"]), F.lit("</td></tr>"))), "")
    return F.when(F.size(kept) > 0, F.concat(F.lit("<table>"), body, F.lit("</table>"))).otherwise("")


def steps(records: Column) -> Column:
    body = F.array_join(F.transform(records, lambda r: F.concat(F.lit("<li><strong>"), escape(r["step"]), F.lit("</strong><p>"), escape(r["detail"]), F.lit("</p></li>"))), "")
    return F.when(F.size(records) > 0, F.concat(F.lit('<ol class="steps">'), body, F.lit("</ol>"))).otherwise("")


def position_map(positions: Column, columns: int = 8) -> Column:
    """Cells of one row: x where the column number is in the array, else -."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: F.when(F.array_contains(positions, i), F.lit("<td>x</td>")).otherwise(F.lit("<td>-</td>"))), "")


def panel(title: str, content: Column) -> Column:
    """A titled section; nothing if it has no content."""
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"<section><h3>{title}</h3>"), content, F.lit("</section>")))


def paragraphs(x: Column | str) -> Column:
    """Blank-line separated parts as <p>; blank parts go."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "\\n\\n"), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))), "")


def sql_literal(x: Column) -> Column:
    """A quoted SQL string, quotes doubled; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def grid_svg(rows: Column, side: int = 10) -> Column:
    """A small SVG of an array of boolean rows."""
    cells = F.transform(
        rows,
        lambda r, y: F.array_join(
            F.transform(r, lambda v, x: F.when(v, F.concat(F.lit('<rect x="'), (x * side).cast("string"), F.lit('" y="'), (y * side).cast("string"), F.lit(f'" width="{side}" height="{side}"/>'))).otherwise(F.lit(""))),
            "",
        ),
    )
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(cells, ""), F.lit("</svg>"))
