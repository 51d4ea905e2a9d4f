"""Lock-position maps of a record: verified ones, inferred ones, and the cut tables that maps give.

A diagram is struct(title, placement, caption, panels), a panel struct(label, columns, rows,
note), a row its label and a cell for each column, ``filled`` or empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.completeness import lock_visual
from .text import col

DIAGRAMS = "array<struct<title:string,placement:string,caption:string,panels:array<struct<label:string,columns:array<string>,rows:array<array<string>>,note:string>>>>"

# -- fixed values: maps that were checked on the page, by code --------------------------------------


def _run(first: int, last: int) -> tuple[int, ...]:
    return tuple(range(first, last + 1))


def _numbers(last: int) -> tuple[str, ...]:
    return tuple(map(str, _run(1, last)))


DOUBLED = ("1", "2", "2", "3", "4", "4", "5", "6", "7", "7")
#: Code, a part of the keyway that must be there, columns, and the filled positions of each lock; the first lock in a row's label counts.
VERIFIED = (
    ("AV-3", "", _numbers(10), (("IGNITION", _run(1, 10)), ("DOOR", _run(1, 10)), ("GLOVE", (2, 4, 6, 8, 10)))),
    ("AV-8", "HU66", _numbers(8), (("IGNITION", _run(1, 8)), ("DOOR", _run(1, 8)), ("TRUNK", _run(1, 8)), ("HATCH", _run(1, 8)), ("GLOVE", (4, 5, 6)))),
    ("AV-24", "", _numbers(8), (("IGNITION", _run(1, 8)), ("DOOR", _run(1, 8)), ("TRUNK", _run(1, 8)))),
    ("FORD-C34", "", _numbers(8), (("IGNITION", (1, 3, 4, 5, 6, 7, 8)), ("DOOR", _run(3, 8)), ("TRUNK", _run(3, 8)), ("HATCH", _run(3, 8)), ("GLOVE", (4, 5, 6)))),
    ("FORD-X3", "", DOUBLED, (("IGNITION", _run(1, 10)), ("DOOR", _run(1, 10)), ("TRUNK", _run(1, 10)))),
    ("GM-P10", "", _numbers(10), (("IGNITION", ()), ("DOOR", _run(5, 10)), ("TRUNK", _run(5, 10)), ("SPARE", _run(6, 10)), ("STOWAGE", _run(6, 10)), ("GLOVE", _run(7, 10)))),
)
#: Headers of a map that says something, and locks that its rows name.
HEADERS = (_numbers(5), _numbers(7), _numbers(8), _numbers(10), DOUBLED)
LOCKS = ("IGNITION", "DOOR", "TRUNK", "HATCH", "GLOVE", "SPARE", "STOWAGE")
LEAST_FILLED, LEAST_IN_ROW = 4, 2
#: The map of ten positions that a source proves by naming all of these.
TEN_LOCKS = ("IGNITION", "DOORS", "TRUNK", "SPARE TIRE", "STOWAGE", "GLOVE BOX")
TEN_HEADER = "\\b10\\s+CUT\\b|1\\s+2\\s+3\\s+4\\s+5\\s+6\\s+7\\s+8\\s+9\\s+10"
TEN_ROWS = (("Ignition", _run(5, 9)), ("Doors", _run(5, 9)), ("Trunk", _run(6, 9)), ("Spare tire", _run(6, 9)), ("Stowage", _run(6, 9)), ("Glove box", _run(7, 9)))
TEN_CAPTION = "Original redrawn lock-position map showing which cut positions are used by each lock group."
TEN_NOTE = "Read columns from bow/handle to tip. Rows represent the locks listed in the source map."
MAP_SIGN = "LOCK-POSITION"
CUT_PLACEMENTS = ("mechanical_key", "making_key")
CUT_VALUE = "^\\.?[0-9]+(?:\\.[0-9]+)?$"

# -- expressions ------------------------------------------------------------------------------------


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _cells(positions: Sequence[int], width: int) -> Column:
    return _strings(["filled" if p in positions else "" for p in range(1, width + 1)])


def _known(code: Column) -> Column:
    """The verified map of a code: struct(keyway, columns, locks: array<struct(token, cells)>), or null."""
    maps = []
    for name, keyway, columns, rows in VERIFIED:
        locks = F.array(*[F.struct(F.lit(t).alias("token"), _cells(p, len(columns)).alias("cells")) for t, p in rows])
        maps += [F.lit(name), F.struct(F.lit(keyway).alias("keyway"), _strings(columns).alias("columns"), locks.alias("locks"))]
    return F.try_element_at(F.create_map(*maps), F.upper(F.coalesce(code, F.lit(""))))


def _trimmed(columns: Column) -> Column:
    return F.transform(columns, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def enforce(diagrams: Column | str, code: Column | str, keyway: Column | str) -> Column:
    """``diagrams`` with the rows of verified maps as they were checked.

    Panels whose columns are not the verified ones, rows of other locks and diagrams that are no
    lock-position maps stay as they are; so does everything of a code without a verified map.
    """
    known = _known(col(code))
    way = F.upper(F.coalesce(col(keyway), F.lit("")))

    def row(cells: Column, k: Column) -> Column:
        label = F.upper(F.coalesce(F.get(cells, 0), F.lit("")))
        lock = F.get(F.filter(k["locks"], lambda m: F.contains(label, m["token"])), 0)
        return F.when(lock.isNotNull() & (F.size(cells) > 0), F.concat(F.slice(cells, 1, 1), lock["cells"])).otherwise(cells)

    def panel(p: Column, k: Column) -> Column:
        rows = F.when(_trimmed(p["columns"]) == k["columns"], F.transform(p["rows"], lambda r: row(r, k))).otherwise(p["rows"])
        return F.struct(p["label"].alias("label"), p["columns"].alias("columns"), rows.alias("rows"), p["note"].alias("note"))

    def diagram(d: Column, k: Column) -> Column:
        named = F.contains(F.upper(F.concat_ws(" ", d["title"], d["caption"])), F.lit(MAP_SIGN))
        panels = F.when(named, F.transform(d["panels"], lambda p: panel(p, k))).otherwise(d["panels"])
        return F.struct(d["title"].alias("title"), d["placement"].alias("placement"), d["caption"].alias("caption"), panels.alias("panels"))

    def with_known(k: Column) -> Column:
        fits = k.isNotNull() & F.contains(way, k["keyway"])
        return F.when(fits, F.transform(col(diagrams), lambda d: diagram(d, k))).otherwise(col(diagrams))

    return F.element_at(F.transform(F.array(known), with_known), 1)


def informative(diagram: Column) -> Column:
    """Whether the first panel with a known header has enough filled cells in rows that name locks."""
    headed = F.filter(diagram["panels"], lambda p: F.array_contains(F.array(*map(_strings, HEADERS)), _trimmed(p["columns"])))

    def filled(r: Column, width: Column) -> Column:
        label = F.upper(F.coalesce(F.get(r, 0), F.lit("")))
        named = F.exists(_strings(LOCKS), lambda t: F.contains(label, t))
        marks = F.size(F.filter(F.slice(r, F.lit(2), width), lambda v: F.lower(F.trim(F.coalesce(v, F.lit("")))) == "filled"))
        return F.when(named & (F.size(r) >= 2), marks).otherwise(0)

    counts = F.element_at(F.transform(F.slice(headed, 1, 1), lambda p: F.transform(p["rows"], lambda r: filled(r, F.size(p["columns"])))), 1)
    counts = F.when(F.size(headed) > 0, counts)
    return F.coalesce((F.aggregate(counts, F.lit(0), lambda a, n: a + n) >= LEAST_FILLED) & (F.array_max(counts) >= LEAST_IN_ROW), F.lit(False))


def infer(diagrams: Column | str, source: Column | str, keyway: Column | str, code_series: Column | str) -> Column:
    """``diagrams``, and the ten-position map where none of them is informative and the source proves that it has that map."""
    own = F.coalesce(col(diagrams), F.array().cast(DIAGRAMS))
    raw = F.coalesce(col(source), F.lit(""))
    flat = F.regexp_replace(F.upper(raw), "\\s+", " ")
    proved = lock_visual(raw) & F.rlike(flat, F.lit(TEN_HEADER))
    for token in TEN_LOCKS:
        proved = proved & F.contains(flat, F.lit(token))
    profile = F.trim(F.coalesce(F.nullif(F.coalesce(col(keyway), F.lit("")), F.lit("")), F.nullif(F.coalesce(col(code_series), F.lit("")), F.lit("")), F.lit("10-cut key")))
    rows = F.array(*[F.concat(F.array(F.lit(label)), _cells(positions, 10)) for label, positions in TEN_ROWS])
    panel = F.struct(F.lit("Lock positions").alias("label"), _strings(_numbers(10)).alias("columns"), rows.alias("rows"), F.lit(TEN_NOTE).alias("note"))
    made = F.struct(F.concat(profile, F.lit(" lock-position guide")).alias("title"), F.lit("making_key").alias("placement"), F.lit(TEN_CAPTION).alias("caption"), F.array(panel).alias("panels"))
    return F.when(proved & ~F.exists(own, informative), F.concat(own, F.array(made).cast(DIAGRAMS))).otherwise(own)


def cut_table(diagrams: Column | str, kind: str) -> Column:
    """Column to value of the last panel labelled as a table of ``kind`` (spacing or depths), null without one.

    The first row counts; it must have a number for each column.  Of columns of one name the last stays.
    """
    labels = ("spacing",) if kind == "spacing" else ("depth", "depths")
    placed = F.filter(col(diagrams), lambda d: d["placement"].isin(*CUT_PLACEMENTS))
    panels = F.flatten(F.transform(placed, lambda d: F.coalesce(d["panels"], F.array().cast("array<struct<label:string,columns:array<string>,rows:array<array<string>>,note:string>>"))))

    def whole(p: Column) -> Column:
        values = F.get(p["rows"], 0)
        numbers = F.forall(values, lambda v: F.rlike(F.trim(F.coalesce(v, F.lit(""))), F.lit(CUT_VALUE)))
        return F.coalesce(F.lower(F.trim(p["label"])).isin(*labels) & (F.size(p["columns"]) > 0) & (F.size(values) == F.size(p["columns"])) & numbers, F.lit(False))

    last = F.try_element_at(F.filter(panels, whole), F.lit(-1))
    pairs = F.arrays_zip(_trimmed(last["columns"]).alias("k"), F.transform(F.get(last["rows"], 0), lambda v: F.trim(v)).alias("v"))
    named = F.filter(pairs, lambda p: p["k"] != "")
    kept = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.when(last.isNotNull(), F.map_from_entries(kept))
