"""Year ranges as scanned text writes them.  The three readings differ on purpose and stay apart.

Each returns struct(year_from int, year_to int), null where the text is no range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

FIRST, LAST, LONGEST = 1900, 2035, 50


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _range(start: Column, end: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(start.cast("int").alias("year_from"), end.cast("int").alias("year_to")))


def strict(x: Column | str) -> Column:
    """1900..2035; a two-digit end rolls over the century, three digits count as their first two; the end never precedes the start."""
    shape = "([0-9]{4})\\s*[-–]\\s*([0-9]{2,4})"
    start, raw = _int(F.regexp_extract(col(x), shape, 1)), F.regexp_extract(col(x), shape, 2)
    century = F.substring(start.cast("string"), 1, 2)
    short = _int(F.concat(century, F.substring(raw, 1, 2)))
    end = F.when(F.char_length(raw) == 2, F.when(short < start, short + 100).otherwise(short)).when(F.char_length(raw) == 3, short).otherwise(_int(raw))
    return _range(start, end, start.between(FIRST, LAST) & (end >= start) & (end <= LAST) & (end - start <= LONGEST))


def lenient(raw_start: Column | str, raw_end: Column | str) -> Column:
    """An empty end is the start; a four-digit end past 2035 is read as two digits and may precede the start."""
    start, raw = _int(col(raw_start)), F.coalesce(col(raw_end), F.lit(""))
    century = F.substring(start.cast("string"), 1, 2)
    short = _int(F.concat(century, F.substring(raw, 1, 2)))
    rolled = F.when(short < start, short + 100).otherwise(short)
    size = F.char_length(raw)
    end = F.when(size == 0, start).when(size == 4, F.when(_int(raw) > LAST, short).otherwise(_int(raw))).when(size == 2, rolled).when(size == 3, short).otherwise(_int(raw))
    bounded = F.when(size.isin(0, 4), F.lit(True)).when(size == 2, (end <= LAST) & (end - start <= LONGEST)).otherwise((end >= start) & (end <= F.least(F.lit(LAST), start + LONGEST)))
    return _range(start, end, start.between(FIRST, LAST) & bounded)


def century_optional(x: Column | str) -> Column:
    """The whole text: an optional century (20 if absent), two digits, an optional end of two to four digits; no bounds."""
    text = F.trim(col(x))
    shape = "^(19|20)?([0-9]{2})(?:[-–]([0-9]{2,4}))?$"
    start = _int(F.concat(F.coalesce(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")), F.lit("20")), F.regexp_extract(text, shape, 2)))
    raw = F.regexp_extract(text, shape, 3)
    end = F.when(raw == "", start).when(F.char_length(raw) == 2, _int(F.concat(F.substring(start.cast("string"), 1, 2), raw))).otherwise(_int(raw))
    return _range(start, end, F.rlike(text, F.lit(shape)))
