"""Splitting page sequences into coded sections.

Per-page features are columns; only they and the page number go to the state machine, which
runs per document because an inferred code depends on the one before it.  Texts are joined
back by page range.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.section_text import heading_code, page_text
from ..functions.text import col, count_matches

HEAD = 180
#: What marks a page's part in a section.
TECHNICAL_SIGNS = ("CODE SERIES", "SPACING", "DEPTHS", "DECODERS:", "LISHI:", "ACCUREADER:")
CONTINUATION_SIGNS = ("CONTINUED", "PROGRAMMER & DIAGNOSTIC", "DIAGNOSTIC TOOLS", "CHIP INFORMATION")
BOUNDARY_SIGNS = (
    "TABLE OF CONTENTS",
    "TAЫLE OF CONTENTS",
    "ТАЫЕ OF CONTENTS",
    "ON-BOARD TRANSPONDER PROGRAMMING",
    "PROXIMITY PROGRAMMING INSTRUCTIONS",
    "CUT PROGRESSION CHART",
    "PASSLOCK",
    "VATS",
    "THE EVOLUTION OF THE LEXUS",
    "PROGRAM GRID",
    "MISC INFO - LEXUS",
    "TOYOTA CODE SERIES M.A.C.S.",
    "NATIONAL AUTO LOCK SERVICE",
    "TRANSPONDER INFORMATION - FORD",
    "ACURA - HONDA - TRANSPONDER INFORMATION",
    "PROGRESSION CHART",
    "ANTI-SCAN MODE",
)
BOUNDARY_PATTERN = "ACURA\\s*-?\\s*HON\\s*DA?\\s*-?\\s*TRANSPONDER INFORMATION"
COVER_SIGNS = ("CODES", "STYLE", "CARD", "MACS", "STARTCUT", "CUTTOCUT", "AIRBAGS", "IGNRETAINER")
SECTION_CODE = "\\b([A-Z]{2,5}-[A-Z0-9]{1,4})\\s+SECTION\\b"

OUTPUT = "document string, code string, page_start long, page_end long, first_page_shared boolean, confidence double"


def _any(x: Column, signs) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | F.contains(x, F.lit(s))
    return out


def page_features(pages: DataFrame, document: str = "document", page: str = "page_number", text: str = "text", code: Column | None = None, boundary=BOUNDARY_SIGNS, repair: bool = False) -> DataFrame:
    """The signals the state machine reads, one row a page; with ``repair`` of the page as it was meant, and its code too."""
    if repair:
        pages = pages.withColumn("__qw_text", page_text(text))
        code = heading_code(text, F.col(document).cast("string")) if code is None else code
        text = "__qw_text"
    up = F.upper(F.coalesce(col(text), F.lit("")))
    head = F.substring(up, 1, HEAD)
    long_head = F.substring(up, 1, 1100)
    compact = F.regexp_replace(long_head, "\\s+", "")
    technical = sum((F.contains(up, F.lit(s)).cast("int") for s in TECHNICAL_SIGNS), F.lit(0))
    covers = sum((F.contains(compact, F.lit(s)).cast("int") for s in COVER_SIGNS), F.lit(0))
    found = code if code is not None else F.regexp_extract(up, SECTION_CODE, 1)
    return pages.select(
        F.col(document).cast("string").alias("document"),
        F.col(page).cast("long").alias("page_number"),
        F.coalesce(found, F.lit("")).alias("code"),
        (_any(up, boundary) | F.rlike(up, F.lit(BOUNDARY_PATTERN))).alias("boundary"),
        _any(head, CONTINUATION_SIGNS).alias("continuation"),
        (technical >= 2).alias("technical"),
        F.contains(up, F.lit("CONTINUED")).alias("continued"),
        (~F.contains(long_head, F.lit("CONTINUED")) & F.rlike(long_head, F.lit("\\b(?:19|20)[0-9]{2}\\s*[-–]\\s*[0-9]{2,4}\\b")) & (covers >= 4)).alias("cover"),
        (~F.contains(head, F.lit("CONTINUED")) & F.contains(head, F.lit("SECTION")) & (count_matches(head, "\\?") >= 2)).alias("corrupted"),
        F.regexp_extract(head, "(?:\\?{2,}|-)?[.]?([0-9]{1,3})\\s+SECTION\\b", 1).alias("suffix"),
        (F.char_length(up) > 0).alias("has_text"),
    )


def _suffix(code: str) -> int | None:
    tail = code.rpartition("-")[2]
    return int(tail) if "-" in code and tail.isdigit() else None


def _stem(code: str) -> str:
    return code.rstrip("0123456789")


def _next_variant(code: str) -> str:
    stem = _stem(code)
    return f"{stem}{int(code[len(stem):]) + 1}" if len(stem) < len(code) and "-" in stem else ""


def _inferred(row, current: str) -> str:
    """A code for a page without one, from the section it follows."""
    if row.cover:
        return _next_variant(current)
    own = _suffix(current)
    if row.suffix and (own is None or int(row.suffix) > own):
        return f"{_stem(current)}{row.suffix}"
    if row.corrupted:
        return f"{_stem(current)}{own + 1}" if own is not None else _next_variant(current)
    return ""


def walk(rows: Sequence) -> list[list]:
    """Sections of one document, whose pages come in order."""
    done: list[list] = []
    open_: list | None = None  # document, code, start, end, shared

    def close(end: int) -> None:
        nonlocal open_
        if open_ is not None:
            open_[3] = end
            done.append(open_)
            open_ = None

    for i, row in enumerate(rows):
        if not row.code and row.boundary and not (open_ is not None and row.technical):
            close(row.page_number - 1)
            continue
        code = row.code
        if open_ is not None and not code:
            after = rows[i + 1] if i + 1 < len(rows) else None
            if after is not None and after.code and after.code != open_[1] and after.continuation:
                close(row.page_number - 1)  # this page opens the section that the next one continues
                open_ = [row.document, after.code, row.page_number, None, False]
                continue
            code = _inferred(row, open_[1])
        if not code or (open_ is not None and code == open_[1]):
            continue
        close(row.page_number - 1)
        start, shared = row.page_number, False
        if row.continued and i > 0 and rows[i - 1].has_text and not rows[i - 1].code:
            start, shared = rows[i - 1].page_number, True  # the page before belongs to both
        open_ = [row.document, code, start, None, shared]
    if rows:
        close(rows[-1].page_number)
    return done


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents one after the other; only one document's features are held."""
    held: list = []
    for batch in batches:
        Page = namedtuple("Page", batch.schema.names)  # noqa: N806
        done: list[list] = []
        for row in map(Page._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if held and held[0].document != row.document:
                done += walk(held)
                held = []
            held.append(row)
        if done:
            yield _batch(done)
    if held and (done := walk(held)):
        yield _batch(done)


def _batch(done: list[list]) -> pa.RecordBatch:
    document, code, start, end, shared = zip(*done, strict=True)
    columns = [pa.array(document, pa.string()), pa.array(code, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(shared, pa.bool_()), pa.array([0.6] * len(done), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUTPUT.split(", ")])


def split_sections(features: DataFrame) -> DataFrame:
    """Sections of all documents: document, code, page_start, page_end, first_page_shared, confidence.

    Pages are dealt out by document and sorted, then walked as they stream by.
    """
    return features.repartition("document").sortWithinPartitions("document", "page_number").mapInArrow(_walk_all, OUTPUT)


def section_texts(sections: DataFrame, pages: DataFrame, document: str = "document", page: str = "page_number", text: str = "text") -> DataFrame:
    """Sections with the texts of their pages joined by newlines."""
    spread = sections.withColumn("_page", F.explode(F.sequence("page_start", "page_end")))
    p = pages.select(F.col(document).cast("string").alias("_doc"), F.col(page).cast("long").alias("_no"), F.coalesce(col(text), F.lit("")).alias("_text"))
    joined = spread.join(p, (spread["document"] == p["_doc"]) & (spread["_page"] == p["_no"]))
    parts = F.array_sort(F.collect_list(F.struct("_no", "_text")))
    return joined.groupBy(*sections.columns).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), "\n").alias("raw_text"))
