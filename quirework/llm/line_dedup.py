"""Removal of repeated runs of lines by winnowing over line hashes.

Of every window of WINDOW_LINES line hashes the least is a mark, so two places that share such a
window share a mark, and only marks are written.  Those whose line marks nothing else are
dropped; from the others matches are extended both ways, over the stretches that they stand for
and then along the diagonal of the two documents, and a stretch is deleted from all places but
its first in corpus order.  A frequent line costs nothing but its own rows: what is joined is the
stretch around it.  Runs of fewer lines count if they have many words; one or two adjacent lines
with MIN_WORDS words have a mark of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import common

#: Lines of a window, the shortest run that is deleted whatever its words.
WINDOW_LINES = 3
#: A run is deleted if it has so many lines, or so many words.
MIN_LINES, MIN_WORDS = WINDOW_LINES, 50

#: Stretches of lines around a mark, as (first, last) offsets; a mark says by a bit which of them it stands for.
STRETCHES = ((-2, 0), (-1, 1), (0, 2), (0, 0), (-1, 0), (0, 1))


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def window_minima(h: np.ndarray, n: int = WINDOW_LINES) -> np.ndarray:
    """Position of the least hash of every window of ``n``; of equal ones the last."""
    if len(h) < n:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h[::-1], n)[::-1]
    return np.arange(len(windows)) + n - 1 - np.argmin(windows, axis=1)


def document_marks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of a text: their lines (numbered without the blank ones), the hashes of the five lines
    around each, and the bits of the stretches that they stand for.

    A mark is the least line hash of a window, of two adjacent lines with many words, or of a
    line that has as many alone: what two places share, they share with its mark.
    """
    lines, solid = lines_of(text)
    own = [lines[i].strip() for i in solid]
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in own), dtype=np.uint64, count=len(own))
    words = np.fromiter((x.count(" ") + 1 for x in own), dtype=np.int64, count=len(own))
    bits = np.zeros(len(own), dtype=np.int32)

    def stands_for(least: np.ndarray, first: np.ndarray, size: int) -> None:
        for k, (low, high) in enumerate(STRETCHES):
            if high - low + 1 == size:
                np.bitwise_or.at(bits, least[least + low == first], 1 << k)

    least = window_minima(h)
    stands_for(least, np.arange(len(least)), WINDOW_LINES)
    for n in range(1, MIN_LINES):
        least = window_minima(h, n)
        first = np.arange(len(least))
        heavy = sum(words[k : k + len(first)] for k in range(n)) >= MIN_WORDS
        stands_for(least[heavy], first[heavy], n)
    at = np.flatnonzero(bits)
    around = np.pad(h.view(np.int64), 2)
    return at, around[at[:, None] + np.arange(5)], bits[at]


_MARKS = "doc_id long, text_key long, line int, around array<long>, bits int"


def marks(docs: DataFrame) -> DataFrame:
    """The marks of every document: fewer rows than lines."""
    names = [c.split()[0] for c in _MARKS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common.hold_cache("lines", lambda: None)
        found = [document_marks(t) for t in batch.column(2).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        at, around, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 5), pa.array(around.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), lists, pa.array(bits)], names=names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    # Rows equal in doc_id and text are one document.
    return common.map_batches(keyed, run, _MARKS)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Per document with any: doc_id, text_key, runs (array of first and last index among its solid lines).

    Marks whose line marks nothing else are dropped.  From each of the others the match is
    extended both ways over the stretches that the mark stands for, and places with an equal
    stretch are joined to the first of them in the order of doc_id, text_key and line.  Matches
    on the same diagonal of the same two documents grow together into one run.
    """
    every = common.cut(marks(docs).withColumn("print", F.element_at("around", 3)), "marks")
    # Written, so that the joins below deal both sides anew and a frequent line or stretch can be split.
    shared = common.cut(every.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "prints")
    stretch = F.explode(F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))) for k, (a, b) in enumerate(STRETCHES)]), lambda s: s.isNotNull()))
    near = every.join(shared, "print").select("doc_id", "text_key", "line", "around", stretch.alias("s"))
    size = F.col("s.high") - F.col("s.low") + 1
    near = near.select("doc_id", "text_key", F.xxhash64(F.slice("around", F.col("s.low") + 3, size), size).alias("hash"), (F.col("line") + F.col("s.low")).alias("first"), (F.col("line") + F.col("s.high")).alias("last"))
    near = common.cut(near, "near")
    place = F.struct("doc_id", "text_key", "first")
    firsts = near.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("f")).filter("n > 1")
    firsts = common.cut(firsts.select("hash", F.col("f.doc_id").alias("f_doc"), F.col("f.text_key").alias("f_key"), F.col("f.first").alias("f_first")), "firsts")
    common.discard(every, shared)
    later = near.join(firsts, "hash").filter(~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_key") == F.col("f_key")) & (F.col("first") == F.col("f_first"))))
    diagonal = Window.partitionBy("doc_id", "text_key", "f_doc", "f_key", F.col("first") - F.col("f_first")).orderBy("first", "last")
    reach = F.max("last").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    grown = later.withColumn("new", (F.coalesce(F.col("first") > reach + 1, F.lit(True))).cast("int")).withColumn("step", F.col("first") - F.col("f_first"))
    grown = grown.withColumn("run", F.sum("new").over(diagonal))
    runs = grown.groupBy("doc_id", "text_key", "f_doc", "f_key", "step", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))


def delete_runs(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int, int]:
    """The text without the runs; its lines, the deleted lines and the deleted runs.

    Blank lines inside a deleted run go with it, and so do those right before it.
    """
    lines, solid = lines_of(text)
    n = len(lines) if text else 0
    if not runs:
        return text, n, 0, 0
    gone, count, end = np.zeros(len(lines), dtype=bool), 0, -1
    for r in runs:
        first, last = r["first"], min(r["last"], len(solid) - 1)
        gone[(solid[first - 1] + 1 if first else 0) : solid[last] + 1] = True
        count += first > end + 1 or end < 0
        end = max(end, last)
    kept = [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
    return "\n".join(kept), n, int(gone.sum()), count


def _edited(docs: DataFrame) -> DataFrame:
    """``docs`` as it is but for ``text``, and __qw_lines, __qw_removed, __qw_runs."""
    added = ("__qw_lines", "__qw_removed", "__qw_count")
    kept = docs.columns
    runs = repeated_runs(docs).select(F.col("doc_id").alias("__qw_id"), F.col("text_key").alias("__qw_key"), F.col("runs").alias("__qw_runs"))
    keyed = docs.select(*kept, F.xxhash64("text").alias("__qw_text_key"))
    joined = keyed.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__qw_id")) & (F.col("__qw_text_key") == F.col("__qw_key")), "left").select(*kept, "__qw_runs")
    at = kept.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [delete_runs(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True)]
        text, *counts = zip(*done, strict=True)
        columns = [pa.array(text, type=pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, type=pa.int64()) for c in counts)], names=[*kept, *added])

    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, LongType())
    return common.map_batches(joined, run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, and n_lines, n_removed, n_runs.

    Lines are compared without white space at their ends; blank lines are passed over.  A
    run of at least MIN_LINES lines or MIN_WORDS words that occurs at an earlier place of the
    corpus is deleted, so the first occurrence of any run stays.  Null texts
    stay null, with no lines; a document whose lines are all repeated keeps an empty text.
    Rows equal in doc_id and text are one document and change alike.  Every other column
    stays (columns named like the new ones are replaced); an empty table gives no rows.
    """
    names = {"__qw_lines": "n_lines", "__qw_removed": "n_removed", "__qw_count": "n_runs"}
    return _edited(docs.drop(*names.values())).withColumnsRenamed(names)


def without_repeats(docs: DataFrame, length: str | None = None) -> DataFrame:
    """``docs`` with repeated runs deleted, under its own columns; documents that lose every line go.

    ``length`` names a column with the number of code points of the text, which follows it.
    Texts without a line of their own (null, empty, blank) stay as they are.
    """
    out = _edited(docs).filter("__qw_removed = 0 or trim(BOTH ' \t\n\r' FROM text) <> ''")
    if length:
        out = out.withColumn(length, F.when(F.col("__qw_removed") > 0, F.length("text").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)
