"""Cleaning of nested records by walking their schema: every rule becomes a column expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

Clean = Callable[[Column], Column]


def _empty_to_null(x: Column, kind: DataType) -> Column:
    """Null for what is empty; ``x`` is worked out once, a test beside it would double the work at each level."""
    if isinstance(kind, StringType):
        return F.get(F.filter(F.array(x), lambda v: v != ""), F.lit(0))
    if isinstance(kind, (ArrayType, MapType)):
        return F.get(F.filter(F.array(x), lambda v: F.size(v) > 0), F.lit(0))
    return x


def prune(x: Column, kind: DataType, clean: Clean = F.trim) -> Column:
    """Strings cleaned; empty strings, arrays, maps and structs become null, and null elements go."""
    if isinstance(kind, StructType):
        whole = F.struct(*[prune(x[f.name], f.dataType, clean).alias(f.name) for f in kind.fields])
        # Worked out once: a test beside the struct would double the work at each level.
        return F.element_at(F.transform(F.array(whole), lambda s: F.when(_any_set([s[f.name] for f in kind.fields]), s)), 1)
    if isinstance(kind, ArrayType):
        return _empty_to_null(F.filter(F.transform(x, lambda v: prune(v, kind.elementType, clean)), lambda v: v.isNotNull()), kind)
    if isinstance(kind, MapType):
        return _empty_to_null(F.map_filter(F.transform_values(x, lambda _, v: prune(v, kind.valueType, clean)), lambda _, v: v.isNotNull()), kind)
    if isinstance(kind, StringType):
        return _empty_to_null(clean(x), kind)
    return x


def _any_set(fields: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | f.isNotNull()
    return out


def strings(x: Column, kind: DataType, path: Column) -> Column:
    """array<struct<path, value>> of every string in a record, arrays by index."""
    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, StringType):
        return F.when(x.isNotNull(), F.array(F.struct(path.cast("string").alias("path"), x.alias("value")))).otherwise(none)
    if isinstance(kind, StructType):
        parts = [strings(x[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        return F.coalesce(F.concat(none, *parts), none)
    if isinstance(kind, ArrayType):
        inner = F.transform(x, lambda v, i: strings(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(kind, MapType):
        inner = F.transform(F.map_entries(x), lambda e: strings(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(inner), none)
    return none


def issues(x: Column, kind: DataType, patterns: Sequence[str], root: str = "report", shown: int = 120) -> Column:
    """'path: value' of every string that matches a pattern."""
    bad = F.filter(strings(x, kind, F.lit(root)), lambda s: F.rlike(s["value"], F.lit("(?iu)" + "|".join(f"(?:{p})" for p in patterns))))
    return F.transform(bad, lambda s: F.concat(s["path"], F.lit(": "), F.substring(s["value"], 1, shown)))


def merge(base: Column, overlay: Column, kind: DataType) -> Column:
    """Structs merge field by field, maps key by key, everything else the overlay replaces where it is set."""
    if isinstance(kind, StructType):
        both = F.struct(*[merge(base[f.name], overlay[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(overlay.isNull(), base).when(base.isNull(), overlay).otherwise(both)
    if isinstance(kind, MapType):
        kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(overlay, k))
        return F.when(overlay.isNull(), base).when(base.isNull(), overlay).otherwise(F.map_concat(kept, overlay))
    return F.coalesce(overlay, base)


def patch(base: Column, overlay: Column, kind: StructType, allowed: Sequence[str]) -> Column:
    """A merge restricted to the allowed fields."""
    return F.struct(*[(merge(base[f.name], overlay[f.name], f.dataType) if f.name in allowed else base[f.name]).alias(f.name) for f in kind.fields])


def dedupe_array(x: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in order; elements with a null or empty key go."""
    return F.filter(x, lambda v, i: (F.coalesce(key(v), F.lit("")) != "") & ~F.exists(F.slice(x, F.lit(1), i), lambda u: key(u) == key(v)))


def pad_row(row: Column, width: int) -> Column:
    """Cut or filled with empty strings to ``width``."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.lit(width))), 1, width)


def informative_grid(rows: Column, least_marks: int = 4, least_in_row: int = 2) -> Column:
    """Whether boolean rows hold enough marks, and one row enough by itself."""
    marks = F.transform(rows, lambda r: F.size(F.filter(r, lambda v: v)))
    return (F.aggregate(marks, F.lit(0), lambda a, n: a + n) >= least_marks) & (F.coalesce(F.array_max(marks), F.lit(0)) >= least_in_row)


def position_row(label: Column, positions: Column, columns: int) -> Column:
    return F.concat(F.array(label), F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: F.when(F.array_contains(positions, i), F.lit("filled")).otherwise(F.lit(""))))


#: Rules that are broadcast; more are joined by their code.
RULES_AT_ONCE = 20_000


def apply_rules(df: DataFrame, rules: DataFrame, text: str, fields: Sequence[str], code: str | None = None) -> DataFrame:
    """Overlay constants where a rule fits: its code is the row's (null: any) and all its tokens occur in the text.

    ``rules``: rule_id, code, tokens (array), and a column for each of ``fields``.  Of several
    rules that fit, the first by rule_id that sets a field wins; the row's own value yields to
    it.  Each row meets the rules of its code alone, by an equi-join over code or 'any'.
    """
    # Without a code every row meets every rule, so the rules go to the rows; their number is checked.
    count = rules.count()
    if code is None and count > RULES_AT_ONCE:
        raise ValueError(f"{count} rules without a code to find them by; at most {RULES_AT_ONCE}")
    r = rules.select("rule_id", F.coalesce("code", F.lit("*")).alias("_c"), "tokens", *[F.col(f).alias(f"_r_{f}") for f in fields])
    key = F.array(F.lit("*"), F.col(code)) if code else F.array(F.lit("*"))
    low = F.upper(F.coalesce(F.col(text), F.lit("")))
    # The tokens are tested where the texts are; only ids of fitting rules travel.
    w = df.withColumn("__qw_id", F.xxhash64(*df.columns)).withColumn("__qw_up", low)
    hits = w.select("__qw_id", "__qw_up", F.explode(key).alias("_c")).join(F.broadcast(r) if count <= RULES_AT_ONCE else r, "_c").filter(F.forall("tokens", lambda t: F.contains(F.col("__qw_up"), F.upper(t))))
    best = hits.groupBy("__qw_id").agg(*[F.min_by(f"_r_{f}", F.when(F.col(f"_r_{f}").isNotNull(), F.col("rule_id"))).alias(f"_b_{f}") for f in fields])
    out = w.drop("__qw_up").join(best, "__qw_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_b_{f}"), F.col(f)))
    return out.select(*df.columns)


def descending_table(table: Column, count: int) -> Column:
    """Whether a map of position to text falls strictly over positions 1..count."""
    value = lambda i: F.try_element_at(table, i.cast("string")).try_cast("double")
    steps = F.forall(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: F.coalesce(value(i) > value(i + 1), F.lit(False)))
    return (F.size(table) >= count) & steps


def bounded_table(table: Column, count: int, low: float, high: float) -> Column:
    """Whether every entry has a position in 1..12 and a value in the bounds, and there are enough."""
    ok = F.forall(F.map_entries(table), lambda e: F.coalesce(e["key"].try_cast("int").between(1, 12) & e["value"].try_cast("double").between(low, high), F.lit(False)))
    return (F.size(table) >= count) & ok


RESPONSE = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>"


def response_text(x: Column) -> Column:
    """The text of a model response kept as JSON: its own field, else the text parts joined; null if there is none."""
    r = F.from_json(x, RESPONSE)
    parts = F.flatten(F.transform(r["output"], lambda o: F.coalesce(F.filter(o["content"], lambda c: c["type"].isin("output_text", "text") & (F.coalesce(c["text"], F.lit("")) != "")), F.array().cast("array<struct<type:string,text:string>>"))))
    joined = F.trim(F.array_join(F.transform(parts, lambda c: c["text"]), "\n"))
    return F.when(r["output_text"].isNotNull(), F.trim(r["output_text"])).when(joined != "", joined)


def search_blob(*parts: Column) -> Column:
    """Strings as they are and everything else as JSON, joined by blanks, nulls left out."""
    return F.concat_ws(" ", *parts)
