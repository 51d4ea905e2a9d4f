"""Fact extraction from section texts: identifiers, labelled values, tables, inferred kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, extract, first_of, sentences, sorted_values

# Shapes of what a section states.
FREQUENCY = "(?i)\\b(315|433|434|868|902)\\s*MHz\\b"
FCC = "(?i)\\bFCC(?: Info| ID)?[:\\s]+([A-Z0-9-]{5,24})"
CODE_SERIES = "(?i)\\bCode Series[:\\s]+([A-Z0-9-]+)"
CHIP = "(?i)\\bChip[:\\s]+([A-Za-z0-9 ()/-]+?)(?=\\s+(?:Reusable|Code Series|FCC|PIN)|$)"
PART = "\\b([0-9]{7,9}[A-Z]{0,2}|[0-9]{5}-[0-9]{5}|[0-9]{5}-[A-Z0-9]{2,4}-[A-Z0-9]{2,4})\\b"
KEYWAY = "\\b((?:PRX|RHK|RKE|FLIP)-[A-Z0-9-]+|(?:TOY|HON|NIS|NSN|HU|CY|HD|DA|TR|Y|B)[0-9]{1,5}[A-Z]?)\\b"
YEAR_HINT = "((?:19|20)[0-9]{2}\\s*[-–]\\s*[0-9]{2,4})"
SYSTEM_CODE = "^[A-Z]{2,10}-[A-Z0-9]{1,4}$"
TOPICS = ("proximity", "transponder", "remote", "lishi", "determinator", "programming")
CAPS = {"parts": 30, "fcc_ids": 20, "frequencies": 8, "keyways": 20}
#: What labelled values are kept under, and how they are recognised.
LABELLED = {
    "frequency": FREQUENCY,
    "code_series": CODE_SERIES,
    "chip": CHIP,
    "macs": "(?i)\\bMACS[:\\s]+([0-9]{1,2})\\b",
    "card": "(?i)\\bCARD#?[:#\\s]+([A-Z0-9.-]*[0-9][A-Z0-9.-]*)",
    "test_key": "(?i)Test\\s*Key\\s*is\\s*([A-Z0-9/-]+)",
    "reusable": "(?i)Reusable[:\\s]+([A-Za-z0-9 ]{1,60})",
    "factory_tool": "(?i)Factory Tool\\s+(.{1,80}?)(?:PIN|TCODE|SMART|$)",
    "emergency_key": "(?is)Emergency.{0,30}?([0-9]{7,9}[A-Z]{0,2}|[0-9]{5}-[0-9]{5}|[A-Z]{1,3}[0-9]{2,4}[A-Z]?)",
    "pin_kit": "(?i)\\b(?:pin kit|pin)\\s*[:#]?\\s*([0-9]{4,8}[A-Z]?)\\b",
    "buttons": "(?i)([0-9])\\s*Btn",
    "year_hint": YEAR_HINT,
    "lishi": "(?i)\\bLishi[:\\s|]+(HU[0-9]{1,4}(?:\\s*v[0-9]+)?)",
}


def valid_fcc(x: Column) -> Column:
    """5 to 24 signs with a letter and a digit."""
    up = F.upper(F.trim(x))
    return F.rlike(up, F.lit("^[A-Z0-9-]{5,24}$")) & F.rlike(up, F.lit("[A-Z]")) & F.rlike(up, F.lit("[0-9]")) & ~up.isin("111FO", "1NFO", "INFO", "FCC")


def good_identifier(x: Column) -> Column:
    """2 to 32 plain signs, a digit among them."""
    return F.rlike(F.trim(x), F.lit("^[A-Za-z0-9#./ -]{2,32}$")) & F.rlike(x, F.lit("[0-9]"))


def valid_keyway(x: Column) -> Column:
    return good_identifier(x) & F.rlike(F.upper(F.trim(x)), F.lit("^" + KEYWAY.removeprefix("\\b").removesuffix("\\b") + "$"))


def system_code(x: Column | str) -> Column:
    """Upper case, foreign signs dropped, a hyphen put between letters and digits; empty if it has no code's shape."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(col(x), F.lit(""))), "[^A-Z0-9-]", ""), "^-+|-+$", "")
    joined = F.when(F.rlike(clean, F.lit("^[A-Z]{2,6}[0-9]{1,3}$")), F.regexp_replace(clean, "^([A-Z]+)([0-9]+)$", "$1-$2")).otherwise(clean)
    return F.when(F.rlike(joined, F.lit(SYSTEM_CODE)), joined).otherwise("")


def labelled(x: Column | str, patterns: dict[str, str] = LABELLED) -> Column:
    """struct of the first value of each pattern, null where there is none."""
    return F.struct(*[F.trim(extract(x, p)).alias(name) for name, p in patterns.items()])


def identifiers(x: Column | str) -> Column:
    """Sorted distinct identifiers; sorted first, then checked, then capped."""
    text = col(x)
    keep = lambda values, test, cap: F.slice(F.filter(values, test), 1, cap)
    return F.struct(
        keep(sorted_values(text, PART, 1), good_identifier, CAPS["parts"]).alias("parts"),
        keep(sorted_values(text, FCC, 1), valid_fcc, CAPS["fcc_ids"]).alias("fcc_ids"),
        F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FREQUENCY), F.lit(1)), lambda v: F.concat(v, F.lit(" MHz"))))), 1, CAPS["frequencies"]).alias("frequencies"),
        keep(sorted_values(text, KEYWAY, 1), valid_keyway, CAPS["keyways"]).alias("keyways"),
    )


def topics(x: Column | str, words: Sequence[str] = TOPICS) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def depth_table(x: Column | str) -> Column:
    """Map of depth number to value from 'n = .ddd'; the last of a number stays."""
    numbers = F.regexp_extract_all(col(x), F.lit("([1-9])\\s*=\\s*[.]([0-9]{3})"), F.lit(1))
    found = F.regexp_extract_all(col(x), F.lit("([1-9])\\s*=\\s*[.]([0-9]{3})"), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("k"), found.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.concat(F.lit("."), p["v"]))))


def spacing_values(x: Column | str) -> Column:
    """Thousandths before the word DEPTHS, in order; empty without the word SPACING."""
    text = F.coalesce(col(x), F.lit(""))
    segment = F.split(text, "(?i)\\bDEPTHS?\\b")[0]
    found = F.transform(F.regexp_extract_all(segment, F.lit("(?<![0-9])[.]?\\s*([0-9]{3})(?![0-9])"), F.lit(1)), lambda v: v.cast("int"))
    return F.when(F.contains(F.upper(text), F.lit("SPACING")), found).otherwise(F.array().cast("array<int>"))


def remote_options(x: Column | str) -> Column:
    """array<struct> of the remotes that sentences name by part number, each kind once."""
    lines = F.filter(sentences(x), lambda s: F.rlike(s, F.lit("FCC|Fob|Remote")) & F.rlike(s, F.lit(PART)))
    rows = F.transform(
        lines,
        lambda s: F.struct(
            F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(s, F.lit(PART), F.lit(1))), 1, 2), " / ").alias("part"),
            F.regexp_extract(s, YEAR_HINT, 1).alias("years"),
            F.upper(F.regexp_extract(s, FCC, 1)).alias("fcc_id"),
            F.regexp_extract(s, FREQUENCY, 1).alias("frequency"),
            F.regexp_extract(s, LABELLED["buttons"], 1).alias("buttons"),
        ),
    )
    return F.array_distinct(rows)


def system_type(x: Column | str) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.when(F.contains(low, F.lit("proximity")), "Proximity / Smart Key").when(F.contains(low, F.lit("fobik")), "Fobik").when(F.contains(low, F.lit("transponder")), "Transponder Key").otherwise("Key")


def remote_type(x: Column | str) -> Column:
    return F.when(first_of(x, ["proximity"], "") != "", "Proximity fob").when(first_of(x, ["remote"], "") != "", "Remote").otherwise("Key")


def title(code: Column, applications: Column, makes: int = 2, models: int = 4) -> Column:
    """'years makes models' of array<struct<make,model,year_from,year_to>>, long lists cut with a plus."""
    label = lambda xs, n: F.concat(F.array_join(F.slice(xs, 1, n), " / "), F.when(F.size(xs) > n, " +").otherwise(""))
    clean = lambda f: F.filter(F.array_distinct(F.transform(applications, lambda a: F.trim(F.coalesce(a[f], F.lit(""))))), lambda v: v != "")
    years = F.filter(F.flatten(F.transform(applications, lambda a: F.array(a["year_from"], a["year_to"]))), lambda y: y.isNotNull())
    span = F.when(F.size(years) > 0, F.concat(F.array_min(years).cast("string"), F.lit("-"), F.array_max(years).cast("string")))
    parts = F.filter(F.array(span, label(F.array_sort(clean("make")), makes), label(clean("model"), models)), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when((F.size(applications) > 0) & (F.size(parts) > 0), F.array_join(parts, " ")).otherwise(F.concat(code, F.lit(" Vehicle Reference")))
