"""Column functions for the repair, scoring, cleaning and extraction of scanned text.

All are built-in expressions, so they compile into one projection.  Regular expressions state
their case and Unicode flags, since the engine's defaults differ from other dialects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike characters of scanned text and what they stand for.
LOOK_ALIKES = {
    "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
    "Р": "P", "С": "C", "А": "A", "О": "O", "Т": "T", "М": "M", "В": "B", "Н": "H", "К": "K",
    "х": "x", "а": "a", "е": "e", "о": "o", "с": "c", "і": "i", "т": "t", "ч": "h", "ы": "b", "ь": "b",
    "р": "p", "н": "h", "и": "u", "г": "r", "л": "n", "б": "b", "д": "d", "™": "",
}
#: Domain terms that speak for a good reading.
DOMAIN_TERMS = ("FCC", "MHz", "Lishi", "AccuReader", "Determinator", "Remote", "Fob", "Code Series", "SPACING", "DEPTHS", "PIN", "Transponder", "Chip", "Key", "Door", "Trunk", "Ignition")
#: Record kinds in the order they are tried.
TYPE_WORDS = ("Proximity", "Fobik", "Key", "Remote", "Transponder")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ocr_clean(x: Column | str, table: Mapping[str, str] = LOOK_ALIKES) -> Column:
    """Look-alikes mapped, blanks squeezed, three or more newlines to two, trimmed.  Null stays null.

    Every key is one character and every value at most one, so one ``translate`` is enough:
    characters without a value come last and vanish.
    """
    keys = sorted(table, key=lambda k: not table[k])
    out = F.translate(col(x), "".join(keys), "".join(table[k] for k in keys))
    out = F.regexp_replace(out, "(?U)[^\\S\\r\\n]+", " ")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")


def count_matches(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(x), F.lit(pattern))


def quality_points(x: Column | str, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    """Hundredths of the reading quality: letters, spaces and domain terms for it, foreign and noisy signs against.

    Whole numbers, so that no tie depends on rounding.  Null and empty texts score 0.
    """
    text = F.coalesce(col(x), F.lit(""))
    points = (
        100 * count_matches(text, "[A-Za-z]")
        + 15 * count_matches(text, " ")
        + 1200 * count_matches(text, "(?i)\\b(?:" + "|".join(terms) + ")\\b")
        - 800 * count_matches(text, "[^\\x00-\\x7F]")
        - 500 * count_matches(text, "[±¤\\[\\]{}]|[A-Za-z][0-9][A-Za-z]")
    )
    return points.cast("long")


def quality_score(x: Column | str, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    return quality_points(x, terms) / F.lit(100.0)


def clamp(x: Column | str, limit: float = 999.99) -> Column:
    """Rounded to two places within +/- ``limit``, as a NUMERIC(5,2) holds it."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.round(col(x), 2)))


def choose_text(native: Column | str, scanned: Column | str, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    """Native text if it scores 0.85 of the scan at least and is long; the scan if better and not short; else what there is."""
    a, b = F.coalesce(col(native), F.lit("")), F.coalesce(col(scanned), F.lit(""))
    pa, pb = quality_points(a, terms), quality_points(b, terms)
    return (
        F.when((100 * pa >= 85 * pb) & (F.char_length(a) > 80), a)
        .when((pb >= pa) & (F.char_length(b) > 40), b)
        .when(a != "", a)
        .otherwise(b)
    )


def alnum_fold(x: Column | str) -> Column:
    """Letters and digits of any script, lower case."""
    return F.lower(F.regexp_replace(col(x), "[^\\p{L}\\p{N}]", ""))


def first_of(x: Column | str, words: Sequence[str], default: str) -> Column:
    """The first listed word that occurs in ``x``, whatever its case."""
    low, out = F.lower(col(x)), None
    for w in words:
        hit = F.contains(low, F.lit(w.lower()))
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return out.otherwise(F.lit(default))


def detect_type(x: Column | str) -> Column:
    return first_of(x, TYPE_WORDS, "Key")


def extract(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(col(x), pattern, group), F.lit(""))


def sorted_values(x: Column | str, pattern: str, group: int = 0, cap: int | None = None) -> Column:
    """Distinct matches in order; ``cap`` cuts after sorting."""
    out = F.array_sort(F.array_distinct(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))))
    return F.slice(out, 1, cap) if cap else out


def replace_all(x: Column | str, table: Mapping[str, str]) -> Column:
    """Literal replacements in listed order: later ones see what earlier ones made."""
    out = col(x)
    for a, b in table.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rewrite(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """White space to one blank, then pattern rules in order, without regard to case."""
    out = F.trim(F.regexp_replace(col(x), "(?U)\\s+", " "))
    for pattern, to in rules:
        out = F.regexp_replace(out, "(?iu)" + pattern, to)
    return out


def worked_out(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``columns`` that are worked out once, whatever reads them.

    They come out of a generator of one row: neither filters nor projections above it repeat them.
    """
    held = df.withColumn("__held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.withColumns({n: F.col("__held")[n] for n in columns}).drop("__held")


def letter_ratio(x: Column | str) -> Column:
    return count_matches(x, "[A-Za-z]") / F.greatest(F.char_length(col(x)), F.lit(1))


def public_text(x: Column | str, banned: str | None = None) -> Column:
    """The text, or empty if it has a sign outside ASCII, a banned pattern, or over 24 signs with few letters."""
    text = F.coalesce(col(x), F.lit(""))
    bad = F.rlike(text, F.lit("[^\\x00-\\x7F]")) | ((F.char_length(text) > 24) & (100 * count_matches(text, "[A-Za-z]") < 42 * F.char_length(text)))
    if banned:
        bad = bad | F.rlike(text, F.lit("(?iu)" + banned))
    return F.when(bad, F.lit("")).otherwise(text)


def suspicious_name(x: Column | str, tokens: Sequence[str] = ()) -> Column:
    """Listed tokens, a digit in a long name, unbalanced parentheses, or a length outside 2..45."""
    text = F.coalesce(col(x), F.lit(""))
    opening = F.char_length(text) - F.char_length(F.replace(text, F.lit("("), F.lit("")))
    closing = F.char_length(text) - F.char_length(F.replace(text, F.lit(")"), F.lit("")))
    out = (F.rlike(text, F.lit("[0-9]")) & (F.char_length(text) > 18)) | (opening != closing) | ~F.char_length(text).between(2, 45)
    return out | F.rlike(text, F.lit("(?i)" + "|".join(tokens))) if tokens else out


def sentences(x: Column | str) -> Column:
    """Split at newlines and after full stops; blank parts go."""
    return F.filter(F.transform(F.split(col(x), "[\\n\\r]+|(?<=\\.)\\s+"), lambda s: F.trim(s)), lambda s: s != "")


def meaningful_line(x: Column | str) -> Column:
    """28 to 520 characters, three spaces at least, fit for the public."""
    return F.char_length(col(x)).between(28, 520) & (count_matches(x, " ") >= 3) & (public_text(x) != "")


def rule_texts(x: Column | str, rules: Sequence[tuple[str, str]], cap: int | None = None) -> Column:
    """Texts of the rules whose keyword occurs, in rule order."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    out = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(t)) for k, t in rules]), lambda v: v.isNotNull())
    return F.slice(out, 1, cap) if cap else out


def safe_stem(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), "\\.[^.]*$", ""), "[^A-Za-z0-9._-]+", "_")


def section_code(x: Column | str) -> Column:
    """Upper case, foreign signs dropped, the first code shape, a hyphen after four signs where it lacks one."""
    up = F.regexp_replace(F.upper(F.replace(col(x), F.lit("_"), F.lit("-"))), "[^A-Z0-9-]", "")
    found = F.regexp_extract(up, "[A-Z]{2,5}-?[A-Z0-9]{1,4}", 0)
    return F.when(found == "", up).when(~F.contains(found, F.lit("-")) & (F.char_length(found) > 4), F.concat(F.substring(found, 1, 4), F.lit("-"), F.substring(found, 5, 99))).otherwise(found)


def numeric_suffix(x: Column | str) -> Column:
    return F.try_to_number(extract(x, "-([0-9]+)$"), F.lit("999999999")).cast("int")


def next_code(x: Column | str) -> Column:
    """The code with its final number one higher; empty if it does not have the shape."""
    shape = "^([A-Z]{2,10}-[A-Z]?)([0-9]+)$"
    number = F.regexp_extract(col(x), shape, 2)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.regexp_extract(col(x), shape, 1), (number.cast("long") + 1).cast("string")))


def link_points(make: Column | str, model: Column | str, default_make: Column | str, similarity: Column | float = 0.0, debris: str = "[.)]\\s*$") -> Column:
    """Hundredths of the confidence of a link: .76, better when canonical or overridden, worse with digits, length or debris."""
    make, model, default_make = F.coalesce(col(make), F.lit("")), F.coalesce(col(model), F.lit("")), F.coalesce(col(default_make), F.lit(""))
    similarity = similarity if isinstance(similarity, Column) else F.lit(similarity)
    points = (
        F.lit(76)
        + F.when(similarity >= 0.78, 8).otherwise(0)
        + F.when((make != "") & (default_make != "") & (make != default_make), 8).otherwise(0)
        - F.when(F.rlike(model, F.lit("[0-9]")), 6).otherwise(0)
        - F.when(F.char_length(model) > 24, 12).otherwise(0)
        - F.when(F.rlike(model, F.lit(debris)), 16).otherwise(0)
    )
    return F.greatest(F.lit(35), F.least(F.lit(90), points))
