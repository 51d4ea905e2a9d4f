"""Repair of scanned section pages and of the codes in their headings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed values, in the order in which they are applied: misread words of section pages.
PAGE_REPAIRS = (
    ("SECTlON", "SECTION"), ("SECT10N", "SECTION"), ("SECTI0N", "SECTION"), ("SECTAON", "SECTION"), ("SECTTO", "SECTIO"), ("SEGHON", "SECTION"), ("SЕCT", "SECT"),
    ("ВМУЬ", "BMW-"), ("ВМ\\ЈЪ", "BMW-"), ("ВМЊ", "BMW-"), ("вм", "BM"), ("МВ", "MB"), ("мв", "MB"), ("П-", "FA-"), ("ПИ", "FA-"), ("Пиб", "FA-6"), ("ПИЗ", "FA-3"), ("АСИ", "ACU"),
    ("Асига", "Acura"), ("НОН", "HON"), ("НК", "HK"), ("нк", "HK"), ("6М", "GM"), ("ЁМ", "GM"), ("ЈЕЕР", "JEEP"), ("ТОУ", "TOY"), ("0n-Board", "On-Board"), ("lnformation", "Information"),
    ("•", "-"), ("·", "-"),
)
# Misread numbers behind a make's prefix, tried in this order.
NUMBER_REPAIRS = {
    "HK": (("2З", "23"), ("З1", "31"), ("З6", "36"), ("З7", "37"), ("З8", "38"), ("ЗД", "39"), ("4О", "40"), ("4Д", "49"), ("З", "3"), ("1З", "13"), ("Л", "7"), ("Б", "6")),
    "JEEP": (("З", "3"), ("1О", "10")),
}
STRICT_HEADER = "(?i)\\b([A-Z]{2,5}[-.]?[A-Z0-9]{1,4})\\s*[-.]?\\s*S[E3]CT(?:I|1|\\[)?(?:O|0)?N?\\b"
LOOSE_HEADER = "(?iu)([A-Z0-9А-Яа-яЈЬ•._-]{2,14})\\s*S[E3]CT"
GM_HEADER = "(?iu)(?:GM|СМ|ЗМ)[.\\s-]*([FBKPВКР])\\s*([0-9ОЗД]{1,3})\\s+SECTION\\b"
TOYOTA_HEADER = "(?i)\\bTOY[.\\s-]*([0-9ОЗД]{1,3})\\s+SECTION\\b"
# Look-alikes in a code; prefixes that a document's codes are misread as.
CODE_LETTERS = (("В", "B"), ("М", "M"), ("У", "Y"), ("Ь", "W"), ("Ј", "J"), ("Л", "A"), ("И", "N"), ("П", "FA"))
DOCUMENT_PREFIXES = {
    "asian": {"ACJ": "ACU", "NLS": "NIS", "LSUZU": "ISUZU", "TSUZU": "ISUZU", "MLTS": "MITS", "WTS": "MITS", "SUZL": "SUZU", "SUZI": "SUZU", "SUA": "SUZU", "MFA": "MAZ", "Y": "TOY", "SUN": "SUB"},
    "domestic": {"DCE": "DGE", "CM": "GM"},
    "audi": {"AVA": "AV"},
    "jaguar": {"JUR": "JLR", "ULR": "JLR", "JER": "JLR"},
}
_DIGITS = ("ОЗД", "039")


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, so that steps which use it often do not multiply."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _first_header(text: Column, pattern: str, prefix: str, family: int | None) -> Column:
    """``text`` with headings of one make in their plain form; a page's headings share the first one's code."""
    number = F.translate(F.upper(F.regexp_extract(text, pattern, 2 if family else 1)), *_DIGITS)
    letter = F.translate(F.upper(F.regexp_extract(text, pattern, 1)), "ВКР", "BKP") if family else F.lit("")
    plain = F.concat(F.lit(prefix), letter, number, F.lit(" SECTION"))
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_replace(text, F.lit(pattern), plain)).otherwise(text)


def page_text(x: Column | str) -> Column:
    """A section page with misread words and headings restored; null is empty."""
    out = F.coalesce(col(x), F.lit(""))
    for wrong, right in PAGE_REPAIRS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = _let(out, lambda t: _first_header(t, GM_HEADER, "GM-", 1))
    out = _let(out, lambda t: _first_header(t, TOYOTA_HEADER, "TOY-", None))
    out = F.regexp_replace(out, "\\bHON[.\\s-]*Р(?=[0-9])", "HON-P")
    for prefix, pairs in NUMBER_REPAIRS.items():
        for wrong, right in pairs:
            out = F.regexp_replace(out, f"(?<=\\b{prefix}|\\b{prefix}[.-]){wrong}\\b", right)
    return out


def heading_code(x: Column | str, document: Column | str = "") -> Column:
    """The code of the page's section heading, by its strict form, else by a loose one; empty if there is none."""

    def found(text: Column) -> Column:
        strict = F.regexp_extract(F.replace(text, F.lit("."), F.lit("-")), STRICT_HEADER, 1)
        return document_code(F.when(strict != "", strict).otherwise(F.regexp_extract(text, LOOSE_HEADER, 1)), document, text)

    return _let(page_text(x), found)


def document_code(x: Column | str, document: Column | str = "", context: Column | str | None = None) -> Column:
    """A code in its plain form under the habits of its document; empty if it has no code's shape.

    ``document`` is a column or, as a string that names none, the empty name.
    """
    name = F.lower(document if isinstance(document, Column) else F.lit(document))
    page = F.upper(F.lit("") if context is None else col(context))
    code = F.regexp_replace(F.upper(F.translate(F.coalesce(col(x), F.lit("")), ".•_", "---")), "^-+|-+$", "")
    for wrong, right in CODE_LETTERS:
        code = F.replace(code, F.lit(wrong), F.lit(right))
    code = F.regexp_replace(code, "[^A-Z0-9-]+", "")
    digits = lambda v: F.translate(v, "TILOQSB", "1110058")
    asian, domestic = F.contains(name, F.lit("asian")), F.contains(name, F.lit("domestic"))
    joined, gm = "^([A-Z]{2,5})([A-Z]?[0-9]{1,4})$", "^GM-([FBKP])4([0-9]{2})$"

    def bmw(c: Column) -> Column:
        tail = F.regexp_replace(c, "^[A-Z-]+", "")
        return F.when(F.startswith(name, F.lit("bmw")) & F.rlike(c, F.lit("^(?:BMYW|BMWB|BMV|BMX)")), F.concat(F.lit("BMW-"), F.when(tail != "", tail).otherwise(digits(F.right(c, F.lit(1)))))).otherwise(c)

    def fiat(c: Column) -> Column:
        last = digits(F.right(F.regexp_replace(c, "[^0-9A-Z]+", ""), F.lit(1)))
        return F.when(F.contains(name, F.lit("fiat")) & ~F.startswith(c, F.lit("FA")) & (last != ""), F.concat(F.lit("FA-"), last)).otherwise(c)

    def makes(c: Column) -> Column:
        return (
            F.when(F.startswith(name, F.lit("mercedes")) & F.rlike(c, F.lit("^MB[^-]*$")), F.concat(F.lit("MB-"), digits(F.substring(c, 3, 99))))
            .when(asian & F.rlike(c, F.lit("^F[0-9]{1,3}$")) & F.contains(page, F.lit("ACU")), F.concat(F.lit("ACU-"), c))
            .when(asian & F.rlike(c, F.lit("^R[0-9]{1,3}$")), F.concat(F.lit("HON-"), c))
            .when(asian & (c == "SUZU-3") & F.contains(page, F.lit("ASCENDER")), F.lit("ISUZU-3"))
            .otherwise(c)
        )

    def hyphened(c: Column) -> Column:
        prefix = F.regexp_extract(c, joined, 1)
        return F.when(prefix != "", F.concat(F.when(prefix.isin("AVB", "AW"), F.lit("AV")).otherwise(prefix), F.lit("-"), F.regexp_extract(c, joined, 2))).otherwise(c)

    def continued(c: Column) -> Column:
        number = F.regexp_extract(c, gm, 2).try_cast("int").cast("string")
        return F.when(domestic & F.rlike(c, F.lit(gm)) & F.contains(page, F.lit("CONTINU")), F.concat(F.lit("GM-"), F.regexp_extract(c, gm, 1), number)).otherwise(c)

    def prefixed(c: Column) -> Column:
        head, rest = F.regexp_extract(c, "^([^-]*)-", 1), F.regexp_replace(c, "^[^-]*-", "")
        out = c
        for marker, repairs in reversed(DOCUMENT_PREFIXES.items()):  # the first marker that fits decides
            to = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in repairs.items() for v in pair]), head), head)
            tail = F.when((head == "AVA") & (rest == "5"), F.lit("15")).otherwise(rest) if marker == "audi" else rest
            out = F.when(F.contains(name, F.lit(marker)) & F.contains(c, F.lit("-")), F.concat(to, F.lit("-"), tail)).otherwise(out)
        return out

    def shaped(c: Column) -> Column:
        ok = F.rlike(c, F.lit("^[A-Z]{2,10}-[A-Z0-9]{1,4}$")) & F.rlike(c, F.lit("[0-9]")) & ~F.contains(c, F.lit("CONTINU"))
        return F.when(ok, c).otherwise("")

    for step in (bmw, fiat, makes, hyphened, continued, prefixed, shaped):
        code = _let(code, step)
    return code
