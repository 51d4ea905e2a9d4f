"""Makes and models as scanned headings write them: repair, aliases, overrides, known models.

Tables of fixed size are values that must match; the vocabulary of models is a parameter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, replace_all, worked_out

# -- fixed values -----------------------------------------------------------------------------------

#: The make that the letters of a section code stand for.
PREFIX_MAKES = {
    "ACU": "Acura", "HON": "Honda", "ISUZU": "Isuzu", "LSUZU": "Isuzu", "SUZL": "Suzuki", "MAZ": "Mazda", "MITS": "Mitsubishi", "MLTS": "Mitsubishi", "WTS": "Mitsubishi", "NIS": "Nissan", "NLS": "Nissan",
    "SB": "Subaru", "LEX": "Lexus", "TOY": "Toyota", "HK": "Kia", "CHRY": "Chrysler", "DGE": "Dodge", "DODGE": "Dodge", "DCE": "Dodge", "FORD": "Ford", "GM": "Chevrolet", "CM": "Chevrolet", "VOL": "Volvo", "AV": "Audi", "BMW": "BMW", "MB": "Mercedes-Benz",
}
KNOWN_MAKES = (
    "Acura", "Alfa Romeo", "Audi", "BMW", "Buick", "Cadillac", "Chevrolet", "Chrysler", "Dodge", "Fiat", "Ford", "GMC", "Honda", "Hummer", "Infiniti", "Isuzu", "Jaguar", "Jeep", "Kia", "Land Rover", "Lexus", "Lincoln", "Mazda",
    "Mercedes", "Mercedes-Benz", "Mercury", "Mini", "Mitsubishi", "Nissan", "Oldsmobile", "Plymouth", "Pontiac", "Porsche", "Saab", "Saturn", "Scion", "Subaru", "Suzuki", "Toyota", "Volkswagen", "Volvo",
)
#: Makes that a document may name, by a word of its name.
DOCUMENT_MAKES = {
    "asian": ("Acura", "Honda", "Infiniti", "Isuzu", "Kia", "Lexus", "Mazda", "Mitsubishi", "Nissan", "Scion", "Subaru", "Suzuki", "Toyota"),
    "domestic": ("Buick", "Cadillac", "Chevrolet", "Chrysler", "Dodge", "Ford", "GMC", "Jeep", "Lincoln", "Mercury", "Oldsmobile", "Pontiac", "Saturn"),
    "audi": ("Audi", "Volkswagen", "Porsche"),
    "bmw": ("BMW", "Mini"),
    "fiat": ("Fiat", "Alfa Romeo"),
    "jaguar": ("Jaguar", "Land Rover"),
    "mercedes": ("Mercedes-Benz",),
    "saab": ("Saab",),
    "volvo": ("Volvo",),
}
#: Aliases of a make after title case.
MAKE_ALIASES = {
    "Chevy": "Chevrolet", "Gmc": "GMC", "Vw": "Volkswagen", "Vwy": "Volkswagen", "V": "Volkswagen", "Onfniti": "Infiniti", "Linc": "Lincoln", "Lincf": "Lincoln", "LincOl": "Lincoln", "Co": "Lincoln", "Co1": "Lincoln", "Emc": "GMC", "Olds": "Oldsmobile",
    "Ge": "Geo", "Mercedes": "Mercedes-Benz", "Benz": "Mercedes-Benz",
}
#: Letters of another script that scanning reads for Latin ones.
LOOK_ALIKE = ("СсАаЕеОоРрХхНнКкМмТті", "CcAaEeOoPpXxHhKkMmTti")
SCAN_REPAIRS = {"ЗОО": "300", "З00": "300", "0ut": "Out", "1mpala": "Impala", "GiuIa": "Giulia", "TIХ": "TLX", "М0Х": "MDX", "(WW)": "(VW)", "(WwW)": "(VW)", "(Aud)": "(Audi)", "(Au)": "(Audi)"}
SCAN_PATTERNS = (("(?i)\\bAS(?=\\s*\\(Audi\\))", "A5"), ("(?i)\\bAG\\s*/\\s*S[E6](?=\\s*\\(Audi\\))", "A6 / S6"))
#: Broken makes in parentheses.
PAREN_REPAIRS = {"(vwY": "(VW)", "(vwy": "(VW)", "(vww": "(VW)", "xvw)": "(VW)", "onfniti)": "(Infiniti)", "Linc01f)": "(Lincoln)", "Emc)": "(GMC)", "GE0)": "(Geo)", "01ds)": "(Oldsmobile)"}
#: Makes that are taken out of a model's text.
NAMED_IN_MODELS = (
    "Acura", "Honda", "Nissan", "Infiniti", "Toyota", "Lexus", "Scion", "Ford", "Lincoln", "Mercury", "Chevrolet", "Cadillac", "Buick", "GMC", "Dodge", "Chrysler", "Jeep", "Plymouth", "Subaru", "Mazda", "Mitsubishi", "Suzuki", "Isuzu", "Volvo", "Saab", "BMW", "Mini",
    "Mercedes", "Audi", "Volkswagen", "Porsche",
)
MODEL_REPAIRS = {
    "1LX": "ILX", "T X": "TLX", "C1arity": "Clarity", "CIarity": "Clarity", "FueI ce": "Fuel Cell", "P1 In": "Plug-In", "PiIot": "Pilot", "E1ement": "Element", "SoIara": "Solara", "PreIude": "Prelude", "Odyseey": "Odyssey", "0dyseey": "Odyssey", "GaIant": "Galant",
    "Ga1ant": "Galant", "GaIar- t": "Galant", "AT o": "Amigo", "EcIipse": "Eclipse", "0utback": "Outback", "0utIander": "Outlander", "ExpIorer": "Explorer", "EscaIade": "Escalade", "BonneviIIe": "Bonneville", "Fu11": "Full", "Pick p": "Pick Up", "1-Miev": "i-MiEV",
    "WPh etow": "Phaeton", "To a e m": "Touareg", "JetW": "Jetta", "JettaMvw": "Jetta", "Coteadoxvw": "Corrado", "Passatxvw": "Passat", "Passatww": "Passat", "Tiguaniw": "Tiguan", "Tiguan(w": "Tiguan", "Touareg) eS copes ste carve me": "Touareg", "WA4/S4": "A4 / S4",
    "A4MS4": "A4 / S4", "A4 S4": "A4 / S4", "A S0": "A6 / S6", "A6 S6": "A6 / S6", "QOOT-04TT": "TT", "T2Caymam": "Cayman", "Cabriolet(vww t": "Cabriolet", "GoIf/GTi": "Golf / GTI", "Golf/GTi": "Golf / GTI", "FX35 FX45": "FX35 / FX45", "G35 (2DR": "G35", "G35 (4DR": "G35",
    "1S 350C": "IS 350C", "B1ackwood": "Blackwood", "Town Ca": "Town Car", "S15 sonoma p": "Sonoma", "Sierra Full Size Pick Up": "Sierra", "Savanna": "Savana", "S01stice": "Solstice", "Continental (": "Continental",
}
#: Pattern repairs of a model, in order.
MODEL_PATTERNS = (
    ("\\bCI\\b", "CL"),
    ("\\b(?:AW|AV|AVB)?\\.?[0-9]{1,2}\\b", ""),
    ("\\b(?:P x|p ox|CA ITL|StanCHt|Star1Cu|S1anCut|SIanCut).*", ""),
    ("(?i)\\((?:ho|honda|ford|chevy|emc|co|vw|m)[^)]*\\)", ""),
    ("(?i)\\b(?:St3rtCut|Cutt0CUhA|Ceterminatr|Air a|CX2|111-pt|EurovaMvw).*$", ""),
    ("(?i)\\bTouareg\\b.*", "Touareg"),
    ("(?i)\\bTiguan\\b.*", "Tiguan"),
    ("(?i)\\b(?:GoIf|Golf)\\s*/\\s*GTI.*", "Golf / GTI"),
    ("(?i)\\bA4\\s*/\\s*S4.*", "A4 / S4"),
    ("\\s+", " "),
)
#: Makes that a model's name decides.
MODEL_MAKES = {
    "A3": "Audi", "A4": "Audi", "A4 / S4": "Audi", "A5": "Audi", "A6 / S6": "Audi", "A7": "Audi", "A8 / S8": "Audi", "Q3": "Audi", "Q5": "Audi", "Q7": "Audi", "Q8": "Audi", "TT": "Audi", "Beetle": "Volkswagen", "Cabriolet": "Volkswagen", "CC": "Volkswagen",
    "Corrado": "Volkswagen", "EOS": "Volkswagen", "Eurovan": "Volkswagen", "Golf": "Volkswagen", "Golf / GTI": "Volkswagen", "Jetta": "Volkswagen", "Passat": "Volkswagen", "Rabbit": "Volkswagen", "Tiguan": "Volkswagen", "Phaeton": "Volkswagen", "Touareg": "Volkswagen",
    "928": "Porsche", "911": "Porsche", "718 Boxster": "Porsche", "718 Cayman": "Porsche", "Boxster": "Porsche", "Cayman": "Porsche", "Cayenne": "Porsche", "Macan": "Porsche", "Panamera": "Porsche", "Taycan": "Porsche", "FX35 / FX45": "Infiniti", "G35": "Infiniti",
    "Blackwood": "Lincoln", "Town Car": "Lincoln", "Sonoma": "GMC", "Sierra": "GMC", "SRX": "Cadillac", "DTS": "Cadillac",
}
#: What no model's name holds.
BAD_MODEL = (
    "code series", "depth", "spacing", "method", "factory", "reader", "decoder", "fcc", "mhz", "part", "section", "codes", "cooes", "caro", "startcut", "cutto", "cuttc", "cut10", "stancut", ".", "airbags", "air bags", "ignretainer", "itl", "mode1s", "optional",
    "0ptional", "overlap", "overiap", "tid-year", "cjlt",
)
#: Words of a heading that are no part of a model.
HEADING_WORDS = "(?i)\\b(?:prox|proximity|remote|fob|f0b|key|transponder|high sec|dbl sided|sided|ptox|p ox|p x|moxe?)\\b"
#: Where the models of a heading end.
SECTION_STOP = "(?i)\\b(?:CODES?|COOES|CARD#?|CARO#?|STYLE|STYI_E|MACS|StartCut|S1artCut|CuttoCut|AirBags|Ign|Retainer|KEYS?|MASTER|Chip|Programmer|Diagnostic|Cloner|Decoders?|Lishi|Determinator|AccuReader|SPACING|DEPTHS)\\b"
#: What a scan left of a make at the end of a model.
DEBRIS = "(?i)[.)]\\s*$|\\b(?:0sm|onfniti|Emc|Linc01f|GE0)\\b"
PAREN_MAKE = "\\(([A-Za-z][A-Za-z -]{1,24})\\)"
YEARS = "(?:19|20)[0-9]{2}\\s*[-–]\\s*[0-9]{2,4}"
#: Characters between a year range and a model, and between a model and its make.
NEAR_MODEL, NEAR_MAKE = 20, 30
MODEL_LENGTH = 80

# -- makes and models -------------------------------------------------------------------------------


def strip(x: Column, signs: str) -> Column:
    """``x`` without ``signs`` (of a character class) at its ends."""
    return F.regexp_replace(x, f"^[{signs}]+|[{signs}]+$", "")


def ocr_text(x: Column | str) -> Column:
    """Look-alike letters as Latin ones, white space to one blank."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(col(x), F.lit("")), *LOOK_ALIKE), "(?U)\\s+", " "))


def scan_text(x: Column | str) -> Column:
    """The text in which known models are looked for."""
    out = replace_all(ocr_text(x), SCAN_REPAIRS)
    for pattern, to in SCAN_PATTERNS:
        out = F.regexp_replace(out, pattern, to)
    return out


def make_name(x: Column | str) -> Column:
    """Title case, each part of a hyphened name too, aliases resolved."""
    clean = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^A-Za-z -]+", ""))
    title = F.array_join(F.transform(F.split(clean, "-"), F.initcap), "-")
    return F.coalesce(F.try_element_at(_map(MAKE_ALIASES), title), title)


def default_make(code: Column | str, document: Column | str) -> Column:
    """By the letters of the code, else the first known make that the document names; empty without one."""
    by_prefix = F.try_element_at(_map(PREFIX_MAKES), F.upper(F.substring_index(F.coalesce(col(code), F.lit("")), "-", 1)))
    low = F.lower(F.coalesce(col(document), F.lit("")))
    named = F.get(F.filter(F.array(*map(F.lit, KNOWN_MAKES)), lambda m: F.contains(low, F.lower(m))), 0)
    return F.coalesce(by_prefix, named, F.lit(""))


def possible_makes(document: Column | str, make: Column | str) -> Column:
    """The makes of the first listed word in the document's name, else the default make alone."""
    low, make = F.lower(F.coalesce(col(document), F.lit(""))), F.coalesce(col(make), F.lit(""))
    out = F.when(make != "", F.array(make)).otherwise(F.array().cast("array<string>"))
    for word, makes in reversed(DOCUMENT_MAKES.items()):
        out = F.when(F.contains(low, F.lit(word)), F.array(*map(F.lit, makes))).otherwise(out)
    return out


def model_text(x: Column | str) -> Column:
    """The part of a heading that may name models: without year ranges, kinds of keys and foreign signs, cut."""
    words = F.regexp_replace(F.regexp_replace(col(x), f"\\b{YEARS}\\b", " "), HEADING_WORDS, " ")
    clean = F.regexp_replace(F.regexp_replace(words, "[^A-Za-z0-9() /&.-]+", " "), "\\s+", " ")
    return F.trim(F.substring(strip(clean, " /,-"), 1, MODEL_LENGTH))


def model_name(x: Column | str) -> Column:
    """Literal repairs, then pattern repairs, in order."""
    out = replace_all(x, MODEL_REPAIRS)
    for pattern, to in MODEL_PATTERNS:
        out = F.regexp_replace(out, pattern, to)
    return strip(F.regexp_replace(out, "(?i)^cc$", "CC"), " /()-")


def named_make(x: Column | str, default: Column | str) -> Column:
    """The known make that stands in parentheses in a cleaned heading, else the default make."""
    named = make_name(F.regexp_extract(replace_all(x, PAREN_REPAIRS), PAREN_MAKE, 1))
    return F.when(named.isin(*KNOWN_MAKES), named).otherwise(F.coalesce(col(default), F.lit("")))


def bare_model(x: Column | str) -> Column:
    """The model in a cleaned heading, without any make."""
    bare = F.regexp_replace(F.regexp_replace(replace_all(x, PAREN_REPAIRS), PAREN_MAKE, ""), "(?i)\\b(?:" + "|".join(NAMED_IN_MODELS) + ")\\b", "")
    return model_name(strip(F.regexp_replace(bare, "\\s+", " "), " /,-"))


def make_of(model: Column | str, make: Column | str) -> Column:
    """The make that a model's name decides, else ``make``."""
    return F.coalesce(F.try_element_at(_map(MODEL_MAKES), col(model)), col(make))


def split_heading(df: DataFrame, heading: str, default: str) -> DataFrame:
    """``df`` with make and model of a cleaned heading."""
    held = worked_out(df, {"model": bare_model(heading), "make": named_make(heading, default)})
    return held.withColumn("make", make_of("model", "make"))


def bad_model(x: Column | str) -> Column:
    """A listed token, a length outside 2..45, fewer than two letters, or nothing but P, O, X and digits."""
    model = F.coalesce(col(x), F.lit(""))
    low = F.lower(model)
    out = ~F.char_length(model).between(2, 45) | (F.char_length(F.regexp_replace(model, "[^A-Za-z]", "")) < 2) | F.rlike(model, F.lit("^[PpOoXx0-9 /.-]+$"))
    for token in BAD_MODEL:
        out = out | F.contains(low, F.lit(token))
    return out


def _map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


# -- known models in a text -------------------------------------------------------------------------


def model_pattern(model: str) -> str:
    """A model's letters with the confusions of scanning: 0 for O, 1 for I, blanks and hyphens that may be missing."""
    alike = {"0": "[0O]", "1": "[1I]", "-": r"[-\s]?", "/": r"\s*/\s*"}
    return "".join(r"\s*" if c.isspace() else alike.get(c, re.escape(c)) for c in model)


def _fold(c: str) -> str:
    """A letter as the automaton reads it; signs that a model's pattern lets go are none."""
    if c.isspace() or c == "-":
        return ""
    low = c.casefold() if len(c.casefold()) == 1 else c
    return {"o": "0", "i": "1", "ı": "1"}.get(low, low)


class KnownModels:
    """One automaton over the folded names of all models; a hit is held against the model's own pattern."""

    def __init__(self, vocabulary: Mapping[str, Sequence[str]]):
        names: dict[str, list[tuple[str, str, re.Pattern]]] = {}
        for make, models in sorted(vocabulary.items()):
            for model in sorted(set(models), key=lambda m: (-len(m), m)):
                if key := "".join(map(_fold, model)):
                    names.setdefault(key, []).append((make, model, re.compile(model_pattern(model) + r"(?=[\s(|,]|\Z)", re.I)))
        self.automaton = ahocorasick.Automaton()
        for key, found in names.items():
            self.automaton.add_word(key, (len(key), found))
        if names:
            self.automaton.make_automaton()
        self.any = bool(names)

    def spans(self, text: str) -> dict[tuple[str, str], list[tuple[int, int]]]:
        """Per make and model, its places (start, end) in the text, in order."""
        out: dict[tuple[str, str], list[tuple[int, int]]] = {}
        if not self.any:
            return out
        folded = [(_fold(c), i) for i, c in enumerate(text)]
        folded = [(c, i) for c, i in folded if c]
        for end, (size, found) in self.automaton.iter("".join([c for c, _ in folded])):
            start = folded[end - size + 1][1]
            for make, model, pattern in found:
                if m := pattern.match(text, start):
                    out.setdefault((make, model), []).append((start, m.end()))
        return out

    def applications(self, text: str) -> list[dict]:
        """make, model, years, near of each year range that has the model within NEAR_MODEL characters.

        Of the year ranges that reach the same place of a model the first one takes it.  The last
        digits of a range may be the first of a model: the range then ends before them.
        """
        ranges = [(m.start(), m.end(1)) for m in re.finditer(f"(?=({YEARS}))", text)]
        out = []
        if not ranges:
            return out
        for (make, model), places in sorted(self.spans(text).items()):
            places.sort()
            starts, free = [a for a, _ in places], 0
            for a, b in ranges:
                if a < free:
                    continue
                digits = len(re.search("[0-9]+$", text[a:b])[0])
                for end in range(b, b - digits + 1, -1):
                    k = bisect_left(starts, end)
                    if k < len(starts) and starts[k] <= end + NEAR_MODEL:
                        free = places[k][1]
                        out.append({"make": make, "model": model, "years": text[a:end], "near": text[free : free + NEAR_MAKE]})
                        break
        return out


def applications(text: Column | str, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """array<struct<make,model,years,near>> of the known models beside year ranges, in Arrow batches.

    The vocabulary is a parameter of the program, so its size is known; null texts have none.
    """

    @F.pandas_udf("array<struct<make:string,model:string,years:string,near:string>>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = KnownModels(vocabulary)
        for texts in batches:
            yield pd.Series([models.applications(t) if t else [] for t in texts])

    return match(col(text))


def confirmed(hit: Column, make: Column | str, document: Column | str) -> Column:
    """Whether an application counts: its make may stand in the document, a make in parentheses close
    behind is the same, and without one it is the default make and the model has three signs at least."""
    near = F.regexp_extract(hit["near"], PAREN_MAKE, 1)
    named = F.when(near != "", make_name(near)).otherwise("")
    signs = F.char_length(F.regexp_replace(hit["model"], "[^A-Za-z0-9]", ""))
    alone = (hit["make"] == F.coalesce(col(make), F.lit(""))) & (signs > 2)
    return F.array_contains(possible_makes(document, make), hit["make"]) & F.when(named != "", named == hit["make"]).otherwise(alone)
