"""Fields of a draft record from the text of its section: values, tables, advice, numbered methods.

Every field is an expression over the repaired text.  Advice is data: a text and the words that
call for it.  Names that a publisher wants out of public text are a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import facts
from .text import col, replace_all, rewrite, sentences

# -- fixed values -----------------------------------------------------------------------------------

#: Literal repairs of scanned text, in order: later ones see what earlier ones made.
OCR_REPAIRS = {
    "вЂ“": "-", "вЂ”": "-", "вЂ™": "'", "Р ": " ", "РЎ": " ", "С™": "", "C0DES": "CODES", "COOES": "CODES", "СODES": "CODES", "1gn": "Ign", "IgnRelainer": "Ign Retainer", "Relainer": "Retainer", "Retalner": "Retainer", "StanCut": "StartCut",
    "S1artCut": "StartCut", "Cuttocut": "CutToCut", "CuttoCut": "CutToCut", "F0b": "Fob", "FO8": "FOB", "Llshi": "Lishi", "Lishl": "Lishi", "AccuReade": "AccuReader", "Determjnator": "Determinator", "Determinatr": "Determinator", "KEYИME": "KEYNAME",
    "MACs": "MACS", "MAcs": "MACS", "M0re": "More", "1nfo": "Info", "HUS6": "HU66", "Testkeyis": "Test Key is ",
    "Nocodesonanylocks": "No codes on any locks", "NoCodesonanylocks": "No codes on any locks", "onlyaguide": "only a guide", "itneedstoworkinthelocks": "it needs to work in the locks", "donot": "do not", "Thisisagamble": "This is a gamble",
    "mitung": "milling", "AUTELIMGDS": "AUTEL IM608",
}
OCR_PATTERNS = (("(?<=[0-9])\\s*-\\s*(?=[0-9]{2,4})", "-"), ("(?i)\\bF\\s*C\\s*C\\b", "FCC"), ("(?i)\\bM\\s*H\\s*z\\b", "MHz"))
#: Literal repairs of a line of notes.
NOTE_REPAIRS = {
    "РљРµСѓ": "key", "Рљеу": "key", "СЃР°Рі": "vehicle", "СѓРѕРё": "you", "Р’РѕС…": "box", "РІРѕС…": "box", "С‚Р°РєРµ": "make", "танпга1": "manual", "тапиа1": "manual", "deаIer": "dealer", "dea[er": "dealer", "dea1er": "dealer", "Iock": "lock",
    "d00r": "door", "d0or": "door", "Kеу": "Key", "Кеу": "Key",
}
#: What no public value holds.
BAD_TEXT = "(?i)[^\\x00-\\x7f]|\\biock\\b|\\bdaors?\\b|Decoder/Reade|Meth0d|Lopk|SECTlON|continued\\s*-"
#: What no published method holds.
UNPUBLISHABLE = (
    "[^\\x00-\\x7f]", "\\|", "(?i)\\b(?:CONTINUED\\s*-|[A-Z]{2,6}-[0-9]+\\s+SECTION)\\b", "(?i)\\b(?:METH0D|L0CK|D0OR|SI5MHZ|DECBDER|REDDER|CYLIND\\+)\\b", "(?i)\\b(?:THEXDBOT|DETERM[I1]NETHE|WCRKING|PROYESSION|T0OL)\\b",
    "(?i)\\b(?:ACJRA|SHE11|BE10W|ILC0|DTV|H[CO]NDA|TA[NH]GO)\\b|:NFO\\b", "\\bFLlP\\b", "(?i)\\b(?:NOCODESONANYLOCKS|USEA|DOORLOCK-TO|A=\\s*TRACK|WW\\s*2\\s*TE)\\b", "(?i)\\b(?:GERER|FOFO|TYEE|SO\\s+A)\\b", "^[\\s@_|=-]{1,5}[A-Za-z]", "(?:\\s>\\s.*){2,}",
)
REWRITES = (
    ("\\bCheck with dealer for correct part # by VIN\\b", "Verify the exact part number with a VIN-based parts lookup before ordering."),
    ("\\bPIN Required\\b", "PIN access is required."),
    ("\\bNo Cloning for this System\\b", "This system should be treated as non-clonable; plan for programmer-based enrollment."),
    ("\\bCheck with your key programmer supplier\\b", "Confirm support in the programmer application or with the tool vendor before connecting."),
)
PART = "(?i)\\b(?:[A-Z]{2,5}#?\\s*)?([0-9]{7,9}[A-Z]{0,2}|[0-9]{5}-[0-9]{5}|[0-9]{5}-[A-Z0-9]{2,4}-[A-Z0-9]{2,4})\\b"
GROUPED_PART = "(?i)\\b([0-9A-Z]{2,3}[0O]\\s*[0-9]{3}\\s*[0-9]{3}\\s*[A-Z]{0,2})\\b"
KEYWAY = "(?i)\\b(?:ILCO#?\\s*)?(PRX-[A-Z0-9-]+|[A-Z]{1,3}[0-9]{2,4}[A-Z]?)\\b"
KEYWAY_WHOLE = "^(?:(?:PRX|RHK|RKE|FLIP)-[A-Z0-9-]+|(?:TOY|HON|NIS|NSN|HU|CY|HD|DA|TR|Y|B)[0-9]{1,5}[A-Z]?)$"
LISHI = "(?i)\\bLishi[:\\s|]+(HU[0-9]{1,4}(?:\\s*v[0-9]+)?)"
DETERMINATOR = "(?i)\\bDeterminator[:\\s]+([A-Z0-9 ]+?)(?=\\s+Lishi|\\s+AccuReader|\\s+EEZ|\\s+Cobra|$)"
READERS = ("AccuReader", "EEZ Reader", "Cobra")
PROGRAMMERS = ("Smart Pro", "TCODE", "MVP", "TDB1000", "Hotwire", "Auto Pro Pad", "Autel", "IM608")
CHIP_WORDS = "(?i)\\b(?:Philips|Megamos|Texas|Crypto|AES|Wedge|4D|46|48|ID)\\b"
LOCK_WORDS = ("strattec", "asp", "pin kit", "lock part", "lock available", "lock not available")
INSTRUCTION = "(?i)\\b(?:method|decode|decoder|reader|determine|disassemble|working key|making a key|no codes)\\b"
REMOTE_WORDS = ("FCC", "Fob", "F0b", "Remote")
NOTE_WORDS = ("FCC", "MHz", "Remote", "Fob", "F0b", "Proximity", "Emergency", "Smart")
NO_NOTE = "Verify fitment by VIN before ordering."
NOT_IDENTIFIERS = ("111FO", "1NFO", "T001S", "D00R")
NOT_EMERGENCY = ("WILL", "WI11", "T001S", "D00R", "F05")
EMERGENCY = "(?i)Emergency.{0,30}?([0-9]{7,9}[A-Z]{0,2}|[0-9]{5}-[0-9]{5}|[0-9]{5}-[A-Z0-9]{2,4}-[A-Z0-9]{2,4}|[A-Z]{1,3}[0-9]{2,4}[A-Z]?)"
#: Most entries of each list.
CAPS = {"Part numbers": 30, "FCC IDs": 20, "Frequencies": 8, "Blades / keyways": 20, "Chip references": 10, "Programming tools": 12}
MOST_METHODS, MOST_NOTES, MOST_GUIDE, MOST_TROUBLE, MOST_LOCK_PARTS, MOST_GENERAL, MOST_NUMBERED = 6, 14, 16, 8, 12, 10, 5

#: Advice: a text, and the alternatives (all words of one of them) that call for it; none: always.
METHODS = (
    ("Check the owner's manual or dealer-written code record before removing parts.", (("owner", "manual"),)),
    ("Use a lock decoder/reader on an accessible door lock to determine the cuts for a working key.", (("lock decoder",), ("reader",), ("decode",))),
    ("Remove the door cylinder only when decoding in-place is not practical, then decode the wafers/tumblers.", (("door cylinder",), ("door lock",))),
    ("If the door does not provide enough information, use the trunk/hatch cylinder when the vehicle layout supports it.", (("trunk",),)),
    ("Verify VIN-based key, fob, or proximity data with the dealer/source before ordering parts.", (("dealer", "vin"),)),
    ("Use the referenced tryout set only after confirming the correct system and keyway.", (("tryout",),)),
)
NO_METHOD = "Verify keyway and system data, then decode an accessible lock or use the listed source method for the vehicle."
FIELD_NOTES = (
    ("Match FCC ID, frequency, button count, and part number before programming or selling a remote.", (("fcc",), ("mhz",))),
    ("PIN access is mentioned for this system; confirm the PIN workflow before connecting a programmer.", (("pin",),)),
    ("VIN or dealer verification is mentioned; verify fitment before ordering key, fob, or proximity parts.", (("dealer",), ("vin",))),
    ("A lock reader/decoder path is available or referenced; use the listed decoder data before removing parts.", (("decode",), ("lishi",), ("reader",))),
    ("Door lock/cylinder information is relevant for making a working mechanical key.", (("door",),)),
    ("Trunk or hatch lock information may help when the door lock does not provide enough usable cuts.", (("trunk",), ("hatch",))),
    ("No-cloning language is present; plan to program the key/fob rather than clone it.", (("no cloning",),)),
    ("Reusable status is mentioned; verify whether used keys/fobs are allowed for this system.", (("reusable",),)),
    ("Airbag or retainer safety language is present; follow safe removal procedure before servicing lock components.", (("airbag",), ("retainer",))),
)
GUIDE_FIRST = "Use this system record as the job control sheet: verify vehicle identity, blade data, remote/FCC data, and programmer support before work begins."
GUIDE_CODES = ("Mechanical key work should use the listed code series: ", ".")
GUIDE = (
    ("Use the spacing/depth data in the mechanical key section when cutting the blade; do not rely on screenshot tables.", (("spacing",), ("depth",))),
    ("For remote or proximity systems, verify FCC ID, frequency, button count, and part number before programming.", (("remote",), ("fob",), ("proximity",))),
    ("Check the transponder/chip section before choosing a reusable, clone, or program-new workflow.", (("chip",), ("transponder",))),
    ("PIN access is required or referenced; confirm the PIN source and programmer support before attempting programming.", (("pin",),)),
    ("The source indicates no cloning for this system; use a programming workflow instead of cloning.", (("no cloning",),)),
    ("Dealer or VIN verification is referenced; confirm exact part fitment before ordering.", (("dealer",), ("vin",))),
    ("When all keys are lost, decode the door lock/cylinder or use the listed lock reader path to recover cuts.", (("decode",), ("door lock",), ("door cylinder",))),
    ("If supported by the vehicle, the trunk/hatch cylinder can be used as an alternate decoding source.", (("trunk",), ("hatch",))),
    ("Lock part availability is mentioned; verify lock, cylinder, and pin-kit information before parts ordering.", (("strattec",), ("asp",))),
)
TROUBLE = (
    ("Vehicle or trim mismatch", "Confirm make, model, year, system code, FCC/frequency, and VIN-based part fitment before ordering or programming.", ()),
    ("PIN access required", "Obtain or calculate the correct PIN before programming; stop if the tool cannot support the PIN workflow for this vehicle.", (("pin",),)),
    ("Security gateway blocks programming", "Prepare the required gateway bypass/access path before connecting the programmer.", (("gateway",),)),
    ("Part number uncertainty", "Verify the remote or proximity fob by VIN when the source indicates dealer/VIN confirmation.", (("dealer",), ("vin",))),
    ("No usable lock code available", "Decode an accessible lock or remove and decode the cylinder, then cut the mechanical key from the recovered cuts.", (("no codes",), ("keycodes",))),
    ("Used remote or chip may fail", "Check reusable status before selling or programming a used fob/transponder.", (("reusable",),)),
    ("Column or lock removal risk", "Follow airbag and retainer safety steps before removing ignition or column components.", (("airbag",), ("retainer",))),
)
WARNINGS = (
    ("Verify exact part numbers by VIN before ordering.", ()),
    ("Confirm programmer support before connecting to the vehicle.", ()),
    ("Security gateway bypass may be required.", (("gateway",),)),
    ("Vehicle electronics risk is mentioned in source material; follow tool/vendor safety guidance.", (("risk",),)),
)
PROGRAMMING_PATH = (("Use a supported programmer for the exact vehicle.", ()), ("PIN access is required or mentioned.", (("pin",),)), ("Check whether gateway bypass is required.", (("gateway",),)))
#: The first that fits is what is said of codes.
CODES = (
    ("No usable lock code is listed for this system; decode an accessible lock or cylinder when making a mechanical key.", (("no code",),)),
    ("A lock code may be stamped on the referenced lock/cylinder; verify before decoding manually.", (("code is stamped",), ("codes are stamped",))),
    ("VIN/dealer verification is mentioned for this system; verify exact key/fob data before ordering.", (("dealer", "vin"),)),
    ("Use the blade, decoder, and method notes below to determine the working key path.", ()),
)
WORKFLOW = (
    ("Confirm vehicle match", "Verify make, model, year, system code and trim before ordering parts."),
    ("Verify parts", "Confirm FCC ID, frequency, button count and part number before programming."),
    ("Prepare access", ""),
    ("Create mechanical key", "Use approved blade, spacing, depths and decoder data from this report."),
    ("Program and test", "Program the remote/transponder and test every customer-facing function before release."),
)
CHECKLIST = {
    "Bring to the job": ("Supported programmer", "Decoder/reader tools", "Correct blade/keyway", "PIN access if required"),
    "Verify before ordering": ("VIN-based part number", "FCC ID", "Frequency", "Chip/transponder type"),
    "Final tests": ("Mechanical key operation", "Remote lock/unlock", "Start authorization", "Trunk/remote start if equipped"),
}
CUTTING = (
    ("cut_track", "(?i)left\\s+track.{0,24}(?:cuts?|cutting)", "The left track contains the cuts."),
    ("guide_track", "(?i)right\\s+track.{0,24}(?:guide|clearance)", "The right track is used only as a guide/clearance track."),
    ("preparation", "(?i)pre-?cut\\s+the\\s+left\\s+track.{0,48}number\\s+one\\s+depths", "Pre-cut the left track to all number 1 depths before applying the working-key cut values."),
)
CLIPPERS = ("Curtis Clipper", "Pak-A-Punch", "FRAMON")
CLIPPER_NOTE = "Mentioned in source; verify exact setup on source page during review."
#: Methods whose wording a phrase of the source settles: number, pattern, wording.
SETTLED = (
    ("1", "(?i)Method\\s*#?\\s*1.{0,40}lock\\s+Reader/Decoder.{0,80}door\\s+lock.{0,80}complete\\s+key", "Use a lock reader/decoder in the door lock to determine the cuts for a complete key"),
    ("2", "(?i)Method\\s*#?\\s*2.{0,40}Disassemble\\s+the\\s+door\\s+cylinder.{0,80}decode\\s+the\\s+tumblers", "Disassemble the door cylinder and decode the tumblers"),
)
NUMBERED = "(?i)\\bMethod\\s*#?\\s*([0-9]+)\\s*(.+?)(?=\\bMethod\\s*#?\\s*[0-9]+\\b|$)"
METHOD_END = "(?i)(?:\\b(?:Main\\s*Track|This\\s+is\\s+an\\s+example|REMOTE\\s*:|TRANSPONDER|PROGRAMMER|DECODERS?\\s*:|CHIP\\s+INFORMATION|FACTORY\\s+TOOL|AUDI-?\\s*VW|PORSCHE)\\b|©|Main\\s*Track|This\\s+is\\s+an\\s+example).*$"
METHOD_REPAIRS = (
    ("(?i)\\block\\s+Reader/Decoder\\b", "lock reader/decoder"), ("(?i)\\bdoorlock\\b", "door lock"), ("(?i)\\blocktomakekey\\b", "lock to make a key"), ("(?i)\\bstamped\\s+onthem\\b", "stamped on them"), ("(?i)and\\.disassemble", "and disassemble"),
    ("\\s*&\\s*", " and "), ("[=|_<>\"{}]+", " "), ("(?i)\\b(?:GERER+|Tyee|Bo)\\b.*$", ""), ("(?i)\\bto[- ]determine\\b", "to determine"), ("^[^A-Za-z0-9]+", ""), ("\\s+", " "),
)
BODY_REPAIRS = (("(?i)\\s*:\\s*So\\s+a$", ""), ("\\(\\s*[0-9]+\\s+[0-9]+\\s*$", ""), ("(?i)\\bGERER[A-Z0-9 ]*$", ""), ("\\s+", " "))
METHOD_WORDS = "(?i)\\b(?:decode|reader|decoder|disassemble|cylinder|tumblers|wafers|door lock|owner'?s manual|key code|code stamped|impression)\\b"
#: Wordings of a numbered method: number, groups of which each has a word in it, wording.
WORDINGS = (
    ("1", (("OWNER",), ("MANUAL",)), "Check the owner's manual for a dealer-written key code"),
    ("2", (("CODE STAMPED",), ("DOOR LOCK",)), "Check the door lock for a stamped key code"),
    (
        "3",
        (("GLOVE BOX",), ("BALL", "CHROME FACE CAP")),
        "If the vehicle has a locking glove-box lock, remove and carefully disassemble that cylinder without letting the tumblers fall out. The glove-box cylinder usually contains 8 of the 10 cuts needed for a master key; "
        "impression the remaining two ignition cuts, prep both sides of the key, or use progression for the remaining cuts. The trunk lock can also be picked, impressioned, or disassembled without a working key. "
        "When removing the chrome face cap, drill a small centered hole through the stamping instead of forcing a screwdriver between the cap and plug body. Reinstall the cap in a different position and make new stamps in the plug cap. "
        "Watch for ball-bearing detents and springs.",
    ),
    ("3", (("GLOVE BOX",), ("ODD", "POSITIONS 2")), "Remove and disassemble the glove-box lock for cut positions 2, 4, 6, 8, and 10; then impression the door or ignition for the odd-spaced cut positions"),
    ("2", (("HANDLE",), ("CODE", "TUMBLERS")), "Remove or pull out the handle/lock far enough to read the stamped code on the handle housing; if the code cannot be read, remove the handle/lock assembly and decode the tumblers"),
    ("3", (("IMPRESSION",), ("LOCK",)), "Impression the locks"),
    ("4", (("IGNITION",), ("SPRING",)), "If needed, remove the spring-retained ignition cylinder and either read the stamped code or disassemble it to make a working key; protect the turn-signal assembly while accessing the cylinder"),
    ("5", (("DOOR LOCK",), ("MAKE",)), "Disassemble the door lock to make the key"),
)

# -- helpers ----------------------------------------------------------------------------------------


def _text(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def _strip(x: Column, signs: str) -> Column:
    return F.regexp_replace(x, f"^[{signs}]+|[{signs}]+$", "")


def _called_for(low: Column, alternatives: Sequence[Sequence[str]]) -> Column:
    """Whether all words of some alternative occur; without alternatives always."""
    out = F.lit(not alternatives)
    for words in alternatives:
        test = F.lit(True)
        for w in words:
            test = test & F.contains(low, F.lit(w))
        out = out | test
    return out


def _said(low: Column, words: str | Sequence[str], value: Column, otherwise: Column | str = "") -> Column:
    """``value``, which is ``otherwise`` wherever the lower-case text has none of the words, worked out only where it has one."""
    return F.when(_called_for(low, [(w,) for w in ([words] if isinstance(words, str) else words)]), value).otherwise(otherwise)


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def advice(x: Column | str, table: Sequence[tuple], most: int | None = None, low: Column | None = None) -> Column:
    """Texts of a table that the text (or ``low``, its lower case) calls for, in order."""
    low = F.lower(_text(x)) if low is None else low
    out = F.filter(F.array(*[F.when(_called_for(low, row[-1]), F.lit(row[0])) for row in table]), lambda v: v.isNotNull())
    return F.slice(out, 1, most) if most else out


def repaired(x: Column | str) -> Column:
    """Scanned text after its literal and pattern repairs; all that follows reads the result."""
    out = replace_all(_text(x), OCR_REPAIRS)
    for pattern, to in OCR_PATTERNS:
        out = F.regexp_replace(out, pattern, to)
    return replace_all(out, NOTE_REPAIRS)


def short_value(x: Column | str, longest: int, spaces: bool = True) -> Column:
    """A value, or empty if it is long, bad or has signs that no value has."""
    value = _strip(_squeeze(_text(x)), " \\-,:;.")
    shape = "^[A-Za-z0-9 /#().-]+$" if spaces else "^[A-Za-z0-9#.-]+$"
    return _let(value, lambda v: F.when((F.char_length(v) <= longest) & ~F.rlike(v, F.lit(BAD_TEXT)) & F.rlike(v, F.lit(shape)), v).otherwise(""))


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, pattern, group)


def _when(x: Column, test) -> Column:
    return _let(x, lambda v: F.when(test(v), v).otherwise(""))


def after_label(x: Column | str, label: str) -> Column:
    literal = "".join("\\" + c if c in "#.-" else c for c in label)
    return short_value(_first(_text(x), f"(?i){literal}[:#\\s]+([A-Z0-9 /.-]{{1,24}})"), 24)


def decoder_reference(x: Column) -> Column:
    return _when(short_value(x, 18), lambda v: ~F.rlike(v, F.lit("(?i)^(?:n/?a|nia|none)\\b")) & F.rlike(v, F.lit("[0-9]|[A-Z]{2,}")))


def chip_reference(x: Column) -> Column:
    return _when(short_value(x, 48), lambda v: F.rlike(v, F.lit(CHIP_WORDS)))


def code_series(x: Column | str, low: Column | None = None) -> Column:
    found = _when(short_value(_first(_text(x), facts.CODE_SERIES), 40), lambda v: (F.char_length(v) >= 3) & F.rlike(v, F.lit("[0-9]")))
    return found if low is None else _said(low, "code series", found)


def good_identifier(x: Column) -> Column:
    value = F.trim(x)
    return ~F.rlike(value, F.lit(BAD_TEXT)) & F.rlike(value, F.lit("[0-9]")) & ~F.upper(value).isin(*NOT_IDENTIFIERS) & F.rlike(value, F.lit("^[A-Za-z0-9#./ -]{2,32}$"))


def keyway_identifier(x: Column) -> Column:
    return good_identifier(x) & F.rlike(F.upper(F.trim(x)), F.lit(KEYWAY_WHOLE))


def grouped_part(x: Column) -> Column:
    """Upper case, one blank between groups, O read as 0 in the first."""
    groups = F.split(_squeeze(F.upper(x)), " ")
    return F.array_join(F.transform(groups, lambda g, i: F.when(i == 0, F.replace(g, F.lit("O"), F.lit("0"))).otherwise(g)), " ")


# -- tables -----------------------------------------------------------------------------------------

DECODER = "array<struct<tool:string,reference:string>>"


def decoders(x: Column | str, low: Column | None = None) -> Column:
    """tool and reference of the decoders that a text names with one; the first of each tool."""
    text = _text(x)
    low = F.lower(text) if low is None else low
    found = [("Lishi", decoder_reference(_first(text, LISHI))), ("Determinator", decoder_reference(_first(text, DETERMINATOR)))]
    found += [(label, decoder_reference(after_label(text, label))) for label in READERS]
    rows = lambda said: F.array(*[F.struct(F.lit(t).alias("tool"), _said(said, t.lower(), r).alias("reference")) for t, r in found])
    return F.filter(_let(low, rows), lambda r: r["reference"] != "").cast(DECODER)


def decoder_summary(rows: Column) -> Column:
    named = F.transform(rows, lambda r: F.concat(r["tool"], F.lit(": "), r["reference"]))
    return F.when(F.size(rows) > 0, F.array_join(named, "; ")).otherwise("Check source pages")


def programmer_tools(x: Column | str, low: Column | None = None) -> Column:
    """name and status of the known programmers that a text names."""
    text = _text(x)
    status = F.when(F.contains(text, F.lit("?")), "Check support").otherwise("Mentioned")
    rows = lambda said: F.array(*[F.when(F.contains(said, F.lit(t.lower())), F.struct(F.lit(t).alias("name"), status.alias("status"))) for t in PROGRAMMERS])
    return F.filter(_let(F.lower(text) if low is None else low, rows), lambda r: r.isNotNull())


def source_lines(x: Column | str) -> Column:
    """Sentences that mean something: 28 to 520 signs, three blanks, clean, letters enough; each once, whatever its case."""
    lines = F.transform(sentences(_text(x)), lambda s: _strip(_squeeze(s), " \\-|"))
    letters = lambda s: F.char_length(F.regexp_replace(s, "[^A-Za-z]+", ""))
    enough = lambda s: _let(letters(s), lambda n: (n >= 18) & ((F.char_length(s) <= 90) | (n / F.char_length(s) >= 0.45)))
    blanks = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))
    good = F.filter(lines, lambda s: F.char_length(s).between(28, 520) & (blanks(s) >= 3) & ~F.rlike(s, F.lit(BAD_TEXT)) & enough(s))
    return first_of_each(good, F.lower)


def first_of_each(x: Column, key) -> Column:
    """The first element of each key, in order."""

    def kept(rows: Column) -> Column:
        keys = F.transform(rows, key)
        return _let(keys, lambda ks: F.filter(rows, lambda v, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    return _let(x, kept)


LOCK_PART = "array<struct<years:string,models:string,ignition_lock:string,door_lock:string,trunk_lock:string,pin_kit:string>>"


def lock_parts(x: Column | str, lines: Column | None = None) -> Column:
    """Stock of locks by sentence (``lines``, if the text's source_lines are there): never a procedure; the first of each summary."""
    lines = source_lines(x) if lines is None else lines
    named = F.filter(lines, lambda s: _let(F.lower(s), lambda low: _called_for(low, [(w,) for w in LOCK_WORDS])))

    def row(s: Column) -> Column:
        def of(summary: Column) -> Column:
            has = lambda *words: _let(F.lower(s), lambda low: _called_for(low, [(w,) for w in words]))
            ok = ~F.rlike(summary, F.lit(BAD_TEXT)) & ~F.rlike(summary, F.lit(INSTRUCTION))
            record = F.struct(
                F.regexp_extract(s, facts.YEAR_HINT, 1).alias("years"),
                F.lit("").alias("models"),
                F.when(has("ignition", "lock"), summary).otherwise("").alias("ignition_lock"),
                F.when(has("door"), summary).otherwise("").alias("door_lock"),
                F.when(has("trunk"), summary).otherwise("").alias("trunk_lock"),
                _first(s, facts.LABELLED["pin_kit"]).alias("pin_kit"),
            )
            return F.when(ok, record)

        return _let(rewrite(F.substring(s, 1, 180), REWRITES), of)

    rows = F.filter(F.transform(named, row), lambda r: r.isNotNull())
    return F.slice(first_of_each(rows, lambda r: r["ignition_lock"]), 1, MOST_LOCK_PARTS).cast(LOCK_PART)


def remote_note(line: Column) -> Column:
    """What a sentence says of a remote, shortened; a general advice where nothing clean is left."""
    clean = _let(_squeeze(line), lambda v: F.when(F.rlike(v, F.lit(BAD_TEXT)), F.regexp_replace(v, "[^\\x00-\\x7f]+", " ")).otherwise(v))

    def of(v: Column) -> Column:
        parts = F.array(*[F.trim(_first(v, f"(?i).{{0,40}}\\b{w}\\b.{{0,70}}", 0)) for w in NOTE_WORDS])
        joined = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")
        cut = F.regexp_replace(joined, "(?i)\\b(?:SECTION|CODES?|SPACING|DEPTHS|MACS|StartCut|CuttoCut).*$", "")
        return _let(_strip(_squeeze(cut), " \\-,:;"), lambda n: F.when((F.char_length(n) < 8) | F.rlike(n, F.lit(BAD_TEXT)), F.lit(NO_NOTE)).otherwise(rewrite(F.substring(n, 1, 120), REWRITES)))

    return _let(clean, of)


REMOTE = "array<struct<years:string,models:string,part:string,fcc_id:string,frequency:string,emergency_blade:string,buttons:string,notes:string>>"


def remote_options(x: Column | str) -> Column:
    """Remotes by sentence with a part number: years, part, FCC, frequency, blade, buttons, note; each once."""
    lines = F.filter(_said(_text(x), REMOTE_WORDS, sentences(_text(x)), _none()), lambda s: _called_for(s, [(w,) for w in REMOTE_WORDS]))

    def row(s: Column) -> Column:
        grouped = F.transform(F.regexp_extract_all(s, F.lit(GROUPED_PART), F.lit(1)), grouped_part)
        plain = F.array_except(F.regexp_extract_all(s, F.lit(PART), F.lit(1)), grouped)
        fcc = _when(_first(s, "(?i)\\bFCC\\s*Info\\s*[:#-]?\\s*([A-Z0-9-]{5,24})"), lambda v: facts.valid_fcc(v) & ~F.rlike(v, F.lit(BAD_TEXT)))
        mhz = _first(s, facts.FREQUENCY)
        blade = _first(s, "(?i)\\b(?:Emerg(?:ency)?\\s+Key|E-Key)\\s*[:#-]?\\s*([0-9A-Z ]{8,20})")
        record = lambda parts: F.struct(
            F.regexp_extract(s, facts.YEAR_HINT, 1).alias("years"),
            F.lit("").alias("models"),
            F.array_join(F.array_distinct(F.slice(parts, 1, 2)), " / ").alias("part"),
            F.upper(fcc).alias("fcc_id"),
            F.when(mhz != "", F.concat(mhz, F.lit(" MHz"))).otherwise("").alias("frequency"),
            F.when(blade != "", grouped_part(blade)).otherwise("").alias("emergency_blade"),
            _first(s, facts.LABELLED["buttons"]).alias("buttons"),
            remote_note(s).alias("notes"),
        )
        return _let(F.concat(grouped, plain), lambda parts: F.when(F.size(parts) > 0, record(parts)))

    rows = F.filter(F.transform(lines, row), lambda r: r.isNotNull())
    marker = lambda r: F.lower(F.concat_ws("\u0001", r["years"], r["part"], r["fcc_id"], r["frequency"], r["buttons"], r["notes"]))
    return first_of_each(rows, marker).cast(REMOTE)


# -- numbered methods -------------------------------------------------------------------------------


def publishable(x: Column) -> Column:
    """Whether a text may be published: not damaged, not full of rulings, not of signs alone."""
    flat = _squeeze(x)
    rulings = F.size(F.regexp_extract_all(flat, F.lit("[|_=>]"), F.lit(0)))
    out = (flat != "") & (rulings < 4) & ~((F.char_length(flat) > 140) & F.rlike(flat, F.lit("[|_=>]{2,}"))) & ~F.rlike(flat, F.lit("^[\\W_]+$"))
    for p in UNPUBLISHABLE:
        out = out & ~F.rlike(flat, F.lit(p))
    return out


def method_wording(number: Column, body: Column) -> Column:
    """The body of a numbered method without debris, in settled words where its words call for them."""
    out = _squeeze(_strip(body, " .,:;\\-"))
    out = F.regexp_replace(out, *BODY_REPAIRS[0])
    out = _let(out, lambda v: F.when(F.rlike(v, F.lit("(?i)\\b[A-Z]{1,4}-[0-9]+$")), v).otherwise(F.regexp_replace(v, ",?\\s*[0-9]+$", "")))
    for pattern, to in BODY_REPAIRS[1:]:
        out = F.regexp_replace(out, pattern, to)

    def settle(v: Column) -> Column:
        up, said = F.replace(F.upper(v), F.lit("-"), F.lit(" ")), v
        for n, groups, wording in reversed(WORDINGS):
            test = number == n
            for words in groups:
                test = test & _called_for(up, [(w,) for w in words])
            said = F.when(test, F.lit(wording)).otherwise(said)
        return said

    return _let(_strip(out, " .,:;\\-"), settle)


def numbered_methods(x: Column | str, low: Column | None = None) -> Column:
    """'Method n: ...' of a source, at most MOST_NUMBERED: settled ones, then others by their own words.

    A method lasts to the next one or to a word that ends it; a number that is settled is taken
    once, and what names no way to a key or is not fit to publish goes.
    """

    def of(flat: Column) -> Column:
        settled = F.filter(F.array(*[F.when(F.rlike(flat, F.lit(p)), F.struct(F.lit(n).alias("n"), F.lit(t).alias("body"))) for n, p, t in SETTLED]), lambda m: m.isNotNull())
        numbers, bodies = (F.regexp_extract_all(flat, F.lit(NUMBERED), F.lit(g)) for g in (1, 2))

        def clean(m: Column) -> Column:
            body = _strip(F.regexp_replace(_strip(m["body"], " \\-=|"), METHOD_END, ""), " .\\-=|")
            for pattern, to in METHOD_REPAIRS:
                body = F.regexp_replace(body, pattern, to)
            return F.struct(m["n"].alias("n"), method_wording(m["n"], F.trim(body)).alias("body"))

        found = F.transform(F.arrays_zip(numbers.alias("n"), bodies.alias("body")), clean)
        fit = lambda m: (F.char_length(m["body"]) >= 12) & F.rlike(m["body"], F.lit(METHOD_WORDS)) & publishable(m["body"])

        def joined(known: Column) -> Column:
            others = F.filter(F.filter(found, lambda m: ~F.exists(known, lambda k: k["n"] == m["n"])), fit)
            return F.concat(known, first_of_each(others, lambda m: m["n"]))

        said = F.transform(_let(settled, joined), lambda m: F.concat(F.lit("Method "), m["n"], F.lit(": "), m["body"], F.lit(".")))
        return F.slice(F.array_distinct(said), 1, MOST_NUMBERED)

    return _said(F.lower(_text(x)) if low is None else low, "method", _let(F.regexp_replace(_text(x), "\\s+", " "), of), _none())


# -- the record -------------------------------------------------------------------------------------


def record(x: Column | str, low: Column | str, fields: Column, options: Column, named_decoders: Column, spacing: Column) -> Column:
    """The parts of a draft that its repaired text gives; values are empty where the text has none.

    ``low`` is the text in lower case, ``fields`` is facts.labelled, ``options`` and
    ``named_decoders`` are the tables above.
    """
    text, low = _text(x), col(low)
    said = lambda words, value, otherwise="": _said(low, words, value, otherwise)
    all_of = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # What several fields read is worked out once.
    shared = {
        "chip": said("chip", short_value(F.coalesce(fields["chip"], F.lit("")), 48)),
        "series": code_series(text, low),
        "fcc": said("fcc", F.array_sort(F.array_distinct(F.filter(all_of("(?i)\\bFCC[:\\s]+([A-Z0-9-]{5,})"), facts.valid_fcc))), _none()),
        "mhz": said("mhz", F.array_sort(F.array_distinct(F.transform(all_of(facts.FREQUENCY), lambda v: F.concat(v, F.lit(" MHz"))))), _none()),
        "emergency": said("emergency", _when(_first(text, EMERGENCY), lambda v: ~F.upper(v).isin(*NOT_EMERGENCY))),
        "keyways": F.filter(all_of(KEYWAY), keyway_identifier),
        "path": F.array_join(advice(text, PROGRAMMING_PATH, low=low), " "),
        "methods": advice(text, METHODS, MOST_METHODS, low=low),
        "notes": advice(text, FIELD_NOTES, MOST_NOTES, low=low),
        "lines": source_lines(text),
        "tools": programmer_tools(text, low),
        "card": said("card", _when(short_value(_let(after_label(text, "CARD#"), lambda v: F.when(v != "", v).otherwise(after_label(text, "CARD"))), 16, spaces=False), lambda v: F.rlike(v, F.lit("[0-9]")))),
        "macs": said("macs", _first(text, facts.LABELLED["macs"])).try_cast("int"),
    }
    return _let(F.struct(*[v.alias(k) for k, v in shared.items()]), lambda s: _record(text, low, options, named_decoders, spacing, s))


def _record(text: Column, low: Column, options: Column, named_decoders: Column, spacing: Column, shared: Column) -> Column:
    """The record from what its fields share."""
    said = lambda words, value, otherwise="": _said(low, words, value, otherwise)
    has = lambda *words: _called_for(low, [(w,) for w in words])
    chip, series, fcc, mhz, emergency, path, methods, notes, lines, tools, card, macs = (shared[k] for k in ("chip", "series", "fcc", "mhz", "emergency", "path", "methods", "notes", "lines", "tools", "card", "macs"))
    fcc_text, mhz_text = F.array_join(fcc, ", "), F.array_join(mhz, ", ")
    keyways = F.array_join(F.array_distinct(F.slice(shared["keyways"], 1, 4)), " / ")
    general = F.slice(F.transform(F.filter(lines, lambda s: ~_let(F.lower(s), lambda v: _called_for(v, [("copyright",), ("table of contents",)]))), lambda s: rewrite(F.substring(s, 1, 320), REWRITES)), 1, MOST_GENERAL)
    guide = F.concat(F.array(F.lit(GUIDE_FIRST)), F.when(series != "", F.array(F.concat(F.lit(GUIDE_CODES[0]), series, F.lit(GUIDE_CODES[1])))).otherwise(F.array().cast("array<string>")), advice(text, GUIDE, low=low))
    rewritten = lambda word, pattern, longest: said(word, _let(short_value(_first(text, pattern), longest), lambda v: rewrite(v, REWRITES)))
    flat = _squeeze(text)
    cutting = [said("track", F.when(F.rlike(flat, F.lit(p)), F.lit(t)).otherwise("")).alias(n) for n, p, t in CUTTING] + [F.when(F.contains(low, F.lit(c.lower())), F.lit(CLIPPER_NOTE)).otherwise("").alias(c) for c in CLIPPERS]
    answers = [
        F.when(chip != "", F.concat(F.lit("Transponder/chip data detected: "), chip, F.lit("."))),
        F.when(F.size(fcc) > 0, F.concat(F.lit("FCC ID detected: "), fcc_text, F.lit("."))),
        F.when(has("pin"), "PIN access appears to be required or mentioned for this system."),
        F.lit("Use the sections below to verify blade, FCC/frequency, programming path, decoder references, and final tests before releasing the vehicle."),
    ]
    trouble = F.filter(F.array(*[F.when(_called_for(low, when), F.struct(F.lit(i).alias("issue"), F.lit(a).alias("action"))) for i, a, when in TROUBLE]), lambda r: r.isNotNull())
    codes = F.lit("")
    for answer, when in reversed(CODES):
        codes = F.when(_called_for(low, when), F.lit(answer)).otherwise(codes)
    sorted_values = lambda pattern, group=1: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
    chips = said("chip", F.filter(F.transform(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)\\bChip[:\\s]+([A-Za-z0-9 /-]{2,42})"), F.lit(1)), lambda v: F.trim(v)))), chip_reference), lambda v: v != ""), _none())
    named = {
        "Part numbers": F.filter(sorted_values(PART), good_identifier),
        "FCC IDs": said("fcc", F.filter(sorted_values("(?i)\\bFCC(?: Info)?[:\\s]+([A-Z0-9-]{5,24})"), facts.valid_fcc), _none()),
        "Frequencies": said("mhz", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(facts.FREQUENCY), F.lit(0)), lambda v: F.replace(F.upper(v), F.lit(" "), F.lit(""))))), _none()),
        "Blades / keyways": F.array_sort(F.array_distinct(shared["keyways"])),
        "Chip references": chips,
        "Programming tools": F.transform(tools, lambda t: t["name"]),
    }
    source_facts = [F.slice(v, 1, CAPS[k]).alias(k) for k, v in named.items()] + [F.when(series != "", F.array(series)).otherwise(F.array().cast("array<string>")).alias("Code series")]
    milling = said("milling", F.when(F.rlike(text, F.lit("(?is)\\bINTERNAL.{0,24}\\bMILLING\\b")), "Internal milling").when(F.rlike(text, F.lit("(?is)\\bEXTERNAL.{0,24}\\bMILLING\\b")), "External milling").otherwise(""))
    struct = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    return struct(
        job_essentials=F.struct(
            emergency.alias("Emergency blade / keyway"), series.alias("Code series"), decoder_summary(named_decoders).alias("Lishi / decoder"), fcc_text.alias("FCC ID"), mhz_text.alias("Frequency"),
            chip.alias("Chip / transponder"), F.when(has("pin"), "Required").otherwise("Check source").alias("PIN"), path.alias("Programming path"),
        ),
        quick_answer=F.filter(F.array(*answers), lambda a: a.isNotNull()),
        key_remote=struct(
            remote_type=F.when(has("proximity"), "Proximity fob").when(has("remote"), "Remote").otherwise("Key"), frequency=mhz_text, fcc_id=fcc_text, known_options=options,
            proximity_option=said("kessy", F.when(F.rlike(text, F.lit("(?i)\\bKESSY\\b")), "Some models may be equipped with the KESSY proximity option.").otherwise("")),
        ),
        mechanical_key=struct(
            code_series=series, style=F.when(has("dbl", "double"), "Double-sided").otherwise(""), card=card, ilco_keyway=F.when(emergency != "", emergency).otherwise(keyways),
            macs=F.when(macs.between(1, 12), macs.cast("string")).otherwise(""), start_cut=said("start", _first(text, "(?i)Start.{0,20}?(\\.[0-9]{3})")), cut_to_cut=said("cut", _first(text, "(?i)Cut.{0,20}?(\\.[0-9]{3})")), milling=milling,
            spacing=spacing, depths=facts.depth_table(text), cutting_setup=F.struct(*cutting),
        ),
        transponder=struct(
            transponder_type=F.when(has("proximity"), "Proximity").when(has("transponder"), "Transponder").otherwise(""), chip=chip, reusable=rewritten("reusable", "(?i)Reusable[:\\s]+(.{1,80})", 60),
            test_key=said("test", short_value(_first(text, "(?i)Test\\s*Key\\s*is\\s*([A-Z0-9 /-]+)"), 32)),
        ),
        programming=struct(
            pin_required=F.when(has("pin"), "Yes").otherwise("Check source"), factory_tool=rewritten("factory tool", "(?i)Factory Tool\\s+(.{1,80}?)(?:PIN|TCODE|SMART|$)", 64),
            system_requirement=said("transponder", F.when(F.rlike(flat, F.lit("(?i)Dealer\\s+transponder\\s+system")), "Dealer transponder system; specialized key programmer or EEPROM equipment is required.").otherwise("")),
            cloning=F.when(has("no cloning"), "No cloning for this system.").otherwise("Check source"), tools=tools,
        ),
        making_key=struct(
            code_availability=codes, methods=F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit(NO_METHOD))), numbered_methods=numbered_methods(text, low),
            field_workflow=F.array(*[F.struct(F.lit(s).alias("step"), (F.lit(t) if t else path).alias("detail")) for s, t in WORKFLOW]),
            field_notes=F.when(F.size(notes) > 0, notes).otherwise(general), service_notes=F.slice(guide, 1, MOST_GUIDE),
        ),
        technician_checklist=F.struct(*[F.array(*map(F.lit, items)).alias(k) for k, items in CHECKLIST.items()]),
        source_facts=F.struct(*source_facts),
        decoders=named_decoders,
        lock_parts=lock_parts(text, lines),
        troubleshooting=F.slice(trouble, 1, MOST_TROUBLE),
        warnings=advice(text, WARNINGS, low=low),
    )


def public_value(x: Column) -> Column:
    """A string as a record may publish it: empty if it is bad, a section's heading or short of letters."""

    def of(v: Column) -> Column:
        heading = F.rlike(v, F.lit("(?i)\\b[A-Z]{1,5}-?[0-9]{1,3}\\s+SECTION\\b"))
        few = (F.char_length(v) > 24) & (F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")) / F.char_length(v) < 0.42)
        return F.when(F.rlike(v, F.lit(BAD_TEXT)) | heading | few, F.lit("")).otherwise(v)

    return _let(_squeeze(x), of)
