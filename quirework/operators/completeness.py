"""Completeness of a record against its source: what the source states, the record must hold.

The source is a text, the record JSON text (missing parts may be absent, null or empty).  A rule
is data; all rules become one array expression, so a table of drafts is judged in one pass
without Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    issue: str
    source: str  # pattern on the upper-cased source
    paths: tuple[str, ...] = ()  # one of them must be filled
    mention: str = ""  # or the record as a whole must say this


# Signs in a source and the place of the fact in a record.
TOOLS = "\\b(?:MICROPOD|WI\\s*TECH|TECHSTREAM|IDS|SDD|ODIS|TECH\\s*2|TECH2|J\\s*2534|J2534|12534)\\b"
RULES = (
    Rule("applications missing", "\\b(?:19|20)\\d{2}\\s*[-–]\\s*\\d{2,4}\\s+[A-Z]", ("vehicle_applications",)),
    Rule("factory tool missing", TOOLS, ("programming.factory_tool",)),
    Rule("keyway missing", "\\b(?:ILCO|KEYWAY)\\s*[:#]", ("mechanical_key.ilco_keyway",)),
    Rule("macs missing", "\\bMACS[:\\s]+[0-9]{1,2}\\b", ("mechanical_key.macs",)),
    Rule("style missing", "\\bSTYLE\\b|STVIE", ("mechanical_key.style",)),
    Rule("milling missing", "INTERNAL(?s:.)*(?:MITUNG|MILLING)|(?:MITUNG|MILLING)(?s:.)*INTERNAL", ("mechanical_key.milling",)),
    Rule("air bags missing", "AIRBAGS", ("mechanical_key.air_bags",)),
    Rule("retainer missing", "\\bIGN(?:ITION)?\\s+RETAINER\\b(?s:.){0,90}?(?:\\b(?:YES|NO|N/A|NA|ON|OFF)\\b|\\b(?:RETAINER|IGNITION)\\s*[:#]\\s*[A-Z0-9])", ("mechanical_key.ignition_retainer",)),
    Rule("pin guidance missing", "\\bPIN\\b", mention="PIN"),
    Rule("methods missing", "\\b(?:METHOD|DECODER|CUTTING THE KEY|MAKING KEY)\\b", ("making_key.methods",)),
    Rule("tryout missing", "TRYOUT", mention="TRYOUT"),
    Rule("transponder missing", "\\b(?:CHIP|TRANSPONDER)\\b", ("transponder",)),
    Rule("chip missing", "\\bCHIP\\s*INFORMATION\\b", ("transponder.chip",)),
    Rule("test key missing", "\\bTEST\\s*KEY\\s*IS\\b|\\bTESTKEYIS", ("transponder.test_key",)),
    Rule("programming missing", "\\b(?:PROGRAMMER|DIAGNOSTIC|SMART PRO|TCODE|MVP)\\b", ("programming",)),
    Rule("subscription tool missing", "PROGRAMMER & DIAGNOSTIC TOOLS(?s:.)*SUBSCRIPTION|SUBSCRIPTION(?s:.)*PROGRAMMER & DIAGNOSTIC TOOLS", ("programming.factory_tool",)),
    Rule("dealer requirement missing", "DEALER TRANSPONDER SYSTEM", ("programming.system_requirement",)),
    Rule("cloner tools missing", "\\bCLONER\\s*MACHINE\\s*INFORMATION\\b", ("transponder.cloner_tools", "transponder.cloning")),
    Rule("kessy missing", "KESSY", mention="KESSY"),
    Rule("pin access missing", "DEALER(?s:.){0,80}(?:NO|NOT|DOES\\s+NOT|DOESN'?T)(?s:.){0,80}ACCESS(?s:.){0,40}PIN", ("programming.pin_guidance",)),
    Rule("no codes missing", "\\bNOCODESONANYLOCKS\\b", mention="NO CODES ON ANY LOCKS"),
    Rule("lock parts missing", "\\b(?:LOCKS?\\s+NOT\\s+AVAILABLE|PIN\\s+KIT|STRATTEC\\s+(?:LOCK|PART)|(?:IGNITION|DOOR|TRUNK)\\s+LOCK\\s*[:=-])", ("lock_parts",)),
    Rule("pin kit missing", "PIN KIT", mention="PIN KIT"),
)
#: A source field that the record must keep, filled or not.
KEPT_FIELDS = (("start cut lost", "STARTCUT", "mechanical_key.start_cut"), ("cut to cut lost", "CUTTOCUT", "mechanical_key.cut_to_cut"))
MISPLACED_TOOL = "(?i)\\b(?:TDB1000|TCODE|MVP|AUTEL|SMART\\s*PRO|AUTO\\s*PRO\\s*PAD)\\b"
CORRUPT_RETAINER = ("on", "or", "in", "yes")
LOCK_PARTS = "\\b(?:PIN\\s+KIT|STRATTEC|IGNITION\\s+LOCK|DOOR\\s+LOCK|TRUNK\\s+LOCK|LIFTGATE)\\b"
#: Word before a table, characters of it, and bounds of its values in thousandths.
TABLES = {"spacing": ("\\bSPAC(?:ING|NG|ES)\\b", 700, 150, 1200), "depths": ("\\bDEPTHS?\\b", 500, 100, 600)}


def _value(record: Column, path: str) -> Column:
    return F.get_json_object(record, "$." + path)


def filled(record: Column, path: str) -> Column:
    """The part is there and neither null, false, zero nor empty."""
    return ~F.trim(F.coalesce(_value(record, path), F.lit(""))).isin("", "[]", "{}", "null", "false", "0")


def table_values(source: Column, kind: str) -> Column:
    """Plausible thousandths after the word of a table, in order."""
    word, length, low, high = TABLES[kind]
    flat = F.regexp_replace(F.upper(source), "\\s+", " ")
    at = F.regexp_instr(flat, F.lit(word))
    runs = F.regexp_extract_all(F.substring(flat, at, F.lit(length)), F.lit("[0-9]+"), F.lit(0))
    found = F.filter(runs, lambda v: (F.length(v) == 3) & v.cast("int").between(low, high))
    return F.when(at > 0, found).otherwise(F.array().cast("array<string>"))


def position_count(source: Column) -> Column:
    """Positions of a spacing table: 10, 8, or as many values as there are, none below 6."""
    n = F.size(table_values(source, "spacing"))
    return F.when(n >= 10, 10).when(n >= 8, 8).when(n >= 6, n).otherwise(0)


def cut_table(record: Column, name: str) -> Column:
    return F.from_json(_value(record, f"mechanical_key.{name}"), "map<string,string>")


#: Fixed value: codes whose spacing was seen to rise from bow to tip.
ASCENDING_CODES = ("HON-R15",)


def _ordered(table: Column, count: Column | int, before) -> Column:
    n = F.lit(count) if isinstance(count, int) else count
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(table, i.cast("string")).try_cast("double"))
    in_order = F.forall(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i == 0) | before(F.get(values, i - 1), F.get(values, i)))
    return F.forall(values, lambda v: v.isNotNull()) & in_order


def descending(table: Column, count: Column | int) -> Column:
    """Positions 1..count are numbers that fall strictly."""
    return _ordered(table, count, lambda a, b: a > b)


def ascending(table: Column, count: Column | int) -> Column:
    """Positions 1..count are numbers that rise strictly."""
    return _ordered(table, count, lambda a, b: a < b)


def valid_depths(table: Column, count: int) -> Column:
    """At least ``count`` entries, positions 1..12 and values of 0.02 to 0.75 alone."""
    ok = F.forall(F.map_entries(table), lambda e: F.coalesce(F.trim(e["key"]).try_cast("int").between(1, 12) & F.trim(e["value"]).try_cast("double").between(0.02, 0.75), F.lit(False)))
    return (F.size(table) >= count) & ok


def issues(source: Column | str, record: Column | str) -> Column:
    """array<string> of the issues of a record, in the order of the rules; null texts and records are empty."""
    raw, rec = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (source, record))
    up, rendered = F.upper(raw), F.upper(rec)
    out: list[tuple[Column, Column | str]] = []
    for rule in RULES:
        there = F.contains(rendered, F.lit(rule.mention)) if rule.mention else F.lit(False)
        for path in rule.paths:
            there = there | filled(rec, path)
        text = raw if rule.issue == "applications missing" else up  # a make begins with a capital
        out.append((F.rlike(text, F.lit(rule.source)) & ~there, rule.issue))
    for issue, sign, path in KEPT_FIELDS:
        out.append((F.contains(up, F.lit(sign)) & _value(rec, path).isNull(), issue))
    options = F.upper(F.coalesce(_value(rec, "key_remote.known_options"), F.lit("")))
    out.append((F.rlike(up, F.lit("\\bFCC(?:\\s+INFO)?\\s*[:#]")) & ~F.contains(options, F.lit("FCC")), "fcc without remote options"))
    remotes = F.size(F.array_distinct(F.regexp_extract_all(up, F.lit("\\bREMOTE\\s*:\\s*([A-Z0-9-]{6,24})"), F.lit(1))))
    listed = F.coalesce(F.json_array_length(_value(rec, "key_remote.known_options")), F.lit(0))
    out.append((F.rlike(up, F.lit("\\bFCC(?:\\s+INFO)?\\s*[:#]")) & (remotes >= 2) & (listed < remotes), "remote options missing"))
    decoders = F.upper(F.coalesce(_value(rec, "decoders"), F.lit("")))
    out.append((F.rlike(up, F.lit("\\bLISHI[:\\s|]+HU[0-9]{1,4}")) & ~F.contains(decoders, F.lit("LISHI")), "lishi missing"))
    fold = lambda x: F.regexp_replace(F.translate(F.upper(x), "IO", "10"), "[^A-Z0-9]+", "")
    reference = F.regexp_extract(up, "\\bLISHI[:\\s|]+(HU[0-9]{1,4}(?:\\s*V[0-9]+)?)", 1)
    out.append(((reference != "") & ~F.contains(fold(decoders), fold(reference)), "decoder reference mismatched"))
    out.append((F.rlike(F.coalesce(_value(rec, "mechanical_key.ilco_keyway"), F.lit("")), F.lit(MISPLACED_TOOL)), "tool in keyway"))
    spacing, depths = cut_table(rec, "spacing"), cut_table(rec, "depths")
    rises = F.upper(F.coalesce(_value(rec, "code"), F.lit(""))).isin(*ASCENDING_CODES)
    spaced = lambda n: descending(spacing, n) | (rises & ascending(spacing, n))
    n_spacing, n_depths = (F.coalesce(F.size(t), F.lit(0)) for t in (spacing, depths))
    n_spacing, n_depths = (F.greatest(n, F.lit(0)) for n in (n_spacing, n_depths))
    positions = position_count(raw)
    different = F.size(F.array_distinct(F.regexp_extract_all(raw, F.lit("(?:^|[^0-9])([.][0-9]{3})(?![0-9])"), F.lit(1))))
    wanted = F.when(different > 0, F.least(positions, different)).otherwise(positions)
    out.append(((positions > 0) & (n_spacing == 0), "spacing missing"))
    out.append(((positions > 0) & (n_spacing > 0) & (n_spacing < wanted), "spacing short"))
    out.append(((positions > 0) & (n_spacing > 0) & (n_spacing >= wanted) & ~spaced(wanted), "spacing out of order"))
    has_depths = F.size(table_values(raw, "depths")) >= 3
    outer = F.rlike(F.upper(F.coalesce(_value(rec, "mechanical_key"), F.lit(""))), F.lit("\\b(?:EXTERNAL|EDGE|4-TRACK)\\b")) & valid_depths(depths, 4)
    out.append((has_depths & (n_depths == 0), "depths missing"))
    out.append((has_depths & (n_depths > 0) & (n_depths < 4), "depths short"))
    out.append((has_depths & (n_depths >= 4) & ~(descending(depths, 4) | F.coalesce(outer, F.lit(False))), "depths out of order"))
    eight, four = F.rlike(up, F.lit("\\bEIGHT\\s+SPACES\\b")), F.rlike(up, F.lit("\\bFOUR\\s+DEPTHS\\b"))
    out.append((eight & (n_spacing < 8), "eight spaces incomplete"))
    out.append((eight & (n_spacing > 0) & ~spaced(8), "eight spaces out of order"))
    out.append((filled(rec, "mechanical_key.start_cut") & filled(rec, "mechanical_key.cut_to_cut") & (n_depths > 0) & (n_spacing == 0), "cuts without spacing"))
    out.append((four & (n_depths < 4), "four depths incomplete"))
    out.append((four & (n_depths > 0) & ~descending(depths, 4), "four depths out of order"))
    out.append((F.lower(F.trim(F.coalesce(_value(rec, "mechanical_key.ignition_retainer"), F.lit("")))).isin(*CORRUPT_RETAINER), "retainer corrupt"))
    methods = F.size(F.regexp_extract_all(up, F.lit("\\bMETHOD\\s*#?\\s*[0-9]+"), F.lit(0)))
    kept = F.coalesce(F.json_array_length(_value(rec, "making_key.methods")), F.lit(0))
    out.append(((methods >= 2) & (kept < methods), "methods short"))
    tools = F.from_json(_value(rec, "transponder.cloner_tools"), "array<struct<name:string,model:string,status:string>>")
    bad_tool = F.exists(tools, lambda t: (F.trim(F.coalesce(t["name"], t["model"], F.lit(""))) == "") | (F.trim(F.coalesce(t["status"], F.lit(""))) == ""))
    out.append((F.rlike(up, F.lit("\\bCLONER\\s*MACHINE\\s*INFORMATION\\b")) & bad_tool, "cloner tools incomplete"))
    out.append((F.contains(up, F.lit("PROXIMITY OPTION")) & F.startswith(F.upper(F.trim(F.coalesce(_value(rec, "system_type"), F.lit("")))), F.lit("PROXIMITY")), "proximity is an option"))
    lost = F.exists(F.regexp_extract_all(up, F.lit("\\b70[0-9]{4,5}\\b"), F.lit(0)), lambda p: ~F.contains(rendered, p))
    out.append((F.rlike(up, F.lit(LOCK_PARTS)) & lost, "lock part number missing"))
    out.append((lock_visual(raw) & ~F.rlike(F.coalesce(_value(rec, "procedure_diagrams"), F.lit("")), F.lit("(?i)\"filled\"")), "lock diagram missing"))
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in out]), lambda m: m.isNotNull())


def lock_visual(source: Column) -> Column:
    """The page shows which positions which lock uses, rather than telling it in prose."""
    flat = F.regexp_replace(F.regexp_replace(F.upper(source), "\\s+", " "), "\\bIGN(?:ITION)?\\s+RETAINER\\b", " ")
    labels = F.rlike(flat, F.lit("IGNITION.{0,100}(?:DOORS?|TRUNK|HATCH)|(?:DOORS?|TRUNK|HATCH).{0,80}IGNITION"))
    header = F.rlike(flat, F.lit("\\b(?:1 2 3 4 5 6 7(?: 8)?|POSITIONS?)\\b|\\b(?:FILLED|MARK(?:ED)?|SQUARE|WAFER)\\b"))
    rows = F.size(F.regexp_extract_all(flat, F.lit("\\b(?:IGNITION|DOORS?|TRUNK|HATCH|GLOVE\\s+BOX)\\b.{0,60}?\\b[1-9]\\b"), F.lit(0))) >= 2
    return F.rlike(flat, F.lit("DOORS?\\b|HATCH\\b")) & labels & (header | rows)


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _number(text: Column, words) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


# Words of pages with lock diagrams, and of rows that are or are not lock parts.
LOCKS = ("IGNITION", "DOOR", "TRUNK", "VALET", "GLOVE BOX", "GLOVE")
WORKFLOW = ("CUTTING THE KEY", "MAKING KEY", "METHOD", "LOCK READER", "DECODER", "TUMBLER", "POSITION")
CANDIDATE_LOCKS = ("IGNITION", "DOOR", "DOORS", "TRUNK", "VALET", "GLOVE BOX")
CANDIDATE_CONTEXT = ("PIN", "PINS", "POSITION", "POSITIONS", "WAFER", "WAFERS", "CUTTING THE KEY", "MAKING KEY", "DECODER", "LOCK READER", "METHOD #")
FRONT_MATTER = ("TABLE OF CONTENTS", "INTRODUCTION", "ACKNOWLEDGMENTS")
INVENTORY = "(?i)\\b(?:STRATTEC|ASP|PIN\\s*kit|part|available|not\\s+available)\\b|\\b70\\d{4,5}\\b"
PROCEDURE = "(?i)\\b(?:method|decode|decoder|reader|determine|working key|disassemble|no\\s*codes)\\b"


def lock_diagram_page(text: Column | str) -> Column:
    up = F.upper(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    making = F.contains(up, F.lit("CUTTING THE KEY")) | (F.contains(up, F.lit("METHOD #1")) & F.contains(up, F.lit("METHOD #2")))
    return _any(up, WORKFLOW) & ((_number(up, LOCKS) >= 2) | making)


def diagram_candidate_page(text: Column | str) -> Column:
    up = F.upper(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return _any(up, ("KEY", "BLADE", "LOCK", "IGNITION")) & (_number(up, CANDIDATE_LOCKS) >= 2) & _any(up, CANDIDATE_CONTEXT) & ~_any(up, FRONT_MATTER)


def lock_part(values: Column) -> Column:
    """Whether a record, given as the array of its values, names stock and not a procedure."""
    text = F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), " ")
    return F.rlike(text, F.lit(INVENTORY)) & ~F.rlike(text, F.lit(PROCEDURE))


def judged(drafts: DataFrame, source: str, record: str) -> DataFrame:
    """``drafts`` with issues (array of strings)."""
    return drafts.withColumn("issues", issues(source, record))
