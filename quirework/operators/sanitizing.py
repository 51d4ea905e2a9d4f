"""Type guards and value rules for the sections of a record that comes as JSON text.

A fixed schema drops what has the wrong type (only the part itself, not the record); what is
left passes the rules of its section.  Members without a rule here, of the record or of one of
its sections, stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import public_text
from . import completeness

_TEXTS = "array<string>"
_TABLE = "map<string,string>"
#: Rows of a list are read one by one, so that a row of the wrong type is dropped alone.
ROWS = {
    "vehicle_applications": "make string, model string, year_from int, year_to int",
    "decoders": "tool string, reference string, note string",
    "lock_parts": "lock string, part string, supplier string, note string",
    "troubleshooting": "problem string, action string",
    "known_options": "part string, years string, fcc_id string, frequency string, buttons string",
    "cloner_tools": "name string, model string, status string",
    "tools": "name string, note string",
    "field_workflow": "step string, detail string",
}
RECORD = (
    f"code string, title string, system_type string, vehicle_applications {_TEXTS}, quick_answer {_TEXTS}, warnings {_TEXTS}, source_coverage {_TEXTS}, decoders {_TEXTS}, lock_parts {_TEXTS}, troubleshooting {_TEXTS}, "
    f"key_remote struct<remote_type:string,frequency:string,fcc_id:string,known_options:{_TEXTS}>, "
    f"mechanical_key struct<ilco_keyway:string,style:string,macs:string,start_cut:string,cut_to_cut:string,milling:string,air_bags:string,ignition_retainer:string,spacing:{_TABLE},depths:{_TABLE},cutting_setup:{_TABLE},cut_position_map:{_TEXTS}>, "
    f"transponder struct<chip:string,test_key:string,reusable:string,cloning:string,cloner_tools:{_TEXTS}>, "
    f"programming struct<factory_tool:string,pin_guidance:string,tool_guidance:string,pin_required:string,tools:{_TEXTS}>, "
    f"making_key struct<methods:{_TEXTS},field_notes:{_TEXTS},service_notes:{_TEXTS},field_workflow:{_TEXTS}>, "
    f"job_essentials {_TABLE}, technician_checklist map<string,{_TEXTS}>, source_facts map<string,{_TEXTS}>"
)
SECTIONS = ("key_remote", "mechanical_key", "transponder", "programming", "making_key")
#: Members of each section that have a rule.
SECTION_FIELDS = {name: tuple(re.findall(r"(\w+):", fields)) for name, fields in re.findall(r"(\w+) struct<((?:[^<>]|<[^<>]*>)*)>", RECORD)}
# What stands for a missing value, shapes of cuts, and words that say there is none.
PLACEHOLDERS = ("CHECK SOURCE", "VERIFY SOURCE", "SOURCE CHECK", "UNKNOWN FROM SOURCE")
CUT = "^\\d?(?:\\.\\d{3})$"
NO_CUT = ("N/A", "NA", "NONE", "-", "--", "VARIES")
PRECUT = "(?i)^precut(?:\\s+position)?\\s+\\d+$"
OUTER_TRACK = "\\b(?:EXTERNAL|EDGE|4-TRACK)\\b"


def _text(x: Column) -> Column:
    """Trimmed; null if blank or a placeholder."""
    t = F.trim(x)
    return F.when((t != "") & ~F.upper(t).isin(*PLACEHOLDERS), t)


def _texts(x: Column) -> Column:
    kept = F.array_distinct(F.filter(F.transform(x, _text), lambda v: v.isNotNull()))
    return F.when(F.size(kept) > 0, kept)


def _public(x: Column) -> Column:
    return F.when(public_text(x) != "", _text(x))


def _cut(x: Column) -> Column:
    t = F.trim(x)
    return F.when(F.rlike(t, F.lit(CUT)) | F.upper(t).isin(*NO_CUT) | F.rlike(t, F.lit(PRECUT)), t)


def _rows(part: Column, name: str, keep) -> Column:
    rows = F.transform(part[name], lambda v: F.from_json(v, ROWS[name], {"mode": "PERMISSIVE"}))
    kept = F.filter(rows, lambda r: r.isNotNull() & F.coalesce(keep(r), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def _table(x: Column, clean) -> Column:
    kept = F.map_filter(F.transform_values(x, lambda _, v: clean(v)), lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def _inside(json: Column) -> Column:
    """An object's text without its braces; empty for null."""
    return F.regexp_replace(F.coalesce(json, F.lit("")), "^\\{|\\}$", "")


def _named(name: str, inside: Column) -> Column:
    """A member with an object, or empty if the object is."""
    return F.element_at(F.transform(F.array(inside), lambda x: F.when(x != "", F.concat(F.lit(f'"{name}":{{'), x, F.lit("}"))).otherwise("")), 1)


def _members(*insides: Column) -> Column:
    return F.array_join(F.filter(F.array(*insides), lambda x: x != ""), ",")


def _others(json: Column, known: Sequence[str]) -> Column:
    """The members of a JSON object that are not known, as the inside of an object; empty without any."""
    members = F.from_json(json, "map<string,variant>", {"mode": "PERMISSIVE"})
    return _inside(F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*known) & v.isNotNull() & ~F.to_json(v).isin("null", '""', "[]", "{}"))))


def _has(*fields: Column) -> Column:
    return F.trim(F.coalesce(*fields, F.lit(""))) != ""


def sanitized(record: Column | str) -> Column:
    """JSON text of the record's sections with what is malformed, empty or no public fact left out.

    Text that is not JSON gives an empty record, null gives null.
    """
    source = F.col(record) if isinstance(record, str) else record
    r = F.from_json(source, RECORD, {"mode": "PERMISSIVE"})
    m, t, p, k, o = r["mechanical_key"], r["transponder"], r["programming"], r["making_key"], r["key_remote"]
    outer = F.rlike(F.upper(F.coalesce(F.to_json(m), F.lit(""))), F.lit(OUTER_TRACK)) & completeness.valid_depths(m["depths"], 4)
    mechanical = F.struct(
        *[_text(m[c]).alias(c) for c in ("ilco_keyway", "style", "milling", "air_bags")],
        F.when(F.rlike(F.trim(m["macs"]), F.lit("^\\d{1,2}$")), F.trim(m["macs"])).alias("macs"),
        *[_cut(m[c]).alias(c) for c in ("start_cut", "cut_to_cut")],
        _public(m["ignition_retainer"]).alias("ignition_retainer"),
        F.when(completeness.descending(m["spacing"], 5), m["spacing"]).alias("spacing"),
        F.when(completeness.descending(m["depths"], 4) | F.coalesce(outer, F.lit(False)), m["depths"]).alias("depths"),
        m["cutting_setup"].alias("cutting_setup"),
        _texts(m["cut_position_map"]).alias("cut_position_map"),
    )
    parts = {
        **{c: _text(r[c]) for c in ("code", "title", "system_type")},
        "vehicle_applications": _rows(r, "vehicle_applications", lambda v: _has(v["make"]) & _has(v["model"]) & (F.coalesce(v["year_from"], F.lit(0)) <= F.coalesce(v["year_to"], F.lit(9999)))),
        **{c: _texts(r[c]) for c in ("quick_answer", "warnings", "source_coverage")},
        "decoders": _rows(r, "decoders", lambda v: _has(v["tool"]) & _has(v["reference"])),
        "lock_parts": _rows(r, "lock_parts", lambda v: completeness.lock_part(F.array(v["lock"], v["part"], v["supplier"], v["note"]))),
        "troubleshooting": _rows(r, "troubleshooting", lambda v: _has(v["problem"], v["action"])),
        "key_remote": F.struct(*[_text(o[c]).alias(c) for c in ("remote_type", "frequency", "fcc_id")], _rows(o, "known_options", lambda v: _has(v["part"], v["fcc_id"])).alias("known_options")),
        "mechanical_key": mechanical,
        "transponder": F.struct(*[_text(t[c]).alias(c) for c in ("chip", "test_key", "reusable", "cloning")], _rows(t, "cloner_tools", lambda v: _has(v["name"], v["model"]) & _has(v["status"])).alias("cloner_tools")),
        "programming": F.struct(*[_public(p[c]).alias(c) for c in ("factory_tool", "pin_guidance", "tool_guidance")], _text(p["pin_required"]).alias("pin_required"), _rows(p, "tools", lambda v: _has(v["name"])).alias("tools")),
        "making_key": F.struct(_texts(F.filter(k["methods"], lambda v: public_text(v) != "")).alias("methods"), *[_texts(k[c]).alias(c) for c in ("field_notes", "service_notes")], _rows(k, "field_workflow", lambda v: _has(v["step"], v["detail"])).alias("field_workflow")),
    }
    parts |= {"job_essentials": _table(r["job_essentials"], _text), "technician_checklist": _table(r["technician_checklist"], _texts), "source_facts": _table(r["source_facts"], _texts)}
    insides = [_inside(F.to_json(F.struct(*[v.alias(name) for name, v in parts.items() if name not in SECTIONS])))]
    for name in SECTIONS:  # a section with nothing left goes
        body = _members(_inside(F.to_json(parts[name])), F.when(r.getField(name).isNotNull(), _others(F.get_json_object(source, f"$.{name}"), SECTION_FIELDS[name])).otherwise(""))
        insides.append(_named(name, body))
    return F.when(source.isNotNull(), F.concat(F.lit("{"), _members(*insides, _others(source, tuple(parts))), F.lit("}")))


def sanitize(drafts: DataFrame, record: str = "record") -> DataFrame:
    """``drafts`` with the record replaced by its sanitised text."""
    return drafts.withColumn(record, sanitized(record))
