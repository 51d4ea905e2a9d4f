"""Rules of the record's sections, one malformed part at a time."""

import json

from quirework.operators import sanitizing

CASES = [
    ({"code": "FO-1", "title": "Check source", "mechanical_key": "text", "warnings": "none"}, {"code": "FO-1"}),
    ({"warnings": ["a", " a ", "", "VERIFY SOURCE"], "decoders": [{"tool": "Lishi", "reference": "HU92"}, {"tool": "x"}, "y"]}, {"warnings": ["a"], "decoders": [{"tool": "Lishi", "reference": "HU92"}]}),
    ({"mechanical_key": {"macs": "123", "start_cut": ".105", "cut_to_cut": "junk", "style": "4-track"}}, {"mechanical_key": {"style": "4-track", "start_cut": ".105"}}),
    ({"mechanical_key": {"macs": "4", "start_cut": "Precut position 3", "cut_to_cut": "n/a"}}, {"mechanical_key": {"macs": "4", "start_cut": "Precut position 3", "cut_to_cut": "n/a"}}),
    ({"mechanical_key": {"spacing": {"1": ".9", "2": ".8", "3": ".7", "4": ".6", "5": ".5"}, "depths": {"1": ".2", "2": ".3"}}}, {"mechanical_key": {"spacing": {"1": ".9", "2": ".8", "3": ".7", "4": ".6", "5": ".5"}}}),
    ({"mechanical_key": {"style": "external", "depths": {"1": ".1", "2": ".2", "3": ".3", "4": ".4"}}}, {"mechanical_key": {"style": "external", "depths": {"1": ".1", "2": ".2", "3": ".3", "4": ".4"}}}),
    ({"mechanical_key": {"depths": {"1": ".1", "2": ".2", "3": ".3", "4": ".4"}}}, {}),
    ({"lock_parts": [{"part": "7012345"}, {"note": "decoder method"}, {"supplier": "Strattec part", "note": "use the reader"}]}, {"lock_parts": [{"part": "7012345"}]}),
    ({"transponder": {"chip": "46", "cloner_tools": [{"name": "A", "status": "ok"}, {"name": "B"}, {"model": "C", "status": "no"}]}}, {"transponder": {"chip": "46", "cloner_tools": [{"name": "A", "status": "ok"}, {"model": "C", "status": "no"}]}}),
    ({"programming": {"factory_tool": "", "tools": [{"name": "T"}, {"note": "x"}], "pin_required": "Yes"}}, {"programming": {"pin_required": "Yes", "tools": [{"name": "T"}]}}),
    (
        {"job_essentials": {"PIN": "Check source", "FCC ID": " ABC12 "}, "technician_checklist": {"Bring": ["a", ""], "No": []}, "source_facts": "x", "procedure_diagrams": [{"title": "t", "n": 1.5}], "verified": True, "none": None, "empty": {}},
        {"job_essentials": {"FCC ID": "ABC12"}, "technician_checklist": {"Bring": ["a"]}, "procedure_diagrams": [{"title": "t", "n": 1.5}], "verified": True},
    ),
    ({"mechanical_key": {"macs": "x", "code_series": "A1-9", "tracks": {"left": ["1"]}}, "transponder": {"own": 5}, "programming": {"own": ""}}, {"mechanical_key": {"code_series": "A1-9", "tracks": {"left": ["1"]}}, "transponder": {"own": 5}}),
    ({"making_key": {"methods": ["Read the code from the lock.", ""], "field_notes": "no list"}}, {"making_key": {"methods": ["Read the code from the lock."]}}),
]


def test_sections_are_sanitised(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)] + [(100, "no json"), (101, None), (102, "")]
    got = {r["i"]: r["record"] for r in sanitizing.sanitize(spark.createDataFrame(rows, "i int, record string")).collect()}
    for i, (_, expected) in enumerate(CASES):
        assert json.loads(got[i]) == expected, i
    assert got[100] == "{}" and got[101] is None and got[102] == "{}"
