"""Draft fields on hand-written sections."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import draft_fields as fields
from quirework.plans import drafts


def one(spark, x, value):
    return spark.createDataFrame([(value,)], "t string").select(x(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Lishi: HU100 v2 Determinator: 7 KA Lishi", [("Lishi", "HU100 v2"), ("Determinator", "7 KA")]),
        ("lishi | hu66 EEZ Reader: N/A Cobra: 12AB, more", [("Lishi", "hu66"), ("Cobra", "12AB")]),
        ("AccuReade: 5AB", [("AccuReader", "5AB")]),  # as a scan leaves it; the repair makes the label
        ("Determinator: none Lishi", []),
        (None, []),
    ],
)
def test_decoders(spark, text, expected):
    assert [tuple(r) for r in one(spark, lambda t: fields.decoders(fields.repaired(t)), text)] == expected


def test_decoder_summary(spark):
    assert one(spark, lambda t: fields.decoder_summary(fields.decoders(t)), "Lishi: HU100 Cobra: 7X, ") == "Lishi: HU100; Cobra: 7X"
    assert one(spark, lambda t: fields.decoder_summary(fields.decoders(t)), "") == "Check source pages"


def test_remote_options(spark):
    text = (
        "2004-08 Remote 1234567AB FCC Info: ABC123 315 MHz 3 Btn with panic.\n2004-08 Remote 1234567AB FCC Info: ABC123 315 MHz 3 Btn with panic.\n"
        "Fob 1KO 959 753 AB and E-Key: 1O 837 246 C later\nRemote without a number\n12345-67890 of something else"
    )
    a, b = one(spark, fields.remote_options, text)
    assert (a["years"], a["part"], a["fcc_id"], a["frequency"], a["buttons"]) == ("2004-08", "1234567AB", "ABC123", "315 MHz", "3")
    assert a["notes"].startswith("2004-08 Remote 1234567AB FCC Info: ABC123")
    assert b["part"] == "1K0 959 753 AB" and b["emergency_blade"].startswith("10 837 246 C") and b["fcc_id"] == ""


def test_lock_parts(spark):
    text = (
        "2004-08 STRATTEC ignition lock cylinder available here, pin kit 7012345 too\n"
        "2004-08 STRATTEC ignition lock cylinder available here, pin kit 7012345 too\n"
        "The door lock part and the trunk lock part are both in stock now\n"
        "Use the decoder on the lock part to determine the working key\n"
        "ASP short"
    )
    got = [tuple(r) for r in one(spark, fields.lock_parts, text)]
    first = "2004-08 STRATTEC ignition lock cylinder available here, pin kit 7012345 too"
    second = "The door lock part and the trunk lock part are both in stock now"
    assert got == [("2004-08", "", first, "", "", "7012345"), ("", "", second, second, second, "")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Method #1 Check the owner-manual first. Method 2 something of no use at all", ["Method 1: Check the owner's manual for a dealer-written key code."]),
        ("METHOD 1: lock Reader/Decoder in the door lock for a complete key METHOD 2 Disassemble the door cylinder and decode the tumblers", ["Method 1: Use a lock reader/decoder in the door lock to determine the cuts for a complete key.", "Method 2: Disassemble the door cylinder and decode the tumblers."]),
        ("Method 3 impression all the\nlocks TRANSPONDER chip 46", ["Method 3: Impression the locks."]),
        ("Method 7 remove the cylinder & read it, 12", ["Method 7: remove the cylinder and read it."]),
        ("Method 7 remove the cylinder to get AB-12", ["Method 7: remove the cylinder to get AB-12."]),
        ("Method 7 decode METH0D x Method 7 decode the wafers now", ["Method 7: decode the wafers now."]),
        (" ".join(f"Method {n} decode the wafers {chr(96 + n)}x" for n in range(1, 9)), [f"Method {n}: decode the wafers {chr(96 + n)}x." for n in range(1, 6)]),
        ("", []),
        (None, []),
    ],
)
def test_numbered_methods(spark, text, expected):
    assert one(spark, fields.numbered_methods, text) == expected


@pytest.mark.parametrize("value, longest, expected", [(" A1-9; ", 40, "A1-9"), ("x" * 41, 40, ""), ("Lopk 5", 40, ""), ("5 é", 40, ""), ("a  b", 40, "a b"), ("a@b", 40, ""), (None, 40, "")])
def test_short_values(spark, value, longest, expected):
    assert one(spark, lambda t: fields.short_value(t, longest), value) == expected


def test_repairs(spark):
    assert one(spark, fields.repaired, "C0DES F0b 1nfo: 12 - 34 F C C 315 M Hz d00r Iock\nTestkeyisHUS6") == "CODES Fob Info: 12-34 FCC 315 MHz door lock\nTest Key is HU66"


def section(spark, *texts):
    return spark.createDataFrame([(f"FO-{i}", "doc", 3, 4, t, "Ford", 0.6) for i, t in enumerate(texts, 1)], "code string, source_document string, page_start long, page_end long, raw_text string, default_make string, confidence double")


def test_a_whole_record(spark):
    text = (
        "FO-1 double sided transponder remote 315 MHz FCC Info: ABC123 Code Series: A1-9 Chip: Philips 46 Reusable: no Code Series. CARD# C12\nMACS: 7 StartCut .156 CutToCut .092 "
        "INTERNAL 2 track MILLING Lishi: HU100 Autel ILCO HU92 SPACING .900 .850 .800 .750 .700 .650 .600 .550 DEPTHS 1=.340 2=.325 Test Key is HU92-P\nFactory Tool NGS PIN needed KESSY "
        "Dealer transponder system. No cloning\nSTRATTEC door lock part 7012345 is available from the dealer\nMethod 3 impression all the locks"
    )
    apps = spark.createDataFrame([], "make string, model string, year_from int, year_to int, system_type string, system_code string, source_document string, source_page int, confidence double")
    out = drafts.draft(section(spark, text, None, ""), apps)
    assert out.columns == [*section(spark, "").columns, "vehicle_applications", "draft"]
    got = {r["code"]: json.loads(r["j"]) for r in out.select("code", F.to_json("draft").alias("j")).collect()}
    d = got["FO-1"]
    m, t, p = d["mechanical_key"], d["transponder"], d["programming"]
    assert (d["title"], d["system_type"]) == ("FO-1 Vehicle Reference", "Transponder Key")
    assert (m["code_series"], m["style"], m["card"], m["ilco_keyway"], m["macs"], m["start_cut"], m["cut_to_cut"], m["milling"]) == ("A1-9", "Double-sided", "C12", "HU100 / HU92", "7", ".156", ".156", "Internal milling")  # the first cut in the text is that of StartCut
    assert m["spacing"] == {str(i + 1): f".{900 - 50 * i}" for i in range(8)} and m["depths"] == {"1": ".340", "2": ".325"}
    assert (t["transponder_type"], t["chip"], t["test_key"]) == ("Transponder", "Philips 46", "HU92-P")
    assert (p["pin_required"], p["factory_tool"], p["cloning"], [x["name"] for x in p["tools"]]) == ("Yes", "NGS", "No cloning for this system.", ["Autel"])
    assert p["system_requirement"].startswith("Dealer transponder system") and d["key_remote"]["proximity_option"].endswith("KESSY proximity option.")
    assert d["job_essentials"]["Lishi / decoder"] == "Lishi: HU100" and d["source_facts"]["FCC IDs"] == ["ABC123"] and d["source_facts"]["Part numbers"] == ["7012345"]
    assert d["making_key"]["numbered_methods"] == ["Method 3: Impression the locks."] and len(d["lock_parts"]) == 1
    assert [x["issue"] for x in d["troubleshooting"]][:2] == ["Vehicle or trim mismatch", "PIN access required"]
    assert set(d["technician_checklist"]) == {"Bring to the job", "Verify before ordering", "Final tests"}
    assert got["FO-2"] | {"code": "", "title": ""} == got["FO-3"] | {"code": "", "title": ""}  # null and empty texts alike
    assert "lock_parts" not in got["FO-2"] and got["FO-2"]["making_key"]["methods"] == [fields.NO_METHOD]
