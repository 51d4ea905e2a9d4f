"""Known models by the automaton against a pattern a name; headings against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.functions import vehicles
from quirework.plans import candidates

VOCABULARY = {"Ford": ["Focus", "Escape", "Ka", "F150", "Crown Victoria", "E Series"], "Jeep": ["Grand Cherokee", "Cherokee"], "Audi": ["A4 / S4", "A4", "Q5"], "Honda": ["CR-V", "Clarity", "Clarity Plug-In", "10I"], "Mazda": ["5", "CX-5"]}


def by_patterns(text: str) -> list[tuple]:
    """Every pattern on its own, as the definition has it."""
    out = []
    for make, models in VOCABULARY.items():
        for model in models:
            body = "".join(r"\s*" if c == " " else r"[-\s]?" if c == "-" else r"\s*/\s*" if c == "/" else "[0O]" if c == "0" else "[1I]" if c == "1" else re.escape(c) for c in model)
            for m in re.finditer(rf"((?:19|20)[0-9]{{2}}\s*[-–]\s*[0-9]{{2,4}}).{{0,20}}?(?:{body})(?=\s|\(|\||,|$)", text, re.I):
                out.append((make, model, m[1], text[m.end() : m.end() + 30]))
    return sorted(out)


def test_spans_equal_a_pattern_a_name():
    models = vehicles.KnownModels(VOCABULARY)
    r = random.Random(4)
    parts = ["1998-04", "2003 – 2008", "1975-845 Series", "2001-2", "1999-2004-08", "1998-2004-12", " ", " ", ", ", "x ", "(Ford)", "FOCUS", "Focus", "focus,", "F15O", "fI50", "CR V", "CRV ", "CR-V|", "Grand Cherokee", "GrandCherokee", "Cherokee ", "A4/S4 ", "A4 / s4", "5 ", "CX5", "Clarity Plug In", "Clarity", "1OI", "Ka", "some other words here ", "crown  victoria", "1998-045 ", "Eseries", "é"]
    hits = 0
    for _ in range(4000):
        text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 14)))
        got = sorted((a["make"], a["model"], a["years"], a["near"]) for a in models.applications(text))
        assert got == by_patterns(text), text
        hits += len(got)
    assert hits > 3000
    assert models.applications("") == [] and vehicles.KnownModels({}).applications("1998-04 Focus") == []


def test_what_confirms_an_application(spark):
    rows = [
        ("d", "Ford", "1998-04 Focus", [("Ford", "Focus")]),
        ("d", "Ford", "1998-04 Focus (Ford)", [("Ford", "Focus")]),
        ("d", "Ford", "1998-04 Focus (Audi)", []),
        ("d", "Ford", "1998-04 Ka", []),  # two signs need their make
        ("d", "Ford", "1998-04 Ka (FORD)", [("Ford", "Ka")]),
        ("d", "Audi", "1998-04 Focus", []),
        ("domestic 7", "Audi", "1998-04 Focus (Ford) 2001-05 Cherokee (Jeep)", [("Ford", "Focus"), ("Jeep", "Cherokee")]),
        ("domestic 7", "Audi", "1998-04 Q5 (Audi)", []),
        ("my audi book", "", "1998-04 AG/SE (Au) 2005-08 AS (Aud)", []),
        ("asian", "", "2004-06 СR-V (honda)", [("Honda", "CR-V")]),  # a look-alike letter
        (None, None, None, []),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, source_document string, default_make string, raw_text string")
    got = {}
    for r in candidates.canonical_applications(df, VOCABULARY).collect():
        got.setdefault(r["i"], []).append((r["make"], r["model"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: r[3] for i, r in enumerate(rows) if r[3]}


@pytest.mark.parametrize(
    "heading, make, model, bad",
    [
        ("Focus", "Ford", "Focus", False),
        ("Golf", "Volkswagen", "Golf", False),
        ("Corolla (toyota)", "Toyota", "Corolla", False),
        ("Silverado (Chevy)", "Chevrolet", "Silverado", False),
        ("Sprinter (Benz)", "Mercedes-Benz", "Sprinter", False),
        ("Passatxvw)", "Volkswagen", "Passat", False),
        ("GoIf / GTI more", "Volkswagen", "Golf / GTI", False),
        ("Ford Town Ca", "Lincoln", "Town Car", False),
        ("5 Series", "Ford", "Series", False),
        ("cc", "Volkswagen", "CC", False),
        ("PO X 9", "Ford", "PO X", True),
        ("Focus depth", "Ford", "Focus depth", True),
        ("A", "Ford", "A", True),
        ("Unknown (Nobody)", "Ford", "Unknown", False),
        ("", "Ford", "", True),
    ],
)
def test_headings(spark, heading, make, model, bad):
    df = vehicles.split_heading(spark.createDataFrame([(heading, "Ford")], "h string, d string"), "h", "d")
    r = df.select("make", "model", vehicles.bad_model("model").alias("bad")).first()
    assert tuple(r) == (make, model, bad)


def test_names_of_makes(spark):
    names = {"chevy": "Chevrolet", "GMC": "GMC", "mercedes-benz": "Mercedes-Benz", "LAND ROVER": "Land Rover", "vw1": "Volkswagen", "": "", "Olds.": "Oldsmobile", "ge0": "Geo"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", vehicles.make_name("n").alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == names


def test_default_and_possible_makes(spark):
    df = spark.createDataFrame([("HON-1", "x"), ("zz-1", "the Kia book"), ("zz", None), (None, "domestic")], "c string, d string")
    got = df.select(vehicles.default_make("c", "d").alias("m"), F.size(vehicles.possible_makes("d", F.lit("Saab"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [("Honda", 1), ("Kia", 1), ("", 1), ("", 13)]


def test_an_application_stands_once(spark):
    secs = spark.createDataFrame(
        [("FORD-1", "a", 1, "1998-04 Focus transponder 2001-03 Fokus (Ford) KEYS 2010-11 Edge", "Ford"), ("FORD-1", "a", 9, "1998-04 FOCUS", "Ford"), ("FORD-2", "b", 1, "2001- Escpae 2003-05 Golf", "Ford")],
        "code string, source_document string, page_start long, raw_text string, default_make string",
    )
    got = {(r["system_code"], r["make"], r["model"], r["year_from"], r["year_to"]): r["confidence"] for r in candidates.from_sections(secs, VOCABULARY).collect()}
    assert got == {
        ("FORD-1", "Ford", "Focus", 1998, 2004): 0.92,
        ("FORD-1", "Ford", "Focus", 2001, 2003): pytest.approx(0.84),
        ("FORD-2", "Ford", "Escape", 2001, 2001): pytest.approx(0.84),
        ("FORD-2", "Volkswagen", "Golf", 2003, 2005): pytest.approx(0.84),
    }


def test_sections_without_a_year_range_are_not_repaired(spark):
    """They go before repair; ranges across any white space stay."""
    from quirework.plans import candidates

    rows = [("AB-1", "d", 1, "1998 – 2004 Focus more"), ("AB-2", "d", 2, "1998 Focus"), ("AB-3", "d", 3, None)]
    secs = spark.createDataFrame(rows, "code string, source_document string, page_start long, raw_text string").selectExpr("*", "'Ford' AS default_make")
    found = candidates.canonical_applications(secs, {"Ford": ["Focus"]})
    assert "RLIKE" in found._jdf.queryExecution().analyzed().toString()
    assert [(r["code"], r["model"], r["year_from"], r["year_to"]) for r in found.collect()] == [("AB-1", "Focus", 1998, 2004)]
