"""Repair of section pages and their codes, case by case."""

import pytest
from pyspark.sql import functions as F

from quirework.functions import section_text
from quirework.operators import sections

PAGES = [
    ("x FO-12 SECTlON", "FO-12", ""),
    ("2004 НОН-Р3 SECTION", "HON-P3", ""),
    ("НК.2З SECTION one", "HK-23", ""),
    ("HK-З SECTION", "HK-3", ""),
    ("СМ К1З SECTION", "GM-K13", "Domestic"),
    ("gm.p4 section", "GM-P4", ""),
    ("TOY-1О SECTION", "TOY-10", ""),
    ("ВМУЬ4 SECTION", "BMW-4", ""),
    ("MLTS-4 SECTION", "MITS-4", "Asian book"),
    ("Y-12 SECTION", "TOY-12", "Asian book"),
    ("DCE-3 SECTI0N", "DGE-3", "Domestic"),
    ("AVA-5 SECTION", "AV-15", "Audi"),
    ("THIS SECTION", "", ""),
    ("R15 SECTION", "HON-R15", "Asian"),
    ("MBS SECT", "MB-5", "Mercedes"),
    ("nothing here", "", ""),
    (None, "", ""),
]


def test_heading_codes(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, _, d) in enumerate(PAGES)], "i int, text string, document string")
    got = {r["i"]: r["code"] for r in df.select("i", section_text.heading_code("text", F.col("document")).alias("code")).collect()}
    assert got == {i: c for i, (_, c, _) in enumerate(PAGES)}


@pytest.mark.parametrize(("code", "document", "page", "expected"), [("SUZU-3", "asian", "Ascender", "ISUZU-3"), ("GM-F412", "domestic", "continued", "GM-F12"), ("GM-F412", "domestic", "", "GM-F412"), ("F12", "asian", "acura", "ACU-F12"), ("AVB3", "", "", "AV-3"), ("LSUZU_3", "asian", "", "ISUZU-3"), ("BMX", "bmw", "", ""), ("X9", "fiat", "", "FA-9")])
def test_codes_by_document(spark, code, document, page, expected):
    df = spark.createDataFrame([(code, document, page)], "code string, document string, page string")
    assert df.select(section_text.document_code("code", F.col("document"), "page")).first()[0] == expected


def test_repaired_pages_open_sections(spark):
    pages = spark.createDataFrame([("Domestic", 1, "СМ К1З SECTION text"), ("Domestic", 2, "more"), ("Domestic", 3, "TAЫLE OF CONTENTS")], "document string, page_number long, text string")
    found = sections.split_sections(sections.page_features(pages, repair=True)).collect()
    assert [(r["code"], r["page_start"], r["page_end"]) for r in found] == [("GM-K13", 1, 2)]
