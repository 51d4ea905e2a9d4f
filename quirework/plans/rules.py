"""Queries of the completeness rules and page predicates, with oracle SQL.

Sources and records are put together from phrases and fields that the row's number chooses, by
one expression that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts
from ..operators import completeness, sanitizing
from .catalog import query, table

#: Phrase and the numbers (modulus, remainder) that have it.
PHRASES = [
    ("2004-08 Ford Focus", 2, 0), ("TechStream", 3, 0), ("ILCO: HU92", 5, 1), ("MACS: 4", 4, 1), ("STYLE two track", 7, 2), ("INTERNAL cut MILLING", 6, 5),
    ("AirBags", 8, 3), ("IGN RETAINER: YES", 9, 4), ("PIN needed", 5, 2), ("METHOD #1 read", 4, 2), ("METHOD #2 try", 4, 2), ("tryout keys", 11, 3),
    ("CHIP INFORMATION", 6, 1), ("Test key is HU9", 7, 3), ("PROGRAMMER & DIAGNOSTIC TOOLS", 5, 3), ("SUBSCRIPTION", 10, 3), ("DEALER TRANSPONDER SYSTEM", 13, 1),
    ("CLONER MACHINE INFORMATION", 8, 1), ("Kessy", 9, 1), ("dealer does not have access to pin", 12, 7), ("NOCODESONANYLOCKS", 14, 5), ("PIN KIT 7012345", 7, 5),
    ("STARTCUT", 5, 4), ("CUTTOCUT", 6, 4), ("FCC INFO: ABC123", 3, 1), ("REMOTE: 1234567A", 6, 1), ("REMOTE: 7654321B", 12, 1), ("Lishi: HU100 v2", 8, 5),
    ("SPACING .900 .800 .700 .600 .500 .400", 4, 3), ("EIGHT SPACES", 9, 7), ("DEPTHS 1=.305 2=.280 3=.255 4=.230", 5, 0), ("FOUR DEPTHS", 10, 6),
    ("PROXIMITY OPTION", 11, 5), ("IGNITION DOORS TRUNK POSITION 1 2 3 4 5 6 7", 13, 4), ("TABLE OF CONTENTS", 17, 2),
]
#: The same for parts of a record: parent, JSON member.
FIELDS = [
    ("", '"vehicle_applications":[{"make":"Ford"}]', 4, 0), ("", '"system_type":" Proximity fob"', 3, 2), ("", '"lock_parts":[{"part":"7012345"}]', 14, 5), ("", '"decoders":[{"tool":"Lishi","reference":"HUI00 V2"}]', 16, 5),
    ("", '"procedure_diagrams":[{"panels":[{"rows":[["IGNITION","filled"]]}]}]', 26, 4), ("", '"note":"kessy pin"', 18, 1),
    ("mechanical_key", '"ilco_keyway":"HU92"', 10, 1), ("mechanical_key", '"ilco_keyway":"Tcode"', 25, 6), ("mechanical_key", '"macs":"4"', 8, 1), ("mechanical_key", '"style":""', 7, 2), ("mechanical_key", '"ignition_retainer":"On"', 18, 4),
    ("mechanical_key", '"start_cut":""', 10, 4), ("mechanical_key", '"cut_to_cut":".1"', 12, 4), ("mechanical_key", '"spacing":{"1":".900","2":".800","3":".700","4":".600","5":".500","6":".400"}', 8, 3),
    ("mechanical_key", '"spacing":{"1":".400","2":".450","3":".500","4":".550","5":".600","6":".650","7":".700","8":".750"}', 8, 7), ("mechanical_key", '"depths":{"1":".305","2":".280","3":".255","4":".230"}', 15, 5), ("mechanical_key", '"depths":{"1":".305","2":".280","3":".290","4":".230"}', 15, 10),
    ("transponder", '"chip":"46"', 12, 1), ("transponder", '"cloner_tools":[{"name":"","model":"X","status":"ok"},{"name":"Y"}]', 16, 1), ("programming", '"factory_tool":"TechStream"', 6, 0), ("programming", '"pin_guidance":"ask"', 24, 7),
    ("making_key", '"methods":["one"]', 8, 2), ("making_key", '"methods":["one","two"]', 8, 6), ("key_remote", '"known_options":[{"fcc":"ABC123"}]', 6, 1),
]


def _case(text: str, modulus: int, remainder: int) -> str:
    return f"CASE WHEN p_partkey % {modulus} = {remainder} THEN '{text}' END"


def _object(parent: str) -> str:
    own = ", ".join(_case(t, m, r) for p, t, m, r in FIELDS if p == parent)
    inner = f"concat_ws(',', {own})"
    return f"CASE WHEN {inner} <> '' THEN concat('\"{parent}\":{{', {inner}, '}}') END"


SOURCE = f"concat_ws(' ', p_name, {', '.join(_case(*p) for p in PHRASES)})"
PARENTS = ("mechanical_key", "transponder", "programming", "making_key", "key_remote")
RECORD = "concat('{', concat_ws(',', " + ", ".join([_case(t, m, r) for p, t, m, r in FIELDS if not p] + [_object(p) for p in PARENTS]) + "), '}')"


def _sql_filled(path: str) -> str:
    return f"(trim(coalesce(json_extract_string(rec, '$.{path}'), '')) NOT IN ('', '[]', '{{}}', 'null', 'false', '0'))"


#: A source that shows which positions which lock uses.
_LOCK_FLAT = "regexp_replace(regexp_replace(up, '\\s+', ' ', 'g'), '\\bIGN(?:ITION)?\\s+RETAINER\\b', ' ', 'g')"
_LOCK_VISUAL = (
    f"regexp_matches({_LOCK_FLAT}, 'DOORS?\\b|HATCH\\b') AND regexp_matches({_LOCK_FLAT}, 'IGNITION.{{0,100}}(?:DOORS?|TRUNK|HATCH)|(?:DOORS?|TRUNK|HATCH).{{0,80}}IGNITION') "
    f"AND (regexp_matches({_LOCK_FLAT}, '\\b(?:1 2 3 4 5 6 7(?: 8)?|POSITIONS?)\\b|\\b(?:FILLED|MARK(?:ED)?|SQUARE|WAFER)\\b') "
    f"OR len(regexp_extract_all({_LOCK_FLAT}, '\\b(?:IGNITION|DOORS?|TRUNK|HATCH|GLOVE\\s+BOX)\\b.{{0,60}}?\\b[1-9]\\b')) >= 2)"
)


def _sql_rules() -> list[tuple[str, str]]:
    out = []
    for r in completeness.RULES:
        there = " OR ".join([f"contains(upper(rec), '{r.mention}')"] * bool(r.mention) + [_sql_filled(p) for p in r.paths])
        text = "src" if r.issue == "applications missing" else "up"
        pattern = r.source.replace("'", "''")
        out.append((f"regexp_matches({text}, '{pattern}') AND NOT ({there})", r.issue))
    for issue, sign, path in completeness.KEPT_FIELDS:
        out.append((f"contains(up, '{sign}') AND json_extract_string(rec, '$.{path}') IS NULL", issue))
    fcc = "regexp_matches(up, '\\bFCC(?:\\s+INFO)?\\s*[:#]')"
    options = "json_extract(rec, '$.key_remote.known_options')"
    fold = lambda x: f"regexp_replace(translate(upper({x}), 'IO', '10'), '[^A-Z0-9]+', '', 'g')"
    reference = "regexp_extract(up, '\\bLISHI[:\\s|]+(HU[0-9]{1,4}(?:\\s*V[0-9]+)?)', 1)"
    decoders = "upper(coalesce(CAST(json_extract(rec, '$.decoders') AS VARCHAR), ''))"
    remotes = "len(list_distinct(regexp_extract_all(up, '\\bREMOTE\\s*:\\s*([A-Z0-9-]{6,24})', 1)))"
    falls = lambda t, n: f"list_bool_and(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda i: try_cast(json_extract_string({t}, '$.\"' || i || '\"') AS DOUBLE) IS NOT NULL AND (i = 1 OR coalesce(try_cast(json_extract_string({t}, '$.\"' || (i - 1) || '\"') AS DOUBLE) > try_cast(json_extract_string({t}, '$.\"' || i || '\"') AS DOUBLE), false))))"
    ordered = lambda n: f"({falls('spacing', n)} OR (upper(coalesce(json_extract_string(rec, '$.code'), '')) = 'HON-R15' AND {falls('spacing', n).replace(' AS DOUBLE) > try_cast', ' AS DOUBLE) < try_cast')}))"
    eight, four = "regexp_matches(up, '\\bEIGHT\\s+SPACES\\b')", "regexp_matches(up, '\\bFOUR\\s+DEPTHS\\b')"
    out += [
        (f"{fcc} AND NOT contains(upper(coalesce(CAST({options} AS VARCHAR), '')), 'FCC')", "fcc without remote options"),
        (f"{fcc} AND {remotes} >= 2 AND coalesce(json_array_length({options}), 0) < {remotes}", "remote options missing"),
        (f"regexp_matches(up, '\\bLISHI[:\\s|]+HU[0-9]{{1,4}}') AND NOT contains({decoders}, 'LISHI')", "lishi missing"),
        (f"{reference} <> '' AND NOT contains({fold(decoders)}, {fold(reference)})", "decoder reference mismatched"),
        (f"regexp_matches(coalesce(json_extract_string(rec, '$.mechanical_key.ilco_keyway'), ''), '{completeness.MISPLACED_TOOL}')", "tool in keyway"),
        ("positions > 0 AND n_spacing = 0", "spacing missing"),
        ("positions > 0 AND n_spacing > 0 AND n_spacing < wanted", "spacing short"),
        (f"positions > 0 AND n_spacing > 0 AND n_spacing >= wanted AND NOT {ordered('greatest(wanted, 1)')}", "spacing out of order"),
        ("n_found_depths >= 3 AND n_depths = 0", "depths missing"),
        ("n_found_depths >= 3 AND n_depths BETWEEN 1 AND 3", "depths short"),
        (f"n_found_depths >= 3 AND n_depths >= 4 AND NOT {falls('depths', '4')}", "depths out of order"),
        (f"{eight} AND n_spacing < 8", "eight spaces incomplete"),
        (f"{eight} AND n_spacing > 0 AND NOT {ordered('8')}", "eight spaces out of order"),
        (f"{_sql_filled('mechanical_key.start_cut')} AND {_sql_filled('mechanical_key.cut_to_cut')} AND n_depths > 0 AND n_spacing = 0", "cuts without spacing"),
        (f"{four} AND n_depths < 4", "four depths incomplete"),
        (f"{four} AND n_depths > 0 AND NOT {falls('depths', '4')}", "four depths out of order"),
        ("lower(trim(coalesce(json_extract_string(rec, '$.mechanical_key.ignition_retainer'), ''))) IN ('on', 'or', 'in', 'yes')", "retainer corrupt"),
        ("len(regexp_extract_all(up, '\\bMETHOD\\s*#?\\s*[0-9]+')) >= 2 AND coalesce(json_array_length(json_extract(rec, '$.making_key.methods')), 0) < len(regexp_extract_all(up, '\\bMETHOD\\s*#?\\s*[0-9]+'))", "methods short"),
        ("regexp_matches(up, '\\bCLONER\\s*MACHINE\\s*INFORMATION\\b') AND contains(rec, '{\"name\":\"Y\"}')", "cloner tools incomplete"),
        ("contains(up, 'PROXIMITY OPTION') AND starts_with(upper(trim(coalesce(json_extract_string(rec, '$.system_type'), ''))), 'PROXIMITY')", "proximity is an option"),
        (f"regexp_matches(up, '{completeness.LOCK_PARTS}') AND len(list_filter(regexp_extract_all(up, '\\b70[0-9]{{4,5}}\\b'), lambda x: NOT contains(upper(rec), x))) > 0", "lock part number missing"),
        (f"{_LOCK_VISUAL} AND NOT contains(rec, '\"filled\"')", "lock diagram missing"),
    ]
    return out


_FOUND = "list_filter(regexp_extract_all(substr(flat, {at}, {length}), '[0-9]+'), lambda x: length(x) = 3 AND CAST(x AS INTEGER) BETWEEN {low} AND {high})"


def _sql_found(kind: str) -> str:
    word, length, low, high = completeness.TABLES[kind]
    at = f"(length(regexp_extract(flat, '^(?s:.)*?{word}')) - length(regexp_extract(regexp_extract(flat, '^(?s:.)*?{word}'), '{word}$')) + 1)"
    return f"CASE WHEN regexp_matches(flat, '{word}') THEN len({_FOUND.format(at=at, length=length, low=low, high=high)}) ELSE 0 END"


def _sql() -> str:
    rules = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in _sql_rules())
    return f"""WITH a AS (SELECT p_partkey, {SOURCE} AS src, {RECORD} AS rec FROM part),
b AS (SELECT *, upper(src) AS up, regexp_replace(upper(src), '\\s+', ' ', 'g') AS flat, json_extract(rec, '$.mechanical_key.spacing') AS spacing, json_extract(rec, '$.mechanical_key.depths') AS depths FROM a),
c AS (SELECT *, coalesce(len(json_keys(spacing)), 0) AS n_spacing, coalesce(len(json_keys(depths)), 0) AS n_depths, {_sql_found('spacing')} AS n_found, {_sql_found('depths')} AS n_found_depths,
  len(list_distinct(regexp_extract_all(src, '[.][0-9]{{3}}\\b'))) AS different FROM b),
d AS (SELECT *, CASE WHEN n_found >= 10 THEN 10 WHEN n_found >= 8 THEN 8 WHEN n_found >= 6 THEN n_found ELSE 0 END AS positions FROM c),
e AS (SELECT *, CASE WHEN different > 0 THEN least(positions, different) ELSE positions END AS wanted FROM d)
SELECT p_partkey, concat_ws('; ', {rules}) AS issues FROM e"""


@query(_sql())
def draft_completeness(spark, d):
    """Every rule over every part."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(SOURCE).alias("src"), F.expr(RECORD).alias("rec"))
    return completeness.judged(rows, "src", "rec").select("p_partkey", F.array_join("issues", "; ").alias("issues"))


def _words_sql(words) -> str:
    return "(" + " + ".join(f"CAST(contains(up, '{w}') AS INTEGER)" for w in words) + ")"


@query(f"""WITH s AS (SELECT p_partkey, upper({SOURCE}) AS up FROM part)
SELECT p_partkey, {_words_sql(completeness.WORKFLOW)} > 0 AND ({_words_sql(completeness.LOCKS)} >= 2 OR contains(up, 'CUTTING THE KEY') OR (contains(up, 'METHOD #1') AND contains(up, 'METHOD #2'))) AS lock_diagram,
{_words_sql(('KEY', 'BLADE', 'LOCK', 'IGNITION'))} > 0 AND {_words_sql(completeness.CANDIDATE_LOCKS)} >= 2 AND {_words_sql(completeness.CANDIDATE_CONTEXT)} > 0 AND {_words_sql(completeness.FRONT_MATTER)} = 0 AS candidate FROM s""")
def diagram_pages(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.expr(SOURCE).alias("src"))
    return s.select("p_partkey", completeness.lock_diagram_page("src").alias("lock_diagram"), completeness.diagram_candidate_page("src").alias("candidate"))


_PART_VALUES = "CASE WHEN p_partkey % 3 = 0 THEN 'Strattec part' END, CASE WHEN p_partkey % 5 = 0 THEN 'decoder reader' END, CASE WHEN p_partkey % 7 = 0 THEN '7012345' END, p_name"


@query(f"""WITH s AS (SELECT p_partkey, concat_ws(' ', {_PART_VALUES}) AS t FROM part)
SELECT p_partkey FROM s WHERE regexp_matches(t, '{completeness.INVENTORY}') AND NOT regexp_matches(t, '{completeness.PROCEDURE}')""")
def lock_part_rows(spark, d):
    return table(spark, d, "part").filter(completeness.lock_part(F.expr(f"array({_PART_VALUES})"))).select("p_partkey")


_IDS = "CASE p_partkey % 6 WHEN 0 THEN 'ABC' || CAST(p_partkey AS VARCHAR(12)) WHEN 1 THEN 'HU92' WHEN 2 THEN 'FCC' WHEN 3 THEN p_brand WHEN 4 THEN 'PRX-' || CAST(p_size AS VARCHAR(12)) ELSE ' hon66 ' END"


@query(f"""WITH s AS (SELECT p_partkey, {_IDS} AS x FROM part)
SELECT p_partkey, regexp_matches(upper(trim(x)), '^[A-Z0-9-]{{5,24}}$') AND regexp_matches(upper(trim(x)), '[A-Z]') AND regexp_matches(upper(trim(x)), '[0-9]') AND upper(trim(x)) NOT IN ('111FO', '1NFO', 'INFO', 'FCC') AS fcc,
regexp_matches(trim(x), '^[A-Za-z0-9#./ -]{{2,32}}$') AND regexp_matches(x, '[0-9]') AS identifier,
regexp_matches(trim(x), '^[A-Za-z0-9#./ -]{{2,32}}$') AND regexp_matches(x, '[0-9]') AND regexp_matches(upper(trim(x)), '^((PRX|RHK|RKE|FLIP)-[A-Z0-9-]+|(TOY|HON|NIS|NSN|HU|CY|HD|DA|TR|Y|B)[0-9]{{1,5}}[A-Z]?)$') AS keyway FROM s""")
def identifier_kinds(spark, d):
    """The other three validators of identifiers."""
    s = table(spark, d, "part").select("p_partkey", F.expr(_IDS).alias("x"))
    x = F.col("x")
    return s.select("p_partkey", facts.valid_fcc(x).alias("fcc"), facts.good_identifier(x).alias("identifier"), facts.valid_keyway(x).alias("keyway"))


@query()
def sanitized_records(spark, d):
    """The record of every part without what is malformed; parts of it are no facts and go."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(RECORD).alias("record"))
    return sanitizing.sanitize(rows)
