"""Queries of the draft fields over every document, with oracle SQL.

What documents do not speak of is put beside their own words, by literal replacements that both
engines do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draft_fields as fields
from ..functions import text
from .catalog import query, table

PLANTED = {
    " th": " Lishi: HU100 v2 th", " qu": " the owners manual qu", " nicht ": " decode the door lock nicht ", " rely ": " dealer VIN rely ", " de ": " no cloning de ", " pour ": " Chip: Philips 46 Reusable pour ", " reedes ": " Code Series: A1-9 reedes ",
    " und ": " AccuReade: 5AB, und ", " anea ": " AUTEL? anea ", " en ": " security gateway risk en ", " di": " Determinator: 7 KA Lishi di", " onre ": " Cobra: none onre ", " than ": " airbag MVP than ", " erin ": " ST # F C C 315 M Hz 12 - 34 erin ", " ntre ": " No codes strattec trunk ntre ",
    " eriner ": " METHOD #1 Check the owner-manual. Method 2 : pull the handle & read the code, 7 Method # 3 impression all locks TRANSPONDER x eriner ", " ou ": " Method 1 lock Reader/Decoder in door lock for complete key ou ", " la ": " method 4 remove GLOVE BOX decoder 12 34 la ",
}


def planted_sql(column: str) -> str:
    for a, b in PLANTED.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


def repaired_sql(column: str) -> str:
    quoted = lambda s: s.replace("'", "''")
    for a, b in fields.OCR_REPAIRS.items():
        column = f"replace({column}, '{quoted(a)}', '{quoted(b)}')"
    for _ in range(2):  # neighbours share a number
        column = f"regexp_replace({column}, '([0-9])\\s*-\\s*([0-9]{{2,4}})', '\\1-\\2', 'g')"
    for a, b in fields.OCR_PATTERNS[1:]:
        column = f"regexp_replace({column}, '{a}', '{b}', 'g')"
    for a, b in fields.NOTE_REPAIRS.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


def case_sql(alternatives, low: str = "low") -> str:
    return " OR ".join("(" + " AND ".join(f"contains({low}, '{w}')" for w in words) + ")" for words in alternatives) or "true"


def advice_sql(rows, said: int = 0) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {case_sql(r[-1])} THEN '" + r[said].replace("'", "''") + "' END" for r in rows) + ")"


TEXT = f"SELECT doc_id, t, lower(t) AS low FROM (SELECT doc_id, {repaired_sql(planted_sql("coalesce(text, '')"))} AS t FROM documents)"
_CODES = "CASE " + " ".join(f"WHEN {case_sql(when)} THEN '{said}'" for said, when in fields.CODES) + " END"
_PATH = advice_sql(fields.PROGRAMMING_PATH)


@query(f"""WITH d AS ({TEXT}) SELECT doc_id, CASE WHEN {advice_sql(fields.METHODS)} = '' THEN '{fields.NO_METHOD}' ELSE {advice_sql(fields.METHODS)} END AS methods,
{advice_sql(fields.FIELD_NOTES)} AS field_notes, {advice_sql(fields.GUIDE)} AS guide, {advice_sql(fields.TROUBLE)} AS trouble, {advice_sql(fields.WARNINGS)} AS warnings, {_PATH} AS path, {_CODES} AS codes FROM d""")
def draft_advice(spark, d):
    """Advice of every kind that the words of a document call for."""
    docs = _repaired(spark, d)
    codes = F.lit("")
    for said, when in reversed(fields.CODES):
        codes = F.when(fields._called_for(F.lower("t"), when), F.lit(said)).otherwise(codes)
    joined = lambda rows: F.array_join(fields.advice("t", rows), "|")
    methods = joined(fields.METHODS)
    return docs.select(
        "doc_id",
        F.when(methods == "", F.lit(fields.NO_METHOD)).otherwise(methods).alias("methods"),
        joined(fields.FIELD_NOTES).alias("field_notes"),
        joined(fields.GUIDE).alias("guide"),
        joined(fields.TROUBLE).alias("trouble"),
        joined(fields.WARNINGS).alias("warnings"),
        joined(fields.PROGRAMMING_PATH).alias("path"),
        codes.alias("codes"),
    )


def _repaired(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.replace_all(F.coalesce("text", F.lit("")), PLANTED).alias("t"))
    return text.worked_out(docs.select("doc_id", "t"), {"t": fields.repaired("t")})


def short_sql(x: str, longest: int) -> str:
    value = f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^[ \\-,:;.]+|[ \\-,:;.]+$', '', 'g')"
    return f"CASE WHEN length({value}) <= {longest} AND NOT regexp_matches({value}, '{fields.BAD_TEXT}') AND regexp_matches({value}, '^[A-Za-z0-9 /#().-]+$') THEN {value} ELSE '' END"


def _reference_sql(x: str) -> str:
    return f"(SELECT CASE WHEN regexp_matches(v, '[0-9]|[A-Z]{{2,}}') AND NOT regexp_matches(v, '(?i)^(?:n/?a|nia|none)\\b') THEN v ELSE '' END FROM (SELECT {short_sql(x, 18)} AS v))"


_DECODERS = [("Lishi", fields.LISHI), ("Determinator", "(?i)\\bDeterminator[:\\s]+([A-Z0-9 ]+?)(?:\\s+Lishi|\\s+AccuReader|\\s+EEZ|\\s+Cobra|$)"), *[(r, f"(?i){r}[:#\\s]+([A-Z0-9 /.-]{{1,24}})") for r in fields.READERS]]


def _decoders_sql() -> str:
    first = [(t, f"regexp_extract(t, '{p}', 1)") for t, p in _DECODERS]
    read = [(t, x if t in ("Lishi", "Determinator") else short_sql(x, 24)) for t, x in first]
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_reference_sql(x)} <> '' THEN '{t}=' || {_reference_sql(x)} END" for t, x in read) + ")"


@query(f"""WITH d AS ({TEXT}) SELECT doc_id, {_decoders_sql()} AS decoders,
concat_ws('|', {", ".join(f"CASE WHEN contains(low, '{t.lower()}') THEN '{t}' END" for t in fields.PROGRAMMERS)}) AS tools, CASE WHEN contains(t, '?') THEN 'Check support' ELSE 'Mentioned' END AS status,
(SELECT CASE WHEN length(v) >= 3 AND regexp_matches(v, '[0-9]') THEN v ELSE '' END FROM (SELECT {short_sql("regexp_extract(t, '(?i)Code Series[:\\s]+([A-Z0-9-]+)', 1)", 40)} AS v)) AS code_series,
(SELECT CASE WHEN regexp_matches(v, '{fields.CHIP_WORDS}') THEN v ELSE '' END FROM (SELECT {short_sql("regexp_extract(t, '(?i)Chip[:\\s]+([A-Za-z0-9 /-]{2,42})', 1)", 48)} AS v)) AS chip FROM d""")
def draft_tables(spark, d):
    """Decoders with their references, programmers with their status, code series and chip of every document."""
    docs = _repaired(spark, d)
    found = text.worked_out(docs, {"rows": fields.decoders("t"), "named": fields.programmer_tools("t")})
    return found.select(
        "doc_id",
        F.array_join(F.transform("rows", lambda r: F.concat(r["tool"], F.lit("="), r["reference"])), "|").alias("decoders"),
        F.array_join(F.transform("named", lambda r: r["name"]), "|").alias("tools"),
        F.coalesce(F.get("named", 0)["status"], F.when(F.contains("t", F.lit("?")), "Check support").otherwise("Mentioned")).alias("status"),
        fields.code_series("t").alias("code_series"),
        fields.chip_reference(F.regexp_extract("t", "(?i)Chip[:\\s]+([A-Za-z0-9 /-]{2,42})", 1)).alias("chip"),
    )


def _methods_sql() -> str:
    strip = lambda x, signs: f"regexp_replace({x}, '^[{signs}]+|[{signs}]+$', '', 'g')"
    body = strip(f"regexp_replace({strip('raw', ' \\-=|')}, '{fields.METHOD_END}', '')", " .\\-=|")
    for a, b in fields.METHOD_REPAIRS:
        if a.endswith("Bo)\\b.*$"):  # word bounds of this dialect know ASCII alone
            a, b = "(?i)(^|[^\\p{L}\\p{N}_])(?:GERER+|Tyee|Bo)(?:[^\\p{L}\\p{N}_].*)?$", "\\1"
        body = f"regexp_replace({body}, '{a}', '{b}', 'g')"
    one = f"regexp_replace(trim(regexp_replace({strip(f'trim({body})', ' .,:;\\-')}, '\\s+', ' ', 'g')), '{fields.BODY_REPAIRS[0][0]}', '', 'g')"
    two = "CASE WHEN regexp_matches(b1, '(?i)\\b[A-Z]{1,4}-[0-9]+$') THEN b1 ELSE regexp_replace(b1, ',?\\s*[0-9]+$', '') END"
    for a, b in fields.BODY_REPAIRS[1:]:
        two = f"regexp_replace({two}, '{a}', '{b}', 'g')"
    worded = "CASE " + " ".join(
        f"WHEN n = '{n}' AND {' AND '.join('(' + ' OR '.join(f'contains(up, {chr(39)}{w}{chr(39)})' for w in words) + ')' for words in groups)} THEN '{said.replace(chr(39), chr(39) * 2)}'" for n, groups, said in fields.WORDINGS
    ) + " ELSE b2 END"
    bad = " OR ".join(f"regexp_matches(flat, '{p}')" for p in fields.UNPUBLISHABLE)
    settled = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS n, 0 AS place, '{said}' AS body FROM f WHERE regexp_matches(flat, '{p}')" for n, p, said in fields.SETTLED)
    words = fields.METHOD_WORDS.replace("'", "''")
    heads = "(?i)\\bMethod\\s*#?\\s*[0-9]+"
    return f"""
WITH d AS ({TEXT}), f AS (SELECT doc_id, regexp_replace(t, '\\s+', ' ', 'g') AS flat FROM d),
s AS ({settled}),
p AS (SELECT doc_id, unnest(regexp_extract_all(flat, '{heads}')) AS head, unnest(string_split_regex(flat, '{heads}')[2:]) AS raw, unnest(range(1, len(regexp_extract_all(flat, '{heads}')) + 1)) AS place FROM f),
b1 AS (SELECT doc_id, place, regexp_extract(head, '[0-9]+$') AS n, {one} AS b1 FROM p WHERE raw <> ''),
b2 AS (SELECT doc_id, place, n, {strip(two, ' .,:;\\-')} AS b2 FROM b1),
w AS (SELECT doc_id, place, n, {worded} AS body FROM (SELECT *, replace(upper(b2), '-', ' ') AS up FROM b2)),
c AS (SELECT doc_id, n, place, body FROM (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM w) WHERE length(body) >= 12 AND regexp_matches(body, '{words}') AND flat <> '' AND NOT ({bad})
  AND len(regexp_extract_all(flat, '[|_=>]')) < 4 AND NOT (length(flat) > 140 AND regexp_matches(flat, '[|_=>]{{2,}}')) AND NOT regexp_matches(flat, '^[\\W_]+$') AND (doc_id, n) NOT IN (SELECT (doc_id, n) FROM s)
  QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY place) = 1),
m AS (SELECT doc_id, 'Method ' || n || ': ' || body || '.' AS said, place, n FROM (SELECT * FROM s UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, n) <= {fields.MOST_NUMBERED})
SELECT d.doc_id, coalesce(string_agg(m.said, '|' ORDER BY m.place, m.n), '') AS methods FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


@query(_methods_sql())
def numbered_methods(spark, d):
    """Numbered methods of every document, in settled words where they have any."""
    return _repaired(spark, d).select("doc_id", F.array_join(fields.numbered_methods("t"), "|").alias("methods"))
