"""Queries of known models and headings over every document, with oracle SQL.

Documents name no vehicles, so year ranges and makes are put beside their own words, by literal
replacements that both engines do; the vocabulary is of their words too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vehicles
from . import candidates
from .catalog import query, table

VOCABULARY = {"En": ["thor", "than the", "th-on", "th0n", "thing", "on"], "Fr": ["que les", "que", "le", "qu1"], "De": ["nicht", "ni", "und d1e"], "Es": ["que la", "que", "un"]}
PLANTED = {" th": " 1998-04 th", " qu": " 2003-2008 qu", " ni": " 2001 – 05 ni", " le ": " 1999-02 le (Fr) ", " on ": " 2004-06 on (en) ", " un ": " 95 1995-99 un (ES) ", " que 1": " que (Chevy) 1", " und ": " 2010-123 und "}


def planted_sql(column: str) -> str:
    for a, b in PLANTED.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


def scanned_sql(column: str) -> str:
    out = f"trim(regexp_replace(translate({column}, '{vehicles.LOOK_ALIKE[0]}', '{vehicles.LOOK_ALIKE[1]}'), '\\s+', ' ', 'g'))"
    for a, b in vehicles.SCAN_REPAIRS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def make_name_sql(x: str) -> str:
    """The aliases by title case, the parts of a hyphened name apart."""
    clean = f"trim(regexp_replace({x}, '[^A-Za-z -]+', '', 'g'))"
    title = f"list_aggregate(list_transform(string_split({clean}, '-'), lambda p: list_aggregate(list_transform(string_split(p, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), 'string_agg', ' ')), 'string_agg', '-')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vehicles.MAKE_ALIASES.items())
    return f"CASE {title} {cases} ELSE {title} END"


#: Stated by hand: each model with what stands for it in a text.
MODELS_SQL = """('En', 'thor', 'thor'), ('En', 'than the', 'than\\s*the'), ('En', 'th-on', 'th[-\\s]?on'), ('En', 'th0n', 'th[0o]n'), ('En', 'thing', 'thing'), ('En', 'on', 'on'), ('Fr', 'que les', 'que\\s*les'), ('Fr', 'que', 'que'), ('Fr', 'le', 'le'), ('Fr', 'qu1', 'qu[1i]'),
('De', 'nicht', 'nicht'), ('De', 'ni', 'ni'), ('De', 'und d1e', 'und\\s*d[1i]e'), ('Es', 'que la', 'que\\s*la'), ('Es', 'que', 'que'), ('Es', 'un', 'un')"""


@query(f"""
WITH d AS (SELECT doc_id, upper(left(lang, 1)) || substring(lang, 2) AS lang, {scanned_sql(planted_sql("coalesce(text, '')"))} AS t FROM documents),
c AS (SELECT doc_id, lang, unnest(range(1, length(t) + 1)) AS i, t FROM d),
y AS (SELECT doc_id, i AS s, i + length(years) AS e, years FROM (SELECT doc_id, i, regexp_extract(substring(t, i, 20), '^(?:19|20)[0-9]{{2}}\\s*[-–]\\s*[0-9]{{2,4}}') AS years FROM c WHERE substring(t, i, 2) IN ('19', '20')) WHERE years <> ''),
v(make, model, pattern) AS (VALUES {MODELS_SQL}),
o AS (SELECT doc_id, make, model, s, s + length(hit) AS e, t FROM (SELECT c.doc_id, v.make, v.model, c.i AS s, regexp_extract(substring(c.t, c.i, 60), '(?i)^(' || v.pattern || ')(?:[\\s(|,]|$)', 1) AS hit, c.t FROM c JOIN v ON v.make = c.lang AND lower(left(v.model, 1)) = lower(substring(c.t, c.i, 1))) WHERE hit <> ''),
p AS (SELECT y.doc_id, o.make, o.model, y.s, y.years, min(o.s) AS place FROM y JOIN o ON o.doc_id = y.doc_id AND o.s BETWEEN y.e AND y.e + 20 GROUP BY ALL),
f AS (SELECT doc_id, make, model, place, arg_min(years, s) AS years FROM p GROUP BY ALL),
n AS (SELECT f.*, {make_name_sql("regexp_extract(substring(o.t, o.e, 30), '\\(([A-Za-z][A-Za-z -]{1,24})\\)', 1)")} AS named FROM f JOIN o ON o.doc_id = f.doc_id AND o.make = f.make AND o.model = f.model AND o.s = f.place),
k AS (SELECT doc_id, make, model, CAST(left(years, 4) AS INTEGER) AS a, regexp_extract(years, '[0-9]+$') AS z FROM n WHERE CASE WHEN named <> '' THEN named = make ELSE length(regexp_replace(model, '[^A-Za-z0-9]', '', 'g')) > 2 END),
r AS (SELECT *, CAST(CASE WHEN length(z) = 4 THEN z ELSE left(CAST(a AS VARCHAR), 2) || left(z, 2) END AS INTEGER) AS b FROM k)
SELECT doc_id, make, model, a AS year_from, CASE WHEN length(z) = 2 AND b < a THEN b + 100 ELSE b END AS year_to, count(*) AS n FROM r
WHERE a BETWEEN 1900 AND 2035 AND CASE length(z) WHEN 2 THEN CASE WHEN b < a THEN b + 100 ELSE b END <= 2035 AND CASE WHEN b < a THEN b + 100 ELSE b END - a <= 50 WHEN 3 THEN b >= a AND b <= least(2035, a + 50) ELSE b <= 2035 END GROUP BY ALL""")
def known_models(spark, d):
    """Known models beside year ranges in whole documents, by one automaton over the vocabulary."""
    docs = table(spark, d, "documents").select("doc_id", text.replace_all(F.coalesce("text", F.lit("")), PLANTED).alias("raw_text"), F.initcap("lang").alias("default_make"))
    found = candidates.canonical_applications(docs, VOCABULARY, head=None)
    return found.groupBy("doc_id", "make", "model", "year_from", "year_to").agg(F.count("*").alias("n"))


#: A line's first words as a heading, with makes and debris by the line's own letters.
HEADINGS = {"th": " (Chevy) fob", "qu": " xvw) 12", "er": " A4 S4 Audi", "de": " (land rover) Savanna", "un": " (Benz) GoIf / GTI more", "an": " 1998-04 prox Town Ca", "on": " cc", "in": " codes"}
HEADING_SQL = "left(raw, 30) || CASE " + " ".join(f"WHEN contains(left(raw, 12), '{w}') THEN '{tail}'" for w, tail in HEADINGS.items()) + " ELSE '' END"


def headings_sql() -> str:
    """Cleaned headings, their makes and models, and whether the model is bad."""
    body = "regexp_replace(regexp_replace(line, '\\b(?:19|20)[0-9]{2}\\s*[-–]\\s*[0-9]{2,4}\\b', ' ', 'g'), '" + vehicles.HEADING_WORDS + "', ' ', 'g')"
    clean = f"regexp_replace(regexp_replace({body}, '[^A-Za-z0-9() /&.-]+', ' ', 'g'), '\\s+', ' ', 'g')"
    strip = lambda x, signs: f"regexp_replace({x}, '^[{signs}]+|[{signs}]+$', '', 'g')"
    fixed = "h"
    for a, b in vehicles.PAREN_REPAIRS.items():
        fixed = f"replace({fixed}, '{a}', '{b}')"
    bare = f"regexp_replace(regexp_replace(f, '{vehicles.PAREN_MAKE}', '', 'g'), '(?i)\\b(?:{'|'.join(vehicles.NAMED_IN_MODELS)})\\b', '', 'g')"
    model = strip(f"regexp_replace({bare}, '\\s+', ' ', 'g')", " /,-")
    for a, b in vehicles.MODEL_REPAIRS.items():
        model = f"replace({model}, '{a}', '{b}')"
    for a, b in vehicles.MODEL_PATTERNS:
        model = f"regexp_replace({model}, '{a}', '{b}', 'g')"
    model = strip(f"regexp_replace({model}, '(?i)^cc$', 'CC')", " /()-")
    known = ", ".join(f"'{m}'" for m in vehicles.KNOWN_MAKES)
    overrides = " ".join(f"WHEN '{m}' THEN '{k}'" for m, k in vehicles.MODEL_MAKES.items())
    bad = " OR ".join(f"contains(lower(model), '{t}')" for t in vehicles.BAD_MODEL)
    named = make_name_sql(f"regexp_extract(f, '{vehicles.PAREN_MAKE}', 1)")
    return f"""
WITH l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
a AS (SELECT doc_id, line_no, lang, {HEADING_SQL} AS line FROM l),
b AS (SELECT doc_id, line_no, trim(left({strip(clean, " /,-")}, 80)) AS h FROM a),
c AS (SELECT doc_id, line_no, h, {fixed} AS f FROM b),
e AS (SELECT doc_id, line_no, {named} AS named, {model} AS model FROM c)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE model {overrides} ELSE CASE WHEN named IN ({known}) THEN named ELSE 'Ford' END END AS make, model,
  (length(model) NOT BETWEEN 2 AND 45 OR length(regexp_replace(model, '[^A-Za-z]', '', 'g')) < 2 OR regexp_matches(model, '^[PpOoXx0-9 /.-]+$') OR {bad}) AS bad FROM e"""


@query(headings_sql())
def heading_models(spark, d):
    """Every line of every document as a heading: make, model, whether the model is bad."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    tail = F.lit("")
    for w, added in reversed(HEADINGS.items()):
        tail = F.when(F.contains(F.substring("raw", 1, 12), F.lit(w)), F.lit(added)).otherwise(tail)
    lines = lines.withColumn("heading", vehicles.model_text(F.concat(F.substring("raw", 1, 30), tail))).withColumn("ford", F.lit("Ford"))
    found = vehicles.split_heading(lines, "heading", "ford")
    return found.select("doc_id", "line_no", "make", "model", vehicles.bad_model("model").alias("bad"))
