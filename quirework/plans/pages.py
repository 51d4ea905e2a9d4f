"""Queries of full-text search over every document, with oracle SQL.

The SQL finds occurrences, covers and fragments by joins over word positions; its phrases and
alternatives are stated by hand, so the reader of queries is held against it too.
"""

from __future__ import annotations

from ..operators import fulltext
from .catalog import query, table

LETTERS = "\\p{L}\\p{N}\\p{M}"


def stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{e}') AND length({word}) > {len(e) + 2} THEN left({word}, length({word}) - {len(e)})" for e in fulltext.ENDINGS)
    stops = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
    return f"CASE WHEN {word} IN ({stops}) THEN '' {cases} ELSE {word} END"


def fulltext_sql(phrases: list[list[tuple[str, int]]], alternatives: list[tuple[list[int], list[int]]], tail: str, fold: str = "strip_accents(replace({0}, 'ß', 'ss'))") -> str:
    """Matching documents with their covers: ``phrases`` are (stem, words after the first), ``alternatives`` (wanted, unwanted) phrases."""
    stems = ", ".join(f"'{s}'" for s in sorted({s for p in phrases for s, _ in p}))
    occurrences = []
    for k, p in enumerate(phrases):
        joins = " ".join(f"JOIN e e{j} ON e{j}.doc_id = e0.doc_id AND e{j}.pos = e0.pos + {step} AND e{j}.lexeme = '{s}'" for j, (s, step) in enumerate(p) if j)
        occurrences.append(f"SELECT e0.doc_id, {k} AS phrase, e0.pos AS s, e0.pos + {p[-1][1]} AS t FROM e e0 {joins} WHERE e0.lexeme = '{p[0][0]}'")
    has = lambda k: f"EXISTS (SELECT 1 FROM o WHERE o.doc_id = x.doc_id AND o.phrase = {k})"
    open_ = [" AND ".join(["true", *(f"NOT {has(k)}" for k in no)]) for _, no in alternatives]
    holds = " OR ".join("(" + " AND ".join([o, *map(has, yes)]) + ")" for o, (yes, _) in zip(open_, alternatives))
    reach = " UNION ALL ".join(
        f"SELECT z.doc_id, z.q, min(z.s) AS b FROM z JOIN m ON m.doc_id = z.doc_id WHERE m.open{i} AND z.phrase IN ({', '.join(map(str, yes))}) GROUP BY z.doc_id, z.q HAVING count(*) = {len(yes)}"
        for i, (yes, _) in enumerate(alternatives)
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+[^{LETTERS}]*') AS tok FROM documents),
x AS (SELECT doc_id, tok, list_transform(tok, lambda t: regexp_extract(t, '^[{LETTERS}]+')) AS word FROM w),
p AS (SELECT doc_id, pos, {stem_sql('low')} AS lexeme, length(raw) > 3 AS long FROM (SELECT doc_id, generate_subscripts(word, 1) - 1 AS pos, unnest(word) AS raw, {fold.format('lower(raw)')} AS low FROM x)),
e AS (SELECT doc_id, pos, lexeme FROM p WHERE lexeme IN ({stems})),
o AS ({' UNION ALL '.join(occurrences)}),
m AS (SELECT doc_id, tok, word, {', '.join(f'{t} AS open{i}' for i, t in enumerate(open_))} FROM x WHERE {holds}),
z AS (SELECT e.doc_id, e.pos AS q, o.phrase, max(o.s) AS s FROM e JOIN o ON o.doc_id = e.doc_id AND o.t <= e.pos GROUP BY ALL),
r AS (SELECT doc_id, q, max(b) AS b FROM ({reach}) GROUP BY doc_id, q),
c AS (SELECT doc_id, b, min(q) AS q FROM r GROUP BY doc_id, b),
n AS (SELECT c.doc_id, c.b, c.q, count(*) AS n FROM c JOIN e ON e.doc_id = c.doc_id AND e.pos BETWEEN c.b AND c.q GROUP BY ALL),
k AS (SELECT m.doc_id, coalesce(round(sum(0.1 / (2 + n.q - n.b - n.n)), 6), 0) AS rank FROM m LEFT JOIN n ON n.doc_id = m.doc_id GROUP BY m.doc_id)
{tail}"""


RANKS = "SELECT doc_id, CAST(rank AS DOUBLE) AS rank FROM k"
#: The best fragment of each document that has a cover, and its words.
HEADLINES = """, h AS (SELECT c.doc_id, c.b, c.q, least(c.b + 34, len(m.word) - 1) AS reach, least(c.b + 11, least(c.b + 34, len(m.word) - 1)) AS least FROM c JOIN m ON m.doc_id = c.doc_id),
g AS (SELECT p.doc_id, p.pos FROM p JOIN m ON m.doc_id = p.doc_id WHERE p.long OR (p.doc_id, p.pos) IN (SELECT (doc_id, pos) FROM e)),
t AS (SELECT h.doc_id, h.b, h.q, CASE WHEN h.q - h.b + 1 >= 35 THEN coalesce(max(g.pos) FILTER (g.pos BETWEEN h.least AND h.reach), h.least)
  ELSE coalesce(min(g.pos) FILTER (g.pos >= greatest(h.q, h.least)), h.reach) END AS last FROM h LEFT JOIN g ON g.doc_id = h.doc_id AND g.pos BETWEEN h.b AND h.reach GROUP BY h.doc_id, h.b, h.q, h.least, h.reach),
f AS (SELECT doc_id, q, last, CASE WHEN last - b + 1 < 12 THEN greatest(0, last - 11) ELSE b END AS first FROM t),
j AS (SELECT f.doc_id, f.first, f.last, (f.last >= f.q) AS whole, (SELECT count(*) FROM e WHERE e.doc_id = f.doc_id AND e.pos BETWEEN f.first AND f.last) AS words, (f.doc_id, f.last) IN (SELECT (doc_id, pos) FROM g) AS good FROM f),
i AS (SELECT doc_id, first, last FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, words DESC, good DESC, first, last DESC) = 1),
s AS (SELECT i.doc_id, p.pos, CASE WHEN e.pos IS NOT NULL THEN '<b>' || m.word[p.pos + 1] || '</b>' ELSE m.word[p.pos + 1] END || CASE WHEN p.pos < i.last THEN substring(m.tok[p.pos + 1], length(m.word[p.pos + 1]) + 1) ELSE '' END AS shown
  FROM i JOIN m ON m.doc_id = i.doc_id JOIN p ON p.doc_id = i.doc_id AND p.pos BETWEEN i.first AND i.last LEFT JOIN e ON e.doc_id = p.doc_id AND e.pos = p.pos)
"""
SHOWN = HEADLINES + "SELECT s.doc_id, CAST(k.rank AS DOUBLE) AS rank, string_agg(s.shown, '' ORDER BY s.pos) AS headline FROM s JOIN k ON k.doc_id = s.doc_id GROUP BY s.doc_id, k.rank"


def ranked(spark, d, text: str, **options):
    return fulltext.full_text(table(spark, d, "documents").select("doc_id", "text"), "text", text, **options).drop("text")


@query(fulltext_sql([[("tion", 0)], [("worthles", 0)]], [([0], [1])], SHOWN))
def fulltext_search(spark, d):
    """Two words, one of them unwanted: rank by covers and the best fragment."""
    return ranked(spark, d, "tion the -worthless")


@query(fulltext_sql([[("anea", 0), ("eriner", 1)], [("erin", 0), ("ntreou", 2)], [("thth", 0)], [("thti", 0)], [("nd", 0), ("theaeati", 1)], [("pour", 0)]], [([0], []), ([1, 2], [3]), ([5], [4])], RANKS))
def fulltext_alternatives(spark, d):
    """Alternatives of phrases (one across a stop word), words, an unwanted word and an unwanted phrase."""
    return ranked(spark, d, '"anea eriner" or "erin at ntreou" thth -thti OR pour -"nd theaeati"', headline=False)


@query(fulltext_sql([[("ntre", 0)], [("erin", 0)], [("tion", 0)]], [([0, 1], []), ([1, 2], [])], SHOWN))
def fulltext_headlines(spark, d):
    """Covers of two words that may stand far apart: the fragment cuts or lengthens them."""
    return ranked(spark, d, "ntre erin or erin tion")


@query(fulltext_sql([[("fur", 0)], [("cion", 0)], [("nicht", 0)]], [([0, 2], []), ([1], [])], RANKS))
def fulltext_accents(spark, d):
    """Accents folded in texts and in the query."""
    return ranked(spark, d, "für nicht or ción", fold_query=True, headline=False)


@query(fulltext_sql([[("für", 0)], [("nicht", 0)]], [([0], []), ([1], [])], RANKS))
def fulltext_unfolded_query(spark, d):
    """The text is folded and the query is not: its accented word finds nothing."""
    return ranked(spark, d, "für or nicht", headline=False)


@query(fulltext_sql([[("erin", 0)], [("tion", 0)]], [([0, 1], [])], HEADLINES + """, best AS (SELECT doc_id, rank FROM k ORDER BY rank DESC, doc_id LIMIT 10)
SELECT best.doc_id, CAST(best.rank AS DOUBLE) AS rank, string_agg(s.shown, '' ORDER BY s.pos) AS headline FROM best JOIN s ON s.doc_id = best.doc_id GROUP BY best.doc_id, best.rank"""))
def search_best_pages(spark, d):
    """The ten best documents with their headlines."""
    return fulltext.search_pages(table(spark, d, "documents").select("doc_id", "text"), "text", "erin tion", ["doc_id"]).drop("text")
