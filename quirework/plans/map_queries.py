"""Queries of lock maps and of the best of several reads, with oracle SQL.

Cells of the maps are the signs and sizes of embedding values, so that verified maps contradict most of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lock_maps, text
from ..operators import gates
from .catalog import _quality_sql, query, table

LABELS = ("Ignition", "Doors", "Trunk / hatch", "Spare tire", "Glove box")
CODES = ("AV-3", "GM-P10", "AV-8", "XY-1")

#: Stated by hand: what rows of the verified maps of ten columns hold, by code and label.
_VERIFIED_SQL = """CASE WHEN code = 'AV-3' AND label IN ('Ignition', 'Doors') THEN 'filled,filled,filled,filled,filled,filled,filled,filled,filled,filled' WHEN code = 'AV-3' AND label = 'Glove box' THEN ',filled,,filled,,filled,,filled,,filled'
WHEN code = 'GM-P10' AND label = 'Ignition' THEN ',,,,,,,,,' WHEN code = 'GM-P10' AND label IN ('Doors', 'Trunk / hatch') THEN ',,,,filled,filled,filled,filled,filled,filled' WHEN code = 'GM-P10' AND label = 'Spare tire' THEN ',,,,,filled,filled,filled,filled,filled'
WHEN code = 'GM-P10' AND label = 'Glove box' THEN ',,,,,,filled,filled,filled,filled' END"""
_CODE_SQL = "CASE WHEN embedding[61] >= 0 AND embedding[62] >= 0 THEN 'AV-3' WHEN embedding[61] >= 0 THEN 'GM-P10' WHEN embedding[62] >= 0 THEN 'AV-8' ELSE 'XY-1' END"


@query(f"""WITH e AS (SELECT vec_id, embedding, {_CODE_SQL} AS code, embedding[63] >= 0 AS named FROM embeddings),
r AS (SELECT vec_id, embedding, code, named, k, (['Ignition', 'Doors', 'Trunk / hatch', 'Spare tire', 'Glove box'])[k + 1] AS label FROM e, range(0, 5) t(k)),
c AS (SELECT vec_id, code, named, k, label, array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN embedding[k * 10 + i] >= 0.1 THEN 'filled' ELSE '' END), ',') AS cells FROM r)
SELECT vec_id, CAST(k AS INTEGER) AS row_no, label, coalesce(CASE WHEN named THEN {_VERIFIED_SQL} END, cells) AS cells FROM c""")
def verified_lock_maps(spark, d):
    """Maps whose cells contradict the verified ones of their code, row by row after enforcement."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", i) >= 0
    code = F.when(at(61) & at(62), CODES[0]).when(at(61), CODES[1]).when(at(62), CODES[2]).otherwise(CODES[3])
    mark = lambda v: F.when(v >= 0.1, "filled").otherwise("")
    rows = F.array(*[F.concat(F.array(F.lit(label)), F.transform(F.slice("embedding", 10 * k + 1, 10), mark)) for k, label in enumerate(LABELS)])
    columns = F.array(*[F.lit(f" {i}") for i in range(1, 11)])
    panel = F.struct(F.lit("Lock positions").alias("label"), columns.alias("columns"), rows.alias("rows"), F.lit("").alias("note"))
    title = F.when(at(63), F.lit("HU92 lock-position guide")).otherwise(F.lit("key blade"))
    diagrams = F.array(F.struct(title.alias("title"), F.lit("making_key").alias("placement"), F.lit("").alias("caption"), F.array(panel).alias("panels")))
    held = text.worked_out(e.select("vec_id", "embedding"), {"diagrams": diagrams.cast(lock_maps.DIAGRAMS), "code": code})
    done = held.select("vec_id", lock_maps.enforce("diagrams", "code", F.lit("HU92")).alias("diagrams"))
    out = done.select("vec_id", F.posexplode(F.col("diagrams")[0]["panels"][0]["rows"]).alias("row_no", "row"))
    return out.select("vec_id", "row_no", F.get("row", 0).alias("label"), F.array_join(F.slice("row", 2, 10), ",").alias("cells"))


_FORMS_SQL = "SELECT doc_id, 6 AS pass, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id, 4, replace(replace(coalesce(text, ''), 'e', 'é'), 'th', 't[h') FROM documents UNION ALL SELECT doc_id, 11, replace(coalesce(text, ''), ' an', ' PIN key ') FROM documents"


@query(f"""WITH f AS ({_FORMS_SQL}), p AS (SELECT doc_id, pass, t, {_quality_sql('t')} AS points FROM f)
SELECT doc_id, arg_max(pass, (points, CASE pass WHEN 6 THEN 3 WHEN 4 THEN 2 ELSE 1 END)) AS pass, max(points) AS points FROM p GROUP BY doc_id""")
def best_of_reads(spark, d):
    """Each document in three forms, as three passes would read it: the one of the best quality, of equal ones the first pass."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    forms = [(6, F.col("t")), (4, F.replace(F.replace("t", F.lit("e"), F.lit("é")), F.lit("th"), F.lit("t[h"))), (11, F.replace("t", F.lit(" an"), F.lit(" PIN key ")))]
    reads = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("pass"), F.lit(i).alias("place"), t.alias("t")) for i, (n, t) in enumerate(forms)])).alias("r"))
    best = gates.best_read(reads.select("doc_id", "r.*"), ["doc_id"], "t", "place")
    return best.select("doc_id", "pass", "points")
