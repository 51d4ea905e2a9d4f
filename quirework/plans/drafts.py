"""From sections to published records: draft, gate, status, publication, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draft_fields, facts, records
from ..functions.text import worked_out
from ..operators import completeness, gates, relational

MAX_SPAN = 12
#: Patterns that no published string may hold.
BAD = draft_fields.UNPUBLISHABLE
WAITING = "awaiting verification"


def safe_span(start: Column | str, end: Column | str, longest: int = MAX_SPAN) -> Column:
    """The pages are known, in order, and few."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)) for x in (start, end))
    return (a > 0) & (b >= a) & (b - a + 1 <= longest)


def eligible(secs: DataFrame, least: float, codes: DataFrame | None = None) -> DataFrame:
    """Sections sure enough, of a safe span, of the wanted codes if given."""
    out = secs.filter((F.col("confidence") >= least) & safe_span("page_start", "page_end"))
    return out if codes is None else out.join(codes.select("code").distinct(), "code", "left_semi")


def priority(problem: Column) -> list[Column]:
    """Order of work: codes without earlier problems, surer links, shorter spans, code."""
    return [problem.cast("int"), F.desc("link_confidence"), F.col("page_end") - F.col("page_start"), F.col("code"), F.col("page_start")]


def link_confidence(secs: DataFrame, applications: DataFrame) -> DataFrame:
    """``secs`` with the best confidence of the code's applications, 0 without any."""
    best = applications.groupBy(F.col("system_code").alias("_code")).agg(F.max("confidence").alias("_best"))
    return secs.join(best, secs["code"] == best["_code"], "left").withColumn("link_confidence", F.coalesce("_best", F.lit(0.0))).drop("_code", "_best")


def repeated_codes(secs: DataFrame) -> DataFrame:
    return secs.filter("code <> ''").groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")


def draft(secs: DataFrame, applications: DataFrame) -> DataFrame:
    """The structured record of each section: its applications and what its repaired text gives.

    The repaired text and its tables are worked out once; every string goes through the public
    filter, and what is empty goes.
    """
    apps = applications.groupBy(F.col("system_code").alias("_code")).agg(F.array_sort(F.collect_set(F.struct("make", "model", "year_from", "year_to"))).alias("vehicle_applications"))
    joined = secs.join(apps, secs["code"] == apps["_code"], "left").drop("_code")
    # The join leaves all sections of a code in one task, and a draft costs far more than its shuffle:
    # sections are dealt out evenly, in as many parts as were asked for, however few their bytes are.
    joined = joined.repartition(int(secs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = worked_out(joined, {"_text": draft_fields.repaired("raw_text")})
    joined = worked_out(joined, {"_low": F.lower("_text"), "_values": facts.spacing_values("_text")})
    own = F.coalesce("vehicle_applications", F.array().cast("array<struct<make:string,model:string,year_from:int,year_to:int>>"))
    run = relational.monotone_run(F.col("_values"), 8)
    spacing = F.map_from_entries(F.transform(run, lambda v, i: F.struct((i + 1).cast("string"), F.concat(F.lit("."), F.lpad(v.cast("string"), 3, "0")))))
    tables = {"_apps": own, "_options": draft_fields.remote_options("_text"), "_decoders": draft_fields.decoders("_text", F.col("_low")), "_spacing": spacing}
    joined = worked_out(joined, tables)
    parts = worked_out(joined, {"_record": draft_fields.record("_text", "_low", facts.labelled("_text"), F.col("_options"), F.col("_decoders"), F.col("_spacing"))})
    fields = parts.schema["_record"].dataType.names
    record = F.struct(
        facts.system_code("code").alias("code"),
        facts.title(F.col("code"), F.col("_apps")).alias("title"),
        facts.system_type("_text").alias("system_type"),
        F.col("_apps").alias("vehicle_applications"),
        *[F.col("_record")[f].alias(f) for f in fields],
    )
    out = parts.withColumn("draft", record).drop("_text", "_low", "_values", *tables, "_record")
    return out.withColumn("draft", records.prune(F.col("draft"), out.schema["draft"].dataType, draft_fields.public_value))


def completeness_rules(text: str = "raw_text") -> list[tuple[Column, Column, str]]:
    """What a source states and its record must hold."""
    has = lambda p: F.rlike(text, F.lit(p))
    return [
        (has(facts.FREQUENCY), F.col("draft.key_remote.frequency").isNotNull(), "frequency"),
        (has(facts.CODE_SERIES), F.col("draft.mechanical_key.code_series").isNotNull(), "code series"),
        (has("[1-9]\\s*=\\s*[.][0-9]{3}"), F.col("draft.mechanical_key.depths").isNotNull(), "depths"),
        (has("(?i)SPACING"), F.col("draft.mechanical_key.spacing").isNotNull(), "spacing"),
        (has(facts.CHIP), F.col("draft.transponder.chip").isNotNull(), "chip"),
        (has(facts.PART), F.size(F.col("draft.source_facts")["Part numbers"]) > 0, "part numbers"),
    ]


def gate(drafts: DataFrame, verified: str = "verified") -> DataFrame:
    """Drafts with issues and status."""
    kind = drafts.schema["draft"].dataType
    found = F.concat(records.issues(F.col("draft"), kind, BAD), gates.completeness_issues(completeness_rules()), completeness.issues("raw_text", F.to_json("draft")))
    useful = [F.col(f"draft.{p}").isNotNull() for p in ("key_remote", "mechanical_key", "programming", "transponder", "source_facts")]
    out = drafts.withColumn("issues", F.coalesce(found, F.array().cast("array<string>")))
    ok = gates.publishable(F.col("draft.code"), F.col("issues"), F.coalesce(F.size("draft.vehicle_applications"), F.lit(0)), useful)
    return out.withColumn("status", gates.status(ok, F.col(verified), F.col("issues")))


def tallies(gated: DataFrame) -> DataFrame:
    """One row: published, awaiting, rejected, review, and how many wait for nothing but verification."""
    n = lambda s: F.count_if(F.col("status") == s)
    waits = F.count_if(F.exists("issues", lambda i: F.contains(F.lower(i), F.lit(WAITING))))
    return gated.agg(n("published").alias("published"), n("awaiting_verification").alias("awaiting"), n("rejected").alias("rejected"), n("needs_review").alias("review"), waits.alias("waiting"))


def export_seed(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Retained rows of the seed and the published ones, which win.

    A code is blocked if a draft of it was rejected for more than waiting; blocking removes
    retained rows only.  Columns: code, verified, issues, status, body.
    """
    only_waiting = (F.size("issues") > 0) & F.forall("issues", lambda i: F.contains(F.lower(i), F.lit(WAITING)))
    blocked = drafts.filter((F.col("status") == "rejected") & ~only_waiting).select("code").distinct()
    published = drafts.filter((F.col("status") == "published") & F.col("verified") & (F.size("issues") == 0))
    published = relational.first_per_key(published, ["code"], [F.desc("body")])
    kept = existing.filter((F.col("code") != "") & F.col("verified") & (F.size("issues") == 0) & F.col("body").isNotNull()).join(blocked, "code", "left_anti")
    return published.unionByName(kept.join(published.select("code"), "code", "left_anti"))


def preview(matches: DataFrame, systems: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """JSON payload of each match of a published system: title, the labelled values it has, the vehicle."""
    glance = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")) for c, label in labels]), lambda e: ~F.lower(e["value"]).isin("", "-", "n/a", "none"))
    joined = matches.join(systems, "code")
    payload = F.struct(
        F.lit(True).alias("found"),
        F.lower("code").alias("report_id"),
        F.concat_ws(" ", F.concat_ws("-", "year_from", "year_to"), "make", "model").alias("title"),
        glance.alias("at_a_glance"),
        F.struct("make", "model", "year_from", "year_to", F.col("code").alias("system_code")).alias("vehicle"),
    )
    return joined.select("make", "model", "year", "code", F.to_json(payload).alias("payload"))
