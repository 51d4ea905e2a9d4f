"""From pages to candidates: sections with facts, and applications from headers and contents tables.

Candidates: make, model, year_from, year_to, system_type, system_code, source_document,
source_page, confidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts, similarity, text, vehicles, years
from ..operators import geometry, relational, sections
from ..session import written

COLUMNS = ("make", "model", "year_from", "year_to", "system_type", "system_code", "source_document", "source_page", "confidence")
#: How sure each way of finding an application is.
TOC_LINE, TOC_COLUMN, CANONICAL, SECTION = 0.55, 0.65, 0.92, 0.6
HEADER, LONG_HEADER = 1000, 1800
#: A year range of a header; its end may be missing.
HEADER_YEARS = "\\b((?:19|20)[0-9]{2})\\s*[-–]\\s*([0-9]{0,4})\\b"
YEARS = "(?:19|20)[0-9]{2}\\s*[-–]\\s*[0-9]{2,4}"
#: What every such range begins with, before and after the repair of a text: no repair makes or joins these signs.
YEAR_START = "(?U)(?:19|20)[0-9]{2}\\s*[-–]"
TOC_CODE = "\\b([A-Z]{2,5}[-–][A-Z0-9]{1,4})\\b"
OPERATIONAL = "(?i)\\b(?:KEYS?|MASTER|Chip|Programmer|Diagnostic|Cloner)\\b"


def _named(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def from_toc_lines(pages: DataFrame, document: str = "document", page: str = "page_number", body: str = "text") -> DataFrame:
    """Contents lines 'model years .. code'; an upper-case line of up to three words is the make from there on."""
    lines = pages.select(F.col(document).alias("source_document"), F.col(page).cast("int").alias("source_page"), F.posexplode(F.split(body, "\n")).alias("no", "raw"))
    lines = lines.withColumn("line", F.regexp_replace(F.trim("raw"), "(?U)\\s+", " ")).filter("line <> ''")
    has_years = F.rlike("line", F.lit(YEARS))
    heading = (F.size(F.split("line", " ")) <= 3) & F.rlike("line", F.lit("[A-Z]")) & (F.upper("line") == F.col("line")) & ~has_years
    # Other lines are neither a make nor an entry, so they need not be dealt out and sorted.
    lines = lines.withColumn("heading", heading).filter(F.col("heading") | (has_years & F.rlike("line", F.lit(TOC_CODE))))
    lines = relational.carry_forward(lines, ["source_document", "source_page"], ["no"], F.when(F.col("heading"), F.initcap("line")), "make")
    r = years.strict("line")
    rows = lines.filter(~F.col("heading") & F.col("make").isNotNull()).withColumn("r", r).withColumn("code", F.replace(F.regexp_extract("line", TOC_CODE, 1), F.lit("–"), F.lit("-")))
    rows = rows.filter(F.col("r").isNotNull() & (F.col("code") != "")).withColumn("model", F.regexp_replace(F.regexp_extract("line", "^(.*?)" + YEARS, 1), "^[ -]+|[ -]+$", ""))
    return _named(
        rows.filter("model <> ''").select(
            "make", "model", "r.year_from", "r.year_to", text.detect_type("line").alias("system_type"), F.col("code").alias("system_code"), "source_document", "source_page", F.lit(TOC_LINE).alias("confidence")
        )
    )


def from_toc_columns(pages: DataFrame) -> DataFrame:
    """Pages with arrays ``models``, ``years``, ``types``, ``codes`` and a make.

    Models advance on their own: each row takes the next model unless that is a year range or a
    dash, so a model can serve several rows only when the model list has run out.
    """
    usable = F.filter("models", lambda m: years.strict(m).isNull() & ~F.rlike(m, F.lit("^[-–]+$")))
    stuck = F.array_position(F.transform("models", lambda m: years.strict(m).isNotNull() | F.rlike(m, F.lit("^[-–]+$"))), True)
    # The list stops at the first entry that is no model: the reader never passes it.
    ready = F.when(stuck > 0, F.slice("models", F.lit(1), (stuck - 1).cast("int"))).otherwise(usable)
    n = F.least(F.size("years"), F.size("codes"))
    rows = pages.withColumn("_models", ready).filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    model = F.get("_models", F.least(F.col("i"), F.size("_models") - 1))
    rows = rows.withColumn("model", F.when(F.size("_models") > 0, model)).withColumn("r", years.strict(F.get("years", F.col("i"))))
    rows = rows.filter(F.col("r").isNotNull() & (F.coalesce("model", F.lit("")) != ""))
    return _named(
        rows.select(
            "make", "model", "r.year_from", "r.year_to", F.coalesce(F.get("types", F.col("i")), F.lit("")).alias("system_type"), text.section_code(F.get("codes", F.col("i"))).alias("system_code"), "source_document", "source_page", F.lit(TOC_COLUMN).alias("confidence")
        )
    )


def from_toc_words(words: DataFrame, makes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, page statistics) of word boxes of contents pages.

    ``words``: document, page, page_width, text, left, top, width, height, confidence.
    ``makes``: document, page, make, one row for each page that was to be read; a page without
    words is reported as missing.
    """
    w = geometry.centres(words.withColumn("page_key", F.concat_ws(":", "document", "page")))
    rows = geometry.row_columns(geometry.cluster_rows(w, "page_key"), "page_key", "page_width").withColumnsRenamed({f"text_{c}": c for c in geometry.TOC_COLUMNS})
    lines = geometry.cluster_rows(w, "page_key").groupBy("page_key", "row_no").agg(F.min("mid_y").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("line"))
    pages = makes.select("make", F.col("document").alias("source_document"), F.col("page").cast("int").alias("source_page"), F.concat_ws(":", "document", "page").alias("page_key"))
    rows = rows.join(lines, ["page_key", "row_no"]).join(pages, "page_key")
    model = F.when((F.col("model") != "") & years.strict("model").isNull() & ~F.lower("model").isin("model", "make"), F.col("model"))
    rows = relational.carry_forward(rows, ["page_key"], ["row_no"], model, "current")
    rows = rows.withColumn("r", years.strict(F.when(F.col("years") != "", F.col("years")).otherwise(F.col("line")))).filter(F.col("r").isNotNull() & F.col("current").isNotNull() & (F.col("section") != ""))
    found = _named(
        rows.select(
            "make", F.col("current").alias("model"), "r.year_from", "r.year_to", text.detect_type(F.when(F.col("type") != "", F.col("type")).otherwise(F.col("line"))).alias("system_type"), text.section_code("section").alias("system_code"), "source_document", "source_page", "confidence"
        )
    )
    counted = words.groupBy("document", "page").agg(F.count("*").alias("words"))
    hits = found.groupBy(F.col("source_document").alias("document"), F.col("source_page").alias("page")).agg(F.count("*").alias("candidates"))
    stats = makes.select("document", F.col("page").cast("int").alias("page")).join(counted, ["document", "page"], "left").join(hits, ["document", "page"], "left")
    return found, stats.select("document", "page", "words", F.when(F.col("words").isNotNull(), F.coalesce("candidates", F.lit(0))).alias("candidates"), F.when(F.col("words").isNull(), "missing image").alias("error"))


def header_chunks(secs: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Year ranges of a section's header with the text up to the next one: + year_from, year_to, model."""
    head = F.substring(F.coalesce(raw, F.lit("")), 1, HEADER)
    dated = secs.filter(F.rlike(head, F.lit(YEAR_START)))  # the others need no repair
    header = F.split(vehicles.ocr_text(head), OPERATIONAL)[0]
    starts = F.regexp_extract_all(header, F.lit(HEADER_YEARS), F.lit(0))
    bodies = F.slice(F.split(header, HEADER_YEARS), 2, 10_000)
    rows = dated.withColumn("chunk", F.explode(F.arrays_zip(starts.alias("y"), bodies.alias("b"))))
    shape = HEADER_YEARS.removesuffix("\\b")  # a range alone has no word after it
    r = years.lenient(F.regexp_extract(F.col("chunk.y"), shape, 1), F.regexp_extract(F.col("chunk.y"), shape, 2))
    model = vehicles.model_text(F.split(F.col("chunk.b"), vehicles.SECTION_STOP)[0])
    return rows.withColumn("r", r).withColumn("model", model).filter(F.col("r").isNotNull() & (F.col("model") != "")).select(*secs.columns, "r.year_from", "r.year_to", "model")


def canonical_applications(secs: DataFrame, vocabulary: Mapping[str, Sequence[str]], default_make: str = "default_make", raw: str = "raw_text", head: int | None = LONG_HEADER) -> DataFrame:
    """Known models within reach of a year range at the head of a section (or in all of it): + make, model, year_from, year_to."""
    body = F.coalesce(F.col(raw), F.lit(""))
    body = F.substring(body, 1, head) if head else body
    document = "source_document" if "source_document" in secs.columns else F.lit("")
    rows = secs.filter(F.rlike(body, F.lit(YEAR_START))).withColumn("hit", F.explode(vehicles.applications(vehicles.scan_text(body), vocabulary)))
    rows = rows.filter(vehicles.confirmed(F.col("hit"), default_make, document))
    shape = "([0-9]{4})\\s*[-–]\\s*([0-9]{2,4})"
    r = years.lenient(F.regexp_extract(F.col("hit.years"), shape, 1), F.regexp_extract(F.col("hit.years"), shape, 2))
    return rows.withColumn("r", r).filter("r is not null").select(*secs.columns, "hit.make", "hit.model", "r.year_from", "r.year_to")


def from_sections(secs: DataFrame, vocabulary: Mapping[str, Sequence[str]], default_make: str = "default_make") -> DataFrame:
    """Each application of a code once, as the first section names it: there known models first, then header chunks."""
    base = dict(system_type=text.detect_type(F.substring("raw_text", 1, 900)), system_code=F.col("code"), source_page=F.col("page_start").cast("int"))
    sure = canonical_applications(secs, vocabulary, default_make).withColumn("confidence", F.lit(CANONICAL)).withColumn("_way", F.lit(0))
    loose = vehicles.split_heading(header_chunks(secs), "model", default_make).filter((F.col("make") != "") & (F.col("model") != "") & ~vehicles.bad_model("model"))
    loose = similarity.canonicalize(loose, vocabulary, "make", "model").withColumn("model", F.col("canonical"))
    loose = loose.withColumn("confidence", text.link_points("make", "model", default_make, F.coalesce("score", F.lit(0.0)), vehicles.DEBRIS) / 100).withColumn("_way", F.lit(1))
    both = sure.unionByName(loose.select(*sure.columns)).withColumns(base)
    w = Window.partitionBy(F.lower("make"), F.lower("model"), "year_from", "year_to", "system_code").orderBy("source_document", "source_page", "_way", "make", "model")
    return _named(both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1"))


def build(pages: DataFrame, vocabulary: Mapping[str, Sequence[str]], default_makes: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections with facts, application candidates of contents lines and sections).

    ``default_makes`` by the letters of a code go before the fixed ones.  Both are written once:
    the applications come from the sections, and drafts read both again.
    """
    spans = sections.split_sections(sections.page_features(pages))
    secs = sections.section_texts(spans, pages).withColumnRenamed("document", "source_document")
    make = vehicles.default_make("code", "source_document")
    if default_makes:
        makes = F.create_map(*[F.lit(v) for kv in default_makes.items() for v in kv])
        make = F.coalesce(F.try_element_at(makes, F.substring_index("code", "-", 1)), make)
    secs = written(secs.withColumn("default_make", make), "sections")
    found = written(from_toc_lines(pages).unionByName(from_sections(secs, vocabulary)), "applications")
    described = {"fields": facts.labelled("raw_text"), "facts": facts.identifiers("raw_text"), "topics": facts.topics("raw_text")}
    return secs.withColumns(described).select(*[c for c in secs.columns if c != "default_make"], *described, "default_make"), found


def quality_report(candidates: DataFrame, page_stats: DataFrame | None = None, low: float = 0.65) -> DataFrame:
    """section, key, n: counts by make and code prefix, low and suspicious candidates, weak pages."""
    by = lambda name, key: candidates.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "key", "n")
    flags = candidates.agg(F.count_if(F.col("confidence") < low).alias("low"), F.count_if(text.suspicious_name("model")).alias("suspicious"))
    flags = flags.select(F.explode(F.create_map(F.lit("low confidence"), "low", F.lit("suspicious"), "suspicious")).alias("key", "n")).select(F.lit("flags").alias("section"), "key", "n")
    out = by("make", F.col("make")).unionByName(by("prefix", F.substring_index("system_code", "-", 1))).unionByName(flags)
    if page_stats is not None:
        weak = page_stats.filter((F.coalesce("candidates", F.lit(0)) == 0) | (F.coalesce("words", F.lit(0)) < 20) | (F.coalesce("error", F.lit("")) != ""))
        out = out.unionByName(weak.select(F.lit("weak page").alias("section"), F.concat_ws(":", "document", "page").alias("key"), F.lit(1).cast("long").alias("n")))
    return out
