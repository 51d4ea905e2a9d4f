"""Sources and sinks: nested JSON page sets, candidates, word tables, tolerant reads, atomic writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PAGES = "array<struct<page_number:int,image_path:string,native_text:string,raw_ocr_text:string,ocr_text:string,ocr_quality:double,cleaning_method:string>>"
IMPORTED = f"name string, path string, missing boolean, pages_total int, pages_imported int, pages {PAGES}"
APPLICATION = "make string, model string, year_from int, year_to int, system_type string, system_code string, source_document string, source_page int, confidence double"
SECTION = "code string, title string, source_document string, page_start int, page_end int, raw_text string, confidence double"
CANDIDATES = f"vehicle_applications array<struct<{APPLICATION.replace(' ', ':').replace(',:', ',')}>>, sections array<struct<{SECTION.replace(' ', ':').replace(',:', ',')}>>"
WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string"


def read_json(spark: SparkSession, path: str, schema: str, seed: DataFrame | None = None) -> DataFrame:
    """Whole-file JSON under a fixed schema.  A missing file gives no rows; unreadable records give the seed, or none."""
    try:
        df = spark.read.schema(schema + ", _corrupt string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
        # The other columns are named too: a count alone would read nothing but the corrupt one.
        whole = F.to_json(F.struct(*[c for c in df.columns if c != "_corrupt"])).isNotNull()
        good = df.filter(F.col("_corrupt").isNull() & whole).drop("_corrupt")
        return good if seed is None or not good.isEmpty() else seed
    except AnalysisException:
        return seed if seed is not None else spark.createDataFrame([], schema)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of imported documents, each with its document's name."""
    return flat_pages(read_json(spark, path, IMPORTED))


def flat_pages(docs: DataFrame) -> DataFrame:
    """Pages of a page set whatever it was read from; missing documents have none."""
    docs = docs.filter(~F.coalesce("missing", F.lit(False)))
    return docs.select(F.col("name").alias("document"), F.explode("pages").alias("p")).select("document", "p.*")


def applications(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CANDIDATES).select(F.explode("vehicle_applications").alias("a")).select("a.*")


def sections(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CANDIDATES).select(F.explode("sections").alias("s")).select("s.*")


def words(spark: SparkSession, path: str) -> DataFrame:
    """OCR word boxes from TSV: blank texts and negative confidences go; an unreadable confidence is -1."""
    rows = spark.read.schema(WORDS).csv(path, sep="\t", header=True, quote="")
    rows = rows.withColumn("confidence", F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)))
    return rows.filter((F.trim("text") != "") & (F.col("confidence") >= 0)).drop("conf", "level")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime").orderBy("path")


def existing(df: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """Rows whose file is in the listing."""
    return df.join(files.select(F.col("path").alias("_path")), df[column] == F.col("_path"), "left_semi")


def manifest(df: DataFrame, files: DataFrame, suffix: str = ".svg", least_bytes: int = 1500) -> DataFrame:
    """Manifest rows with the suffix, a reason, and a file of enough bytes."""
    big = files.filter(F.col("length") >= least_bytes).select(F.col("path").alias("_path"))
    ok = df.filter(F.endswith("public_path", F.lit(suffix)) & (F.trim(F.coalesce("decision_reason", F.lit(""))) != ""))
    return ok.join(big, ok["public_path"] == big["_path"], "left_semi")


def replace_document(page_set: DataFrame, incoming: DataFrame, name: str = "document") -> DataFrame:
    """The page set with the incoming documents in place of those of the same name."""
    return page_set.join(incoming.select(name).distinct(), name, "left_anti").unionByName(incoming)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet through the engine's commit protocol: a failed job leaves no partial table."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def insert_script(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement a row, quotes doubled, arrays as ARRAY[..]."""
    from ..functions.render import sql_literal

    values = []
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            inner = F.array_join(F.transform(name, lambda v: sql_literal(v.cast("string"))), ", ")
            values.append(F.concat(F.lit("ARRAY["), inner, F.lit("]")))
        elif kind == "string":
            values.append(sql_literal(F.col(name)))
        else:
            values.append(F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))
