"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR_PACKAGE = "public_tokenizers"

#: Rows of one Arrow batch: texts may be long, so a batch holds few of them.
BATCH_ROWS = 512


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is read where it lies, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers where their path does not have it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or getattr(context, "_quirework_sent", False):
        return
    import shutil

    folder = tempfile.mkdtemp()  # the driver serves the file to the workers; they do not share its path
    context.addPyFile(shutil.make_archive(os.path.join(folder, "quirework"), "zip", root, "quirework"))
    context._quirework_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made and set, on a single machine only: elsewhere
    executors would each write to a folder of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", master := spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "quirework-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files.

    A lost executor then costs a re-read, not a re-run of all that came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirework/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirework_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` returned; nothing may read them any more."""
    for df in cuts:
        if path := getattr(df, "_quirework_path", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch; partitions stay as they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


_holder: list = [None, None]


def hold_cache(owner: str, clear: Callable[[], None]) -> None:
    """Say that ``owner`` keeps things in this worker from now on; whoever did before lets go.

    Workers outlive stages, so without this the caches of all operators would add up.
    """
    if _holder[0] != owner:
        if _holder[1] is not None:
            _holder[1]()
        _holder[:] = [owner, clear]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
