"""Incremental runs over arriving files, equal to a batch over all of them.

Windowed event aggregates are an extension: the reference has no stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import upsert


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_upserts(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: str) -> None:
    """Every micro-batch is merged into a new version of the table; the last row of a key stays.

    A version is written before the pointer table names it, so a lost batch is run again on
    the version before and gives the same result.  The table is written whole with each
    micro-batch, so batches should be large beside it.
    """
    pointer = f"{target}/_current"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Only a pointer table that is not there means that there is no version; any other failure stops the batch.
        last = spark.read.parquet(pointer).agg(F.max_by("path", F.when(F.col("number") < number, F.col("number")))).first()[0] if exists(spark, pointer) else None
        base = spark.read.parquet(last) if last else spark.createDataFrame([], batch.schema)
        path = f"{target}/v{number}"
        upsert(base, batch, keys, order).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(number, path)], "number long, path string").write.mode("append").parquet(pointer)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    path = spark.read.parquet(f"{target}/_current").agg(F.max_by("path", "number")).first()[0]
    return spark.read.parquet(path)


def tumbling(events: DataFrame, size: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count and sum by window and type; the same expression serves streams and batches."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
