"""Session settings that fit a large cluster; everything can be overridden by the caller."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(app: str = "quirework", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder does on a single machine; elsewhere that is an error,
    since each executor would write to a folder of its own.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quirework-scratch")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for what several later steps read: it is worked out once."""
    path = f"{shared_dir(df.sparkSession)}/quirework/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
