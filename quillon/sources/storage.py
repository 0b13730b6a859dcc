"""Tables in the folder that all machines share: lineage is cut there, and what outlives a job is kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine without that setting, a temporary folder of the application."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="quillon-"))


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df, written as Parquet and read back: a lost executor costs its running tasks, never what led to them."""
    path = f"{shared_dir(df.sparkSession)}/quillon-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
