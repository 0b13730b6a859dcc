"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the operators' contracts define them (fixed values, as regular expressions).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own_dirs[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read that back.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/quillon-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(df: DataFrame, megabytes: int = 4, rows: int = 10_000) -> DataFrame:
    """df in a session of its own whose Arrow batches hold at most so many MB and rows.

    Both ends of a Python worker's pipe hold a batch more than once, so its size decides what a task needs beside the
    JVM's heap. The caller's session keeps its settings, and so do jobs that run in it meanwhile.
    """
    spark = df.sparkSession
    inner = spark._jsparkSession.cloneSession()
    own = type(spark)(spark.sparkContext, inner)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(inner, plan), own)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns in one struct, `row`: whatever their names, they can't clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
