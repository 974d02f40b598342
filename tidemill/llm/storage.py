"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset a temporary folder, but only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    return _fallback[0]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The copy cuts lineage and survives lost executors. Its files go when the
    session's JVM ends, or earlier through ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemill_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``store`` returned."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._tidemill_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's own default and what takes its place: texts are long, and both sides of the exchange hold whole batches.
_BATCH, _DEFAULT, _FRUGAL = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def frugal(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python workers smaller Arrow batches, unless a size was chosen."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, _FRUGAL)
    return df


#: Spark's own settings that let go of what its parser has learned, once that is more states than short texts need.
_FORGET = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "4000"}


@contextmanager
def forgetful_parser(spark: SparkSession) -> Iterator[None]:
    """For very long SQL texts: what the parser learns from one would stay on the driver's heap to its end, 57 MB from op6's."""
    before = {k: spark.conf.get(k, None) for k in _FORGET}
    try:
        for k, v in _FORGET.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
