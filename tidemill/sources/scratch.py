"""Intermediate tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's ``spark.checkpoint.dir`` and read it back; in local mode, as in tests, a temporary folder serves where that is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tidemill-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/tidemill/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def remove(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned; other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
