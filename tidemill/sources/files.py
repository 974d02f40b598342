"""Files: delimited text with missing-value reasons, Parquet, plain text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ComputeError
from ..frame import _NA, Frame

#: Cells that mean missing; a token may carry a reason after a colon.
NA_TOKENS = ("", "NA", "NaN", "null", "None")
#: Candidates in order of preference, by how often the header has them.
DELIMITERS = ("\t", ";", ",")
_LONG = r"^[+-]?[0-9]{1,19}$"
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"


def _header(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0].lstrip("﻿") if rows else ""


def sniff(line: str) -> str:
    """The delimiter that the line has most of; tab before semicolon before comma."""
    counts = [line.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))] if max(counts) else ","


def _cell(c: Column) -> tuple[Column, Column]:
    """(text or null, reason or null) of a raw cell."""
    text = F.trim(c)
    reason = F.when(text.startswith("NA:"), F.substring(text, 4, 1 << 30))
    missing = text.isNull() | text.isin(*NA_TOKENS) | text.startswith("NA:")
    return F.when(~missing, text), reason


def inferred(raw: DataFrame) -> Frame:
    """Typed columns from all-string ones: whole number, else double, else boolean, else string.

    One aggregate over all columns decides. Whole numbers that don't fit 64
    bits make the column double, as does a column of missing values only.
    """
    cells = {c: _cell(F.col(f"`{c}`")) for c in raw.columns}
    tests = []
    for k, (text, reason) in enumerate(cells.values()):
        whole = text.rlike(_LONG) & text.try_cast("long").isNotNull()
        tests += [
            F.count(text).alias(f"n{k}"),
            F.count(F.when(whole, 1)).alias(f"i{k}"),
            F.count(F.when(text.rlike(_DOUBLE), 1)).alias(f"d{k}"),
            F.count(F.when(F.lower(text).isin("true", "false"), 1)).alias(f"b{k}"),
            F.count(reason).alias(f"r{k}"),
        ]
    found = raw.agg(*tests).collect()[0] if tests else {}
    out = []
    for k, (name, (text, reason)) in enumerate(cells.items()):
        n = found[f"n{k}"]
        kind = "double" if n == 0 else "long" if found[f"i{k}"] == n else "double" if found[f"d{k}"] == n else "boolean" if found[f"b{k}"] == n else "string"
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
        if found[f"r{k}"]:
            out.append(reason.alias(_NA + name))
    return Frame(raw.select(*out))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> Frame:
    """A delimited file with header; cells ``NA:reason`` are missing for that reason."""
    delimiter = delimiter or sniff(_header(spark, path))
    raw = spark.read.options(header=True, sep=delimiter, inferSchema=False, mode="FAILFAST", quote='"', escape='"', nullValue="\x00", emptyValue="").csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    return inferred(raw.toDF(*names))


def scan_csv(spark: SparkSession, path: str) -> Frame:
    """A deferred scan with Spark's own inference; reasons are not read."""
    return Frame(spark.read.options(header=True, inferSchema=True, sep=sniff(_header(spark, path))).csv(path))


def parse_csv(spark: SparkSession, text: str, delimiter: str | None = None) -> Frame:
    """Delimited text in memory by the same rules; a row with another number of cells is an error."""
    import csv
    import io

    lines = text.lstrip("﻿")
    delimiter = delimiter or sniff(lines.split("\n", 1)[0])
    rows = [r for r in csv.reader(io.StringIO(lines), delimiter=delimiter) if r]
    if not rows:
        raise ComputeError("C0403", "no header")
    names = [c.strip() for c in rows[0]]
    if any(len(r) != len(names) for r in rows):
        raise ComputeError("C0403", "rows differ in their number of cells")
    return inferred(spark.createDataFrame(rows[1:], T.StructType([T.StructField(c, T.StringType()) for c in names])))


def write_csv(frame: Frame, path: str, delimiter: str = ",") -> None:
    """A header in each part file; missing cells read ``NA`` or ``NA:reason``, so that reasons survive."""
    cells = []
    for c in frame.columns:
        reason = frame._reason(c)
        na = F.concat(F.lit("NA"), F.coalesce(F.concat(F.lit(":"), reason), F.lit("")))
        cells.append(F.coalesce(F.col(f"`{c}`").cast("string"), na).alias(c))
    frame.df.select(*cells).write.options(header=True, sep=delimiter, quote='"', escape='"').mode("overwrite").csv(path)


def read_parquet(spark: SparkSession, path: str) -> Frame:
    """Typed columns as stored; pushed-down filters and pruned columns come with the scan."""
    return Frame(spark.read.parquet(path))


scan_parquet = read_parquet


def write_parquet(frame: Frame, path: str, partition_by: Sequence[str] = ()) -> None:
    """All columns, reasons included."""
    hidden = [c for c in frame.df.columns if c.startswith("__ord__")]
    frame.df.drop(*hidden).write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)


def read_lines(spark: SparkSession, path: str) -> Frame:
    return Frame(spark.read.text(path).withColumnRenamed("value", "line"))


def read_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).collect()[0][0]


def write_file(text: str, path: str, append: bool = False) -> None:
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        f.write(text)


def file_exists(path: str) -> bool:
    from pathlib import Path

    return Path(path).exists()


def frame_of(spark: SparkSession, columns: dict[str, Sequence]) -> Frame:
    """A frame from literal columns; mixed types widen to string, double or long, and a column of missing values is double."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ComputeError("C0205", "columns differ in length")
    kinds, cells = [], []
    for v in columns.values():
        there = [x for x in v if x is not None]
        if any(isinstance(x, str) for x in there):
            kinds.append(T.StringType())
            cells.append([None if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in v])
        elif not there or any(isinstance(x, float) for x in there):
            kinds.append(T.DoubleType())
            cells.append([None if x is None else float(x) for x in v])
        elif all(isinstance(x, bool) for x in there):
            kinds.append(T.BooleanType())
            cells.append(list(v))
        else:
            kinds.append(T.LongType())
            cells.append([None if x is None else int(x) for x in v])
    schema = T.StructType([T.StructField(n, k) for n, k in zip(columns, kinds)])
    return Frame(spark.createDataFrame(list(zip(*cells)), schema))
