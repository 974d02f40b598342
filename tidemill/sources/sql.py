"""SQL text over frames, and connections: in-memory catalogs of views, and SQLite files."""

from __future__ import annotations

import itertools
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ComputeError
from ..frame import Frame

_numbers = itertools.count(1)
_MEMORY, _SQLITE = {"memory", "sql", "olap", "duckdb"}, {"sqlite", "sqlite3"}
#: Rows sent to SQLite at once.
_ROWS = 10_000


def query_sql(spark: SparkSession, sql: str, frames: Frame | dict[str, Frame]) -> Frame:
    """Spark SQL over the named frames; a single frame is ``df``. Reasons of missing values are not part of the result."""
    named = {"df": frames} if isinstance(frames, Frame) else frames
    return Frame(spark.sql(sql_with_placeholders(sql, named), **{k: f.to_spark() for k, f in named.items()}))


def sql_with_placeholders(sql: str, named) -> str:
    """Table names outside of quotes become placeholders, which bind frames to this one query only."""
    import re

    names = "|".join(re.escape(n) for n in sorted(named, key=len, reverse=True))
    parts = re.split(r"('(?:[^']|'')*')", sql.replace("{", "{{").replace("}", "}}"))
    at = re.compile(rf"(?i)\b(from|join)(\s+)({names})\b", re.I)
    lookup = {n.lower(): n for n in named}

    def bound(m):
        tail = m.string[m.end() :]
        alias = re.match(r"\s+(?:as\s+)?(?!(?:where|group|order|join|inner|left|right|full|cross|on|union|limit|having|natural|using|lateral|window|intersect|except|semi|anti)\b)[a-z_]\w*", tail, re.I)
        return f"{m[1]}{m[2]}{{{lookup[m[3].lower()]}}}" + ("" if alias else f" AS {m[3]}")

    return "".join(p if k % 2 else at.sub(bound, p) for k, p in enumerate(parts))


class Connection:
    """A named catalog of tables; ``query`` gives frames."""

    def __init__(self, spark: SparkSession, driver: str, uri: str = ":memory:"):
        if driver not in _MEMORY | _SQLITE:
            raise ComputeError("C0304", f"no driver {driver}")
        self.spark, self.driver, self.uri, self.id, self.is_connected = spark, driver, uri, next(_numbers), True
        self._db = sqlite3.connect(uri) if driver in _SQLITE else None
        self._frames: dict[str, Frame] = {}

    def _alive(self) -> None:
        if not self.is_connected:
            raise ComputeError("C0305", "the connection is closed")

    def close(self) -> None:
        self._alive()
        self.is_connected = False
        self._frames.clear()
        if self._db:
            self._db.close()

    def execute(self, sql: str) -> int:
        """Run statements; the number of changed rows on SQLite, zero in memory."""
        self._alive()
        if not self._db:
            return 0
        before = self._db.total_changes
        self._db.executescript(sql)
        self._db.commit()
        return self._db.total_changes - before

    def tables(self) -> list[str]:
        self._alive()
        if not self._db:
            return sorted(self._frames)
        return [r[0] for r in self._db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]

    def register(self, name: str, frame: Frame, mode: str = "append") -> None:
        """Bind a name in memory; on SQLite write the rows, which come in batches, never all at once."""
        self._alive()
        if not self._db:
            self._frames[name] = frame
            return
        kinds = {"boolean": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "float": "REAL"}
        df = frame.to_spark()
        quote = lambda s: '"' + s.replace('"', '""') + '"'
        if mode == "overwrite":
            self._db.execute(f"drop table if exists {quote(name)}")
        self._db.execute(f"create table if not exists {quote(name)} ({', '.join(f'{quote(c)} {kinds.get(k, 'TEXT')}' for c, k in df.dtypes)})")
        cast = df.select(*[F.col(f"`{c}`").cast("int" if k == "boolean" else "string" if k not in kinds else k).alias(c) for c, k in df.dtypes])
        rows = cast.toLocalIterator()
        while batch := list(itertools.islice(rows, _ROWS)):
            self._db.executemany(f"insert into {quote(name)} values ({', '.join('?' * len(df.columns))})", [tuple(r) for r in batch])
        self._db.commit()

    def query(self, sql: str) -> Frame:
        """Rows of a query; on SQLite a NULL is missing for the reason ``db.null``."""
        self._alive()
        if not self._db:
            return query_sql(self.spark, sql, self._frames)
        cursor = self._db.execute(sql)
        names = [d[0] for d in cursor.description]
        rows = [[f"<blob {len(x)} bytes>" if isinstance(x, bytes) else x for x in r] for r in cursor.fetchall()]
        kinds = []
        for k in range(len(names)):
            there = {type(r[k]) for r in rows if r[k] is not None}
            kinds.append(T.StringType() if str in there else T.DoubleType() if float in there or not there else T.LongType())
        for r in rows:
            for k, kind in enumerate(kinds):
                if r[k] is not None:
                    r[k] = {T.StringType: str, T.DoubleType: float, T.LongType: int}[type(kind)](r[k])
        frame = Frame(self.spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])))
        for n in names:
            frame = frame.with_reasons(n, F.lit("db.null"))
        return frame


def connect(spark: SparkSession, driver: str = "memory", uri: str = ":memory:") -> Connection:
    return Connection(spark, driver, uri)
