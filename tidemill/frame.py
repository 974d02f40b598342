"""Frames: lazy DataFrames whose missing values can carry a reason and whose rows can have an order.

A column ``x`` with reasons has a companion column of strings; it moves with
its row through every verb, and Catalyst drops it where nothing asks for it.
Row order is a list of columns. A frame without one gets a row number the first
time a verb depends on order, so that order-free pipelines pay nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import ComputeError, StatError
from .operators import ranges
from .operators.aggregates import Agg

_NA, _ORDER = "__na__", "__ord__"
#: Rows of a side that joins broadcast by themselves are bounded by Spark's own size threshold.
SUFFIX = "_right"


class Frame:
    """An immutable wrapper; every verb returns a new frame and computes nothing."""

    def __init__(self, df: DataFrame, order_by: Sequence[str] = (), keys: Sequence[str] = ()):
        self.df, self.order, self.keys = df, tuple(order_by), tuple(keys)

    # -- shape ------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith((_NA, _ORDER))]

    colnames = columns

    def ncol(self) -> int:
        return len(self.columns)

    def nrow(self) -> int:
        return self.df.count()

    def explain(self, optimized: bool = True) -> str:
        execution = self.df._jdf.queryExecution()
        return (execution.optimizedPlan() if optimized else execution.logical()).toString()

    def to_spark(self) -> DataFrame:
        """The visible columns."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])

    def collect(self) -> list:
        return (self._ordered().df.orderBy(*self._ordered().order) if self.order else self.df).select(*self.columns).collect()

    def glimpse(self, n: int = 10) -> str:
        kinds = dict(self.df.dtypes)
        rows = self.head(n).to_spark().collect()
        return "\n".join(f"{c} <{kinds[c]}> " + ", ".join("NA" if r[c] is None else str(r[c]) for r in rows) for c in self.columns)

    def _need(self, *names: str) -> None:
        for name in names:
            if name not in self.columns:
                raise StatError("S0201", f"no column {name}; there are {', '.join(self.columns)}")

    def _with(self, df: DataFrame, **changes) -> Frame:
        return Frame(df, changes.get("order", self.order), changes.get("keys", self.keys))

    def _pair(self, name: str) -> list[str]:
        return [name, _NA + name] if _NA + name in self.df.columns else [name]

    def _reason(self, name: str) -> Column:
        return F.col(_NA + name) if _NA + name in self.df.columns else F.lit(None).cast("string")

    def _ordered(self) -> Frame:
        if self.order:
            return self
        return self._with(self.df.withColumn(_ORDER, F.monotonically_increasing_id()), order=(_ORDER,))

    def order_by(self, *names: str) -> Frame:
        """Declare the row order by columns; nothing is sorted."""
        self._need(*names)
        return self._with(self.df, order=names)

    # -- columns ----------------------------------------------------------

    def filter(self, condition: Column) -> Frame:
        """Rows for which the condition holds; an unknown condition drops the row."""
        if not isinstance(condition, Column):
            raise ComputeError("C0202", "filter takes a condition on columns")
        return self._with(self.df.filter(condition))

    def select(self, *names: str) -> Frame:
        self._need(*names)
        hidden = [c for c in self.df.columns if c.startswith(_ORDER) or c in self.order and c not in names]
        if any(not c.startswith(_ORDER) for c in hidden):  # an order column that is no longer shown
            moved = {c: f"{_ORDER}{c}" for c in hidden if not c.startswith(_ORDER)}
            df = self.df.withColumnsRenamed(moved)
            order = tuple(moved.get(c, c) for c in self.order)
            return Frame(df.select(*[x for n in names for x in self._pair(n)], *[moved.get(c, c) for c in hidden]), order, self.keys)
        return self._with(self.df.select(*[x for n in names for x in self._pair(n)], *hidden))

    def drop(self, *names: str) -> Frame:
        """Without the named columns; unknown names are no error."""
        return self.select(*[c for c in self.columns if c not in names])

    def rename(self, old: str, new: str) -> Frame:
        self._need(old)
        if new in self.columns:
            raise ComputeError("C0206", f"there is a column {new} already")
        df = self.df.withColumnsRenamed({old: new, _NA + old: _NA + new})
        return self._with(df, order=tuple(new if c == old else c for c in self.order), keys=tuple(new if c == old else c for c in self.keys))

    def mutate(self, **columns) -> Frame:
        """Add or replace columns by expressions or constants; their reasons are cleared."""
        df = self.df
        for name, value in columns.items():
            df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value)).drop(_NA + name)
        return self._with(df)

    def pull(self, name: str) -> DataFrame:
        """One column with its reasons, still lazy."""
        self._need(name)
        return self.df.select(name, self._reason(name).alias("reason"))

    # -- missing values ---------------------------------------------------

    def with_reasons(self, name: str, reason: Column) -> Frame:
        """Give the missing values of a column a reason."""
        self._need(name)
        return self._with(self.df.withColumn(_NA + name, F.when(F.col(name).isNull(), reason.cast("string"))))

    def na_reasons(self, name: str) -> DataFrame:
        self._need(name)
        return self.df.select(self._reason(name).alias("reason"))

    def fill_na(self, name: str, value) -> Frame:
        """Missing values become ``value``; a string makes the column a string column."""
        self._need(name)
        c = F.col(name).cast("string") if isinstance(value, str) else F.col(name)
        return self._with(self.df.withColumn(name, F.coalesce(c, F.lit(value))).drop(_NA + name))

    def fill_na_all(self, value) -> Frame:
        """``fill_na`` on every column that can hold the value: a number also fills strings, as text, and leaves booleans and times alone."""
        out = self
        for c, kind in self.to_spark().dtypes:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if kind == "string" or isinstance(value, str):
                out = out.fill_na(c, str(value))
            elif number and kind.startswith(("double", "float", "decimal")) or isinstance(value, bool) and kind == "boolean":
                out = out.fill_na(c, value)
            elif number and kind in ("tinyint", "smallint", "int", "bigint"):
                put = F.lit(value).cast(kind) if float(value).is_integer() else F.lit(float(value))
                out = out._with(out.df.withColumn(c, F.coalesce(F.col(c), put)).drop(_NA + c))
        return out

    def filter_na(self, name: str) -> Frame:
        self._need(name)
        return self.filter(F.col(name).isNotNull())

    def _listed(self, name: str, reasons: Sequence[str]) -> Column:
        """Whether a missing value's reason is listed; an empty string or NA stands for no reason."""
        plain = any(r in ("", "NA") for r in reasons)
        named = [r for r in reasons if r not in ("", "NA")]
        reason = self._reason(name)
        return F.coalesce(reason.isin(named), F.lit(False)) | (reason.isNull() & F.lit(plain))

    def filter_na_reason(self, name: str, drop: Sequence[str] = (), keep: Sequence[str] = ()) -> Frame:
        """Drop rows missing for a listed reason, or keep of the missing ones only those listed; rows with a value stay, and ``drop`` wins."""
        self._need(name)
        there = F.col(name).isNotNull()
        return self.filter(there | (~self._listed(name, drop) if drop else self._listed(name, keep)))

    def impute(self, name: str, strategy: str = "mean", value=None, only_for: Sequence[str] = ()) -> Frame:
        """Replace missing values by the mean, median, mode, zero or a constant of the column.

        ``only_for`` restricts it to listed reasons; the others keep theirs. Of
        equally frequent modes the smallest is taken.
        """
        self._need(name)
        c = F.col(name)
        if strategy in ("zero", "const"):
            put = F.lit(0 if strategy == "zero" else value)
            df = self.df
        else:
            made = {"mean": F.avg(c), "median": F.median(c), "mode": F.mode(c, True)}.get(strategy)
            if made is None:
                raise ComputeError("C0202", f"no strategy {strategy}")
            # one row, whatever the input
            df = self.df.crossJoin(F.broadcast(self.df.agg(made.alias("__put__"))))
            put = F.col("__put__")
        hit = c.isNull() & (self._listed(name, only_for) if only_for else F.lit(True))
        new = {name: F.when(hit, put).otherwise(c)}
        if _NA + name in self.df.columns:
            new[_NA + name] = F.when(~hit, F.col(_NA + name))
        return self._with(df.withColumns(new).drop("__put__"))

    # -- rows -------------------------------------------------------------

    def arrange(self, *keys) -> Frame:
        """Sort by names or ``desc(name)``; missing values last, ties in row order."""
        base = self._ordered() if self.order else self
        sort = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]
        return self._with(base.df.orderBy(*sort, *base.order))

    def _first_rows(self, n: int, sort: list) -> Frame:
        base = self._ordered()
        return base._with(base.df.orderBy(*sort, *base.order).limit(max(n, 0)))

    def head(self, n: int = 5) -> Frame:
        return self._first_rows(n, [])

    def tail(self, n: int = 5) -> Frame:
        base = self._ordered()
        return base._with(base.df.orderBy(*[F.desc(c) for c in base.order]).limit(max(n, 0)))

    def slice(self, start: int = 0, stop: int = 5) -> Frame:
        """Rows from ``start`` up to before ``stop``."""
        base, start = self._ordered(), max(start, 0)
        return base._with(base.df.orderBy(*base.order).limit(max(stop, start)).orderBy(*base.order).offset(start))

    def slice_min(self, name: str, n: int = 1) -> Frame:
        self._need(name)
        return self._first_rows(n, [F.col(name).asc_nulls_last()])

    def slice_max(self, name: str, n: int = 1) -> Frame:
        self._need(name)
        return self._first_rows(n, [F.col(name).desc_nulls_last()])

    def sample_n(self, n: int = 1, seed: int = 0) -> Frame:
        """Exactly n rows (all, if fewer) without replacement; the same rows for the same seed whatever the partitioning.

        Rows are drawn by a hash of the order's columns, or of all columns if
        there is no order; of equal rows any may be drawn.
        """
        by = list(self.order) if self.order else self.columns
        return self._with(self.df.orderBy(F.xxhash64(F.lit(seed), *by), *self.order).limit(max(0, min(n, (1 << 31) - 1))))

    def sample_frac(self, fraction: float = 1.0, seed: int = 0) -> Frame:
        """As many rows as the share comes to, a half rounded up."""
        return self.sample_n(int(self.nrow() * fraction + 0.5), seed)

    def _row_keys(self, names: Sequence[str]) -> list[Column]:
        return [x for n in names for x in (F.col(n), self._reason(n))]

    def distinct(self, *names: str) -> Frame:
        """The first row of each combination of values; missing values with different reasons differ."""
        self._need(*names)
        keys = self._row_keys(names or self.columns)
        if not names and not any(c.startswith(_NA) for c in self.df.columns) and not any(c.startswith(_ORDER) for c in self.order):
            return self._with(self.df.dropDuplicates(self.columns))
        base = self._ordered()
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*base.order))
        return base._with(base.df.withColumn("__n__", first).filter("__n__ = 1").drop("__n__"))

    # -- groups -----------------------------------------------------------

    def group_by(self, *names: str) -> Frame:
        self._need(*names)
        return self._with(self.df, keys=names)

    def ungroup(self) -> Frame:
        return self._with(self.df, keys=())

    def summarize(self, **aggs: Agg) -> Frame:
        """One row per group, in order of the groups' first rows if the frame has an order; a missing key is a group."""
        for a in aggs.values():
            if a.column is not None:
                self._need(a.column)
        base = self._ordered() if any(a.ordered for a in aggs.values()) else self
        order = F.struct(*base.order) if base.order else None
        made = [a.build(a.column, order).alias(name) for name, a in aggs.items()]
        place = [F.min(order).alias(_ORDER)] if self.order else []
        out = base.df.groupBy(*self.keys).agg(*made, *place)
        return Frame(out, (_ORDER,) if place else ())

    def count(self, name: str) -> Frame:
        """How often each value occurs; missing values count by reason."""
        self._need(name)
        place = [F.min(F.struct(*self.order)).alias(_ORDER)] if self.order else []
        out = self.df.groupBy(*self._pair(name)).agg(F.count(F.lit(1)).alias("n"), *place)
        return Frame(out, (_ORDER,) if place else ())

    # -- joins ------------------------------------------------------------

    def join(self, other: Frame, *on: str, how: str = "inner") -> Frame:
        """Equi-join on columns of the same names; missing keys never match.

        Other columns of ``other`` with names of this frame get ``_right``. Spark
        broadcasts a side under its size threshold and splits skewed keys of
        large sides; reasons of both sides come along.
        """
        self._need(*on)
        other._need(*on)
        if how in ("left_semi", "left_anti"):
            return self._with(self.df.join(other.df.select(*on), list(on), how))
        taken = set(self.columns)
        renamed = {}
        for c in other.columns:
            if c not in on and c in taken:
                renamed |= {c: c + SUFFIX, _NA + c: _NA + c + SUFFIX}
        right = other.df.drop(*[c for c in other.df.columns if c.startswith(_ORDER)], *[_NA + c for c in on]).withColumnsRenamed(renamed)
        return self._with(self.df.join(right, list(on), how))

    def inner_join(self, other: Frame, *on: str) -> Frame:
        return self.join(other, *on)

    def left_join(self, other: Frame, *on: str) -> Frame:
        return self.join(other, *on, how="left")

    def asof_join(self, other: Frame, on: str, by: Sequence[str] = ()) -> Frame:
        """Each row with the last row of ``other`` in the same group whose ``on`` is not later.

        Missing keys and missing ``on`` match nothing, on either side. Both
        sides are merged into one table and the last row seen is carried
        forward by a window, so nothing grows beyond the sum of the inputs.
        """
        self._need(on, *by)
        other._need(on, *by)
        rest = [c for c in other.columns if c not in by]
        named = {c: c + SUFFIX if c in self.columns else c for c in rest}
        named |= {_NA + c: _NA + to for c, to in named.items() if _NA + c in other.df.columns}
        there = other.df.dropna(subset=[on, *by])
        packed = there.select(*by, F.col(on).alias("__t__"), F.lit(0).alias("__s__"), F.struct(*[F.col(c) for c in named]).alias("__r__"))
        own = self.df.select(F.struct(*self.df.columns).alias("__l__"), *by, F.col(on).alias("__t__"), F.lit(1).alias("__s__"))
        both = own.unionByName(packed, allowMissingColumns=True)
        seen = F.last("__r__", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__t__", "__s__").rowsBetween(Window.unboundedPreceding, 0))
        out = both.withColumn("__r__", seen).filter("__s__ = 1")
        return self._with(out.select("__l__.*", *[F.col("__r__")[c].alias(to) for c, to in named.items()]))

    # -- sets (an extension): union_all keeps repeated rows, the others give each row once

    def union_all(self, other: Frame) -> Frame:
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.to_spark().intersect(other.to_spark()))

    def difference(self, other: Frame) -> Frame:
        return Frame(self.to_spark().subtract(other.to_spark()))

    # -- shape changes ------------------------------------------------------

    def pivot_wider(self, names_from: str, values_from: str, id_cols: Sequence[str] = (), names: Sequence | None = None) -> Frame:
        """One column per value of ``names_from``, in order of first appearance; the first of several values wins.

        Missing names are skipped. ``names`` spares the pass that finds them.
        """
        ids = list(id_cols) or [c for c in self.columns if c not in (names_from, values_from)]
        if not ids:
            raise ComputeError("C0205", "pivot_wider needs a column that identifies rows")
        self._need(*ids, names_from, values_from)
        base = self._ordered()
        order = F.struct(*base.order)
        if names is None:
            seen = base.df.filter(F.col(names_from).isNotNull()).groupBy(names_from).agg(F.min(order).alias("o")).orderBy("o")
            names = [r[0] for r in seen.select(names_from).collect()]
        cell = F.struct(F.col(values_from).alias("v"), self._reason(values_from).alias("r"))
        wide = base.df.groupBy(*ids).pivot(names_from, list(names)).agg(F.min_by(cell, order))
        parts = [(str(n), F.col(f"`{c}`")) for n, c in zip(names, wide.columns[len(ids) :])]
        reasons = [x["r"].alias(_NA + n) for n, x in parts] if _NA + values_from in self.df.columns else []
        return Frame(wide.select(*ids, *[x["v"].alias(n) for n, x in parts], *reasons))

    def pivot_longer(self, columns: Sequence[str], names_to: str = "name", values_to: str = "value", id_cols: Sequence[str] | None = None) -> Frame:
        """One row per cell of ``columns``, all rows of the first column before those of the second."""
        self._need(*columns)
        ids = [c for c in self.columns if c not in columns] if id_cols is None else list(id_cols)
        base = self._ordered()
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias(names_to), F.col(c).alias(values_to), self._reason(c).alias(_NA + values_to)) for k, c in enumerate(columns)])
        kinds = {dict(self.df.dtypes)[c] for c in columns}
        if len(kinds) > 1:
            to = "string" if "string" in kinds else "double"
            cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias(names_to), F.col(c).cast(to).alias(values_to), self._reason(c).alias(_NA + values_to)) for k, c in enumerate(columns)])
        long = base.df.select(*ids, F.explode(cells).alias("cell"), F.struct(*base.order).alias("o"))
        long = long.select(*ids, f"cell.{names_to}", f"cell.{values_to}", F.col(f"cell.{_NA}{values_to}"), F.struct("cell.k", "o").alias(_ORDER))
        return Frame(long, (_ORDER,))

    # -- windows ----------------------------------------------------------
    # With ``by`` a group is one task's work; without, rows are dealt by range and no task has to take the table.

    def _window(self, by: Sequence[str]):
        base = self._ordered()
        return base, Window.partitionBy(*by).orderBy(*base.order)

    def lag(self, name: str, to: str, n: int = 1, by: Sequence[str] = ()) -> Frame:
        """The value n rows before; reasons shift too, and n below one changes nothing."""
        return self._shift(name, to, n, by, F.lag)

    def lead(self, name: str, to: str, n: int = 1, by: Sequence[str] = ()) -> Frame:
        return self._shift(name, to, n, by, F.lead)

    def _shift(self, name, to, n, by, function) -> Frame:
        self._need(name)
        base, w = self._window(by)
        moved = {to: name} | ({_NA + to: _NA + name} if _NA + name in base.df.columns else {})
        if n < 1:
            return base._with(base.df.withColumns({k: F.col(c) for k, c in moved.items()}))
        if not by:
            return base._with(ranges.shifted(base.df, base.order, n, moved, function is F.lead))
        return base._with(base.df.withColumns({k: function(c, n).over(w) for k, c in moved.items()}))

    def cumulate(self, name: str, to: str, kind: str = "sum", by: Sequence[str] = ()) -> Frame:
        """Running sum, product, max or min as doubles; from the first missing value on, all are missing, for its reason."""
        self._need(name)
        base, w = self._window(by)
        combine = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}[kind]
        value, gap = F.col(name).cast("double"), F.when(F.col(name).isNull(), F.struct(self._reason(name).alias("reason")))
        df = base.df
        if not by:
            df = ranges.dealt(df, base.order)
            first = (F.min_by(gap, F.when(F.col(name).isNull(), F.struct(*base.order))), lambda c: F.first(c, ignorenulls=True))
            df = df.join(ranges.before(df, __made__=(combine(value), combine), __gap__=first), ranges.PART)
            w = Window.partitionBy(ranges.PART).orderBy(*base.order)
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        made, missing = combine(value).over(w), F.first(gap, ignorenulls=True).over(w)
        if not by:
            together = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "max": F.greatest, "min": F.least}[kind]
            made, missing = F.when(F.col("__made__").isNull(), made).otherwise(together("__made__", made) if kind in ("max", "min") else together(F.col("__made__"), made)), F.coalesce("__gap__", missing)
        df = df.withColumn("__missing__", missing).withColumn(to, F.when(F.col("__missing__").isNull(), made))
        if _NA + name in base.df.columns:
            df = df.withColumn(_NA + to, F.col("__missing__.reason"))
        return base._with(df.drop("__missing__", "__made__", "__gap__", ranges.PART))

    def rank(self, name: str, to: str, by: Sequence[str] = ()) -> Frame:
        """Ascending rank, missing values first; ties get their mean rank.

        Values are counted first; ranks are sums over the counts of smaller
        values, so rows themselves are never sorted in one task.
        """
        self._need(name)
        counts = self.df.groupBy(*by, name).agg(F.count(F.lit(1)).alias("__k__"))
        up = F.col(name).asc_nulls_first()
        if by:
            earlier = F.sum("__k__").over(Window.partitionBy(*by).orderBy(up).rowsBetween(Window.unboundedPreceding, -1))
            counts = counts.withColumn("__b__", F.coalesce(earlier, F.lit(0)))
        else:
            counts = ranges.dealt(counts, [up])
            inside = F.sum("__k__").over(Window.partitionBy(ranges.PART).orderBy(up).rowsBetween(Window.unboundedPreceding, -1))
            counts = counts.join(ranges.before(counts, __p__=(F.sum("__k__"), F.sum)), ranges.PART).withColumn("__b__", F.coalesce("__p__", F.lit(0)) + F.coalesce(inside, F.lit(0)))
        keys = [*by, name]
        placed = counts.select(*[F.col(c).alias(f"__{i}__") for i, c in enumerate(keys)], (F.col("__b__") + (F.col("__k__") + 1) / 2.0).alias(to))
        same = [self.df[c].eqNullSafe(placed[f"__{i}__"]) for i, c in enumerate(keys)]
        return self._with(self.df.join(placed, same).drop(*[f"__{i}__" for i in range(len(keys))]))


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()
