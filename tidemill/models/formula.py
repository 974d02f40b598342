"""Formulas and design columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatError

#: Levels that a categorical term may have; their list comes to the driver.
MOST_LEVELS = 10_000


@dataclass(frozen=True)
class Formula:
    """``y ~ a + b:c | d``: response, terms, and the terms after each bar."""

    response: str
    terms: tuple[str, ...]
    parts: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def parse(cls, text: str) -> Formula:
        left, _, right = text.partition("~")
        if not left.strip() or not right.strip():
            raise StatError("S0201", f"not a formula: {text}")
        pieces = [tuple(t.strip().replace("*", ":").replace(" ", "") for t in p.split("+") if t.strip()) for p in right.split("|")]
        return cls(left.strip(), tuple(t for t in pieces[0] if t != "1"), tuple(pieces[1:]))


@dataclass
class Design:
    """Named numeric columns of a model, with the levels seen when it was fitted."""

    formula: Formula
    intercept: bool
    names: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def sources(self) -> list[str]:
        return sorted({x for t in self.formula.terms for x in t.split(":")})


def _contrasts(name: str, levels: list[str], scheme: str) -> list[tuple[str, Column]]:
    c = F.col(name)
    k = len(levels)
    if scheme == "treatment":
        return [(f"{name}{v}", F.when(c == v, 1.0).when(c.isNotNull(), 0.0)) for v in levels[1:]]
    if scheme == "sum":
        return [(f"{name}{i + 1}", F.when(c == v, 1.0).when(c == levels[-1], -1.0).when(c.isNotNull(), 0.0)) for i, v in enumerate(levels[:-1])]
    if scheme == "helmert":
        out = []
        for i in range(1, k):
            out.append((f"{name}{i}", F.when(c == levels[i], float(i)).when(c.isin(levels[:i]), -1.0).when(c.isNotNull(), 0.0)))
        return out
    if scheme == "polynomial":
        import numpy as np

        x = np.arange(1, k + 1) - (k + 1) / 2
        q, r = np.linalg.qr(np.vander(x, k, increasing=True))
        q = q * np.sign(np.diag(r))
        out = []
        for d in range(1, k):
            e = F.lit(None).cast("double")
            for v, w in zip(levels, q[:, d].tolist()):
                e = F.when(c == v, w).otherwise(e)
            out.append((f"{name}^{d}", e))
        return out
    raise StatError("S0206", f"no contrast scheme {scheme}")


def design(df: DataFrame, formula: Formula, intercept: bool = True, contrasts: dict[str, str] | None = None) -> Design:
    """Design columns: numbers as they are, strings by contrasts over their sorted levels, ``a:b`` as products."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = Design(formula, intercept)
    for x in [formula.response, *made.sources]:
        if x not in kinds:
            raise StatError("S0201", f"no column {x}")
    parts: dict[str, list[tuple[str, Column]]] = {}
    for x in made.sources:
        if isinstance(kinds[x], T.StringType):
            found = [r[0] for r in df.select(x).filter(F.col(x).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
            if not 2 <= len(found) <= MOST_LEVELS:
                raise StatError("S0206", f"{x} has {len(found)} levels")
            made.levels[x] = sorted(found)
            parts[x] = _contrasts(x, made.levels[x], (contrasts or {}).get(x, "treatment"))
        else:
            parts[x] = [(x, F.col(x).cast("double"))]
    for term in formula.terms:
        cells = [("", None)]
        for x in term.split(":"):
            cells = [(f"{a}:{n}" if a else n, c if b is None else b * c) for a, b in cells for n, c in parts[x]]
        for n, c in cells:
            made.names.append(n)
            made.columns.append(c)
    return made


def complete(df: DataFrame, made: Design, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(rows without a missing or NaN cell, names of the numeric columns y, x0, x1, ...)."""
    y = F.col(made.formula.response).cast("double").alias("__y")
    xs = [c.cast("double").alias(f"__x{i}") for i, c in enumerate(made.columns)]
    out = df.select(*[F.col(k) for k in dict.fromkeys(keep)], y, *xs)
    names = ["__y", *[f"__x{i}" for i in range(len(xs))]]
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n)
    return out.filter(ok), names


def escape(name: str) -> str:
    return re.sub(r"\W", "_", name)
