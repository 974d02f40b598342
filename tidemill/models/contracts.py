"""Data contracts: expectations on columns, checked in one pass."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple = field(default=())

    def _with(self, kind: str, **args) -> Contract:
        return Contract(self.name, (*self.rules, (kind, args)))

    def expect_range(self, column: str, low: float, high: float) -> Contract:
        """All values are there and within the range."""
        return self._with("range", column=column, low=low, high=high)

    def expect_na_max(self, column: str, share: float) -> Contract:
        return self._with("na", column=column, share=share)

    def expect_outlier_rule(self, column: str, factor: float = 1.5, share: float = 0.0) -> Contract:
        """At most ``share`` of the values beyond ``factor`` interquartile ranges from the quartiles."""
        return self._with("outlier", column=column, factor=factor, share=share)

    def expect_unique(self, column: str) -> Contract:
        return self._with("unique", column=column)

    def expect_column_names(self, *names: str) -> Contract:
        return self._with("schema", names=list(names))

    def expect_min_sample_size(self, n: int) -> Contract:
        return self._with("sample", n=n)

    def expect_vif_max(self, formula: str, most: float) -> Contract:
        return self._with("vif", formula=formula, most=most)

    def expect_vcov_kind(self, kind: str) -> Contract:
        return self._with("vcov", kind=kind)

    def digest(self) -> str:
        """SHA-256 of the name and all rules."""
        return hashlib.sha256(json.dumps([self.name, self.rules], sort_keys=True, default=list).encode()).hexdigest()


def new_contract(name: str) -> Contract:
    return Contract(name)


def verify(contract: Contract, df: DataFrame, vcov_kind: str | None = None) -> dict:
    """A receipt: each rule with what was found and whether it holds. One aggregate for all rules, one more if there are outlier rules."""
    aggs: dict[str, Column] = {"n": F.count(F.lit(1))}
    for i, (kind, a) in enumerate(contract.rules):
        c = a.get("column")
        if c is not None and c not in df.columns:
            continue
        if kind == "range":
            aggs |= {f"low{i}": F.min(c), f"high{i}": F.max(c), f"na{i}": F.sum(F.col(c).isNull().cast("long"))}
        elif kind == "na":
            aggs[f"na{i}"] = F.avg(F.col(c).isNull().cast("double"))
        elif kind == "unique":
            aggs |= {f"d{i}": F.count_distinct(c), f"na{i}": F.sum(F.col(c).isNull().cast("long"))}
        elif kind == "outlier":
            aggs[f"q{i}"] = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    found = df.agg(*[v.alias(k) for k, v in aggs.items()]).collect()[0].asDict()
    fences = {}
    for i, (kind, a) in enumerate(contract.rules):
        if kind == "outlier" and found.get(f"q{i}"):
            q1, q3 = found[f"q{i}"]
            reach = a["factor"] * (q3 - q1)
            fences[f"o{i}"] = F.avg(((F.col(a["column"]) < q1 - reach) | (F.col(a["column"]) > q3 + reach)).cast("double"))
    if fences:
        found |= df.agg(*[v.alias(k) for k, v in fences.items()]).collect()[0].asDict()
    rules = []
    for i, (kind, a) in enumerate(contract.rules):
        value, ok = None, False
        c = a.get("column")
        if c is not None and c not in df.columns:
            value = "no such column"
        elif kind == "range":
            value = (found[f"low{i}"], found[f"high{i}"])
            ok = value[0] is not None and not found[f"na{i}"] and value[0] >= a["low"] and value[1] <= a["high"]
        elif kind == "na":
            value = found[f"na{i}"] or 0.0
            ok = value <= a["share"]
        elif kind == "unique":
            value = found["n"] - found[f"d{i}"] - (1 if found[f"na{i}"] else 0)
            ok = value == 0
        elif kind == "outlier":
            value = found.get(f"o{i}") or 0.0
            ok = value <= a["share"]
        elif kind == "schema":
            value = [x for x in a["names"] if x not in df.columns]
            ok = not value
        elif kind == "sample":
            value = found["n"]
            ok = value >= a["n"]
        elif kind == "vif":
            from .linear import ols

            value = max(ols(a["formula"], df).stats["vif"].values(), default=1.0)
            ok = value <= a["most"]
        elif kind == "vcov":
            value = vcov_kind
            ok = vcov_kind is not None and vcov_kind.lower() == a["kind"].lower()
        rules.append(dict(rule=kind, **{k: v for k, v in a.items()}, found=value, holds=bool(ok)))
    return dict(contract=contract.name, digest=contract.digest(), n=found["n"], rules=rules, holds=all(r["holds"] for r in rules))


def enforce(contract: Contract, df: DataFrame) -> DataFrame:
    """Rows within all range rules."""
    for kind, a in contract.rules:
        if kind == "range":
            df = df.filter(F.col(a["column"]).between(a["low"], a["high"]))
    return df
