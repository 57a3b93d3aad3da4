"""Metadata filters: a condition tree and a dict form, compiled to Catalyst predicates.

Logic is two-valued: a missing field makes a condition false, also `ne` and
`not_in`, and NOT of that is true.  Comparison across kinds (long, double,
string, boolean) is false, except that `ne` and `not_in` are then true.  NaN
satisfies ge and le with every double, and equals nothing.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: `$ne`, `$not_in` and `$contains` are an extension of the dict form
OPERATORS = {"$eq": "eq", "$gt": "gt", "$ge": "ge", "$lt": "lt", "$le": "le", "$in": "in", "$ne": "ne", "$not_in": "not_in", "$contains": "contains"}
_KINDS = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double", "string": "string", "boolean": "boolean"}


def kind_of(value: Any) -> str:
    for t, k in ((bool, "boolean"), (int, "long"), (float, "double"), (str, "string")):
        if isinstance(value, t):
            return k
    raise ValueError(f"Unsupported filter value: {value!r}")


@dataclass
class Condition:
    name: str
    op: str
    value: Any

    def compile(self, fields: dict[str, tuple[Column, str]]) -> Column:
        if self.name not in fields:
            return F.lit(False)
        c, kind = fields[self.name]
        there, never = c.isNotNull(), F.lit(False)
        if self.op in ("in", "not_in"):
            same = [v for v in self.value if kind_of(v) == kind]
            hit = functools.reduce(lambda a, b: a | b, [self._equal(c, kind, v) for v in same], never)
            return F.coalesce(there & (hit if self.op == "in" else ~hit), never)
        same = kind_of(self.value) == kind
        if self.op in ("eq", "ne"):
            hit = self._equal(c, kind, self.value) if same else never
            return F.coalesce(there & (hit if self.op == "eq" else ~hit), never)
        if self.op == "contains":
            return F.coalesce(c.contains(self.value), never) if same and kind == "string" else never
        if not same:
            return never
        v = F.lit(self.value)
        out = {"gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[self.op]
        if kind == "double":
            nan = F.isnan(c) | F.isnan(v)
            out = F.when(nan, F.lit(self.op in ("ge", "le"))).otherwise(out)
        return F.coalesce(there & out, never)

    def bare(self, fields: dict[str, tuple[Column, str]]) -> Column:
        """The same rows where null counts as false: plain comparisons, which reach the scan."""
        if self.name not in fields:
            return F.lit(False)
        c, kind = fields[self.name]
        if self.op in ("in", "not_in"):
            same = [v for v in self.value if kind_of(v) == kind and v == v]
            if self.op == "in":
                return c.isin(same) if same else F.lit(False)
            return ~c.isin(same) if same else c.isNotNull()
        if self.op == "contains":
            return c.contains(self.value) if kind == "string" and isinstance(self.value, str) else F.lit(False)
        if kind_of(self.value) != kind:
            return c.isNotNull() if self.op == "ne" else F.lit(False)
        v, nan = F.lit(self.value), self.value != self.value
        if nan:
            return c.isNotNull() if self.op in ("ne", "ge", "le") else F.lit(False)
        out = {"eq": c == v, "ne": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[self.op]
        if kind == "double" and self.op in ("gt", "le"):  # NaN is Spark's largest number
            out = out & ~F.isnan(c) if self.op == "gt" else out | F.isnan(c)
        return out

    @staticmethod
    def _equal(c: Column, kind: str, value: Any) -> Column:
        eq = c == F.lit(value)
        return eq & ~F.isnan(c) if kind == "double" else eq


@dataclass
class Filter:
    """AND, OR or NOT (of its first part) over conditions, then sub-filters; empty is true."""

    logic: str = "and"
    conditions: list[Condition] = field(default_factory=list)
    filters: list["Filter"] = field(default_factory=list)

    def add(self, name: str, op: str, value: Any) -> "Filter":
        self.conditions.append(Condition(name, op, value))
        return self

    def add_filter(self, other: "Filter") -> "Filter":
        self.filters.append(other)
        return self

    def compile(self, fields: dict[str, tuple[Column, str]]) -> Column:
        parts = [c.compile(fields) for c in self.conditions] + [f.compile(fields) for f in self.filters]
        if not parts:
            return F.lit(True)
        if self.logic == "not":
            return ~parts[0]
        join = (lambda a, b: a & b) if self.logic == "and" else (lambda a, b: a | b)
        return functools.reduce(join, parts)


    def bare(self, fields: dict[str, tuple[Column, str]]) -> Column:
        if self.logic == "not" or not (self.conditions or self.filters):
            return self.compile(fields)
        join = (lambda a, b: a & b) if self.logic == "and" else (lambda a, b: a | b)
        return functools.reduce(join, [x.bare(fields) for x in [*self.conditions, *self.filters]])

    # named builders; each returns the filter
    def add_eq(self, name: str, value: Any) -> "Filter":
        return self.add(name, "eq", value)

    def add_gt(self, name: str, value: Any) -> "Filter":
        return self.add(name, "gt", value)

    def add_ge(self, name: str, value: Any) -> "Filter":
        return self.add(name, "ge", value)

    def add_lt(self, name: str, value: Any) -> "Filter":
        return self.add(name, "lt", value)

    def add_le(self, name: str, value: Any) -> "Filter":
        return self.add(name, "le", value)

    def add_in(self, name: str, values: list) -> "Filter":
        return self.add(name, "in", values)


def from_dict(spec: dict) -> Filter:
    """`$or` beside other keys makes the whole dict a disjunction; `$and` doesn't change it."""
    out = Filter()
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if key == "$or":
                out.logic = "or"
            for sub in value:
                out.add_filter(from_dict(sub))
        elif isinstance(value, dict):
            for op, v in value.items():
                if op not in OPERATORS:
                    raise ValueError(f"Unsupported operator: {op}")
                out.add(key, OPERATORS[op], v)
        elif isinstance(value, (list, tuple, set)):
            raise ValueError(f"A list needs $in: {key}")
        else:
            out.add(key, "eq", value)
    return out


def predicate(df, spec: dict | Filter | None) -> Column:
    """Two-valued predicate over the typed columns of a DataFrame, for projections and under NOT."""
    return tree_of(spec).compile(fields_of(df))


def tree_of(spec: dict | Filter | None) -> Filter:
    return spec if isinstance(spec, Filter) else from_dict(spec or {})


def fields_of(df) -> dict[str, tuple[Column, str]]:
    return {n: (F.col(n), _KINDS[t]) for n, t in df.dtypes if t in _KINDS}


def matching(df, spec: dict | Filter | None):
    """The rows that match; comparisons outside NOT are plain, so that the scan gets them."""
    tree = tree_of(spec)
    return df.where(tree.bare(fields_of(df))) if tree.conditions or tree.filters else df


def matching_ids(df, ids, spec: dict | Filter | None, key: str = "id"):
    """(key, matches) for each of a table of keys; unknown keys don't match."""
    flagged = df.select(key, predicate(df, spec).alias("matches"))
    return ids.join(flagged, key, "left").withColumn("matches", F.coalesce("matches", F.lit(False)))


def allowed_values(left: list | None, right: list | None) -> list | None:
    """Values that two EQ or IN conditions on a field leave; None is no condition."""
    if left is None or right is None:
        return right if left is None else left
    return [v for v in left if any(type(v) is type(w) and v == w for w in right)]
