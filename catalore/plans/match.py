"""Attribute predicates as columns, for queries and for records being scanned."""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import Column, functions as F

from catalore.functions.text import like
from catalore.plans.model import NUMERIC, Match, QueryError

_AFFIX = {"startswith": ("{}%", True), "endswith": ("%{}", True), "contains": ("%{}%", True), "not_startswith": ("{}%", False), "not_endswith": ("%{}", False), "not_contains": ("%{}%", False)}


def _compare(op: str, c: Column, v: Any) -> Column:
    return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]


def _value(name: str, v: Any) -> Any:
    """A value of the column's kind; numbers in strings count for numeric columns."""
    if name in NUMERIC and isinstance(v, str):
        try:
            return float(v) if "." in v or "e" in v.lower() else int(v)
        except ValueError as e:
            raise QueryError(f"{name} needs a number, not {v!r}") from e
    if name == "available":
        return bool(v)
    return v if name in NUMERIC else str(v)


def operations(ops: dict[str, dict[str, Any]], column: Callable[[str], Column], missing: Callable[[str], bool] | None = None, wildcards: bool = True) -> Column:
    """All operations of one record joined by AND.

    ``missing`` names columns that the record lacks, whose operations are then
    skipped. Without ``wildcards`` affixes are literal.
    """
    out = F.lit(True)
    for op, values in ops.items():
        for name, v in values.items():
            if missing and missing(name):
                continue
            c = column(name)
            if op in ("in_", "nin"):
                if not isinstance(v, (list, tuple)) or not v:
                    raise QueryError(f"{op} needs a list of values for {name}")
                hit = c.isin(*[_value(name, x) for x in v])
                test = hit if op == "in_" else ~hit
            elif op in _AFFIX:
                pattern, wanted = _AFFIX[op]
                text = c.cast("string")
                kind = op.removeprefix("not_")
                each = [like(text, pattern.format(x)) if wildcards else getattr(text, kind)(F.lit(str(x))) for x in (v if isinstance(v, (list, tuple)) else [v])]
                test = each[0]
                for e in each[1:]:
                    test = test | e
                test = test if wanted else ~test
            else:
                test = _compare(op, c, _value(name, v))
            # a record without the value is not judged by it
            out = out & (F.coalesce(test, F.lit(True)) if missing is not None else test)
    return out


def condition(match: Match, column: Callable[[str], Column], missing: Callable[[str], bool] | None = None, wildcards: bool = True) -> Column:
    """A match filter as a column: null where SQL's three-valued logic gives null."""
    parts = [operations(p, column, missing, wildcards) for p in match.parts]
    out = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        out = out | p if match.kind == "or" else out & p
    return ~out if match.kind == "not" else out


def scanned(match: Match, fields: set[str]) -> Column:
    """The condition over a record being scanned: literal affixes, missing fields skipped."""
    return condition(match, F.col, missing=lambda n: n not in fields, wildcards=False)


def columns_of(match: Match) -> set[str]:
    """The columns a match filter looks at."""
    return {c for p in match.parts for values in p.values() for c in values}
