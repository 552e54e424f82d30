"""The predicate language of filter contexts: {"T[c]" or "T.c": values or condition}."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.model import SemanticModel
from cubewright.plans.context import Pred
from cubewright.plans.values import cast, lit

#: Days of a unit of relative_date (fixed values: months and years are whole days).
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}


def where_of(model: SemanticModel, key: str) -> tuple[str, str]:
    if "[" in key:
        return model._column(key)
    table, _, column = key.partition(".")
    table = model.table_name(table.strip("'"))
    return table, model.column_name(table, column)


def context_items(model: SemanticModel, filters: dict) -> tuple[Pred, ...]:
    out = []
    for key, spec in filters.items():
        where = where_of(model, key)
        kind = model.column_type(*where)
        out.append(Pred((where,), lambda column, where=where, spec=spec, kind=kind: condition(column(*where), spec, kind)))
    return tuple(out)


def value(x: object, kind: str) -> Column:
    """A listed value as the column's type; dates may be ISO text."""
    if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        x = dt.datetime(x.year, x.month, x.day)
    if kind == "date" and isinstance(x, str):
        return F.lit(x).cast("timestamp_ntz")
    v = lit(x)
    return v.col if v.type == kind else cast(v, kind)


def condition(c: Column, spec: object, kind: str) -> Column:
    if isinstance(spec, (list, tuple, set)):
        listed = [x for x in spec if x is not None]
        hit = c.isin(*[value(x, kind) for x in listed]) if listed else F.lit(False)
        return (F.coalesce(hit, F.lit(False)) | c.isNull()) if any(x is None for x in spec) else hit
    if not isinstance(spec, dict):
        return condition(c, [spec], kind)
    parts = []
    low = F.lower(c.cast("string"))
    for name, arg in spec.items():
        if name == "op":
            op, other = arg, spec.get("value")
            x, y = (c, F.lit(None)) if other is None else (c, value(other, kind))
            if other is None:
                parts.append(c.isNull() if op in ("=", "==") else c.isNotNull())
                continue
            try:
                parts.append({"=": x == y, "==": x == y, "<>": ~F.coalesce(x == y, F.lit(False)), "!=": ~F.coalesce(x == y, F.lit(False)), "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
            except KeyError:
                raise DaxError(f"no operator {op}") from None
        elif name == "value":
            continue
        elif name == "between":
            parts.append(c.between(value(arg[0], kind), value(arg[1], kind)))
        elif name == "in":
            parts.append(condition(c, list(arg), kind))
        elif name == "not_in":
            parts.append(~F.coalesce(condition(c, list(arg), kind), F.lit(False)))
        elif name == "contains":
            parts.append(F.coalesce(low.contains(str(arg).lower()), F.lit(False)))
        elif name == "starts_with":
            parts.append(F.coalesce(low.startswith(str(arg).lower()), F.lit(False)))
        elif name == "ends_with":
            parts.append(F.coalesce(low.endswith(str(arg).lower()), F.lit(False)))
        elif name == "is_blank":
            blank = c.isNull() | (c == "") if kind == "str" else c.isNull()
            parts.append(F.coalesce(blank, F.lit(True)) if arg else ~F.coalesce(blank, F.lit(True)))
        elif name == "relative_date":
            parts.append(relative(c, arg))
        elif name == "all":
            parts.append(reduce(lambda a, b: a & b, [condition(c, x, kind) for x in arg], F.lit(True)))
        else:
            raise DaxError(f"no predicate '{name}'")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def relative(c: Column, arg: dict) -> Column:
    which, n = ("last", arg["last"]) if "last" in arg else ("next", arg["next"]) if "next" in arg else (arg.get("direction", "last"), arg["n"])
    days = int(n) * UNIT_DAYS[str(arg.get("unit", "day")).lower().rstrip("s")]
    anchor = F.lit(str(arg["anchor"])).cast("timestamp_ntz") if arg.get("anchor") else F.current_date().cast("timestamp_ntz")
    other = F.timestamp_add("DAY", F.lit(-days if which == "last" else days), anchor)
    return c.between(other, anchor) if which == "last" else c.between(anchor, other)
