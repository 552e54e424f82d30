"""Compiled scalars and the BLANK and coercion rules of the language.

A value is a Column with its static type: int, dbl, dec, str, bool, date, or
blank (NULL of no type yet). NULL is BLANK.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from types import FunctionType

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.model import SPARK_TYPE

NOT_CONST = object()
EPOCH = dt.datetime(1899, 12, 30)
NUMERIC = ("int", "dbl", "dec")


@dataclass(frozen=True)
class Val:
    """``made``: the Column, or for constants what makes it (a session may come later)."""

    made: Column | Callable[[], Column]
    type: str
    const: object = NOT_CONST

    @property
    def col(self) -> Column:
        return self.made() if isinstance(self.made, FunctionType) else self.made

    @property
    def is_const(self) -> bool:
        return self.const is not NOT_CONST


def lit(value: object, kind: str | None = None) -> Val:
    """A constant; the Column has the type's Spark type."""
    if kind is None:
        kind = "blank" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "dbl" if isinstance(value, float) else "date" if isinstance(value, dt.datetime) else "str"
    if value is None:
        return Val(lambda: F.lit(None).cast(SPARK_TYPE[kind]), kind, None)
    if kind == "dbl":
        value = float(value)
        return Val(lambda: F.lit(value), kind, value)
    if kind == "date":
        return Val(lambda: F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), kind, value)
    if kind == "int":
        if abs(value) >= 1 << 63:
            return lit(float(value))
        return Val(lambda: F.lit(value).cast("long"), kind, value)
    return Val(lambda: F.lit(value), kind, value)


BLANK = lit(None)


def epoch() -> Column:
    return F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")


def serial(date: Column) -> Column:
    """Days since 1899-12-30."""
    return F.timestamp_diff("MICROSECOND", epoch(), date) / F.lit(8.64e10)


def from_serial(number: Column) -> Column:
    whole = F.floor(number)
    micros = F.round((number - whole) * 8.64e10).cast("long")
    ok = number.between(-600000, 2958465)
    return F.when(ok, F.timestamp_add("MICROSECOND", micros, F.timestamp_add("DAY", whole.cast("int"), epoch())))


def number_text(x: Column, kind: str) -> Column:
    """A number as text: at most 15 significant digits, without trailing zeros.

    Fixed as long as that needs at most 15 decimals and 15 whole digits, else
    scientific with two exponent digits.
    """
    if kind == "int":
        return x.cast("string")
    x = x.cast("double")
    spelled = F.format_string("%.14e", F.abs(x))
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(spelled, "e", 1), r"\.", ""), "(?<=.)0+$", "")
    e = F.substring_index(spelled, "e", -1).cast("int")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
    whole = F.when(e >= 0, F.left(F.concat(digits, zeros(e + 1 - n)), e + 1)).otherwise("0")
    part = F.when(e >= 0, F.when(n > e + 1, F.substring(digits, e + 2, F.lit(20))).otherwise("")).otherwise(F.concat(zeros(-e - 1), digits))
    fixed = F.concat(sign, whole, F.when((part != "") & (digits != "0"), F.concat(F.lit("."), part)).otherwise(""))
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    scientific = F.concat(sign, F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(20)))).otherwise(""), F.lit("E"), power)
    fits = (n - 1 - e <= 15) & (e + 1 <= 15)
    odd = F.when(F.isnan(x), "-nan(ind)").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNull(), None).otherwise(F.coalesce(odd, F.when(fits, fixed).otherwise(scientific)))


def text(v: Val) -> Column:
    """The value as text; BLANK stays NULL."""
    if v.type == "str" or v.type == "blank":
        return v.col.cast("string")
    if v.type == "bool":
        return F.when(v.col, "TRUE").when(~v.col, "FALSE")
    if v.type == "date":
        day = F.date_format(v.col, "M/d/yyyy")
        midnight = (F.hour(v.col) == 0) & (F.minute(v.col) == 0) & (F.second(v.col) == 0)
        time_only = F.to_date(v.col) == F.lit("1899-12-30").cast("date")
        return F.when(time_only, F.date_format(v.col, "h:mm:ss a")).when(midnight, day).otherwise(F.date_format(v.col, "M/d/yyyy h:mm:ss a"))
    return number_text(v.col, v.type)


def text0(v: Val) -> Column:
    return F.coalesce(text(v), F.lit(""))


def number(v: Val) -> Column:
    """The value as a number (double unless int); BLANK stays NULL."""
    if v.type == "int" or v.type == "dbl":
        return v.col
    if v.type == "dec":
        return v.col.cast("double")
    if v.type == "bool":
        return v.col.cast("long")
    if v.type == "date":
        return serial(v.col)
    return F.expr("CAST(NULL AS DOUBLE)") if v.type == "blank" else v.col.try_cast("double")


def double(v: Val) -> Column:
    return number(v).cast("double")


def num_type(v: Val) -> str:
    return "int" if v.type in ("int", "bool") else "dbl"


def zero(kind: str) -> Column:
    return {"str": F.lit(""), "bool": F.lit(False), "date": epoch()}.get(kind, F.lit(0))


def truth(v: Val) -> Column:
    """Condition value: BLANK, 0 and FALSE are false."""
    if v.type == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.type == "str":
        return F.coalesce(F.lower(v.col) == "true", F.lit(False))
    if v.type == "blank":
        return F.lit(False)
    return F.coalesce(number(v) != 0, F.lit(False))


def date(v: Val) -> Column:
    if v.type == "date":
        return v.col
    if v.type == "str":
        return parse_date(v.col)
    if v.type == "blank":
        return F.lit(None).cast("timestamp_ntz")
    return from_serial(number(v))


def parse_date(c: Column) -> Column:
    """US month/day/year first, then day/month/year, then ISO."""
    tries = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in ("M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s", "M/d/yyyy h:m:s a", "d/M/yyyy")]
    return F.coalesce(*tries, c.try_cast("timestamp_ntz"))


def same_type(values: list[Val]) -> tuple[list[Column], str]:
    """Columns of one type for the branches of IF, SWITCH, COALESCE, tables."""
    kinds = {v.type for v in values if v.type != "blank"}
    if not kinds:
        return [v.col for v in values], "blank"
    if len(kinds) == 1:
        kind = kinds.pop()
    elif kinds <= {"int", "dbl", "dec", "bool"}:
        kind = "dbl" if kinds & {"dbl", "dec"} else "int"
    elif kinds <= {"int", "dbl", "dec", "date"}:
        kind = "date"
    else:
        kind = "str"
    return [cast(v, kind) for v in values], kind


def cast(v: Val, kind: str) -> Column:
    if v.type == kind:
        return v.col
    if v.type == "blank":
        return F.lit(None).cast(SPARK_TYPE[kind])
    if kind == "str":
        return text(v)
    if kind == "date":
        return date(v)
    if kind == "bool":
        return F.when(v.col.isNull(), None).otherwise(truth(v))
    return number(v).try_cast(SPARK_TYPE[kind])


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "&":
        if a.is_const and b.is_const and isinstance(a.const, str) and isinstance(b.const, str):
            return lit(a.const + b.const)
        both = text(a).isNull() & text(b).isNull()
        return Val(F.when(both, F.lit(None).cast("string")).otherwise(F.concat(text0(a), text0(b))), "str")
    if a.is_const and b.is_const and type(a.const) in (int, float) and type(b.const) in (int, float) and op not in "/^":
        return lit(a.const + b.const if op == "+" else a.const - b.const if op == "-" else a.const * b.const)
    if op in "/^" and a.is_const and b.is_const and type(a.const) in (int, float) and type(b.const) in (int, float) and b.const > 0:
        return lit(float(a.const / b.const) if op == "/" else float(a.const) ** b.const)
    x, y = number(a), number(b)
    whole = all(v.type in ("int", "bool", "blank") for v in (a, b))
    to = "long" if whole else "double"
    x, y = (c.cast(to) if whole or v.type != "dbl" else c for c, v in ((x, a), (y, b)))
    if op == "*":
        return Val(x * y, "int" if whole else "dbl")
    if op == "^":
        return Val(F.pow(x.cast("double"), y.cast("double")), "dbl")
    if op == "/":
        x, y = x.cast("double"), F.coalesce(y.cast("double"), F.lit(0.0))
        inf = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Val(F.when(x.isNull(), None).when(y == 0, inf).otherwise(F.try_divide(x, y)), "dbl")
    zero_ = F.lit(0).cast("long") if whole else F.lit(0.0)
    p, q = F.coalesce(x, zero_), F.coalesce(y, zero_)
    made = F.when(x.isNull() & y.isNull(), None).otherwise(p + q if op == "+" else p - q)
    dates = (a.type == "date") + (b.type == "date")
    if dates == 1 and (op == "+" or a.type == "date"):
        return Val(from_serial(made), "date")
    return Val(made, "int" if whole else "dbl")


def compare(op: str, a: Val, b: Val) -> Val:
    if a.type == b.type == "blank":
        return lit(op in ("=", "==", "<=", ">="))
    if op == "==":
        x, y = _comparable(a, b)
        return Val(x.eqNullSafe(y), "bool")
    x, y = _comparable(a, b)
    kind = a.type if a.type != "blank" else b.type
    other = b.type if b.type != "blank" else a.type
    z = zero(kind) if kind == other else F.lit("") if "str" in (kind, other) else F.lit(0)
    x, y = F.coalesce(x, z), F.coalesce(y, z)
    made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Val(made, "bool")


def _comparable(a: Val, b: Val) -> tuple[Column, Column]:
    kinds = {a.type, b.type} - {"blank"}
    if len(kinds) == 1:
        kind = kinds.pop()
        return cast(a, kind), cast(b, kind)
    if kinds <= {"int", "dbl", "dec", "bool", "date"}:
        return double(a), double(b)
    if kinds == {"str", "date"}:
        return date(a), date(b)
    if "str" in kinds and kinds & set(NUMERIC):
        return double(a), double(b)
    if "str" in kinds:
        return text(a), text(b)
    raise DaxError(f"{a.type} and {b.type} can't be compared")
