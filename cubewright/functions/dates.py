"""Date and time scalars as Columns over TIMESTAMP_NTZ."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame
from cubewright.plans.planner import SCALARS, Planner, keyword, special
from cubewright.plans.values import Val, date, double, epoch, lit, parse_date, serial, text

from .formats import format_value


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def make_date(y: Val, m: Val, d: Val) -> Val:
    """Months and days beyond their range roll over."""
    if all(x.is_const and type(x.const) is int for x in (y, m, d)) and 1900 <= y.const <= 9000:
        months = y.const * 12 + m.const - 1
        first = dt.datetime(months // 12, months % 12 + 1, 1)
        return lit(first + dt.timedelta(days=d.const - 1))
    a, b, c = (F.coalesce(double(x), F.lit(0.0)).cast("int") for x in (y, m, d))
    a = F.when((a >= 0) & (a <= 1899), a + 1900).otherwise(a)
    ok = a.between(1, 9999)
    start = F.make_date(F.when(ok, a), F.lit(1), F.lit(1))
    blank = y.col.isNull() & m.col.isNull() & d.col.isNull()
    return Val(F.when(~blank & ok, ntz(F.date_add(F.add_months(start, b - 1), c - 1))), "date")


def time(h: Val, m: Val, sec: Val) -> Val:
    total = F.coalesce(double(h), F.lit(0.0)) * 3600 + F.coalesce(double(m), F.lit(0.0)) * 60 + F.coalesce(double(sec), F.lit(0.0))
    return Val(F.timestamp_add("SECOND", F.pmod(total, F.lit(86400.0)).cast("int"), epoch()), "date")


def date_value(v: Val) -> Val:
    return Val(F.date_trunc("DAY", parse_date(F.trim(v.col))).cast("timestamp_ntz"), "date") if v.type == "str" else Val(date(v), "date")


def time_value(v: Val) -> Val:
    t = F.concat(F.lit("1899-12-30 "), F.upper(F.trim(text(v))))
    tries = [F.try_to_timestamp(t, F.lit(f"yyyy-MM-dd {p}")).cast("timestamp_ntz") for p in ("H:m:s", "H:m", "h:m:s a", "h:m a")]
    return Val(F.coalesce(*tries), "date")


def _part(f):
    def made(v: Val) -> Val:
        return Val(f(date(v)).cast("long"), "int")

    return made


def weekday(v: Val, kind: Val = lit(1)) -> Val:
    d = date(v)
    n = {1: F.dayofweek(d), 2: F.weekday(d) + 1, 3: F.weekday(d)}[int(kind.const or 1)]
    return Val(n.cast("long"), "int")


def weeknum(v: Val, kind: Val = lit(1)) -> Val:
    """The week with January 1 is the first; 21 is the ISO week."""
    d = date(v)
    if int(kind.const or 1) == 21:
        return Val(F.weekofyear(d).cast("long"), "int")
    first = F.trunc(d, "year")
    offset = F.dayofweek(first) - 1 if int(kind.const or 1) in (1, 17) else F.weekday(first)
    return Val((F.floor((F.dayofyear(d) - 1 + offset) / 7) + 1).cast("long"), "int")


def edate(v: Val, n: Val) -> Val:
    d = date(v)
    return Val(ntz(F.add_months(d, double(n).cast("int"))), "date")


def eomonth(v: Val, n: Val) -> Val:
    return Val(ntz(F.last_day(F.add_months(date(v), double(n).cast("int")))), "date")


def date_diff(a: Val, b: Val, unit: str) -> Val:
    """Boundaries of the unit crossed from ``a`` to ``b``."""
    x, y = date(a), date(b)
    months = lambda d: F.year(d) * 12 + F.month(d)
    seconds = lambda d: F.floor(F.timestamp_diff("MICROSECOND", epoch(), d) / 1e6)
    days = lambda d: F.floor(serial(d))
    made = {
        "YEAR": F.year(y) - F.year(x),
        "QUARTER": (F.year(y) * 4 + F.quarter(y)) - (F.year(x) * 4 + F.quarter(x)),
        "MONTH": months(y) - months(x),
        "WEEK": F.floor((days(y) - 1) / 7) - F.floor((days(x) - 1) / 7),  # day 1 is a Sunday
        "DAY": days(y) - days(x),
        "HOUR": F.floor(seconds(y) / 3600) - F.floor(seconds(x) / 3600),
        "MINUTE": F.floor(seconds(y) / 60) - F.floor(seconds(x) / 60),
        "SECOND": seconds(y) - seconds(x),
    }[unit]
    return Val(made.cast("long"), "int")


@special("DATEDIFF")
def _date_diff(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    return date_diff(p.scalar(node.args[0], frame, env), p.scalar(node.args[1], frame, env), keyword(node.args[2]))


@special("FORMAT")
def _format(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    v, pattern = p.scalar(node.args[0], frame, env), p.scalar(node.args[1], frame, env)
    culture = p.scalar(node.args[2], frame, env).const if len(node.args) > 2 else p.model.culture
    return format_value(v, pattern, str(culture))


def day_360(x: Column, y: Column, european: bool) -> Column:
    a, b = F.dayofmonth(x), F.dayofmonth(y)
    if european:
        a, b = F.least(a, F.lit(30)), F.least(b, F.lit(30))
    else:
        ends = (x == F.last_day(x)) & (F.month(x) == 2)
        both = ends & (y == F.last_day(y)) & (F.month(y) == 2)
        b = F.when(both, 30).otherwise(b)
        a = F.when(ends, 30).otherwise(a)
        b = F.when((b == 31) & (a >= 30), 30).otherwise(b)
        a = F.least(a, F.lit(30))
    return (F.year(y) - F.year(x)) * 360 + (F.month(y) - F.month(x)) * 30 + (b - a)


def yearfrac(a: Val, b: Val, basis: Val = lit(0)) -> Val:
    p, r = date(a).cast("date"), date(b).cast("date")
    x, y = F.least(p, r), F.greatest(p, r)
    kind, days = int(basis.const or 0), F.datediff(y, x)
    if kind in (0, 4):
        made = day_360(x, y, kind == 4) / 360.0
    elif kind == 2:
        made = days / 360.0
    elif kind == 3:
        made = days / 365.0
    elif kind == 1:
        leap = lambda yr: ((yr % 4 == 0) & ((yr % 100 != 0) | (yr % 400 == 0)))
        first, last = F.year(x), F.year(y)
        years = last - first + 1
        average = (F.datediff(F.make_date(last + 1, F.lit(1), F.lit(1)), F.make_date(first, F.lit(1), F.lit(1)))) / years
        feb29 = lambda yr: F.when(leap(yr), F.to_date(F.concat(yr.cast("string"), F.lit("-02-29"))))
        short = (y <= F.add_months(x, 12))
        has = (leap(first) & (first == last)) | F.coalesce((feb29(first) >= x) & (feb29(first) <= y), F.lit(False)) | F.coalesce((feb29(last) >= x) & (feb29(last) <= y), F.lit(False))
        made = days / F.when(short, F.when(has, 366).otherwise(365)).otherwise(average)
    else:
        raise DaxError("the basis is 0 to 4")
    return Val(made.cast("double"), "dbl")


def network_days(a: Val, b: Val, weekend: Val = lit(1), *holidays: Val) -> Val:
    """Working days from ``a`` to ``b``, both included; by arithmetic on weeks.

    Weekend codes 1 to 7 name two days, 11 to 17 one.
    """
    code = int(weekend.const or 1)
    # Days of the week off, Monday = 0.
    off = {(code + 4) % 7, (code + 5) % 7} if code <= 7 else {(code - 12) % 7}
    x, y = date(a).cast("date"), date(b).cast("date")
    lo, hi, sign = F.least(x, y), F.greatest(x, y), F.when(x <= y, 1).otherwise(-1)
    n = F.datediff(hi, lo) + 1
    out = n
    for day in sorted(off):
        ahead = F.pmod(F.lit(day) - F.weekday(lo), F.lit(7))
        out = out - F.when(ahead < n, F.floor((n - 1 - ahead) / 7) + 1).otherwise(0)
    return Val((sign * out).cast("long"), "int")


SCALARS |= {
    "DATE": make_date,
    "TIME": time,
    "DATEVALUE": date_value,
    "TIMEVALUE": time_value,
    "YEAR": _part(F.year),
    "QUARTER": _part(F.quarter),
    "MONTH": _part(F.month),
    "DAY": _part(F.dayofmonth),
    "HOUR": _part(F.hour),
    "MINUTE": _part(F.minute),
    "SECOND": _part(F.second),
    "WEEKDAY": weekday,
    "WEEKNUM": weeknum,
    "EDATE": edate,
    "EOMONTH": eomonth,
    "YEARFRAC": yearfrac,
    "NETWORKDAYS": network_days,
    "NOW": lambda: Val(F.localtimestamp(), "date"),
    "TODAY": lambda: Val(F.current_date().cast("timestamp_ntz"), "date"),
    "UTCNOW": lambda: Val(F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()), "date"),
    "UTCTODAY": lambda: Val(F.date_trunc("DAY", F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())).cast("timestamp_ntz"), "date"),
}
