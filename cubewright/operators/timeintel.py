"""Time intelligence: sets of dates derived from the visible dates of a context.

For each context the visible dates give bounds (or, for shifts, contiguous
runs); the dates of the unfiltered date table inside the new bounds are found
by a range join of contexts with the calendar, both small next to any fact
table. As a filter of CALCULATE the dates replace all filters of their table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame, Out, Rel, fresh, q
from cubewright.plans.planner import Planner, keyword, special, table_function
from cubewright.plans.values import Val, date

from .filters import column_of

UNITS = {"DAY": 0, "WEEK": 0, "MONTH": 1, "QUARTER": 3, "YEAR": 12}


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def days(c: Column, n: Column | int) -> Column:
    return ntz(F.date_add(c, n))


def calendar(p: Planner, where: tuple[str, str], at: str) -> DataFrame:
    """Every date of the unfiltered date table."""
    return p.model.tables[where[0]].select(ntz(q(where[1])).alias(at)).where(q(at).isNotNull()).distinct()


def visible(p: Planner, node: s.Node, frame: Frame, env: Env) -> tuple[tuple[str, str], DataFrame, str, list[str]]:
    """(column, visible dates per context, their name, keys)."""
    if isinstance(node, s.Ref):
        where = column_of(p, node, env)
        rel, inner = p.base(where[0], env.fc, frame)
        at = fresh("d")
        df = inner.df.select(*map(q, inner.carried), ntz(q(f"{where[0]}[{where[1]}]")).alias(at)).where(q(at).isNotNull()).distinct()
        return where, df, at, list(inner.carried)
    rel = p.table(node, frame, env)
    o = rel.cols[0]
    if o.lineage is None:
        raise DaxError("a date column is needed")
    return o.lineage, rel.df.select(*map(q, rel.keys), ntz(q(o.at)).alias(o.at)).where(q(o.at).isNotNull()).distinct(), o.at, list(rel.keys)


def between(p: Planner, where: tuple[str, str], bounds: DataFrame, keys: list[str], low: Column, high: Column) -> Rel:
    """The calendar's dates inside each context's bounds."""
    at = fresh("d")
    made = bounds.select(*map(q, keys), low.alias("__low"), high.alias("__high"))
    df = made.join(calendar(p, where, at), (q(at) >= F.col("__low")) & (q(at) <= F.col("__high")))
    return Rel(df.select(*map(q, keys), q(at)).distinct(), [Out(where[1], at, "date", where)], keys, shift=True)


def ends(p: Planner, node: s.Node, frame: Frame, env: Env) -> tuple[tuple[str, str], DataFrame, list[str]]:
    """First and last visible date per context: columns __min and __max."""
    where, df, at, keys = visible(p, node, frame, env)
    return where, df.groupBy(*map(q, keys)).agg(F.min(q(at)).alias("__min"), F.max(q(at)).alias("__max")), keys


def first() -> Column:
    return F.col("__min")


def last() -> Column:
    return F.col("__max")


def start_of(c: Column, unit: str) -> Column:
    return ntz(F.trunc(c, unit))


def end_of(c: Column, unit: str) -> Column:
    n = {"month": 0, "quarter": 2, "year": 11}[unit]
    return ntz(F.last_day(F.add_months(F.trunc(c, unit), n)))


def months(c: Column, n: int) -> Column:
    return ntz(F.add_months(c, n))


def year_end(p: Planner, node: s.Node | None, frame: Frame, env: Env) -> tuple[int, int] | None:
    """(month, day) of a year-end text such as "6/30"."""
    if not isinstance(node, s.Literal) or not isinstance(node.value, str):
        return None
    parts = [int(x) for x in node.value.replace("-", "/").split("/") if x.isdigit()]
    if len(parts) == 3:
        parts = parts[1:]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def fiscal_start(c: Column, end: tuple[int, int] | None) -> Column:
    """The first day of the (fiscal) year that ``c`` is in."""
    if end is None:
        return start_of(c, "year")
    m, d = end
    this = F.last_day(F.make_date(F.year(c), F.lit(m), F.lit(1)))
    this = F.least(this, F.date_add(F.make_date(F.year(c), F.lit(m), F.lit(1)), d - 1))
    before = F.date_add(F.add_months(F.make_date(F.year(c), F.lit(m), F.lit(1)), -12), d - 1)
    before = F.least(before, F.last_day(F.add_months(F.make_date(F.year(c), F.lit(m), F.lit(1)), -12)))
    return days(F.when(F.to_date(c) > this, this).otherwise(before), 1)


#: name -> (low, high) of the period, from the first and last visible date.
PERIODS: dict[str, tuple[Callable, Callable]] = {
    "DATESMTD": (lambda: start_of(last(), "month"), lambda: last()),
    "DATESQTD": (lambda: start_of(last(), "quarter"), lambda: last()),
    "PREVIOUSDAY": (lambda: days(first(), -1), lambda: days(first(), -1)),
    "NEXTDAY": (lambda: days(last(), 1), lambda: days(last(), 1)),
    "STARTOFMONTH": (lambda: start_of(first(), "month"), lambda: start_of(first(), "month")),
    "STARTOFQUARTER": (lambda: start_of(first(), "quarter"), lambda: start_of(first(), "quarter")),
    "ENDOFMONTH": (lambda: end_of(last(), "month"), lambda: end_of(last(), "month")),
    "ENDOFQUARTER": (lambda: end_of(last(), "quarter"), lambda: end_of(last(), "quarter")),
    "FIRSTDATE": (lambda: first(), lambda: first()),
    "LASTDATE": (lambda: last(), lambda: last()),
}
for _unit, _n in (("MONTH", 1), ("QUARTER", 3), ("YEAR", 12)):
    _low = _unit.lower()
    PERIODS[f"PREVIOUS{_unit}"] = (lambda u=_low, n=_n: start_of(months(start_of(first(), u), -n), u), lambda u=_low, n=_n: end_of(months(start_of(first(), u), -n), u))
    PERIODS[f"NEXT{_unit}"] = (lambda u=_low, n=_n: start_of(months(start_of(last(), u), n), u), lambda u=_low, n=_n: end_of(months(start_of(last(), u), n), u))


def period(p: Planner, name: str, node: s.Node, frame: Frame, env: Env, end: tuple[int, int] | None = None) -> Rel:
    where, bounds, keys = ends(p, node, frame, env)
    if name == "DATESYTD":
        low, high = fiscal_start(last(), end), last()
    elif name in ("STARTOFYEAR", "ENDOFYEAR", "PREVIOUSYEAR", "NEXTYEAR"):
        edge = first() if name in ("STARTOFYEAR", "PREVIOUSYEAR") else last()
        start = fiscal_start(edge, end)
        following = months(start, 12)
        low, high = {
            "STARTOFYEAR": (start, start),
            "ENDOFYEAR": (days(following, -1), days(following, -1)),
            "PREVIOUSYEAR": (months(start, -12), days(start, -1)),
            "NEXTYEAR": (following, days(months(following, 12), -1)),
        }[name]
    else:
        low, high = (f() for f in PERIODS[name])
    if name.startswith(("STARTOF", "ENDOF")):
        # The first or last date of the period that the date table has.
        unit = name.removeprefix("STARTOF").removeprefix("ENDOF").lower()
        if unit == "year":
            start = fiscal_start(first() if name.startswith("START") else last(), end)
            span = (start, days(months(start, 12), -1))
        else:
            edge = first() if name.startswith("START") else last()
            span = (start_of(edge, unit), end_of(edge, unit))
        rel = between(p, where, bounds, keys, *span)
        o, at = rel.cols[0], fresh("d")
        pick = F.min if name.startswith("START") else F.max
        return Rel(rel.df.groupBy(*map(q, keys)).agg(pick(q(o.at)).alias(at)), [replace(o, at=at)], keys, shift=True)
    return between(p, where, bounds, keys, low, high)


@table_function("DATESMTD", "DATESQTD", "DATESYTD", "PREVIOUSDAY", "NEXTDAY", *[f"{a}{b}" for a in ("PREVIOUS", "NEXT", "STARTOF", "ENDOF") for b in ("MONTH", "QUARTER", "YEAR")], "FIRSTDATE", "LASTDATE")
def dates(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return period(p, node.name, node.args[0], frame, env, year_end(p, node.args[1] if len(node.args) > 1 else None, frame, env))


def _in(p: Planner, rel: Rel, args: tuple, frame: Frame, env: Env) -> Env:
    """The context with the dates ``rel`` and further filter arguments."""
    inner = p.filtered(tuple(a for a in args if a is not None), frame, env)
    gone, items = p._table_filter(rel)
    fc = inner.fc if gone is None else gone(inner.fc)
    return replace(inner, fc=fc.plus(*items))


@special("TOTALYTD", "TOTALQTD", "TOTALMTD")
def totals(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    rest = list(node.args[2:])
    end = None
    for a in list(rest):
        found = year_end(p, a, frame, env)
        if found:
            end = found
            rest.remove(a)
    name = {"TOTALYTD": "DATESYTD", "TOTALQTD": "DATESQTD", "TOTALMTD": "DATESMTD"}[node.name]
    inner = p.transition(frame, env)
    rel = period(p, name, node.args[1], frame, inner, end)
    return p.scalar(node.args[0], frame, _in(p, rel, tuple(rest), frame, env))


@special(*[f"{a}BALANCE{b}" for a in ("OPENING", "CLOSING") for b in ("MONTH", "QUARTER", "YEAR")])
def balances(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    unit = node.name.partition("BALANCE")[2].lower()
    rest = list(node.args[2:])
    end = next((e for a in rest if (e := year_end(p, a, frame, env))), None)
    rest = [a for a in rest if year_end(p, a, frame, env) is None]
    where, bounds, keys = ends(p, node.args[1], frame, p.transition(frame, env))
    if node.name.startswith("OPENING"):
        at = days(fiscal_start(first(), end) if unit == "year" else start_of(first(), unit), -1)
    else:
        at = days(months(fiscal_start(last(), end), 12), -1) if unit == "year" else end_of(last(), unit)
    rel = between(p, where, bounds, keys, at, at)
    return p.scalar(node.args[0], frame, _in(p, rel, tuple(rest), frame, env))


def shift(p: Planner, node: s.Node, n: int, unit: str, frame: Frame, env: Env) -> Rel:
    """Each contiguous run of visible dates moved by n units, month ends to month ends."""
    where, df, at, keys = visible(p, node, frame, env)
    order = fresh("n")
    every = calendar(p, where, "__cal").withColumn(order, F.row_number().over(Window.orderBy("__cal")))
    runs = df.join(every, q(at) == F.col("__cal"))
    over = Window.partitionBy(*map(q, keys)).orderBy(q(at))
    runs = runs.withColumn("__run", q(order) - F.row_number().over(over))
    bounds = runs.groupBy(*map(q, keys), "__run").agg(F.min(q(at)).alias("__min"), F.max(q(at)).alias("__max"))
    if UNITS[unit] == 0:
        by = n * (7 if unit == "WEEK" else 1)
        low, high = days(first(), by), days(last(), by)
    else:
        by = n * UNITS[unit]
        low, high = months(first(), by), months(last(), by)
        # Months are whole: a run to a month's end stays one.
        high = F.when(F.to_date(last()) == F.last_day(last()), ntz(F.last_day(high))).otherwise(high)
    made = between(p, where, bounds.withColumn("__low2", low).withColumn("__high2", high), [*keys, "__run"], F.col("__low2"), F.col("__high2"))
    o = made.cols[0]
    return Rel(made.df.select(*map(q, keys), q(o.at)).distinct(), [o], keys, shift=True)


def _count(p: Planner, node: s.Node, frame: Frame, env: Env) -> int:
    v = p.scalar(node, frame, env)
    if not v.is_const:
        raise DaxError("the number of intervals must be a constant")
    return int(v.const)


@table_function("DATEADD")
def date_add(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return shift(p, node.args[0], _count(p, node.args[1], frame, env), keyword(node.args[2]), frame, env)


@table_function("SAMEPERIODLASTYEAR")
def same_period_last_year(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return shift(p, node.args[0], -1, "YEAR", frame, env)


@table_function("PARALLELPERIOD")
def parallel_period(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Whole periods: the visible span's periods moved by n."""
    where, bounds, keys = ends(p, node.args[0], frame, env)
    n, unit = _count(p, node.args[1], frame, env), keyword(node.args[2])
    if UNITS[unit] == 0:
        return between(p, where, bounds, keys, days(first(), n), days(last(), n))
    by, low = n * UNITS[unit], unit.lower()
    return between(p, where, bounds, keys, months(start_of(first(), low), by), end_of(months(start_of(last(), low), by), low))


def _bound(p: Planner, node: s.Node, frame: Frame, env: Env) -> Val:
    if isinstance(node, s.Ref) and not env.rows:
        raise DaxError("a date is needed")
    return p.scalar(node, frame, env)


@table_function("DATESBETWEEN")
def dates_between(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """From a to b; a BLANK bound leaves that side open."""
    where = column_of(p, node.args[0], env)
    a, b = (date(_bound(p, x, frame, env)) for x in node.args[1:3])
    rel = p.row_of(frame, [("a", Val(a, "date")), ("b", Val(b, "date"))])
    low = F.coalesce(q(rel.cols[0].at), F.lit("0001-01-01").cast("timestamp_ntz"))
    high = F.coalesce(q(rel.cols[1].at), F.lit("9999-12-31").cast("timestamp_ntz"))
    return between(p, where, rel.df, rel.keys, low, high)


@table_function("DATESINPERIOD")
def dates_in_period(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """n units from (or up to) a start date, which is included."""
    where = column_of(p, node.args[0], env)
    start = date(_bound(p, node.args[1], frame, env))
    n, unit = _count(p, node.args[2], frame, env), keyword(node.args[3])
    rel = p.row_of(frame, [("a", Val(start, "date"))])
    at = q(rel.cols[0].at)
    far = days(at, n * (7 if unit == "WEEK" else 1)) if UNITS[unit] == 0 else months(at, n * UNITS[unit])
    if n < 0 and UNITS[unit]:
        far = F.when(F.to_date(at) == F.last_day(at), ntz(F.last_day(far))).otherwise(far)
    low, high = (at, days(far, -1)) if n > 0 else (days(far, 1), at)
    return between(p, where, rel.df, rel.keys, low, high)


@table_function("CALENDAR")
def calendar_table(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel = p.row_of(frame, [("a", Val(date(p.scalar(node.args[0], frame, env)), "date")), ("b", Val(date(p.scalar(node.args[1], frame, env)), "date"))])
    return _days(rel.df, rel.keys, q(rel.cols[0].at), q(rel.cols[1].at))


def _days(df: DataFrame, keys: list[str], a: Column, b: Column) -> Rel:
    at = fresh("d")
    a, b = F.to_date(a), F.to_date(b)
    made = df.select(*map(q, keys), F.explode(F.when(a <= b, F.sequence(a, b))).alias(at))
    return Rel(made.withColumn(at, ntz(q(at))), [Out("Date", at, "date")], keys)


@table_function("CALENDARAUTO")
def calendar_auto(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Whole (fiscal) years over all date columns of the model's stored tables."""
    ending = _count(p, node.args[0], frame, env) if node.args else 12
    spans = []
    for t, df in p.model.tables.items():
        if t in p.model.calculated_tables:
            continue
        cols = [c for c in df.columns if p.model.column_type(t, c) == "date"]
        if cols:
            spans.append(df.agg(F.least(*[F.min(q(c)) for c in cols], F.lit(None).cast("timestamp_ntz")).alias("a"), F.greatest(*[F.max(q(c)) for c in cols], F.lit(None).cast("timestamp_ntz")).alias("b")))
    if not spans:
        raise DaxError("the model has no dates")
    whole = spans[0]
    for one in spans[1:]:
        whole = whole.union(one)
    whole = whole.agg(F.min("a").alias("a"), F.max("b").alias("b"))
    a = F.trunc(F.add_months("a", -(ending % 12)), "year")
    b = F.add_months(F.trunc(F.add_months("b", -(ending % 12)), "year"), 12)
    low, high = F.add_months(a, ending % 12), F.date_sub(F.add_months(b, ending % 12), 1)
    return _days(whole.select(low.alias("a"), high.alias("b")), [], F.col("a"), F.col("b"))

