"""Aggregations: direct form, and partial forms where one exists.

``direct`` maps the compiled arguments to one aggregate Column. Where ``parts``
is given, partial results can be merged: used to pre-aggregate a fact table
before a join with overlapping periods multiplies its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.plans.values import NUMERIC, Val, double, number, serial


@dataclass(frozen=True)
class Aggregate:
    direct: Callable[[list[Val]], Column]
    type: Callable[[list[Val]], str]
    parts: Callable[[list[Val]], list[Column]] | None = None
    merge: Callable[[list[Column]], Column] | None = None


def _some(n: Column) -> Column:
    """A count: 0 is BLANK."""
    return F.nullif(n, F.lit(0).cast("long"))


def numeric(v: Val) -> Column:
    """Numbers only: text and booleans don't count."""
    if v.type in NUMERIC:
        return number(v)
    if v.type in ("date", "blank"):
        return serial(v.col) if v.type == "date" else F.lit(None).cast("double")
    if v.type == "bool":
        return F.lit(None).cast("double")
    return v.col.try_cast("double")


def coerced(v: Val) -> Column:
    """The A-forms: TRUE is 1, FALSE and text 0, dates their serial; BLANK stays."""
    if v.type == "str":
        return F.when(v.col.isNotNull(), F.lit(0.0))
    return double(v)


def _double(values: list[Val]) -> str:
    return "dbl"


def _int(values: list[Val]) -> str:
    return "int"


def _sum_type(values: list[Val]) -> str:
    return "int" if values[0].type == "int" else "dbl"


def _same(values: list[Val]) -> str:
    return values[0].type


def _orderable(v: Val) -> Column:
    return F.nullif(v.col, F.lit("")) if v.type == "str" else v.col


def _filled(v: Val) -> Column:
    """Neither BLANK nor empty text."""
    return F.nullif(v.col, F.lit("")) if v.type == "str" else v.col


def _exclusive(c: Column, k: Column) -> Column:
    """Percentile by k * (n + 1) over the sorted values."""
    values = F.array_sort(F.collect_list(c))
    n = F.size(values)
    at = k * (n + 1)
    low = F.floor(at).cast("int")
    a = F.try_element_at(values, F.greatest(low, F.lit(1)))
    b = F.try_element_at(values, F.least(low + 1, n))
    return F.when((n > 0) & (at >= 1) & (at <= n), a + (at - low) * (b - a))


def _percentile(v: list[Val]) -> Column:
    if not v[1].is_const:
        raise ValueError("the percentile must be a constant")
    return F.percentile(numeric(v[0]).cast("double"), float(v[1].const)) if 0 <= float(v[1].const) <= 1 else F.max(F.lit(None).cast("double"))


def _product(c: Column) -> Column:
    return F.product(c.cast("double"))


def _geometric(c: Column) -> Column:
    return F.when(F.min(c) > 0, F.exp(F.avg(F.ln(F.when(c > 0, c)))))


def _moment(f: Callable[[Column], Column], least: int) -> Aggregate:
    return Aggregate(lambda v: F.when(F.count(numeric(v[0])) >= least, f(numeric(v[0]).cast("double"))), _double)


def _distinct(v: Val) -> Column:
    return F.count_distinct(v.col) + F.coalesce(F.max(v.col.isNull().cast("long")), F.lit(0).cast("long"))


def _decomposed(one: Callable[[list[Val]], Column], merge: Callable[[Column], Column], kind: Callable, finish: Callable = lambda c: c) -> Aggregate:
    return Aggregate(lambda v: finish(one(v)), kind, lambda v: [one(v)], lambda p: finish(merge(p[0])))


_SUM = _decomposed(lambda v: F.sum(numeric(v[0])), F.sum, _sum_type)
_COUNT = _decomposed(lambda v: F.count(v[0].col), F.sum, _int, _some)
_COUNTX = _decomposed(lambda v: F.count(_filled(v[0])), F.sum, _int, _some)
_AVERAGE = Aggregate(
    lambda v: F.avg(numeric(v[0])),
    _double,
    lambda v: [F.sum(numeric(v[0]).cast("double")), F.count(numeric(v[0]))],
    lambda p: F.try_divide(F.sum(p[0]), F.nullif(F.sum(p[1]), F.lit(0).cast("long"))),
)

AGGREGATES: dict[str, Aggregate] = {
    "SUM": _SUM,
    "AVERAGE": _AVERAGE,
    "AVERAGEA": Aggregate(lambda v: F.avg(coerced(v[0])), _double),
    "COUNT": _COUNT,
    "COUNTA": _COUNT,
    "COUNTBLANK": _decomposed(lambda v: F.count(F.when(_filled(v[0]).isNull(), 1)), F.sum, _int, _some),
    "COUNTROWS": _decomposed(lambda v: F.count(F.lit(1)), F.sum, _int, _some),
    "DISTINCTCOUNT": Aggregate(lambda v: _some(_distinct(v[0])), _int),
    "DISTINCTCOUNTNOBLANK": Aggregate(lambda v: _some(F.count_distinct(v[0].col)), _int),
    "APPROXIMATEDISTINCTCOUNT": Aggregate(lambda v: _some(F.approx_count_distinct(v[0].col)), _int),
    "MIN": _decomposed(lambda v: F.min(_orderable(v[0])), F.min, _same),
    "MAX": _decomposed(lambda v: F.max(_orderable(v[0])), F.max, _same),
    "MINA": _decomposed(lambda v: F.min(coerced(v[0])), F.min, _double),
    "MAXA": _decomposed(lambda v: F.max(coerced(v[0])), F.max, _double),
    "PRODUCT": _decomposed(lambda v: _product(numeric(v[0])), F.product, _double),
    "MEDIAN": Aggregate(lambda v: F.median(numeric(v[0]).cast("double")), _double),
    "GEOMEAN": Aggregate(lambda v: _geometric(numeric(v[0]).cast("double")), _double),
    "STDEV.S": _moment(F.stddev_samp, 2),
    "STDEV.P": _moment(F.stddev_pop, 1),
    "VAR.S": _moment(F.var_samp, 2),
    "VAR.P": _moment(F.var_pop, 1),
    "PERCENTILE.INC": Aggregate(_percentile, _double),
    "PERCENTILE.EXC": Aggregate(lambda v: _exclusive(numeric(v[0]).cast("double"), double(v[1])), _double),
}

#: Iterator -> the aggregation of its row results.
ITERATORS: dict[str, str] = {
    "SUMX": "SUM", "AVERAGEX": "AVERAGE", "MINX": "MIN", "MAXX": "MAX", "COUNTX": "COUNTX", "COUNTAX": "COUNTX", "PRODUCTX": "PRODUCT", "MEDIANX": "MEDIAN",
    "GEOMEANX": "GEOMEAN", "STDEVX.S": "STDEV.S", "STDEVX.P": "STDEV.P", "VARX.S": "VAR.S", "VARX.P": "VAR.P", "PERCENTILEX.INC": "PERCENTILE.INC", "PERCENTILEX.EXC": "PERCENTILE.EXC",
}

INTERNAL: dict[str, Aggregate] = {
    "COUNTX": _COUNTX,
    "SELECTED": Aggregate(lambda v: F.when(_distinct(v[0]) == 1, F.min(v[0].col)), _same),
    "ONE": Aggregate(lambda v: _distinct(v[0]) == 1, lambda v: "bool"),
    "ANY": Aggregate(lambda v: F.bool_or(v[0].col), lambda v: "bool"),
    "COUNT0": Aggregate(lambda v: F.count(F.lit(1)), _int),
    "SLOPE": Aggregate(lambda v: F.regr_slope(F.coalesce(double(v[0]), F.lit(0.0)), F.coalesce(double(v[1]), F.lit(0.0))), _double),
    "INTERCEPT": Aggregate(lambda v: F.regr_intercept(F.coalesce(double(v[0]), F.lit(0.0)), F.coalesce(double(v[1]), F.lit(0.0))), _double),
}
ALL_AGGREGATES = AGGREGATES | INTERNAL
