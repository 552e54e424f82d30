"""Scalar kernels: folded for constants; else Spark expressions where there is a closed form, and Arrow-batched UDFs."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cubewright.model import SPARK_TYPE
from cubewright.plans.values import Val, lit, number
from cubewright.workers import ship

#: Results that a task keeps between batches, for each function.
KNOWN = 1 << 14


def _safe(f: Callable, values: tuple):
    if any(v is None or isinstance(v, float) and math.isnan(v) for v in values):
        return None
    try:
        out = f(*values)
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return None if isinstance(out, float) and (math.isnan(out) or math.isinf(out)) or isinstance(out, complex) else out


def plain(v: Val):
    """A constant as the kernels take it: dates stay dates, booleans become 0 and 1."""
    return int(v.const) if isinstance(v.const, bool) else v.const


def python_scalar(f: Callable, values: Sequence[Val], kind: str) -> Val:
    """``f`` of the values; None where an argument is BLANK or ``f`` can't be computed.

    ``f`` depends on its arguments alone: it is called once for equal arguments in a batch.
    """
    if all(v.is_const for v in values):
        return lit(_typed(_safe(f, tuple(plain(v) for v in values)), kind), kind)

    ship()
    fixed = [_fixed(v) if v.is_const else None for v in values]
    given = [i for i, v in enumerate(values) if not v.is_const]
    known: dict = {}  # a task's own: it is sent empty

    @F.pandas_udf(SPARK_TYPE[kind])
    def udf(*columns: pd.Series) -> pd.Series:
        code, first = _alike(columns)
        rows = zip(*(c.iloc[first].astype(object).where(c.iloc[first].notna(), None) for c in columns))
        if len(known) > KNOWN:
            known.clear()
        out = np.empty(len(first), dtype=object)
        for at, row in enumerate(rows):
            if row not in known:
                args = list(fixed)
                for i, x in zip(given, row):
                    args[i] = x
                known[row] = _typed(_safe(f, tuple(args)), kind)
            out[at] = known[row]
        return pd.Series(out[code], dtype=object)

    return Val(udf(*[values[i].col if values[i].type in ("date", "str") else number(values[i]).cast("double") for i in given]), kind)


def _fixed(v: Val):
    """A constant as the column of it would reach the kernel."""
    return v.const if v.const is None or v.type in ("date", "str") else float(v.const)


def _alike(columns: Sequence[pd.Series]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its combination of values, and for each combination its first row."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        one, values = pd.factorize(c)
        code = pd.factorize(code * (len(values) + 1) + one + 1)[0]
    first = np.empty(code.max(initial=-1) + 1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def closed(f: Callable, formula: Callable, values: Sequence[Val]) -> Val:
    """A function with a closed form: constants are folded by ``f``, columns take ``formula``,
    a Spark expression; None where it can't be computed."""
    if all(v.is_const for v in values):
        return python_scalar(f, values, "dbl")
    x = formula(*[number(v).cast("double") for v in values])
    return Val(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x), "dbl")


def _typed(out, kind: str):
    if out is None:
        return None
    if kind == "dbl":
        return float(out)
    if kind == "int":
        return int(out)
    return out


def day(x) -> dt.date:
    """A date argument as a calendar day."""
    if isinstance(x, dt.datetime):
        return x.date()
    if isinstance(x, dt.date):
        return x
    if isinstance(x, str):
        return dt.datetime.fromisoformat(x).date()
    return dt.date(1899, 12, 30) + dt.timedelta(days=int(x))
