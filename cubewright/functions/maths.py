"""Arithmetic, rounding, trigonometric and bit functions as Columns.

BLANK, text that is no number, and arguments outside a function's domain give
BLANK: the domain is guarded, as ANSI mode would raise or give NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.plans.planner import SCALARS
from cubewright.plans.values import Val, double, lit, number, num_type

from .kernels import python_scalar


def _one(f, domain=None):
    def made(v: Val) -> Val:
        x = double(v)
        out = f(x) if domain is None else F.when(domain(x), f(x))
        return Val(out, "dbl")

    return made


def _digits(d: Val | None) -> Column:
    return F.lit(0) if d is None else F.coalesce(double(d), F.lit(0.0)).cast("int")


def _scale(d: Val | None) -> Column:
    return F.pow(F.lit(10.0), _digits(d).cast("double"))


def round_(v: Val, d: Val | None = None) -> Val:
    if d is None or d.is_const:
        n = int(d.const or 0) if d is not None else 0
        return Val(F.round(double(v), n), "dbl")
    x = double(v)
    return Val(F.signum(x) * F.floor(F.abs(x) * _scale(d) + 0.5) / _scale(d), "dbl")


def _toward(up: bool):
    def made(v: Val, d: Val | None = None) -> Val:
        x, k = double(v), _scale(d)
        # A hair of slack: 2.3 * 100 is 229.99999999999997.
        scaled = F.ceil(F.abs(x) * k - 1e-9) if up else F.floor(F.abs(x) * k + 1e-9)
        return Val(F.signum(x) * scaled.cast("double") / k, "dbl")

    return made


def mround(v: Val, m: Val) -> Val:
    x, y = double(v), double(m)
    made = F.floor(x / y + 0.5) * y
    return Val(F.when(x.isNull() | y.isNull(), None).when((y == 0) | (x == 0), 0.0).when(F.signum(x) == F.signum(y), F.signum(x) * F.abs(F.floor(F.abs(x / y) + 0.5) * y)).otherwise(F.when(made.isNull(), None)), "dbl")


def _to_multiple(f, sign_free: bool = False):
    def made(v: Val, m: Val | None = None) -> Val:
        x = double(v)
        y = F.lit(1.0) if m is None else double(m)
        y = F.abs(y) if sign_free else y
        return Val(F.when(y == 0, x).otherwise(f(x / y).cast("double") * y), "dbl")

    return made


def mod(v: Val, d: Val) -> Val:
    x, y = number(v), number(d)
    if num_type(v) == num_type(d) == "int":
        r = F.try_mod(x, y)
        return Val(F.when(y != 0, F.when((r != 0) & (F.signum(r) != F.signum(y)), r + y).otherwise(r)), "int")
    x, y = x.cast("double"), y.cast("double")
    return Val(F.when(y != 0, x - y * F.floor(F.try_divide(x, y))), "dbl")


def quotient(a: Val, b: Val) -> Val:
    made = F.try_divide(double(a), double(b))
    return Val((F.signum(made) * F.floor(F.abs(made))).cast("long"), "int")


def log(v: Val, base: Val | None = None) -> Val:
    x = double(v)
    b = F.lit(10.0) if base is None else double(base)
    return Val(F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b) if base is not None else F.log10(x)), "dbl")


def _parity(odd: bool):
    def made(v: Val) -> Val:
        x = double(v)
        up = F.ceil(F.abs(x))
        sign = F.when(x < 0, -1).otherwise(1)
        out = F.when(up % 2 == (1 if odd else 0), up).otherwise(up + 1)
        return Val((sign * out).cast("long"), "int")

    return made


def _bits(f):
    def made(a: Val, b: Val) -> Val:
        x, y = double(a).cast("long"), double(b).cast("long")
        return Val(F.when((x >= 0) & (y >= 0), f(x, y)), "int")

    return made


def _shift(left: bool):
    def made(a: Val, n: Val) -> Val:
        x, k = double(a).cast("long"), double(n).cast("int")
        k = k if left else -k
        return Val(F.when((x >= 0) & (F.abs(k) <= 53), F.when(k >= 0, F.call_function("shiftleft", x, k)).otherwise(F.call_function("shiftright", x, -k))), "int")

    return made


def _kernel(f, n: int):
    """Integer arithmetic beyond Spark's functions."""

    def made(*values: Val) -> Val:
        return python_scalar(lambda *xs: f(*(int(x) for x in xs)), values, "dbl")

    return made


SCALARS |= {
    "ABS": lambda v: Val(F.abs(number(v)), num_type(v)),
    "ROUND": round_,
    "ROUNDUP": _toward(True),
    "ROUNDDOWN": _toward(False),
    "TRUNC": _toward(False),
    "MROUND": mround,
    "INT": lambda v: Val(F.floor(number(v)).cast("long"), "int"),
    "CEILING": _to_multiple(F.ceil),
    "FLOOR": _to_multiple(F.floor),
    "ISO.CEILING": _to_multiple(F.ceil, True),
    "CEILING.MATH": _to_multiple(F.ceil, True),
    "FLOOR.MATH": _to_multiple(F.floor, True),
    "MOD": mod,
    "QUOTIENT": quotient,
    "POWER": lambda a, b: Val(F.pow(double(a), double(b)), "dbl"),
    "SQRT": _one(F.sqrt, lambda x: x >= 0),
    "SQRTPI": _one(lambda x: F.sqrt(x * F.pi()), lambda x: x >= 0),
    "EXP": _one(F.exp),
    "LN": _one(F.ln, lambda x: x > 0),
    "LOG": log,
    "LOG10": _one(F.log10, lambda x: x > 0),
    "SIGN": lambda v: Val(F.signum(double(v)).cast("long"), "int"),
    "EVEN": _parity(False),
    "ODD": _parity(True),
    "FACT": lambda v: Val(F.when((double(v) >= 0) & (double(v) <= 20), F.factorial(F.least(F.greatest(double(v), F.lit(0.0)), F.lit(20.0)).cast("int")).cast("double")).otherwise(python_scalar(lambda n: float(math.factorial(int(n))) if 20 < n <= 170 else None, (v,), "dbl").col), "dbl"),
    "GCD": _kernel(math.gcd, 2),
    "LCM": _kernel(math.lcm, 2),
    "COMBIN": _kernel(math.comb, 2),
    "COMBINA": _kernel(lambda n, k: math.comb(n + k - 1, k) if n + k > 0 else 1, 2),
    "PERMUT": _kernel(math.perm, 2),
    "PI": lambda: lit(math.pi),
    "RAND": lambda: Val(F.rand(), "dbl"),
    "RANDBETWEEN": lambda a, b: Val((F.floor(F.rand() * (double(b) - double(a) + 1)) + double(a)).cast("long"), "int"),
    "BITAND": _bits(lambda x, y: x.bitwiseAND(y)),
    "BITOR": _bits(lambda x, y: x.bitwiseOR(y)),
    "BITXOR": _bits(lambda x, y: x.bitwiseXOR(y)),
    "BITLSHIFT": _shift(True),
    "BITRSHIFT": _shift(False),
    "SIN": _one(F.sin),
    "COS": _one(F.cos),
    "TAN": _one(F.tan),
    "COT": _one(F.cot, lambda x: x != 0),
    "ASIN": _one(F.asin, lambda x: F.abs(x) <= 1),
    "ACOS": _one(F.acos, lambda x: F.abs(x) <= 1),
    "ATAN": _one(F.atan),
    "ACOT": _one(lambda x: F.pi() / 2 - F.atan(x)),
    "SINH": _one(F.sinh),
    "COSH": _one(F.cosh),
    "TANH": _one(F.tanh),
    "COTH": _one(lambda x: F.try_divide(F.cosh(x), F.sinh(x)), lambda x: x != 0),
    "ASINH": _one(F.asinh),
    "ACOSH": _one(F.acosh, lambda x: x >= 1),
    "ATANH": _one(F.atanh, lambda x: F.abs(x) < 1),
    "ACOTH": _one(lambda x: F.atanh(F.try_divide(F.lit(1.0), x)), lambda x: F.abs(x) > 1),
    "DEGREES": _one(F.degrees),
    "RADIANS": _one(F.radians),
}
