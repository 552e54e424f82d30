"""Text functions as Columns. BLANK counts as empty text unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.plans.planner import SCALARS
from cubewright.plans.values import Val, double, lit, text, text0

from .formats import fixed


def _int(v: Val | None, default: int) -> Column:
    return F.lit(default) if v is None else F.coalesce(double(v), F.lit(0.0)).cast("int")


def concatenate(*values: Val) -> Val:
    return Val(F.concat(*map(text0, values)), "str")


def combine(by: Val, *values: Val) -> Val:
    return Val(F.concat_ws(by.const if by.is_const else ",", *map(text0, values)), "str")


def left(v: Val, n: Val | None = None) -> Val:
    return Val(F.left(text0(v), _int(n, 1)), "str")


def right(v: Val, n: Val | None = None) -> Val:
    return Val(F.right(text0(v), _int(n, 1)), "str")


def mid(v: Val, start: Val, n: Val) -> Val:
    return Val(F.substring(text0(v), _int(start, 1), F.greatest(_int(n, 0), F.lit(0))), "str")


def substitute(v: Val, old: Val, new: Val, nth: Val | None = None) -> Val:
    s, o, w = text0(v), text0(old), text0(new)
    if nth is None:
        return Val(F.when(o == "", s).otherwise(F.replace(s, o, w)), "str")
    k = _int(nth, 1)
    parts = F.split(s, F.concat(F.lit("\\Q"), o, F.lit("\\E")))
    many = F.size(parts)
    head, tail = F.array_join(F.slice(parts, 1, k), "\x00"), F.array_join(F.slice(parts, k + 1, many), "\x00")
    joined = F.concat(F.replace(head, F.lit("\x00"), o), w, F.replace(tail, F.lit("\x00"), o))
    return Val(F.when((o == "") | (k < 1) | (k >= many), s).otherwise(joined), "str")


def replace(v: Val, start: Val, n: Val, new: Val) -> Val:
    s, at = text0(v), _int(start, 1)
    return Val(F.concat(F.left(s, at - 1), text0(new), F.substring(s, at + _int(n, 0), F.greatest(F.length(s), F.lit(1)))), "str")


def _find(fold: bool):
    def made(what: Val, within: Val, start: Val | None = None, missing: Val | None = None) -> Val:
        a, b = text0(what), text0(within)
        if fold:
            a, b = F.lower(a), F.lower(b)
        at = F.call_function("locate", a, b, _int(start, 1))
        other = F.lit(None).cast("long") if missing is None else double(missing).cast("long")
        return Val(F.when(at > 0, at.cast("long")).otherwise(other), "int")

    return made


def _contains(fold: bool):
    def made(within: Val, what: Val) -> Val:
        a, b = text0(within), text0(what)
        return Val(F.contains(F.lower(a), F.lower(b)) if fold else F.contains(a, b), "bool")

    return made


def unichar(v: Val) -> Val:
    """The character of a code point, from its UTF-8 bytes."""
    n = double(v).cast("int")
    b = lambda x: F.lpad(F.hex(x), 2, "0")
    low = lambda k: (F.shiftright(n, k).bitwiseAND(63)).bitwiseOR(128)
    made = (
        F.when(n < 0x80, b(n))
        .when(n < 0x800, F.concat(b(F.shiftright(n, 6).bitwiseOR(0xC0)), b(low(0))))
        .when(n < 0x10000, F.concat(b(F.shiftright(n, 12).bitwiseOR(0xE0)), b(low(6)), b(low(0))))
        .otherwise(F.concat(b(F.shiftright(n, 18).bitwiseOR(0xF0)), b(low(12)), b(low(6)), b(low(0))))
    )
    return Val(F.when((n > 0) & (n < 0x110000), F.unhex(made).cast("string")), "str")


def _parts(v: Val) -> Column:
    return F.split(text(v), r"\|")


def _item(back: bool):
    def made(path: Val, n: Val, kind: Val | None = None) -> Val:
        k = _int(n, 0)
        item = F.when(k > 0, F.try_element_at(_parts(path), -k if back else k))
        if kind is not None and kind.is_const and kind.const in (1, "INTEGER"):
            return Val(item.try_cast("long"), "int")
        return Val(item, "str")

    return made


def length(v: Val) -> Val:
    return Val(F.length(text0(v)).cast("long"), "int")


SCALARS |= {
    "CONCATENATE": concatenate,
    "COMBINEVALUES": combine,
    "LEFT": left,
    "RIGHT": right,
    "MID": mid,
    "LEN": length,
    "UPPER": lambda v: Val(F.upper(text0(v)), "str"),
    "LOWER": lambda v: Val(F.lower(text0(v)), "str"),
    "PROPER": lambda v: Val(F.initcap(text0(v)), "str"),
    "TRIM": lambda v: Val(F.trim(F.regexp_replace(text0(v), " +", " ")), "str"),
    "SUBSTITUTE": substitute,
    "REPLACE": replace,
    "REPT": lambda v, n: Val(F.repeat(text0(v), F.greatest(_int(n, 0), F.lit(0))), "str"),
    "SEARCH": _find(True),
    "FIND": _find(False),
    "CONTAINSSTRING": _contains(True),
    "CONTAINSSTRINGEXACT": _contains(False),
    "EXACT": lambda a, b: Val(text0(a) == text0(b), "bool"),
    "UNICHAR": unichar,
    "UNICODE": lambda v: Val(F.when(text0(v) != "", F.ascii(text(v)).cast("long")), "int"),
    "FIXED": lambda v, d=lit(2), plain=lit(False): fixed(v, d, plain),
    "PATHITEM": _item(False),
    "PATHITEMREVERSE": _item(True),
    "PATHLENGTH": lambda v: Val(F.when(text(v).isNull(), F.lit(0).cast("long")).otherwise(F.size(_parts(v)).cast("long")), "int"),
    "PATHCONTAINS": lambda v, item: Val(F.coalesce(F.array_contains(_parts(v), text0(item)), F.lit(False)), "bool"),
}
