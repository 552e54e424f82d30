"""Logical, conditional, type and information scalars."""

from __future__ import annotations

import getpass

from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame
from cubewright.plans.planner import ROW_SPECIAL, SCALARS, Planner, special
from cubewright.plans.values import BLANK, Val, cast, compare, date, double, lit, number, same_type, text, truth


def if_(values: list[Val]) -> Val:
    cond, yes, no = values[0], values[1], values[2] if len(values) > 2 else BLANK
    (a, b), kind = same_type([yes, no])
    return Val(F.when(truth(cond), a).otherwise(b), kind)


def switch(values: list[Val]) -> Val:
    on, rest = values[0], values[1:]
    default = rest.pop() if len(rest) % 2 else BLANK
    cols, kind = same_type([*rest[1::2], default])
    out = None
    for case, col in zip(rest[0::2], cols):
        hit = truth(case) if on.is_const and on.const is True else compare("=", on, case).col
        out = F.when(hit, col) if out is None else out.when(hit, col)
    return Val(cols[-1] if out is None else out.otherwise(cols[-1]), kind)


def and_(values: list[Val]) -> Val:
    out = truth(values[0])
    for v in values[1:]:
        out = out & truth(v)
    return Val(out, "bool")


def or_(values: list[Val]) -> Val:
    out = truth(values[0])
    for v in values[1:]:
        out = out | truth(v)
    return Val(out, "bool")


def coalesce(values: list[Val]) -> Val:
    cols, kind = same_type(values)
    return Val(F.coalesce(*cols), kind)


def divide(a: Val, b: Val, alt: Val = BLANK) -> Val:
    x, y = double(a), double(b)
    other = double(alt) if alt.type != "blank" else F.lit(None).cast("double")
    return Val(F.when(x.isNull(), None).otherwise(F.coalesce(F.try_divide(x, y), other)), "dbl")


ROW_SPECIAL |= {"IF": if_, "IF.EAGER": if_, "SWITCH": switch, "AND": and_, "OR": or_, "COALESCE": coalesce}
for _name, _f in ROW_SPECIAL.items():

    def _call(p: Planner, node: s.Call, frame: Frame, env: Env, f=_f) -> Val:
        return f([p.scalar(a, frame, env) for a in node.args])

    special(_name)(_call)


def _typed(*kinds: str):
    """A test of the static type; BLANK has none."""

    def test(v: Val) -> Val:
        return lit(False) if v.type not in kinds else Val(v.col.isNotNull(), "bool")

    return test


def _parity(odd: bool):
    def test(v: Val) -> Val:
        n = F.pmod(double(v).cast("long"), F.lit(2).cast("long"))
        return Val(F.when(n.isNull(), None).otherwise((n == 1) == F.lit(odd)), "bool")

    return test


def _after(or_equal: bool):
    """Lexicographic comparison of pairs with directions."""

    def test(*values: Val) -> Val:
        triples, i = [], 0
        while i < len(values):
            has = i + 2 < len(values) and values[i + 2].is_const and values[i + 2].const in ("ASC", "DESC")
            triples.append((values[i], values[i + 1], has and values[i + 2].const == "DESC"))
            i += 3 if has else 2
        out = F.lit(or_equal)
        for a, b, down in reversed(triples):
            out = F.when(compare("<" if down else ">", a, b).col, True).when(compare(">" if down else "<", a, b).col, False).otherwise(out)
        return Val(out, "bool")

    return test


_CONVERT = {"INTEGER": "int", "DOUBLE": "dbl", "CURRENCY": "dec", "STRING": "str", "BOOLEAN": "bool", "DATETIME": "date", "DECIMAL": "dbl"}


def convert(v: Val, to: Val) -> Val:
    kind = _CONVERT[str(to.const)]
    if kind == "int" and v.type in ("dbl", "dec", "str"):
        return Val(F.bround(double(v)).cast("long"), "int")
    if kind == "date":
        return Val(date(v), "date")
    return Val(text(v) if kind == "str" else cast(v, kind), kind)


def value_of(v: Val) -> Val:
    if v.type != "str":
        return Val(number(v), "int" if v.type in ("int", "bool") else "dbl")
    plain = F.regexp_replace(F.trim(v.col), "[,$\\s]", "")
    percent = plain.endswith("%")
    n = F.regexp_replace(plain, "%$", "").try_cast("double")
    return Val(F.when(percent, n / 100).otherwise(n), "dbl")


@special("IFERROR")
def if_error(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """Functions here give BLANK instead of errors, so what can fail is known from the operand:
    infinities, NaN and failed conversions count as errors, BLANK itself doesn't."""
    if isinstance(node.args[0], s.Call) and node.args[0].name == "ERROR":
        return p.scalar(node.args[1], frame, env)
    try:
        v, alt = p.scalar(node.args[0], frame, env), p.scalar(node.args[1], frame, env)
    except DaxError:
        return p.scalar(node.args[1], frame, env)
    (a, b), kind = same_type([v, alt])
    return Val(F.when(_failed(p, node.args[0], v, frame, env), b).otherwise(a), kind)


def _failed(p: Planner, node: s.Node, v: Val, frame: Frame, env: Env):
    bad = F.lit(False)
    if v.type == "dbl":
        bad = F.isnan(v.col) | (F.abs(v.col) == float("inf"))
    if isinstance(node, s.Call) and node.name in ("VALUE", "CONVERT", "DATEVALUE", "TIMEVALUE", "SEARCH", "FIND", "SQRT", "LN", "LOG", "LOG10"):
        source = p.scalar(node.args[0], frame, env)
        bad = bad | (v.col.isNull() & source.col.isNotNull())
    return F.coalesce(bad, F.lit(False))


@special("ISERROR")
def is_error(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    if isinstance(node.args[0], s.Call) and node.args[0].name == "ERROR":
        return lit(True)
    try:
        v = p.scalar(node.args[0], frame, env)
    except DaxError:
        return lit(True)
    return Val(_failed(p, node.args[0], v, frame, env), "bool")


@special("TRUE", "FALSE", "BLANK", "USERNAME", "USERPRINCIPALNAME", "USEROBJECTID", "USERCULTURE", "CUSTOMDATA")
def constants(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    return {
        "TRUE": lit(True), "FALSE": lit(False), "BLANK": BLANK, "USERNAME": lit(""), "USERPRINCIPALNAME": lit(""),
        "USEROBJECTID": lit(getpass.getuser()) if node.name == "USEROBJECTID" else BLANK, "USERCULTURE": lit(p.model.culture), "CUSTOMDATA": BLANK,
    }[node.name]


def error(v: Val) -> Val:
    return Val(F.raise_error(text(v)).cast("string"), "str")


def not_(v: Val) -> Val:
    return Val(~truth(v), "bool")


SCALARS |= {
    "NOT": not_,
    "DIVIDE": divide,
    "ERROR": error,
    "ISBLANK": lambda v: Val(v.col.isNull(), "bool"),
    "ISNUMBER": _typed("int", "dbl", "dec"),
    "ISNUMERIC": _typed("int", "dbl", "dec"),
    "ISTEXT": _typed("str"),
    "ISSTRING": _typed("str"),
    "ISNONTEXT": lambda v: lit(True) if v.type != "str" else Val(v.col.isNull(), "bool"),
    "ISLOGICAL": _typed("bool"),
    "ISBOOLEAN": _typed("bool"),
    "ISINTEGER": _typed("int"),
    "ISINT64": _typed("int"),
    "ISDECIMAL": _typed("dec"),
    "ISCURRENCY": _typed("dec"),
    "ISDOUBLE": _typed("dbl"),
    "ISDATETIME": _typed("date"),
    "ISEVEN": _parity(False),
    "ISODD": _parity(True),
    "ISAFTER": _after(False),
    "ISONORAFTER": _after(True),
    "CONVERT": convert,
    "VALUE": value_of,
    "CURRENCY": lambda v: Val(F.round(double(v), 4).cast("decimal(19,4)"), "dec"),
    "EVALUATEANDLOG": lambda v, *_: v,
}
