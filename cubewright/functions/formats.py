"""FORMAT and FIXED: patterns compiled to a Column tree.

A constant pattern becomes a tree of format, rounding and concatenation
Columns; nothing is interpreted per row. A pattern that is a column is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans.values import Val, date, double, lit, text0

#: Named formats (fixed values).
NAMED = {
    "currency": "$#,##0.00;($#,##0.00)", "fixed": "0.00", "standard": "#,##0.00", "percent": "0.00%", "scientific": "0.00E+00",
    "general date": "m/d/yyyy h:nn:ss AM/PM", "long date": "dddd, mmmm d, yyyy", "medium date": "dd-mmm-yy", "short date": "m/d/yyyy",
    "long time": "h:nn:ss AM/PM", "medium time": "hh:nn AM/PM", "short time": "hh:nn",
}
#: Decimal and group separators by culture (fixed values).
SEPARATORS = {"en": (".", ","), "de": (",", "."), "es": (",", "."), "it": (",", "."), "fr": (",", " "), "pt": (",", "."), "nl": (",", "."), "ru": (",", " "), "pl": (",", " "), "sv": (",", " ")}
_DATE_TOKEN = re.compile(r'"([^"]*)"|\\(.)|(AM/PM|am/pm|A/P|yyyy|yyy|yy|y|mmmm|mmm|mm|m|MMMM|MMM|MM|M|dddd|ddd|dd|d|hh|h|HH|H|nn|n|ss|s|q|ww|w|ttttt)|(.)', re.DOTALL)


def separators(culture: str | None) -> tuple[str, str]:
    return SEPARATORS.get((culture or "en").split("-")[0].lower(), (".", ","))


def format_value(v: Val, pattern: Val, culture: str = "en-US") -> Val:
    if not pattern.is_const:
        raise DaxError("FORMAT needs a constant pattern")
    spelled = str(pattern.const or "")
    low = spelled.lower().strip()
    if low == "general number":
        return Val(text0(v), "str")
    if low in ("true/false", "yes/no", "on/off"):
        yes, no = low.split("/")
        return Val(F.when(double(v) != 0, yes.capitalize()).otherwise(no.capitalize()), "str")
    spelled = NAMED.get(low, spelled)
    if v.type == "blank":
        return lit("")
    if not spelled:
        return Val(text0(v), "str")
    if v.type == "date" or v.type in ("int", "dbl", "dec") and _is_date(spelled):
        return Val(F.coalesce(_date(date(v), spelled), F.lit("")), "str")
    if v.type == "str":
        return Val(text0(v), "str")
    if v.type == "bool" and not re.search("[0#]", spelled):
        return Val(text0(v), "str")
    return Val(_number(double(v), spelled, separators(culture)), "str")


def _is_date(pattern: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.', "", pattern)
    return not re.search("[0#]", bare) and bool(re.search("[ymdhnsqYMDHNSQ]", bare))


def _date(d: Column, pattern: str) -> Column:
    parts: list[Column] = []
    tokens = [m for m in _DATE_TOKEN.finditer(pattern)]
    noon = any(m[3] and "/" in m[3] for m in tokens)
    after_hour = False
    for m in tokens:
        quoted, escaped, token, other = m[1], m[2], m[3], m[4]
        if token is None:
            parts.append(F.lit(quoted if quoted is not None else escaped or other))
            continue
        if token in ("m", "mm") and after_hour:
            token = "n" * len(token)
        low = token.lower() if "/" not in token else token
        if low in ("h", "hh"):
            after_hour = True
        elif low not in ("n", "nn", "s", "ss"):
            after_hour = False
        hour = F.when(F.hour(d) % 12 == 0, 12).otherwise(F.hour(d) % 12) if noon else F.hour(d)
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        parts.append(
            {
                "yyyy": F.lpad(F.year(d).cast("string"), 4, "0"), "yyy": F.lpad(F.year(d).cast("string"), 4, "0"), "yy": two(F.year(d) % 100), "y": F.dayofyear(d).cast("string"),
                "mmmm": F.date_format(d, "MMMM"), "mmm": F.date_format(d, "MMM"), "mm": two(F.month(d)), "m": F.month(d).cast("string"),
                "dddd": F.date_format(d, "EEEE"), "ddd": F.date_format(d, "EEE"), "dd": two(F.dayofmonth(d)), "d": F.dayofmonth(d).cast("string"),
                "hh": two(hour), "h": hour.cast("string"), "nn": two(F.minute(d)), "n": F.minute(d).cast("string"), "ss": two(F.second(d)), "s": F.second(d).cast("string"),
                "q": F.quarter(d).cast("string"), "w": F.dayofweek(d).cast("string"), "ww": (F.floor((F.dayofyear(d) - 2 + F.dayofweek(F.trunc(d, "year"))) / 7) + 1).cast("string"),
                "AM/PM": F.when(F.hour(d) < 12, "AM").otherwise("PM"), "am/pm": F.when(F.hour(d) < 12, "am").otherwise("pm"), "A/P": F.when(F.hour(d) < 12, "A").otherwise("P"),
                "ttttt": F.date_format(d, "h:mm:ss a"),
            }[low if low in ("yyyy", "yyy", "yy", "y", "mmmm", "mmm", "mm", "m", "dddd", "ddd", "dd", "d", "hh", "h", "nn", "n", "ss", "s", "q", "w", "ww", "ttttt") else token]
        )
    return F.concat(*parts)


def _sections(pattern: str) -> list[str]:
    out, now, quoted, i = [], "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            now += pattern[i : i + 2]
            i += 2
            continue
        quoted ^= c == '"'
        if c == ";" and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now]


def _number(x: Column, pattern: str, seps: tuple[str, str]) -> Column:
    sections = _sections(pattern)
    plus = _section(F.abs(x), sections[0], seps)
    minus = _section(F.abs(x), sections[1], seps) if len(sections) > 1 and sections[1] else F.concat(F.lit("-"), plus)
    if len(sections) < 2 or not sections[1]:
        # What rounds to zero has no sign.
        minus = F.when(F.regexp_replace(plus, "[^1-9]", "") == "", plus).otherwise(minus)
    none = _section(F.abs(x), sections[2], seps) if len(sections) > 2 and sections[2] else plus
    blank = F.lit("") if len(sections) < 4 else _section(F.lit(0.0), sections[3], seps)
    return F.when(x.isNull(), blank).when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "∞").otherwise("-∞")).when(x < 0, minus).when(x == 0, none).otherwise(plus)


_NUMBER_TOKEN = re.compile(r'"([^"]*)"|\\(.)|([0#][0#,]*(?:\.[0#]*)?(?:[eE][+-]0+)?,*|\.[0#]+(?:[eE][+-]0+)?)|(.)', re.DOTALL)


def _section(x: Column, pattern: str, seps: tuple[str, str]) -> Column:
    parts: list[Column] = []
    body_done = False
    percent = len(re.findall("%", re.sub(r'"[^"]*"|\\.', "", pattern)))
    for m in _NUMBER_TOKEN.finditer(pattern):
        quoted, escaped, body, other = m[1], m[2], m[3], m[4]
        if body is not None and not body_done:
            parts.append(_body(x * 100**percent, body, seps))
            body_done = True
        elif body is None:
            parts.append(F.lit(quoted if quoted is not None else escaped or other))
    return F.concat(*parts) if parts else F.lit("")


def _body(x: Column, body: str, seps: tuple[str, str]) -> Column:
    point, group = seps
    mantissa, exponent = (re.split("[eE]", body, maxsplit=1) + [None])[:2]
    scale = len(mantissa) - len(mantissa.rstrip(","))
    mantissa = mantissa.rstrip(",")
    whole, _, part = mantissa.partition(".")
    grouped, need = "," in whole, whole.count("0")
    least, most = part.count("0") if part else 0, len(part)
    if exponent is not None:
        power = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.when(x > 0, x)))).cast("int")
        rounded = F.round(x / F.pow(F.lit(10.0), power.cast("double")), most)
        power, rounded = F.when(rounded >= 10, power + 1).otherwise(power), F.when(rounded >= 10, rounded / 10).otherwise(rounded)
        width = exponent.count("0")
        sign = F.when(power < 0, "-").otherwise("+" if exponent[0] == "+" else "")
        return F.concat(_digits(rounded, need, least, most, False, point, group), F.lit("E"), sign, F.lpad(F.abs(power).cast("string"), width, "0"))
    return _digits(x / 1000.0**scale, need, least, most, grouped, point, group)


def _digits(x: Column, need: int, least: int, most: int, grouped: bool, point: str, group: str) -> Column:
    """``x`` >= 0 with ``least`` to ``most`` decimals and at least ``need`` whole digits.

    Halves of the decimal spelling are rounded up; a pattern's point stays even if
    no decimal follows it.
    """
    exact = F.round(x.cast("decimal(38,12)"), most)
    spelled = F.format_number(exact, most)
    whole = F.substring_index(spelled, ".", 1)
    part = F.substring_index(spelled, ".", -1) if most else F.lit("")
    if most > least:
        cut = F.regexp_replace(F.substring(part, least + 1, most), "0+$", "")
        part = F.concat(F.substring(part, 1, least) if least else F.lit(""), cut)
    bare = F.replace(whole, F.lit(","), F.lit(""))
    if need == 0:
        bare = F.when(bare == "0", "").otherwise(bare)
        whole = F.when(whole == "0", "").otherwise(whole)
    if need > 1:
        bare = F.when(F.length(bare) < need, F.lpad(bare, need, "0")).otherwise(bare)
        whole = F.when(F.length(F.replace(whole, F.lit(","), F.lit(""))) < need, bare).otherwise(whole)
    out = whole if grouped else bare
    if grouped and group != ",":
        out = F.replace(out, F.lit(","), F.lit(group))
    if not most:
        return out
    return F.concat(out, F.lit(point), part)


def fixed(v: Val, d: Val, plain: Val) -> Val:
    if not d.is_const:
        raise DaxError("FIXED needs a constant number of decimals")
    n, x = int(d.const or 0), double(v)
    made = F.format_number(F.round(x.cast("decimal(38,12)"), n), max(n, 0))
    if plain.is_const and plain.const:
        made = F.replace(made, F.lit(","), F.lit(""))
    return Val(made, "str")
