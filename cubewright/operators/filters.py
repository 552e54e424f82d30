"""Functions that read or rewrite the filter context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, FilterContext, Frame, Rel
from cubewright.plans.planner import Planner, keyword, special, table_function
from cubewright.plans.values import BLANK, Val, cast, lit, same_type


@special("CALCULATE")
def calculate(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    inner = p.filtered(node.args[1:], frame, env)
    return p.scalar(node.args[0], frame, inner)


@table_function("CALCULATETABLE")
def calculate_table(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return p.table(node.args[0], frame, p.filtered(node.args[1:], frame, env))


def column_of(p: Planner, node: s.Node, env: Env) -> tuple[str, str]:
    if not isinstance(node, s.Ref):
        raise DaxError("a column is needed")
    table = p.home(node, env)
    return table, p.model.column_name(table, node.column)


def _column_leaf(p: Planner, name: str, node: s.Node, frame: Frame, env: Env) -> Val:
    table, column = column_of(p, node, env)
    return p.leaf(name, table, (s.Ref(table, column),), frame, replace(env, rows=()))


@special("SELECTEDVALUE")
def selected_value(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    one = _column_leaf(p, "SELECTED", node.args[0], frame, env)
    if len(node.args) < 2:
        return one
    single = _column_leaf(p, "ONE", node.args[0], frame, env)
    (a, b), kind = same_type([one, p.scalar(node.args[1], frame, env)])
    return Val(F.when(single.col, a).otherwise(b), kind)


@special("HASONEVALUE")
def has_one_value(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    one = _column_leaf(p, "ONE", node.args[0], frame, env)
    return Val(F.coalesce(one.col, F.lit(False)), "bool")


def _direct(fc: FilterContext, column: tuple[str, str]) -> list:
    return [i for i in fc.items if column in i.cols]


@special("HASONEFILTER")
def has_one_filter(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    column = column_of(p, node.args[0], env)
    if any(type(i).__name__ == "Key" for i in _direct(env.fc, column)):
        return lit(True)
    if not _direct(env.fc, column):
        return lit(False)
    return has_one_value(p, node, frame, env)


@special("ISFILTERED")
def is_filtered(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    if isinstance(node.args[0], s.Name):
        table = p.model.table_name(node.args[0].name)
        return lit(env.fc.filters(lambda c: c[0] == table))
    return lit(bool(_direct(env.fc, column_of(p, node.args[0], env))))


@special("ISCROSSFILTERED")
def is_cross_filtered(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    table = p.model.table_name(node.args[0].name) if isinstance(node.args[0], s.Name) else column_of(p, node.args[0], env)[0]
    above = p.model.expanded(table, env.fc.edges)
    return lit(env.fc.filters(lambda c: c[0] in above))


@special("ISINSCOPE")
def is_in_scope(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    column = column_of(p, node.args[0], env)
    return lit(column in env.groups and bool(_direct(env.fc, column)))


@special("RELATED")
def related(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    table, column = column_of(p, node.args[0], env)
    for rc in reversed(env.rows):
        if rc.rel.pick(table, column) is not None:
            return p.reference(node.args[0], frame, env)
    made = p.related(table, column, frame, env)
    if made is None:
        raise DaxError(f"no relationship leads from the current row to '{table}'")
    return made


@table_function("RELATEDTABLE")
def related_table(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return p.table(node.args[0], frame, p.transition(frame, env))


@special("EARLIER", "EARLIEST")
def earlier(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """The column in an outer row context."""
    ref = node.args[0]
    having = [rc for rc in env.rows if rc.rel.pick(ref.table, ref.column) is not None]
    back = 1
    if node.name == "EARLIER" and len(node.args) > 1:
        back = int(p.scalar(node.args[1], frame, env).const)
    if node.name == "EARLIEST":
        back = len(having) - 1
    if len(having) <= back:
        raise DaxError("there is no earlier row context")
    rc = having[-1 - back]
    out = rc.rel.pick(ref.table, ref.column)
    if rc.frame is not frame:
        # The inner row context may have a column of that name: carry a copy.
        at = rc.frame.add(out.val.col, "e")
        frame.require(at)
        return Val(F.col(at), out.type)
    return out.val


@special("IGNORE", "ROLLUPISSUBTOTAL")
def passes(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    return p.scalar(node.args[0], frame, env)


@special("LOOKUPVALUE")
def lookup_value(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """The one value of a column where others equal given values; BLANK or the
    alternative if there is none or they differ. Over the unfiltered table."""
    table, result = column_of(p, node.args[0], env)
    rest = list(node.args[1:])
    alternate = p.scalar(rest.pop(), frame, env) if len(rest) % 2 else BLANK
    pairs = [(column_of(p, rest[i], env), p.scalar(rest[i + 1], frame, env)) for i in range(0, len(rest), 2)]
    p.flush(frame)
    kind = p.model.column_type(table, result)
    from cubewright.plans.context import fresh, match, q

    names = [fresh("l") for _ in pairs]
    out = fresh("l")
    one = p.model.tables[table].groupBy(*[q(c).alias(n) for ((_, c), _), n in zip(pairs, names)])
    one = one.agg(F.when(F.count_distinct(q(result)) + F.max(q(result).isNull().cast("int")) == 1, F.min(q(result))).alias(out))
    on = []
    for ((_, c), v), n in zip(pairs, names):
        want = p.model.column_type(table, c)
        on.append((frame.add(cast(v, want) if v.type != want else v.col), n))
    frame.df = frame.df.join(one, match(on), "left").drop(*names)
    (a, b), kind = same_type([Val(q(out), kind), alternate])
    return Val(F.coalesce(a, b), kind)


@special("CONTAINS")
def contains(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    rel = p.table(node.args[0], frame, env)
    pairs = [(node.args[i], p.scalar(node.args[i + 1], frame, env)) for i in range(1, len(node.args), 2)]
    outs = [rel.pick(r.table, r.column) or rel.pick(None, r.column) for r, _ in pairs]
    return p.exists(Rel(rel.df, outs, rel.keys), [v for _, v in pairs], frame)


@special("CONTAINSROW")
def contains_row(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    rel = p.table(node.args[0], frame, env)
    return p.exists(rel, [p.scalar(a, frame, env) for a in node.args[1:]], frame)


@special("ISEMPTY")
def is_empty(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    rel = p.table(node.args[0], frame, env)
    n = p.over(rel, frame, env, [("COUNT0", [])])[0]
    return Val(n.col == 0, "bool")




@table_function("DETAILROWS", "TABLEOF")
def detail_rows(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """The rows of the measure's home table in the filter context."""
    ref = node.args[0]
    measure = p.model.measures.get(ref.column.lower()) if isinstance(ref, s.Ref) else None
    if measure is None:
        raise DaxError("a measure is needed")
    table = measure.table or next((p.model.table_name(n.table) for n in s.walk(s.parse(measure.expression)) if isinstance(n, s.Ref) and n.table), None)
    table = table or next(p.model.table_name(n.name) for n in s.walk(s.parse(measure.expression)) if isinstance(n, s.Name) and p.model.has_table(n.name))
    inner = p.transition(frame, env)
    return p.base(table, inner.fc, frame)[0]


@special("NAMEOF")
def name_of(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    ref = node.args[0]
    if isinstance(ref, s.Ref) and ref.table is None and (m := p.model.measures.get(ref.column.lower())):
        return lit(f"[{m.name}]" if m.table is None else f"'{m.table}'[{m.name}]")
    table, column = column_of(p, ref, env)
    return lit(f"'{table}'[{column}]")


__all__ = ["calculate", "column_of", "keyword"]
