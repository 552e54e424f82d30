"""Window functions over an ordered relation: ROWNUMBER, RANK, INDEX, OFFSET, WINDOW.

The relation gets row numbers per context and partition by one window; the
current row is found by a join on its columns (or MATCHBY's), and the wanted
positions by an equi-join on row numbers inside the partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame, Key, Out, Rel, fresh, match, q
from cubewright.plans.planner import Planner, keyword, special, table_function
from cubewright.plans.values import Val, cast

from .ranks import numbered
from .tables import constant, direction, renamed


@dataclass
class Axis:
    """The numbered relation: row number ``at``, rank ``rank``/``dense``, rows of the partition ``n``."""

    rel: Rel
    df: object
    parts: list[str]
    at: str
    rank: str
    dense: str
    n: str
    match: list[Out]


def _split(args: tuple) -> tuple[list, dict[str, s.Call]]:
    plain, marks = [], {}
    for a in args:
        if isinstance(a, s.Call) and a.name in ("ORDERBY", "PARTITIONBY", "MATCHBY"):
            marks[a.name] = a
        else:
            plain.append(a)
    return plain, marks


def _numbered(p: Planner, relation: s.Node | None, marks: dict, frame: Frame, env: Env) -> Axis:
    order = marks.get("ORDERBY")
    if order is None and relation is None:
        raise DaxError("a relation or ORDERBY is needed")
    outer = Env(env.fc, (), env.vars, env.selected, env.groups)
    if relation is None:
        refs = [a for m in ("ORDERBY", "PARTITIONBY") if m in marks for a in marks[m].args if isinstance(a, s.Ref)]
        selected = Env(env.selected, (), env.vars, env.selected, env.groups)
        rel = p.table(s.Call("ALLSELECTED", tuple(dict.fromkeys(refs))), frame, selected)
    else:
        rel = renamed(p.table(relation, frame, outer))
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel) if relation is None else Env(env.fc, (), env.vars, env.selected, env.groups).row(inner, rel)
    orders, i, args = [], 0, order.args if order else ()
    while i < len(args):
        down = i + 1 < len(args) and direction(args[i + 1]) is not None
        orders.append((p.scalar(args[i], inner, row_env), down and direction(args[i + 1]) == "DESC"))
        i += 2 if down else 1
    parts = [p.scalar(a, inner, row_env) for a in marks["PARTITIONBY"].args] if "PARTITIONBY" in marks else []
    p.flush(inner)
    part_names = [inner.add(v.col, "p") for v in parts]
    by = [(inner.add(v.col, "o"), d) for v, d in orders]
    names = [fresh(x) for x in ("at", "rank", "dense", "n")]
    df = numbered(inner.df, [*inner.carried, *part_names], by, [o.at for o in rel.cols], names)
    picked = [rel.pick(a.table, a.column) for a in marks["MATCHBY"].args] if "MATCHBY" in marks else rel.cols
    return Axis(Rel(df, rel.cols, list(inner.carried)), df, part_names, *names, picked)


def _current(p: Planner, axis: Axis, frame: Frame, env: Env) -> list[tuple[str, str]]:
    """Pairs (column of the frame, column of the relation) that say which row is current."""
    pairs = []
    for o in axis.match:
        v = None
        for rc in reversed(env.rows):
            have = rc.rel.pick(*o.lineage) if o.lineage else rc.rel.pick(None, o.name)
            if have is not None:
                if rc.frame is not frame:
                    frame.require(have.at)
                v = have.val
                break
        if v is None and o.lineage:
            key = next((i for i in reversed(env.fc.items) if isinstance(i, Key) and i.cols[0] == o.lineage), None)
            if key is not None:
                frame.require(key.key)
                v = Val(q(key.key), o.type)
            else:
                v = p.leaf("SELECTED", o.lineage[0], (s.Ref(*o.lineage),), frame, Env(env.fc, (), env.vars, env.selected))
        if v is None:
            continue
        pairs.append((v, o))
    p.flush(frame)
    if not pairs:
        raise DaxError("there is no current row for the window function")
    return [(frame.add(cast(v, o.type), "m"), o.at) for v, o in pairs]


def _position(p: Planner, axis: Axis, frame: Frame, env: Env, column: str) -> Val:
    pairs = _current(p, axis, frame, env)
    frame.require(*axis.rel.keys)
    out = fresh("w")
    names = {c: fresh("on") for c in dict.fromkeys([*axis.rel.keys, *(b for _, b in pairs)])}
    rows = axis.df.select(*[q(c).alias(n) for c, n in names.items()], q(column).alias(out))
    rows = rows.groupBy(*map(q, names.values())).agg(F.min(q(out)).alias(out))
    on = match([(k, names[k]) for k in axis.rel.keys] + [(a, names[b]) for a, b in pairs])
    frame.df = frame.df.join(rows, on, "left").drop(*names.values())
    return Val(q(out).cast("long"), "int")


@special("ROWNUMBER")
def row_number(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    plain, marks = _split(node.args)
    axis = _numbered(p, plain[0] if plain else None, marks, frame, env)
    return _position(p, axis, frame, env, axis.at)


@special("RANK")
def rank(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    plain, marks = _split(node.args)
    dense = bool(plain) and keyword(plain[0]) == "DENSE"
    if plain and keyword(plain[0]) in ("SKIP", "DENSE"):
        plain = plain[1:]
    axis = _numbered(p, plain[0] if plain else None, marks, frame, env)
    return _position(p, axis, frame, env, axis.dense if dense else axis.rank)


def _rows(p: Planner, axis: Axis, frame: Frame, env: Env, first, last=None) -> Rel:
    """Rows of the relation per context from position ``first(current, n)`` to ``last(current, n)``, or that one alone.

    The positions are listed and joined by equality, not compared with each row.
    """
    pairs = _current(p, axis, frame, env)
    frame.require(*axis.rel.keys)
    mine = [c for c in dict.fromkeys([*axis.rel.keys, *(a for a, _ in pairs)])]
    contexts = frame.df.select(*map(q, mine)).distinct()
    names = {c: fresh("on") for c in axis.df.columns}
    here = axis.df.select(*[q(c).alias(n) for c, n in names.items()])
    on = match([(k, names[k]) for k in axis.rel.keys] + [(a, names[b]) for a, b in pairs])
    current = contexts.join(here, on).select(*map(q, mine), *[q(names[x]).alias(f"__c{i}") for i, x in enumerate(axis.parts)], q(names[axis.at]).alias("__now"), q(names[axis.n]).alias("__of"))
    now, n = F.col("__now"), F.col("__of")
    low = first(now, n).cast("long")
    if last is None:
        current = current.withColumn("__want", low)
    else:
        low, high = F.greatest(low, F.lit(1).cast("long")), F.least(last(now, n).cast("long"), n)
        current = current.withColumn("__want", F.explode(F.when(low <= high, F.sequence(low, high))))
    other = {c: fresh("t") for c in axis.df.columns}
    there = axis.df.select(*[q(c).alias(n) for c, n in other.items()])
    same = [(k, other[k]) for k in axis.rel.keys] + [(f"__c{i}", other[x]) for i, x in enumerate(axis.parts)]
    joined = current.join(there, match([*same, ("__want", other[axis.at])]))
    outs = [Out(o.name, other[o.at], o.type, o.lineage) for o in axis.rel.cols]
    return Rel(joined.select(*map(q, mine), *[q(o.at) for o in outs]), outs, mine)


@table_function("INDEX")
def index(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    plain, marks = _split(node.args)
    k = int(constant(p, plain[0], frame, env))
    axis = _numbered(p, plain[1] if len(plain) > 1 else None, marks, frame, env)
    wanted = q(axis.at) == k if k > 0 else q(axis.at) == q(axis.n) + 1 + k
    if not axis.parts:
        df = axis.df.where(wanted)
        return Rel(df.select(*map(q, [*axis.rel.keys, *(o.at for o in axis.rel.cols)])), axis.rel.cols, axis.rel.keys)
    return _rows(p, axis, frame, env, lambda now, n: F.lit(k) if k > 0 else n + 1 + k)


@table_function("OFFSET")
def offset(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    plain, marks = _split(node.args)
    k = int(constant(p, plain[0], frame, env))
    axis = _numbered(p, plain[1] if len(plain) > 1 else None, marks, frame, env)
    return _rows(p, axis, frame, env, lambda now, n: now + k)


@table_function("WINDOW")
def window(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    plain, marks = _split(node.args)
    bounds, i = [], 0
    while len(bounds) < 2:
        k = int(constant(p, plain[i], frame, env))
        word = keyword(plain[i + 1]) if i + 1 < len(plain) else None
        bounds.append((k, word if word in ("ABS", "REL") else "REL"))
        i += 2 if word in ("ABS", "REL") else 1
    axis = _numbered(p, plain[i] if i < len(plain) else None, marks, frame, env)

    def bound(k: int, kind: str, now: Column, n: Column) -> Column:
        if kind == "REL":
            return now + k
        return F.lit(k) if k > 0 else n + 1 + k

    return _rows(p, axis, frame, env, lambda now, n: bound(*bounds[0], now, n), lambda now, n: bound(*bounds[1], now, n))


