"""Iterators that are more than a fold: ranks, ordered concatenation, first and
last non-blank members, irregular cash flows, regressions."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.functions.finance import xirr
from cubewright.model import dax_type
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame, Out, Rel, fresh, match, q
from cubewright.plans.planner import Planner, keyword, special, table_function
from cubewright.plans.values import Val, date, double, lit, same_type, text
from cubewright.workers import settled, ship

from .filters import column_of
from .ranks import estimated_bytes, running
from .tables import direction


@special("CONCATENATEX")
def concatenate_x(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """Non-blank results joined in order; unordered results in their own order."""
    rel = p.table(node.args[0], frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    item = F.nullif(text(p.scalar(node.args[1], inner, row_env)), F.lit(""))
    by = p.scalar(node.args[2], frame, env) if len(node.args) > 2 and node.args[2] is not None else lit("")
    orders, i = [], 3
    while i < len(node.args):
        down = i + 1 < len(node.args) and direction(node.args[i + 1]) is not None
        orders.append((p.scalar(node.args[i], inner, row_env), down and direction(node.args[i + 1]) == "DESC"))
        i += 2 if down else 1
    p.flush(inner)
    at = inner.add(item, "i")
    inner.df = inner.df.where(q(at).isNotNull())
    keys, out, rank = list(inner.carried), fresh("x"), fresh("n")
    over = [(c.col.desc_nulls_last() if d else c.col.asc_nulls_first()) for c, d in orders] + [q(at).asc()]
    inner.df = inner.df.withColumn(rank, F.row_number().over(Window.partitionBy(*map(q, keys)).orderBy(*over)))
    agg = inner.df.groupBy(*map(q, keys)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(q(rank), q(at)))), lambda x: x[at]), by.const if by.is_const else ",").alias(out))
    p.settle(frame, keys)
    frame.join_back(agg, keys, [out])
    return Val(F.nullif(q(out), F.lit("")), "str")


@special("RANKX")
def rank_x(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """1 + the number of the table's results beyond the value; DENSE counts distinct ones.

    The table's results are reduced to (value, rank) rows per context; the value
    is ranked by an equi-join if it is one of them, else by the nearest below.
    """
    args = list(node.args) + [None] * (5 - len(node.args))
    rel = p.table(args[0], frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    each = p.scalar(args[1], inner, env.row(inner, rel))
    p.flush(inner)
    value = p.scalar(args[2] if args[2] is not None else args[1], frame, env)
    p.flush(frame)
    down, dense = (direction(args[3]) if args[3] is not None else "DESC") != "ASC", keyword(args[4]) == "DENSE"
    (mine, theirs), kind = same_type([value, each])
    at, own = inner.add(theirs, "v"), frame.add(mine, "v")
    keys = list(inner.carried)
    p.settle(frame, keys)
    frame.require(*keys)
    # BLANK ranks as zero, as comparisons take it.
    zero = F.lit("") if kind == "str" else F.lit(0)
    member = args[2] is None or args[2] == args[1]
    groups = inner.df.select(*map(q, keys), F.coalesce(q(at), zero).alias("__v"), F.lit(1).alias("__n"))
    if not member:
        # Values that need not be members are ranked among them, with no weight of their own.
        asked = frame.df.where(q(own).isNotNull()).select(*map(q, keys), q(own).alias("__v"), F.lit(0).alias("__n"))
        groups = groups.unionByName(asked)
    weight = F.max("__n") if dense else F.sum("__n")
    groups = groups.groupBy(*map(q, keys), "__v").agg(weight.cast("long").alias("__n"))
    if keys:
        over = Window.partitionBy(*map(q, keys)).orderBy(F.col("__v").desc() if down else F.col("__v").asc())
        ahead = F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1))
        groups = groups.withColumn("__before", F.coalesce(ahead, F.lit(0)))
    else:
        tables = {o.lineage[0] for o in rel.cols if o.lineage}
        size = sum(estimated_bytes(p.model.tables[t]) for t in tables) if tables else estimated_bytes(groups)
        groups = running(groups, "__v", "__n", down, kind in ("int", "dbl"), size)
    names, out = {k: fresh("on") for k in keys}, fresh("r")
    right = groups.select(*[q(k).alias(n) for k, n in names.items()], F.col("__v").alias("__at"), (F.col("__before") + 1).alias(out))
    named = frame.add(F.coalesce(q(own), zero) if member else q(own), "v")
    frame.df = frame.df.join(right, match([*names.items(), (named, "__at")]), "left").drop(*names.values(), "__at")
    return Val(F.coalesce(q(out), F.lit(1)).cast("long"), "int")


def _members(p: Planner, node: s.Call, frame: Frame, env: Env) -> tuple[Rel, Frame, Val]:
    """Members of the column and the expression's value in each one's context."""
    arg = node.args[0]
    rel = p.table(s.Call("VALUES", (arg,)) if isinstance(arg, s.Ref) else arg, frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    v = p.scalar(node.args[1], inner, p.transition(inner, row_env) if not _plain(node.args[1], rel) else row_env)
    p.flush(inner)
    return rel, inner, v


def _plain(e: s.Node, rel: Rel) -> bool:
    return not any(isinstance(n, s.Call) or isinstance(n, s.Ref) and n.table is None and rel.pick(None, n.column) is None for n in s.walk(e))


@table_function("FIRSTNONBLANK", "LASTNONBLANK")
def non_blank(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel, inner, v = _members(p, node, frame, env)
    o, at = rel.cols[0], fresh("t")
    pick = F.min if node.name == "FIRSTNONBLANK" else F.max
    df = inner.df.where(v.col.isNotNull() & q(o.at).isNotNull()).groupBy(*map(q, inner.carried)).agg(pick(q(o.at)).alias(at)).where(q(at).isNotNull())
    return Rel(df, [Out(o.name, at, o.type, o.lineage)], list(inner.carried))


@special("FIRSTNONBLANKVALUE", "LASTNONBLANKVALUE")
def non_blank_value(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    rel, inner, v = _members(p, node, frame, env)
    o, out = rel.cols[0], fresh("x")
    pick = F.min_by if node.name == "FIRSTNONBLANKVALUE" else F.max_by
    keys = list(inner.carried)
    agg = inner.df.where(v.col.isNotNull() & q(o.at).isNotNull()).groupBy(*map(q, keys)).agg(pick(v.col, q(o.at)).alias(out))
    p.settle(frame, keys)
    frame.join_back(agg, keys, [out])
    return Val(q(out), v.type)


def _flows(p: Planner, node: s.Call, frame: Frame, env: Env) -> tuple[Frame, str, str]:
    rel = p.table(node.args[0], frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    v, d = p.scalar(node.args[1], inner, row_env), p.scalar(node.args[2], inner, row_env)
    p.flush(inner)
    return inner, inner.add(double(v), "v"), inner.add(date(d), "d")


@special("XNPV")
def xnpv(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """Discounted to the earliest date: sums of v / (1+r)^days factor into one pass."""
    inner, v, d = _flows(p, node, frame, env)
    r = p.scalar(node.args[3], frame, env)
    if not r.is_const:
        raise DaxError("XNPV needs a constant rate")
    keys, out = list(inner.carried), fresh("x")
    g = F.lit(1.0 + float(r.const))
    days = F.datediff(q(d), F.lit("2000-01-01").cast("date"))
    total = F.sum(q(v) / F.pow(g, days / 365.0)) * F.pow(g, F.min(days) / 365.0)
    p.settle(frame, keys)
    frame.join_back(inner.df.groupBy(*map(q, keys)).agg(total.alias(out)), keys, [out])
    return Val(q(out), "dbl")


@special("XIRR")
def _xirr(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """Flows are summed by day first; the solver gets one row per day."""
    inner, v, d = _flows(p, node, frame, env)
    guess = float(p.scalar(node.args[3], frame, env).const) if len(node.args) > 3 and node.args[3] is not None else 0.1
    keys, out = list(inner.carried), fresh("x")
    daily = inner.df.groupBy(*map(q, keys), F.to_date(q(d)).alias("__day")).agg(F.sum(q(v)).alias("__v"))

    ship(p.spark)

    @F.pandas_udf("double")
    def solve(values: pd.Series, days: pd.Series) -> float:
        flows = [(float(x), t) for x, t in zip(values, days) if x is not None and isinstance(t, dt.date)]
        return xirr(flows, guess)

    p.settle(frame, keys)
    frame.join_back(daily.groupBy(*map(q, keys)).agg(solve("__v", "__day").alias(out)), keys, [out])
    return Val(q(out), "dbl")


@table_function("LINEST", "LINESTX")
def linest(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Slope1 and Intercept of a simple least-squares fit; BLANK counts as 0."""
    if node.name == "LINEST":
        table, _ = column_of(p, node.args[0], env)
        rel, args = p.base(table, env.fc, frame)[0], node.args[:2]
    else:
        rel, args = p.table(node.args[0], frame, env), node.args[1:3]
    slope, intercept = p.over(rel, frame, env, [("SLOPE", list(args)), ("INTERCEPT", list(args))])
    return p.row_of(frame, [("Slope1", slope), ("Intercept", intercept)])


@special("RANK.EQ")
def rank_eq(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    ref = node.args[1]
    order = node.args[2] if len(node.args) > 2 else s.Name("DESC")
    values = s.Call("SELECTCOLUMNS", (s.Name(column_of(p, ref, env)[0], True), s.Literal("v"), ref))
    x = p.scalar(node.args[0], frame, env)
    rel = p.table(values, frame, env)
    member = p.exists(Rel(rel.df, rel.cols, rel.keys), [x], frame)
    rank = rank_x(p, s.Call("RANKX", (values, s.Ref(None, "v"), node.args[0], order)), frame, env)
    return Val(F.when(member.col, rank.col), "int")


@special("PATH")
def path(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    """Ancestors of the current row, root first: a recursive query over (id, parent)."""
    table, key = column_of(p, node.args[0], env)
    parent = column_of(p, node.args[1], env)[1]
    paths = parent_paths(p, table, key, parent)
    own = p.scalar(node.args[0], frame, env)
    at, out = frame.add(text(own), "p"), fresh("p")
    frame.df = frame.df.join(paths.select(F.col("id").alias("__id"), F.col("path").alias(out)), q(at) == F.col("__id"), "left").drop("__id")
    return Val(q(out), "str")


def parent_paths(p: Planner, table: str, key: str, parent: str):
    """(id, path) by doubling: each round joins the chains found so far, so a
    hierarchy of depth d takes log2(d) joins. A cycle has no root and no path."""
    base = p.model.tables[table]
    kind = lambda c: text(Val(q(c), dax_type(base.schema[c].dataType)))
    rows = base.select(kind(key).alias("id"), kind(parent).alias("up")).where(F.col("id").isNotNull()).dropDuplicates(["id"])
    known = rows.select(F.col("id").alias("known"))
    rows = rows.join(known, F.col("up") == F.col("known"), "left").select("id", F.col("known").alias("up"))
    out = settled(rows.select("id", "up", F.array("id").alias("chain")))
    for _ in range(32):
        if out.where("up IS NOT NULL").isEmpty():
            break
        above = out.select(F.col("id").alias("a"), F.col("up").alias("next"), F.col("chain").alias("head"))
        step = out.join(above, F.col("up") == F.col("a"), "left")
        step = step.select("id", F.col("next").alias("up"), F.when(F.col("head").isNotNull(), F.concat("head", "chain")).otherwise(F.col("chain")).alias("chain"))
        # What repeats an id runs in a cycle. Each round is stored, as the next one reads it twice.
        out = settled(step.where(F.size(F.array_distinct("chain")) == F.size("chain")))
    return out.where("up IS NULL").select("id", F.array_join("chain", "|").alias("path"))


