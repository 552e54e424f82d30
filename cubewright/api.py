"""Entry points: evaluate measures and table expressions on a semantic model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cubewright.errors import DaxError
from cubewright.functions import registry  # noqa: F401
from cubewright.model import SemanticModel
from cubewright.operators.predicates import context_items
from cubewright.operators.tables import axes
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, FilterContext, Key, q
from cubewright.plans.planner import Planner
from cubewright.plans.values import Val, text


def environment(model: SemanticModel, filters: dict | None) -> Env:
    fc = FilterContext(context_items(model, filters or {}))
    return Env(fc, selected=fc)


def secured(model: SemanticModel, role: str | None) -> SemanticModel:
    """The model as a role sees it: its tables filtered at the scan, and what
    their relationships reach with them."""
    if role is None:
        return model
    if role not in model.roles:
        raise DaxError(f"no role '{role}'")
    out = model.copy()
    for table, expression in model.roles[role].items():
        out.tables[table] = table_expression(model, f"FILTER('{table}', {expression})")
    planner = Planner(out)
    for table in model.tables:
        above = [r for r in model.edges() if r.from_table == table]
        for edge in above:
            reached = {edge.to_table} | model.expanded(edge.to_table)
            if reached & set(model.roles[role]):
                one = _visible(out, planner, edge.to_table, model.roles[role])
                keep = one.select(q(edge.to_column).alias("__k")).distinct()
                out.tables[table] = out.tables[table].join(keep, q(edge.from_column) == F.col("__k"), "left_semi")
    out.version += 1
    return out


def _visible(model: SemanticModel, planner: Planner, table: str, filtered: dict) -> DataFrame:
    df = model.tables[table]
    for edge in [r for r in model.edges() if r.from_table == table]:
        if ({edge.to_table} | model.expanded(edge.to_table)) & set(filtered):
            keep = _visible(model, planner, edge.to_table, filtered).select(q(edge.to_column).alias("__k")).distinct()
            df = df.join(keep, q(edge.from_column) == F.col("__k"), "left_semi")
    return df


def evaluate(model: SemanticModel, expressions: str | dict[str, str] | list[str], filters: dict | None = None, role: str | None = None) -> DataFrame:
    """Scalars in one filter context: a row with a column per expression or measure."""
    named = _named(model, expressions)
    model = secured(model, role)
    p = Planner(model)
    frame, env = p.one(), environment(model, filters)
    values = {n: p.scalar(s.parse(e), frame, env) for n, e in named.items()}
    p.flush(frame)
    return frame.df.select(*[v.col.alias(n) for n, v in values.items()])


def _named(model: SemanticModel, expressions) -> dict[str, str]:
    if isinstance(expressions, str):
        expressions = [expressions]
    if isinstance(expressions, dict):
        return expressions
    return {(e if e.lower() in model.measures else e): (f"[{e}]" if e.lower() in model.measures else e) for e in expressions}


def blank_preserving(model: SemanticModel, node: s.Node, seen: frozenset = frozenset()) -> bool:
    """Whether the expression is BLANK in contexts without rows."""
    from cubewright.functions.aggregates import AGGREGATES, ITERATORS

    if isinstance(node, s.Call):
        if node.name == "DIVIDE":
            return len(node.args) == 2 and blank_preserving(model, node.args[0], seen)
        if node.name in ("ROUND", "ABS", "INT", "ROUNDUP", "ROUNDDOWN", "TRUNC", "SQRT", "EXP", "SIGN"):
            return blank_preserving(model, node.args[0], seen)
        return node.name in AGGREGATES and len(node.args) == 1 or node.name in ITERATORS and isinstance(node.args[0], s.Name)
    if isinstance(node, s.Ref):
        low = node.column.lower()
        return low in model.measures and low not in seen and blank_preserving(model, s.parse(model.measures[low].expression), seen | {low})
    if isinstance(node, s.Binary):
        a, b = blank_preserving(model, node.left, seen), blank_preserving(model, node.right, seen)
        return {"*": a or b, "/": a, "+": a and b, "-": a and b}.get(node.op, False)
    return isinstance(node, s.Unary) and node.op == "-" and blank_preserving(model, node.arg, seen)


def evaluate_grouped(
    model: SemanticModel, expressions: str | dict[str, str] | list[str], by: list[str], filters: dict | None = None, *,
    keep_blank: bool = False, top_n: int | None = None, order_by: str | None = None, descending: bool = True, role: str | None = None,
) -> DataFrame:
    """Measures per combination of ``by`` columns ("T[c]"): one row per group.

    Groups whose measures are all BLANK are left out unless ``keep_blank``. If
    all measures aggregate one table, the result is one grouped pass over it.
    """
    named = _named(model, expressions)
    model = secured(model, role)
    p = Planner(model)
    where = [model._column(b) for b in by]
    env = environment(model, filters)
    trees = {n: s.parse(e) for n, e in named.items()}
    keys = [f"__g{i}" for i in range(len(where))]

    def contexts() -> DataFrame:
        rel = axes(p, where, list(trees.values()), p.one(), env)
        return rel.df.select(*[q(o.at).alias(k) for o, k in zip(rel.cols, keys)]).distinct()

    frame = p.frame(contexts)
    frame.group_keys = keys
    frame.keep_all = keep_blank or not all(blank_preserving(model, t) for t in trees.values())
    fc = env.fc.plus(*[Key(t, c, k) for (t, c), k in zip(where, keys)])
    inner = replace(env, fc=fc, groups=tuple(where))
    values = {n: p.scalar(t, frame, inner) for n, t in trees.items()}
    p.flush(frame)
    df = frame.df
    plain = [v for v in values.values() if not v.is_const]
    if plain and not keep_blank:
        some = plain[0].col.isNotNull()
        for v in plain[1:]:
            some = some | v.col.isNotNull()
        df = df.where(some)
    titles = [c if sum(c == d for _, d in where) == 1 else f"{t}[{c}]" for t, c in where]
    out = df.select(*[q(k).alias(t) for k, t in zip(keys, titles)], *[v.col.alias(n) for n, v in values.items()])
    if order_by is not None:
        out = out.orderBy(q(order_by).desc_nulls_last() if descending else q(order_by).asc_nulls_first(), *[q(t).asc_nulls_first() for t in titles])
    return out.limit(top_n) if top_n is not None else out


def table_expression(model: SemanticModel, expression: str, filters: dict | None = None, role: str | None = None) -> DataFrame:
    """The DataFrame of a table expression."""
    model = secured(model, role)
    p = Planner(model)
    frame, env = p.one(), environment(model, filters)
    rel = p.table(s.parse(expression), frame, env)
    if rel.keys:
        # The frame has one row: its key columns are the same in every row.
        frame.require(*rel.keys)
    seen: dict[str, int] = {}
    cols = []
    for o in rel.cols:
        name = o.name if o.name.lower() not in seen else f"{o.name}_{seen[o.name.lower()] + 1}"
        seen[o.name.lower()] = seen.get(o.name.lower(), 0) + 1
        cols.append(q(o.at).alias(name))
    return rel.df.select(*cols)


def with_column(model: SemanticModel, table: str, name: str, expression: str) -> DataFrame:
    """The table with a column computed per row, in row context and no filter context."""
    p = Planner(model)
    table = model.table_name(table)
    fc = FilterContext()
    base, inner = p.base(table, fc, p.one())
    v = p.scalar(s.parse(expression), inner, Env(fc).row(inner, base))
    p.flush(inner)
    kept = [o for o in base.cols if o.name.lower() != name.lower()]
    return inner.df.select(*[q(o.at).alias(o.name) for o in kept], v.col.alias(name))


def status(model: SemanticModel, expressions: dict[str, str], filters: dict | None = None) -> DataFrame:
    """Name, value as text, type and status (ok, blank, unsupported, error) of each expression."""
    from cubewright.errors import UnsupportedFunction

    p = Planner(model)
    frame, env = p.one(), environment(model, filters)
    rows, titles = [], {"int": "Int64", "dbl": "Double", "dec": "Decimal", "str": "String", "bool": "Boolean", "date": "DateTime", "blank": "Blank"}
    for name, expression in expressions.items():
        try:
            v = p.scalar(s.parse(expression), frame, env)
            rows.append((name, v, titles[v.type], None))
        except UnsupportedFunction as e:
            rows.append((name, None, None, f"unsupported: {e}"))
        except DaxError as e:
            rows.append((name, None, None, f"error: {e}"))
    p.flush(frame)
    each = []
    for name, v, title, bad in rows:
        value = F.lit(None).cast("string") if v is None else text(Val(v.col, v.type))
        state = F.lit(bad.split(":")[0]) if bad else F.when(value.isNull(), "blank").otherwise("ok")
        each.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(title).cast("string").alias("data_type"), state.alias("status"), F.lit(bad).cast("string").alias("message")))
    return frame.df.select(F.inline(F.array(*each)))


