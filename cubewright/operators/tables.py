"""Table functions: projections, grouping, joins, set operations, sampling."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.functions.aggregates import ALL_AGGREGATES, ITERATORS
from cubewright.model import SPARK_TYPE
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, FilterContext, Frame, Key, Out, Rel, fresh, match, q
from cubewright.plans.planner import Planner, keyword, special, table_function
from cubewright.plans.values import Val, cast, double, lit, same_type, text, truth

from .filters import column_of
from .ranks import SortKey, at_positions, evenly_spaced, many_rows, numbered, sorting


def renamed(rel: Rel, *, distinct: bool = False) -> Rel:
    """The same rows under new column names, so that two copies never clash."""
    names = {o.at: fresh("t") for o in rel.cols}
    df = rel.df.select(*map(q, rel.keys), *[q(a).alias(n) for a, n in names.items()])
    return Rel(df.distinct() if distinct else df, [replace(o, at=names[o.at]) for o in rel.cols], list(rel.keys), rel.base, rel.shift)


def projected(rel: Rel, outs: list[Out]) -> Rel:
    return Rel(rel.df.select(*map(q, dict.fromkeys([*rel.keys, *(o.at for o in outs)]))), outs, list(rel.keys))


def constant(p: Planner, node: s.Node, frame: Frame, env: Env):
    v = p.scalar(node, frame, env)
    if not v.is_const:
        raise DaxError("a constant is needed")
    return v.const


def blank_row(p: Planner, table: str, rel: Rel) -> Rel:
    """With the BLANK member, if rows of a many side have keys that ``table`` lacks."""
    if not p.model.has_blank_member(table):
        return rel
    empty = rel.df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rel.df.schema.fields if f.name not in rel.keys])
    if rel.keys:
        return rel  # the member's rows come from the contexts themselves
    return Rel(rel.df.unionByName(empty), rel.cols, rel.keys, rel.base)


def column_values(p: Planner, refs: tuple, frame: Frame, fc: FilterContext, env: Env, blank: bool) -> Rel:
    """Distinct values of columns of one table."""
    where = [column_of(p, r, env) for r in refs]
    table = where[0][0]
    if len({t for t, _ in where}) > 1:
        raise DaxError("columns of one table are needed")
    rel, inner = p.base(table, fc, frame)
    outs = [o for w in where for o in rel.cols if o.lineage == w]
    made = projected(Rel(inner.df, rel.cols, inner.carried), outs)
    made.df = made.df.distinct()
    made = blank_row(p, table, made) if blank else made
    made.df = made.df.distinct()
    return made


@table_function("VALUES", "DISTINCT")
def values(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    arg = node.args[0]
    if isinstance(arg, s.Ref):
        rel = column_values(p, (arg,), frame, env.fc, env, node.name == "VALUES")
        return renamed(rel)
    rel = p.table(arg, frame, env)
    if node.name == "VALUES" and rel.base:
        return blank_row(p, rel.base, rel)
    return Rel(rel.df.select(*map(q, dict.fromkeys([*rel.keys, *(o.at for o in rel.cols)]))).distinct(), rel.cols, list(rel.keys))


def unfiltered(p: Planner, args: tuple, fc: FilterContext, frame: Frame, env: Env, blank: bool) -> Rel:
    if isinstance(args[0], s.Name):
        table = p.model.table_name(args[0].name)
        rel = p.base(table, fc, frame)[0]
        return blank_row(p, table, rel) if blank else rel
    return renamed(column_values(p, args, frame, fc, env, blank))


@table_function("ALL", "ALLNOBLANKROW", "ALLCROSSFILTERED", "REMOVEFILTERS")
def all_(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    if not node.args:
        raise DaxError(f"{node.name}() stands only in CALCULATE")
    return unfiltered(p, node.args, FilterContext((), env.fc.edges), frame, env, node.name != "ALLNOBLANKROW")


@table_function("ALLEXCEPT")
def all_except(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    table = p.model.table_name(node.args[0].name)
    kept = {column_of(p, a, env) for a in node.args[1:]}
    fc = env.fc.without(lambda c: c not in kept)
    rel = p.base(table, fc, frame)[0]
    outs = [o for o in rel.cols if o.lineage not in kept]
    made = projected(rel, outs)
    made.df = made.df.distinct()
    return made


@table_function("ALLSELECTED")
def all_selected(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    if not node.args:
        raise DaxError("ALLSELECTED() stands only in CALCULATE")
    return unfiltered(p, node.args, replace(env.selected, edges=env.fc.edges), frame, env, False)


@table_function("FILTERS")
def filters(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """The values that the direct filters of a column leave."""
    column = column_of(p, node.args[0], env)
    own = tuple(i for i in env.fc.items if column in i.cols)
    return renamed(column_values(p, node.args[:1], frame, FilterContext(own, env.fc.edges), env, False))


@table_function("FILTER")
def filter_(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel = p.table(node.args[0], frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    test = p.scalar(node.args[1], inner, env.row(inner, rel))
    p.flush(inner)
    return Rel(inner.df.where(truth(test)), rel.cols, list(inner.carried), rel.base)


def extended(p: Planner, rel: Rel, pairs: list[tuple[str, s.Node]], frame: Frame, env: Env) -> tuple[Rel, list[Out]]:
    """``rel`` with columns computed per row."""
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    made = [(name, p.scalar(e, inner, row_env), _lineage(rel, e)) for name, e in pairs]
    p.flush(inner)
    outs = [Out(name, inner.add(v.col, "t"), v.type, lineage) for name, v, lineage in made]
    return Rel(inner.df, rel.cols, list(inner.carried), rel.base), outs


def _lineage(rel: Rel, node: s.Node):
    if isinstance(node, s.Ref):
        found = rel.pick(node.table, node.column)
        return found.lineage if found else None
    return None


def name_pairs(p: Planner, args: tuple, frame: Frame, env: Env) -> list[tuple[str, s.Node]]:
    return [(str(constant(p, args[i], frame, env)), args[i + 1]) for i in range(0, len(args) - 1, 2)]


@table_function("ADDCOLUMNS")
def add_columns(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel = p.table(node.args[0], frame, env)
    made, outs = extended(p, rel, name_pairs(p, node.args[1:], frame, env), frame, env)
    return Rel(made.df, [*rel.cols, *outs], made.keys, None)


@table_function("SELECTCOLUMNS")
def select_columns(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel = p.table(node.args[0], frame, env)
    pairs, i, rest = [], 0, node.args[1:]
    while i < len(rest):
        if isinstance(rest[i], s.Ref):  # a column by itself keeps its name
            pairs.append((rest[i].column, rest[i]))
            i += 1
        else:
            pairs.append((str(constant(p, rest[i], frame, env)), rest[i + 1]))
            i += 2
    made, outs = extended(p, rel, pairs, frame, env)
    return projected(Rel(made.df, outs, made.keys), outs)


@table_function("ROW")
def row(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return p.row_of(frame, [(n, p.scalar(e, frame, env)) for n, e in name_pairs(p, node.args, frame, env)])


_DATATABLE = {"INTEGER": "int", "STRING": "str", "BOOLEAN": "bool", "DOUBLE": "dbl", "CURRENCY": "dec", "DATETIME": "date"}


@table_function("DATATABLE")
def data_table(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    *head, body = node.args
    cols = [(str(head[i].value), _DATATABLE[keyword(head[i + 1])]) for i in range(0, len(head), 2)]
    rows = []
    for outer in body.rows:
        inner = outer[0].rows if isinstance(outer[0], s.Rows) else (outer,)
        cells = [c[0] if isinstance(c, tuple) else c for c in (inner if isinstance(outer[0], s.Rows) else outer)]
        rows.append([cast(p.scalar(c, frame, env), kind) for c, (_, kind) in zip(cells, cols)])
    at = [fresh("t") for _ in cols]
    array = F.array(*[F.struct(*[c.alias(a) for c, a in zip(r, at)]) for r in rows])
    one = fresh("row")
    df = p.spark.range(1).select(F.explode(array).alias(one)).select(*[F.col(f"{one}.{a}").alias(a) for a in at])
    return Rel(df, [Out(n, a, k) for (n, k), a in zip(cols, at)])


@table_function("GENERATESERIES")
def generate_series(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """start, start + step, ... up to end: made on the executors, not on the driver."""
    parts = [p.scalar(a, frame, env) for a in node.args]
    step = parts[2] if len(parts) > 2 else lit(1)
    at = fresh("t")
    if all(v.is_const for v in (*parts[:2], step)):
        a, b, by = (v.const for v in (*parts[:2], step))
        if by <= 0:
            raise DaxError("the step must be positive")
        if all(isinstance(x, int) for x in (a, b, by)):
            return Rel(p.spark.range(a, b + 1, by).select(q("id").alias(at)), [Out("Value", at, "int")])
        if all(isinstance(x, (int, float)) for x in (a, b, by)):
            n = int((b - a) / by + 1e-9) + 1 if b >= a else 0
            return Rel(p.spark.range(n).select((F.lit(float(a)) + q("id") * F.lit(float(by))).alias(at)), [Out("Value", at, "dbl")])
    rel = p.row_of(frame, [("a", parts[0]), ("b", parts[1]), ("by", step)])
    a, b, by = rel.cols
    whole = {a.type, b.type, by.type} == {"int"}
    n = F.floor((double(b.val) - double(a.val)) / double(by.val) + 1e-9).cast("long")
    df = rel.df.where(n >= 0).select(*map(q, rel.keys), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"), q(a.at), q(by.at))
    made = (q(a.at) + F.col("i") * q(by.at)) if whole else (double(a.val) + F.col("i") * double(by.val))
    if a.type == "date":
        from cubewright.plans.values import from_serial

        return Rel(df.select(*map(q, rel.keys), from_serial(made).alias(at)), [Out("Value", at, "date")], rel.keys)
    return Rel(df.select(*map(q, rel.keys), made.alias(at)), [Out("Value", at, "int" if whole else "dbl")], rel.keys)


# -- grouping ---------------------------------------------------------------


def _group_names(p: Planner, args: tuple, env: Env) -> tuple[list, list[list[int]] | None, tuple, dict[str, list[int]]]:
    """Leading group columns; the grouping sets of ROLLUP, None for plain grouping;
    what follows; and names for subtotal flags."""
    refs: list[s.Ref] = []
    levels: list[list[int]] = []
    fixed: list[int] = []
    flags: dict[str, list[int]] = {}
    i = 0

    def put(r: s.Node) -> int:
        refs.append(r)
        return len(refs) - 1

    while i < len(args):
        a = args[i]
        if isinstance(a, s.Ref) and (a.table is not None or a.column.lower() not in p.model.measures):
            fixed.append(put(a))
        elif isinstance(a, s.Call) and a.name in ("ROLLUP", "ROLLUPADDISSUBTOTAL"):
            items = list(a.args)
            while items:
                one = items.pop(0)
                if isinstance(one, s.Literal):
                    flags[str(one.value)] = levels[-1]
                    continue
                group = one.args if isinstance(one, s.Call) and one.name == "ROLLUPGROUP" else (one,)
                levels.append([put(r) for r in group])
        elif isinstance(a, s.Call) and a.name == "ROLLUPGROUP":
            fixed += [put(r) for r in a.args]
        else:
            break
        i += 1
    sets = None
    if levels:
        sets = [fixed + [x for level in levels[:k] for x in level] for k in range(len(levels), -1, -1)]
    return refs, sets, args[i:], flags


@table_function("SUMMARIZE")
def summarize(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    refs, sets, rest, _ = _group_names(p, node.args[1:], env)
    where = [column_of(p, r, env) for r in refs]
    rel = p.table(node.args[0], frame, env)
    pairs = name_pairs(p, rest, frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    keyed = []
    for w in where:
        v = rel.pick(*w).val if rel.pick(*w) else p.related(*w, inner, row_env)
        if v is None:
            raise DaxError(f"{w} can't be reached from the grouped table")
        keyed.append(Out(w[1], inner.add(v.col, "g"), v.type, w))
    p.flush(inner)
    return grouped(p, Rel(inner.df, keyed, list(inner.carried)), keyed, sets, pairs, frame, env, {}, False)


def grouped(p: Planner, rel: Rel, keys: list[Out], sets, pairs, frame: Frame, env: Env, flags: dict, drop_blank: bool) -> Rel:
    """Distinct keys, then extension columns in each group's filter context."""
    parts: list[tuple[DataFrame, list[Out]]] = []
    outs: list[Out] = []
    for chosen in sets or [list(range(len(keys)))]:
        here = [keys[i] for i in chosen]
        names = {o.at: fresh("s") for o in here}
        df = rel.df.select(*map(q, rel.keys), *[q(a).alias(n) for a, n in names.items()]).distinct()
        cols = [replace(o, at=names[o.at]) for o in here]
        group = Rel(df, cols, list(rel.keys))
        inner = p.frame(df, frame, rel.keys)
        fc = env.fc.without(lambda c, cols=cols: c in {o.lineage for o in cols}).plus(*[Key(o.lineage[0], o.lineage[1], o.at) for o in cols])
        inner_env = replace(env, fc=fc, rows=(), groups=tuple(o.lineage for o in cols))
        plain, made = [], []
        for name, e in pairs:
            if isinstance(e, s.Call) and e.name == "ISSUBTOTAL":
                at = column_of(p, e.args[0], env)
                made.append((name, lit(at not in {o.lineage for o in cols}), False))
                continue
            ignored = isinstance(e, s.Call) and e.name == "IGNORE"
            made.append((name, p.scalar(e.args[0] if ignored else e, inner, replace(inner_env, rows=_group_rows(inner, group, e))), not ignored))
        plain = [v for _, v, counts in made if counts and not v.is_const]
        p.flush(inner)
        out_df = inner.df
        if drop_blank and plain:
            out_df = out_df.where(reduce(lambda a, b: a | b, [v.col.isNotNull() for v in plain]))
        final = [fresh("z") for _ in (*keys, *flags, *made)]
        have = {o.lineage: o for o in cols}
        exprs, outs = [], []
        for name, k in zip(final, keys):
            exprs.append((q(have[k.lineage].at) if k.lineage in have else F.lit(None)).cast(SPARK_TYPE[k.type]).alias(name))
            outs.append(Out(k.name, name, k.type, k.lineage))
        for name, (flag, level) in zip(final[len(keys) :], flags.items()):
            exprs.append(F.lit(not set(level) <= set(chosen)).alias(name))
            outs.append(Out(flag, name, "bool"))
        for name, (title, v, _) in zip(final[len(keys) + len(flags) :], made):
            exprs.append(v.col.alias(name))
            outs.append(Out(title, name, v.type))
        parts.append((out_df.select(*map(q, inner.carried), *exprs), outs))
        carried = list(inner.carried)
    first, outs = parts[0]
    for df, others in parts[1:]:
        first = first.union(df.select(*map(q, carried), *[q(o.at) for o in others]))
    return Rel(first, outs, carried)


def _group_rows(inner: Frame, group: Rel, e: s.Node):
    """A plain reference to a group column reads the row."""
    from cubewright.plans.context import RowContext

    shown = any(isinstance(n, s.Ref) and group.pick(n.table, n.column) for n in s.walk(e)) and not any(isinstance(n, s.Call) for n in s.walk(e))
    return (RowContext(inner, group),) if shown else ()


@table_function("SUMMARIZECOLUMNS")
def summarize_columns(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    refs, sets, rest, flags = _group_names(p, node.args, env)
    i, filters_ = 0, []
    while i < len(rest) and not isinstance(rest[i], s.Literal):
        filters_.append(rest[i])
        i += 1
    env = p.filtered(tuple(filters_), frame, env) if filters_ else env
    pairs = name_pairs(p, rest[i:], frame, env)
    where = [column_of(p, r, env) for r in refs]
    rel = axes(p, where, [e for _, e in pairs], frame, env)
    return grouped(p, rel, rel.cols, sets, pairs, frame, env, flags, True)


def axes(p: Planner, where: list, expressions: list[s.Node], frame: Frame, env: Env) -> Rel:
    """The combinations of group columns to evaluate: of one table, its own; of
    several, those that occur in a table from which all can be reached."""
    tables = list(dict.fromkeys(t for t, _ in where))
    if len(tables) == 1:
        rel = column_values(p, tuple(s.Ref(*w) for w in where), frame, env.fc, env, True)
        by = {o.lineage: o for o in rel.cols}
        return renamed(Rel(rel.df, [by[w] for w in where], rel.keys))
    used = [t for e in expressions for t in tables_in(p, e)]
    reaching = [t for t in dict.fromkeys([*used, *p.model.tables]) if all(p.model.path_up(t, x, env.fc.edges) is not None for x in tables)]
    if reaching:
        rel, inner = p.base(reaching[0], env.fc, frame)
        at = [p.reach(inner, reaching[0], w, env.fc.edges) for w in where]
        names = [fresh("t") for _ in at]
        df = inner.df.select(*map(q, inner.carried), *[q(a).alias(n) for a, n in zip(at, names)]).distinct()
        return Rel(df, [Out(w[1], n, p.model.column_type(*w), w) for w, n in zip(where, names)], list(inner.carried))
    out = None
    for t in tables:
        one = axes(p, [w for w in where if w[0] == t], [], frame, env)
        out = one if out is None else joined(out, one, frame, p)
    by = {o.lineage: o for o in out.cols}
    return Rel(out.df, [by[w] for w in where], out.keys)


def tables_in(p: Planner, node: s.Node, seen: frozenset = frozenset()) -> list[str]:
    """Tables that an expression aggregates, through measures."""
    out = []
    for n in s.walk(node):
        if isinstance(n, s.Ref):
            low = n.column.lower()
            if (n.table is None or not p.model.has_table(n.table) or not p.model.has_column(p.model.table_name(n.table), n.column)) and low in p.model.measures and low not in seen:
                out += tables_in(p, s.parse(p.model.measures[low].expression), seen | {low})
            elif n.table and p.model.has_table(n.table):
                out.append(p.model.table_name(n.table))
        elif isinstance(n, s.Name) and p.model.has_table(n.name):
            out.append(p.model.table_name(n.name))
    return out


@table_function("GROUPBY")
def group_by(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rel = p.table(node.args[0], frame, env)
    refs = [a for a in node.args[1:] if isinstance(a, s.Ref)]
    pairs = name_pairs(p, tuple(a for a in node.args[1:] if not isinstance(a, s.Ref)), frame, env)
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    keys = []
    for r in refs:
        found = rel.pick(r.table, r.column) or rel.pick(None, r.column)
        if found is None:
            where = column_of(p, r, env)
            v = p.related(*where, inner, row_env)
            found = Out(where[1], inner.add(v.col, "g"), v.type, where)
        keys.append(found)
    aggs = []
    for name, e in pairs:
        if not (isinstance(e, s.Call) and e.name in ITERATORS and isinstance(e.args[0], s.Call) and e.args[0].name == "CURRENTGROUP"):
            raise DaxError("GROUPBY aggregates CURRENTGROUP()")
        kind = ALL_AGGREGATES[ITERATORS[e.name]]
        vals = [p.scalar(a, inner, row_env) for a in e.args[1:]]
        aggs.append((name, kind, vals, fresh("x")))
    p.flush(inner)
    carried = list(inner.carried)
    df = inner.df.groupBy(*map(q, carried), *[q(k.at) for k in keys]).agg(*[k.direct(v).alias(a) for _, k, v, a in aggs] or [F.count(F.lit(1)).alias(fresh("n"))])
    return Rel(df, [*keys, *[Out(n, a, k.type(v)) for n, k, v, a in aggs]], carried)


@table_function("CURRENTGROUP")
def current_group(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    raise DaxError("CURRENTGROUP stands only in GROUPBY")


# -- joins and set operations -------------------------------------------------


def joined(a: Rel, b: Rel, frame: Frame, p: Planner, how: str = "inner", on: list[tuple[str, str]] | None = None) -> Rel:
    """Rows of ``a`` by rows of ``b`` within a context."""
    p.settle(frame, [*a.keys, *b.keys])
    frame.require(*a.keys, *b.keys)
    shared = [k for k in b.keys if k in a.keys]
    names = {o.at: fresh("t") for o in b.cols} | {k: fresh("on") for k in b.keys}
    right = b.df.select(*[q(c).alias(n) for c, n in names.items()])
    pairs = [(k, names[k]) for k in shared] + [(x, names[y]) for x, y in on or []]
    left = a.df
    new = [k for k in b.keys if k not in a.keys]
    df = left.join(right, match(pairs), how) if pairs else left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    for k in new:
        df = df.withColumnRenamed(names[k], k)
    outs = [*a.cols, *[replace(o, at=names[o.at]) for o in b.cols]]
    keys = [*a.keys, *new]
    return Rel(df.select(*map(q, dict.fromkeys([*keys, *(o.at for o in outs)]))), outs, keys)


@table_function("CROSSJOIN")
def cross_join(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    rels = [p.table(a, frame, env) for a in node.args]
    return reduce(lambda a, b: joined(a, renamed(b), frame, p), rels[1:], renamed(rels[0]))


@table_function("NATURALINNERJOIN", "NATURALLEFTOUTERJOIN")
def natural_join(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    a, b = (renamed(p.table(x, frame, env)) for x in node.args)
    common = [(x, y) for x in a.cols for y in b.cols if x.name.lower() == y.name.lower()]
    if not common:
        raise DaxError("the tables have no column name in common")
    made = joined(a, b, frame, p, "left" if node.name == "NATURALLEFTOUTERJOIN" else "inner", [(x.at, y.at) for x, y in common])
    dropped = {y.name.lower() for _, y in common}
    outs = [*made.cols[: len(a.cols)], *[o for o in made.cols[len(a.cols) :] if o.name.lower() not in dropped]]
    return projected(made, outs)


@table_function("GENERATE", "GENERATEALL")
def generate(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """The rows of t2, evaluated for each row of t1."""
    outer = renamed(p.table(node.args[0], frame, env))
    inner = p.frame(outer.df, frame, outer.keys)
    right = renamed(p.table(node.args[1], inner, env.row(inner, outer)))
    p.settle(inner, right.keys)
    inner.require(*right.keys)
    p.flush(inner)
    names = {k: fresh("on") for k in right.keys}
    rows = right.df.select(*[q(k).alias(n) for k, n in names.items()], *[q(o.at) for o in right.cols])
    how = "left" if node.name == "GENERATEALL" else "inner"
    df = inner.df.join(rows, match(list(names.items())), how) if names else (inner.df.crossJoin(rows) if how == "inner" else inner.df.join(rows, F.lit(True), "left"))
    return projected(Rel(df, [], list(inner.carried)), [*outer.cols, *right.cols])


def aligned(rels: list[Rel], frame: Frame, p: Planner) -> tuple[list[DataFrame], list[Out], list[str]]:
    """Tables by position, with one set of names, types and keys."""
    width = {len(r.cols) for r in rels}
    if len(width) != 1:
        raise DaxError("the tables differ in their number of columns")
    keys = list(dict.fromkeys(k for r in rels for k in r.keys))
    outs, dfs = [], []
    kinds = [same_type([r.cols[i].val for r in rels])[1] for i in range(width.pop())]
    names = [fresh("t") for _ in kinds]
    p.settle(frame, keys)
    for r in rels:
        inner = p.frame(r.df, frame, r.keys)
        inner.require(*keys)
        dfs.append(inner.df.select(*map(q, keys), *[cast(o.val, k).alias(n) for o, k, n in zip(r.cols, kinds, names)]))
    for i, o in enumerate(rels[0].cols):
        same = all(r.cols[i].lineage == o.lineage for r in rels)
        outs.append(Out(o.name, names[i], kinds[i], o.lineage if same else None))
    return dfs, outs, keys


@table_function("UNION")
def union(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    dfs, outs, keys = aligned([p.table(a, frame, env) for a in node.args], frame, p)
    return Rel(reduce(DataFrame.union, dfs), outs, keys)


@table_function("EXCEPT", "INTERSECT")
def except_intersect(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Rows of the first that the second lacks or has; duplicates of the first stay."""
    rels = [p.table(a, frame, env) for a in node.args]
    (a, b), outs, keys = aligned(rels, frame, p)
    names = {c: fresh("on") for c in a.columns}
    b = b.select(*[q(c).alias(n) for c, n in names.items()]).distinct()
    df = a.join(b, match(list(names.items())), "left_anti" if node.name == "EXCEPT" else "left_semi")
    outs = [replace(o, lineage=r.lineage) for o, r in zip(outs, rels[0].cols)]
    return Rel(df, outs, keys)


@table_function("TREATAS")
def treat_as(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """A table with the lineage of other columns: a virtual relationship."""
    rel = renamed(p.table(node.args[0], frame, env))
    where = [column_of(p, a, env) for a in node.args[1:]]
    if len(where) != len(rel.cols):
        raise DaxError("TREATAS needs a column for each of the table's")
    return Rel(rel.df, [replace(o, name=w[1], lineage=w) for o, w in zip(rel.cols, where)], rel.keys)


@table_function("KEEPFILTERS", "NONVISUAL")
def pass_through(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    return p.table(node.args[0], frame, env)


# -- order, limits, samples -----------------------------------------------------


def ordered(p: Planner, rel: Rel, args: tuple, frame: Frame, env: Env, default: str = "DESC") -> tuple[Rel, list]:
    """Order expressions with their directions as sort Columns (BLANK is smallest)."""
    rel, keys = sort_keys(p, rel, args, frame, env, default)
    return rel, sorting(keys)


def sort_keys(p: Planner, rel: Rel, args: tuple, frame: Frame, env: Env, default: str) -> tuple[Rel, list[SortKey]]:
    inner = p.frame(rel.df, frame, rel.keys)
    row_env = env.row(inner, rel)
    orders, i = [], 0
    while i < len(args):
        if args[i] is None:
            i += 1
            continue
        down = default
        v = p.scalar(args[i], inner, row_env)
        if i + 1 < len(args) and (word := direction(args[i + 1])):
            down = word
            i += 1
        orders.append((v, down))
        i += 1
    p.flush(inner)
    made = [(inner.add(v.col, "o"), down == "DESC") for v, down in orders]
    return Rel(inner.df, rel.cols, list(inner.carried), rel.base), made


def direction(node: s.Node | None) -> str | None:
    word = keyword(node) if node is not None else None
    if word in ("ASC", "DESC"):
        return word
    if isinstance(node, s.Literal) and node.value in (0, 1) and not isinstance(node.value, bool):
        return "DESC" if node.value == 0 else "ASC"
    if isinstance(node, s.Name) and node.name.upper() in ("TRUE", "FALSE") or isinstance(node, s.Call) and node.name in ("TRUE", "FALSE"):
        return "ASC" if (node.name.upper() == "TRUE") else "DESC"
    return None


def tie_break(rel: Rel) -> list:
    return [q(o.at).asc_nulls_first() for o in rel.cols]


def strip(rel: Rel, df: DataFrame) -> Rel:
    return Rel(df.select(*map(q, dict.fromkeys([*rel.keys, *(o.at for o in rel.cols)]))), rel.cols, rel.keys, rel.base)


def ranked(rel: Rel, orders: list, function) -> DataFrame:
    return rel.df.withColumn("__rank", function().over(Window.partitionBy(*map(q, rel.keys)).orderBy(*orders)))


@table_function("TOPN")
def top_n(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """The first n rows of the order; rows that tie with the last come too."""
    n = int(constant(p, node.args[0], frame, env))
    rel, orders = ordered(p, p.table(node.args[1], frame, env), node.args[2:], frame, env)
    if not orders:
        return strip(rel, ranked(rel, tie_break(rel), F.row_number).where(F.col("__rank") <= n))
    if not rel.keys:
        # The n-th row bounds the result: a top-k, not a sort of everything.
        top = rel.df.orderBy(*orders).limit(n)
        return strip(rel, ranked(Rel(_with_ties(rel, top, orders, n), rel.cols, []), orders, F.rank).where(F.col("__rank") <= n))
    return strip(rel, ranked(rel, orders, F.rank).where(F.col("__rank") <= n))


def _with_ties(rel: Rel, top: DataFrame, orders: list, n: int) -> DataFrame:
    """Rows whose order keys are among the first n's distinct keys."""
    names = [c for c in rel.df.columns if c.startswith("__o")][-len(orders) :]
    renamed_ = {c: fresh("on") for c in names}
    keys = top.select(*[q(c).alias(r) for c, r in renamed_.items()]).distinct()
    return rel.df.join(keys, match(list(renamed_.items())), "left_semi")


@table_function("TOPNSKIP")
def top_n_skip(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    n, skip = (int(constant(p, a, frame, env)) for a in node.args[:2])
    rel, orders = ordered(p, p.table(node.args[2], frame, env), node.args[3:], frame, env)
    orders = [*orders, *tie_break(rel)]
    if not rel.keys:
        return strip(rel, rel.df.orderBy(*orders).offset(skip).limit(n))
    return strip(rel, ranked(rel, orders, F.row_number).where(F.col("__rank").between(skip + 1, skip + n)))


@table_function("SAMPLE", "SAMPLEAXISWITHLOCALMINMAX", "SAMPLECARTESIANPOINTSBYCOVER")
def sample(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Evenly spaced rows of the order: positions round(i * (rows - 1) / (n - 1))."""
    n = int(constant(p, node.args[0], frame, env))
    rest = {"SAMPLE": node.args[2:], "SAMPLEAXISWITHLOCALMINMAX": node.args[3:4], "SAMPLECARTESIANPOINTSBYCOVER": node.args[2:4]}[node.name]
    rel, orders = sort_keys(p, p.table(node.args[1], frame, env), rest, frame, env, "ASC")
    ties = [o.at for o in rel.cols]
    rows = 0 if rel.keys else many_rows(rel.df)
    if rows and rows <= n:
        return strip(rel, rel.df)
    if rows:
        keys = [*orders, *((t, False) for t in ties)]
        return strip(rel, evenly_spaced(rel.df, rows, keys, n) if n > 1 else at_positions(rel.df, rows, keys, list(range(n))))
    names = [fresh(x) for x in ("at", "rank", "dense", "n")]
    df = numbered(rel.df, rel.keys, orders, ties, names).withColumn("__n", q(names[3])).withColumn("__at", q(names[0]) - 1)
    if n <= 1:
        return strip(rel, df.where(F.col("__at") < n))
    step = (F.col("__n") - 1) / F.lit(float(n - 1))
    i = F.round(F.col("__at") / step)
    near = [F.bround((i + k) * (F.col("__n") - 1) / F.lit(float(n - 1))) == F.col("__at") for k in (-1, 0, 1)]
    inside = [(i + k).between(0, n - 1) for k in (-1, 0, 1)]
    picked = reduce(lambda a, b: a | b, [x & y for x, y in zip(near, inside)])
    return strip(rel, df.where((F.col("__n") <= n) | picked))


@table_function("ADDMISSINGITEMS")
def add_missing_items(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """Rows for the values of the shown columns that the summary lacks."""
    refs = []
    rest = list(node.args)
    while rest and isinstance(rest[0], s.Ref):
        refs.append(rest.pop(0))
    rel = renamed(p.table(rest[0], frame, env))
    where = [column_of(p, r, env) for r in refs]
    by_table: dict[str, list] = {}
    for w in where:
        by_table.setdefault(w[0], []).append(w)
    axes_ = [renamed(column_values(p, tuple(s.Ref(*w) for w in ws), frame, FilterContext((), env.fc.edges), env, False)) for ws in by_table.values()]
    every = reduce(lambda a, b: joined(a, b, frame, p), axes_)
    own = {w: rel.pick(*w) for w in where}
    if any(o is None for o in own.values()):
        raise DaxError("the summary lacks a shown column")
    pairs = [(o.at, own[o.lineage].at) for o in every.cols]
    extra = every.df.join(rel.df, match(pairs), "left_anti")
    at = {own[o.lineage].at: o.at for o in every.cols}
    filled = extra.select(*[(q(at[o.at]) if o.at in at else F.lit(None).cast(SPARK_TYPE[o.type])).alias(o.at) for o in rel.cols])
    base = rel.df.select(*[q(o.at) for o in rel.cols])
    return Rel(base.unionByName(filled), rel.cols)


@table_function("SUBSTITUTEWITHINDEX")
def substitute_with_index(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    """The common columns of the first replaced by their row's index in the second."""
    left = renamed(p.table(node.args[0], frame, env))
    name = str(constant(p, node.args[1], frame, env))
    right, orders = ordered(p, renamed(p.table(node.args[2], frame, env)), node.args[3:], frame, env, "ASC")
    common = [(x, y) for x in left.cols for y in right.cols if x.name.lower() == y.name.lower() or x.lineage and x.lineage == y.lineage]
    at = fresh("i")
    index = right.df.withColumn(at, (F.row_number().over(Window.partitionBy(*map(q, right.keys)).orderBy(*orders, *tie_break(right))) - 1).cast("long"))
    made = joined(left, Rel(index, [*right.cols, Out(name, at, "int")], right.keys), frame, p, "left", [(x.at, y.at) for x, y in common])
    gone = {x.at for x, _ in common}
    return projected(made, [*[o for o in made.cols[: len(left.cols)] if o.at not in gone], made.cols[-1]])


# -- table to text ---------------------------------------------------------------


def _title(o: Out) -> str:
    return f"'{o.lineage[0]}'[{o.lineage[1]}]" if o.lineage and o.lineage[1] == o.name else f"[{o.name}]"


def _lines(p: Planner, node: s.Call, frame: Frame, env: Env, cell, between: str, row) -> tuple[Rel, list[Val]]:
    rel = p.table(node.args[0], frame, env)
    most = int(constant(p, node.args[1], frame, env)) if len(node.args) > 1 and node.args[1] is not None else 10
    if most >= 0:
        rel = strip(rel, ranked(rel, tie_break(rel), F.row_number).where(F.col("__rank") <= most))
    made = row(F.concat_ws(between, *[cell(o.val) for o in rel.cols]))
    return rel, made


def _joined_rows(p: Planner, rel: Rel, line, frame: Frame, env: Env, between: str) -> tuple:
    inner = p.frame(rel.df, frame, rel.keys)
    at = inner.add(line, "l")
    out, n = fresh("x"), fresh("x")
    order = F.struct(*[q(o.at) for o in rel.cols], q(at).alias("__line"))
    agg = inner.df.groupBy(*map(q, inner.carried)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["__line"]), between).alias(out), F.count(F.lit(1)).alias(n))
    p.settle(frame, inner.carried)
    frame.join_back(agg, list(inner.carried), [out, n])
    return F.coalesce(q(out), F.lit("")), F.coalesce(q(n), F.lit(0).cast("long"))


@special("TOCSV")
def to_csv(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    cell = lambda v: F.coalesce(text(v), F.lit(""))
    rel, line = _lines(p, node, frame, env, cell, ",", lambda c: c)
    body, n = _joined_rows(p, rel, line, frame, env, "\n")
    head = ",".join(map(_title, rel.cols))
    return Val(F.when(n > 0, F.concat(F.lit(head + "\n"), body)).otherwise(F.lit(head)), "str")


@special("TOJSON")
def to_json(p: Planner, node: s.Call, frame: Frame, env: Env) -> Val:
    def cell(v: Val):
        if v.type in ("str", "date"):
            quoted = F.regexp_extract(F.to_json(F.struct(text(v).alias("a"))), r'^\{"a":(.*)\}$', 1)
            return F.when(v.col.isNull(), "null").otherwise(quoted)
        return F.coalesce(F.lower(text(v)) if v.type == "bool" else text(v), F.lit("null"))

    rel, line = _lines(p, node, frame, env, cell, ", ", lambda c: F.concat(F.lit("["), c, F.lit("]")))
    body, n = _joined_rows(p, rel, line, frame, env, ", ")
    head = ", ".join(f'"{_title(o)}"' for o in rel.cols)
    return Val(F.concat(F.lit(f'{{"header": [{head}], "rowCount": '), n.cast("string"), F.lit(', "data": ['), body, F.lit("]}")), "str")

