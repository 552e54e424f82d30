"""The planner: syntax trees to Columns and DataFrames.

``scalar`` compiles an expression to a Column on a frame; ``table`` compiles a
table expression to a row set. An aggregation becomes a grouped DataFrame over
the expanded base table, keyed by the frame's columns that its filters refer
to, and is joined back to the frame. Aggregations over the same table in the
same filter context share one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewright.errors import DaxError, UnknownName, UnsupportedFunction
from cubewright.functions.aggregates import AGGREGATES, ALL_AGGREGATES, ITERATORS
from cubewright.model import Relationship, SemanticModel

from . import syntax as s
from .context import Bound, Env, FilterContext, Frame, Key, Out, Pred, Rel, Sub, Where, fresh, match, q
from .values import BLANK, Val, arithmetic, cast, compare, lit, number, num_type, same_type, truth

#: Names that are words of the language, not tables.
KEYWORDS = frozenset("ASC DESC SKIP DENSE DAY WEEK MONTH QUARTER YEAR HOUR MINUTE SECOND INTEGER DOUBLE STRING BOOLEAN CURRENCY DATETIME ABS REL TRUE FALSE NONE BOTH ONEWAY FIRST LAST KEEP DEFAULT TEXT".split())

#: Filled by the function modules.
SPECIAL: dict[str, Callable] = {}  # (planner, node, frame, env) -> Val
SCALARS: dict[str, Callable] = {}  # (*values) -> Val
TABLES: dict[str, Callable] = {}  # (planner, node, frame, env) -> Rel
REFUSED: dict[str, str] = {}


def special(*names: str):
    def put(f):
        SPECIAL.update(dict.fromkeys(names, f))
        return f

    return put


def table_function(*names: str):
    def put(f):
        TABLES.update(dict.fromkeys(names, f))
        return f

    return put


def keyword(node: s.Node | None) -> str | None:
    return node.name.upper() if isinstance(node, s.Name) and not node.quoted else node.name if isinstance(node, s.Call) and not node.args else None


class Planner:
    def __init__(self, model: SemanticModel) -> None:
        self.model, self.spark = model, model.spark
        self._stack: list[str] = []
        self._contexts: dict = {}

    # -- frames -----------------------------------------------------------

    def one(self) -> Frame:
        return self.frame(self.spark.range(1).select(F.lit(1).alias(fresh("one"))))

    def frame(self, df, parent: Frame | None = None, carried: list[str] | None = None) -> Frame:
        made = Frame(df, parent, carried)
        made.flush_hook = lambda: self.flush(made)
        return made

    # -- base tables under a filter context --------------------------------

    def base(self, table: str, fc: FilterContext, frame: Frame, defer: list | None = None) -> tuple[Rel, Frame]:
        """The rows of ``table`` that ``fc`` leaves, with the keys of ``frame``.

        ``defer``: gets the filters that depend on the context and may multiply
        rows, instead of their being joined.
        """
        source = self.model.tables[table]
        cols = [Out(c, f"{table}[{c}]", self.model.column_type(table, c), (table, c)) for c in source.columns]
        inner = self.frame(source.select(*[q(o.name).alias(o.at) for o in cols]), frame)
        rel = Rel(inner.df, cols, base=table)
        for item in sorted(fc.items, key=lambda i: (isinstance(i, Sub), bool(i.keys))):
            near = {t: self.model.path_up(table, t, fc.edges) for t, _ in item.cols}
            if any(p is None for p in near.values()):
                if all(p is None for p in near.values()):
                    self._across(table, item, fc, inner)
                continue
            at = {c: self.reach(inner, table, c, fc.edges) for c in item.cols}
            if isinstance(item, Pred):
                inner.df = inner.df.where(item.test(lambda t, c, at=at: q(at[t, c])))
            elif isinstance(item, Key):
                if item.key in inner.carried:
                    inner.df = inner.df.where(q(item.key).eqNullSafe(q(at[item.cols[0]])))
                else:
                    inner.df = inner.df.withColumn(item.key, q(at[item.cols[0]]))
                    inner.carried.append(item.key)
            elif item.keys and defer is not None:
                defer.append((item, [at[c] for c in item.cols]))
            else:
                self._sub(inner, item, [at[c] for c in item.cols])
        rel.df, rel.keys = inner.df, inner.carried
        return rel, inner

    def _sub(self, inner: Frame, item: Sub, columns: list[str]) -> None:
        renamed = {n: fresh("in") for n in dict.fromkeys((*item.names, *item.keys))}
        rows = item.df.select(*[q(n).alias(r) for n, r in renamed.items()]).distinct()
        shared = [k for k in item.keys if k in inner.carried]
        new = [k for k in item.keys if k not in inner.carried]
        on = match([(c, renamed[n]) for c, n in zip(columns, item.names)] + [(k, renamed[k]) for k in shared])
        if new:
            joined = inner.df.join(rows, on)
            joined = joined.drop(*[renamed[n] for n in item.names if n not in new], *[renamed[k] for k in shared])
            inner.df = joined.withColumnsRenamed({renamed[k]: k for k in new})
            inner.carried += new
        else:
            inner.df = inner.df.join(rows, on, "left_semi")

    def _across(self, table: str, item, fc: FilterContext, inner: Frame) -> None:
        """A filter of a table that isn't above this one: it comes over relationships
        that filter both ways, or from the rows of the many side (table filters)."""
        if item.whole:
            start = item.cols[0][0]
            path = self.model.path_up(start, table, fc.edges)
            if path:
                many, frame = self.base(start, FilterContext((item,), fc.edges), inner.parent)
                at = self.reach(frame, start, (path[-1].from_table, path[-1].from_column), fc.edges)
                own = f"{table}[{path[-1].to_column}]"
                self._sub(inner, Sub(((table, path[-1].to_column),), frame.df, (at,), tuple(frame.carried)), [own])
                return
        for edge in self.model.edges(fc.edges):
            if edge.many_to_many and self.model.path_up(table, edge.from_table, fc.edges) is not None and all(self.model.path_up(edge.to_table, t, fc.edges) is not None for t, _ in item.cols):
                _, frame = self.base(edge.to_table, FilterContext((item,), fc.edges), inner.parent)
                at = self.reach(inner, table, (edge.from_table, edge.from_column), fc.edges)
                self._sub(inner, Sub(((edge.from_table, edge.from_column),), frame.df, (f"{edge.to_table}[{edge.to_column}]",), tuple(frame.carried)), [at])
                return
            if edge.to_table != table and self.model.path_up(table, edge.to_table, fc.edges) is None:
                continue
            down = {t: self.model.path_up(edge.from_table, t, fc.edges) for t, _ in item.cols}
            if any(p is None for p in down.values()) or not edge.both:
                continue
            many, frame = self.base(edge.from_table, FilterContext((item,), fc.edges), inner.parent)
            at = self.reach(inner, table, (edge.to_table, edge.to_column), fc.edges)
            key = f"{edge.from_table}[{edge.from_column}]"
            self._sub(inner, Sub(((edge.to_table, edge.to_column),), frame.df, (key,), tuple(many.keys)), [at])
            return

    def reach(self, inner: Frame, table: str, column: Where, edges: tuple = ()) -> str:
        """The frame's column for ``column``, joining the tables above ``table`` as needed."""
        t, c = column
        if t == table:
            return f"{t}[{c}]"
        path = self.model.path_up(table, t, edges)
        if path is None:
            raise DaxError(f"'{t}' can't be reached from '{table}'")
        prefix = ""
        at = table
        for edge in path:
            own = f"{at}[{edge.from_column}]" if at == table else f"{prefix}{at}[{edge.from_column}]"
            mark = (edge.ends, prefix)
            step = f"{prefix}>"
            if mark not in inner.joined:
                one = self.model.tables[edge.to_table]
                one = one.select(*[q(x).alias(f"{step}{edge.to_table}[{x}]") for x in one.columns])
                inner.df = inner.df.join(one, q(own) == q(f"{step}{edge.to_table}[{edge.to_column}]"), "left")
                inner.joined[mark] = True
            prefix, at = step, edge.to_table
        return f"{prefix}{t}[{c}]"

    # -- aggregation ---------------------------------------------------------

    def leaf(self, name: str, table: str, args: tuple[s.Node, ...], frame: Frame, env: Env) -> Val:
        """An aggregation over a base table, computed when the frame is flushed."""
        rows = tuple(env.rows)
        memo = ("leaf", name, table, args, id(env.fc), tuple(map(id, rows)), id(env.vars))
        if memo in frame.memo:
            return frame.memo[memo][0]
        out = fresh("a")
        kind = self._leaf_type(name, table, args, frame, env)
        frame.pending.setdefault((table, id(env.fc), tuple(map(id, rows))), []).append((name, args, out, env, kind))
        frame.memo[memo] = (Val(q(out), kind), env)
        return frame.memo[memo][0]

    def _leaf_type(self, name: str, table: str, args: tuple[s.Node, ...], frame: Frame, env: Env) -> str:
        """Types before the columns exist: compiled against the empty table."""
        if not args:
            return ALL_AGGREGATES[name].type([])
        if isinstance(args[0], s.Ref) and args[0].table and args[0].table.lower() == table.lower():
            kind = self.model.column_type(table, self.model.column_name(table, args[0].column))
            return ALL_AGGREGATES[name].type([Val(F.lit(None), kind)])
        if name not in ("SUM", "MIN", "MAX", "SELECTED"):
            return ALL_AGGREGATES[name].type([BLANK])
        rel, inner = self.base(table, FilterContext(), frame)
        return ALL_AGGREGATES[name].type([Val(F.lit(None), self.scalar(a, inner, env.row(inner, rel)).type) for a in args])

    def flush(self, frame: Frame) -> None:
        """Compute what is pending and join it back to the frame."""
        while frame.pending:
            todo, frame.pending = frame.pending, {}
            lone = len(todo) == 1 and frame.lazy and not frame.keep_all
            for (table, _, _), requests in todo.items():
                result, keys, outs = self._grouped(table, requests, frame)
                if lone and set(keys) == set(frame.group_keys) and keys:
                    frame.df = result
                else:
                    frame.join_back(result, keys, outs)

    def _grouped(self, table: str, requests: list, frame: Frame) -> tuple[DataFrame, list[str], list[str]]:
        env = requests[0][3]
        waiting: list | None = [] if all(ALL_AGGREGATES[r[0]].parts for r in requests) else None
        rel, inner = self.base(table, env.fc, frame, waiting)
        row_env = env.row(inner, rel)
        compiled = []
        for name, args, out, _, _ in requests:
            compiled.append((ALL_AGGREGATES[name], [self.scalar(a, inner, row_env) for a in args], out))
        self.flush(inner)
        outs = [out for _, _, out in compiled]
        if not waiting:
            keys = list(inner.carried)
            result = inner.df.groupBy(*map(q, keys)).agg(*[a.direct(v).alias(o) for a, v, o in compiled])
            return result, keys, outs
        # Filters that give each context rows of its own (periods, running totals):
        # aggregate by their columns first, so the join multiplies groups, not rows.
        lineage = list(dict.fromkeys(c for _, columns in waiting for c in columns))
        by = {c: fresh("by") for c in lineage}
        parts, merged = [], []
        for a, v, o in compiled:
            names = [fresh("p") for _ in a.parts(v)]
            parts += [p.alias(n) for p, n in zip(a.parts(v), names)]
            merged.append((a, names, o))
        keys = list(inner.carried)
        inner.df = inner.df.select("*", *[q(c).alias(b) for c, b in by.items()]).groupBy(*map(q, keys), *map(q, by.values())).agg(*parts)
        for item, columns in waiting:
            self._sub(inner, item, [by[c] for c in columns])
        keys = list(inner.carried)
        return inner.df.groupBy(*map(q, keys)).agg(*[a.merge([q(n) for n in names]).alias(o) for a, names, o in merged]), keys, outs

    def over(self, rel: Rel, frame: Frame, env: Env, aggregations: list[tuple[str, list[s.Node | Val]]]) -> list[Val]:
        """Aggregations over any row set, joined back to the frame."""
        inner = self.frame(rel.df, frame, rel.keys)
        row_env = env.row(inner, rel)
        compiled = []
        for name, args in aggregations:
            values = [a if isinstance(a, Val) else self.scalar(a, inner, row_env) for a in args]
            compiled.append((ALL_AGGREGATES[name], values, fresh("x")))
        self.flush(inner)
        keys, outs = list(inner.carried), [o for _, _, o in compiled]
        result = inner.df.groupBy(*map(q, keys)).agg(*[a.direct(v).alias(o) for a, v, o in compiled])
        self.settle(frame, keys)
        frame.join_back(result, keys, outs)
        made = []
        for (a, v, o), (name, _) in zip(compiled, aggregations):
            empty = q(o)
            if name == "COUNT0":
                empty = F.coalesce(empty, F.lit(0).cast("long"))
            made.append(Val(empty, a.type(v)))
        return made

    def settle(self, frame: Frame, keys: list[str]) -> None:
        """Keys may be columns that are still pending."""
        if any(not frame.has(k) for k in keys):
            self.flush(frame)

    # -- scalars -------------------------------------------------------------

    def scalar(self, node: s.Node | None, frame: Frame, env: Env) -> Val:
        if node is None:
            return BLANK
        if isinstance(node, s.Literal):
            return lit(node.value)
        if isinstance(node, s.Ref):
            return self.reference(node, frame, env)
        if isinstance(node, s.Name):
            return self.name(node, frame, env)
        if isinstance(node, s.Let):
            return self.scalar(node.body, frame, self.bind(node, frame, env))
        if isinstance(node, s.Unary):
            v = self.scalar(node.arg, frame, env)
            return Val(~truth(v), "bool") if node.op == "NOT" else Val(-number(v), num_type(v))
        if isinstance(node, s.Binary):
            return self.binary(node, frame, env)
        if isinstance(node, s.Rows):
            return self.to_scalar(self.table(node, frame, env), frame, env)
        return self.call(node, frame, env)

    def binary(self, node: s.Binary, frame: Frame, env: Env) -> Val:
        if node.op == "IN":
            return self.membership(node, frame, env)
        a, b = self.scalar(node.left, frame, env), self.scalar(node.right, frame, env)
        if node.op == "&&":
            return Val(truth(a) & truth(b), "bool")
        if node.op == "||":
            return Val(truth(a) | truth(b), "bool")
        if node.op in ("+", "-", "*", "/", "^", "&"):
            return arithmetic(node.op, a, b)
        return compare(node.op, a, b)

    def membership(self, node: s.Binary, frame: Frame, env: Env) -> Val:
        x = self.scalar(node.left, frame, env)
        if isinstance(node.right, s.Rows):
            values = [self.scalar(row[0], frame, env) for row in node.right.rows]
            if values and all(v.is_const and v.const is not None for v in values) and len({v.type for v in values}) == 1 and x.type == values[0].type:
                return Val(F.coalesce(x.col.isin(*[v.col for v in values]), F.lit(False)), "bool")
            out = F.lit(False)
            for v in values:
                out = out | compare("=", x, v).col
            return Val(out, "bool")
        rel = self.table(node.right, frame, env)
        return self.exists(rel, [x], frame)

    def exists(self, rel: Rel, values: list[Val], frame: Frame) -> Val:
        """Whether the values are a row of ``rel``: a left join on distinct rows."""
        self.settle(frame, rel.keys)
        self.flush(frame)
        named = [(frame.add(cast(v, o.type) if v.type != o.type else v.col), o.at) for v, o in zip(values, rel.cols)]
        flag = fresh("in")
        frame.require(*rel.keys)
        renamed = {n: fresh("on") for n in dict.fromkeys([*(at for _, at in named), *rel.keys])}
        rows = rel.df.select(*[q(n).alias(r) for n, r in renamed.items()]).distinct().withColumn(flag, F.lit(True))
        on = match([(c, renamed[at]) for c, at in named] + [(k, renamed[k]) for k in rel.keys])
        frame.df = frame.df.join(rows, on, "left").drop(*renamed.values())
        return Val(F.coalesce(q(flag), F.lit(False)), "bool")

    def reference(self, node: s.Ref, frame: Frame, env: Env) -> Val:
        for rc in reversed(env.rows):
            out = rc.rel.pick(node.table, node.column)
            if out is not None:
                if rc.frame is not frame:
                    frame.require(out.at)
                return out.val
        if node.table is None:
            measure = self.model.measures.get(node.column.lower())
            if measure is not None:
                return self.measure(node.column, frame, env)
            home = self.model.home_of_column(node.column)
            if home is not None:
                return self.reference(s.Ref(home, node.column), frame, env)
            raise UnknownName(f"nothing is named [{node.column}]")
        if not self.model.has_table(node.table):
            raise UnknownName(f"no table '{node.table}'")
        table = self.model.table_name(node.table)
        if not self.model.has_column(table, node.column):
            if node.column.lower() in self.model.measures:
                return self.measure(node.column, frame, env)
            raise UnknownName(f"no column '{table}'[{node.column}]")
        related = self.related(table, self.model.column_name(table, node.column), frame, env)
        if related is not None:
            return related
        raise DaxError(f"'{table}'[{node.column}] has no row to be read from")

    def related(self, table: str, column: str, frame: Frame, env: Env) -> Val | None:
        """The value above the current row along many -> one relationships."""
        for rc in reversed(env.rows):
            rel, own = rc.rel, rc.frame
            for start in dict.fromkeys(o.lineage[0] for o in rel.cols if o.lineage):
                path = self.model.path_up(start, table, env.fc.edges)
                if not path:
                    continue
                have = rel.pick(start, path[0].from_column)
                if have is None:
                    continue
                if rel.base == start and have.at == f"{start}[{path[0].from_column}]":
                    at = self.reach(own, start, (table, column), env.fc.edges)
                else:
                    at = self._above(own, have.at, path, column)
                if own is not frame:
                    frame.require(at)
                return Val(q(at), self.model.column_type(table, column))
        return None

    def _above(self, own: Frame, start: str, path: list[Relationship], column: str) -> str:
        at = start
        for i, edge in enumerate(path):
            mark = ("above", start, tuple(e.ends for e in path[: i + 1]))
            if mark not in own.joined:
                names = {c: fresh("r") for c in self.model.tables[edge.to_table].columns}
                one = self.model.tables[edge.to_table].select(*[q(c).alias(n) for c, n in names.items()])
                own.df = own.df.join(one, q(at) == q(names[edge.to_column]), "left")
                own.joined[mark] = names
            names = own.joined[mark]
            at = names[column] if i == len(path) - 1 else names[path[i + 1].from_column]
        return at

    def name(self, node: s.Name, frame: Frame, env: Env) -> Val:
        bound = env.vars.get(node.name.lower()) if not node.quoted else None
        if bound is not None:
            if isinstance(bound.value, Rel):
                return self.to_scalar(bound.value, frame, env)
            if bound.frame is frame or bound.value.is_const:
                return bound.value
            if bound.name is None:
                self.flush(bound.frame)
                bound.name = bound.frame.add(bound.value.col, "v")
            frame.require(bound.name)
            return Val(q(bound.name), bound.value.type)
        if node.name.upper() in ("TRUE", "FALSE"):
            return lit(node.name.upper() == "TRUE")
        if self.model.has_table(node.name):
            return self.to_scalar(self.table(node, frame, env), frame, env)
        if node.name.upper() in KEYWORDS:
            return lit(node.name.upper())
        raise UnknownName(f"no variable or table '{node.name}'")

    def bind(self, node: s.Let, frame: Frame, env: Env) -> Env:
        for name, value in node.bindings:
            made = self.table(value, frame, env) if self.is_table(value, env) else self.scalar(value, frame, env)
            env = replace(env, vars={**env.vars, name: Bound(made, frame)})
        return env

    def is_table(self, node: s.Node, env: Env) -> bool:
        if isinstance(node, s.Rows):
            return True
        if isinstance(node, s.Let):
            known = set(env.vars)
            return self.is_table(node.body, env) or isinstance(node.body, s.Name) and node.body.name.lower() not in known and any(n == node.body.name.lower() and self.is_table(b, env) for n, b in node.bindings)
        if isinstance(node, s.Name):
            bound = env.vars.get(node.name.lower())
            return isinstance(bound.value, Rel) if bound is not None else node.name.upper() not in KEYWORDS and self.model.has_table(node.name)
        return isinstance(node, s.Call) and node.name in TABLES

    def call(self, node: s.Call, frame: Frame, env: Env) -> Val:
        name = node.name
        if name in SPECIAL:
            return SPECIAL[name](self, node, frame, env)
        if name in AGGREGATES:
            return self.aggregate(node, frame, env)
        if name in ITERATORS:
            return self.iterate(ITERATORS[name], node.args, frame, env)
        if name in TABLES:
            return self.to_scalar(self.table(node, frame, env), frame, env)
        if name in SCALARS:
            return SCALARS[name](*[self.scalar(a, frame, env) for a in node.args])
        if name in REFUSED:
            raise UnsupportedFunction(f"{name}: {REFUSED[name]}")
        raise UnknownName(f"no function {name}")

    def aggregate(self, node: s.Call, frame: Frame, env: Env) -> Val:
        """SUM(T[c]) and its like: over the filter context, not the row context."""
        name, args = node.name, node.args
        if name in ("MIN", "MAX") and len(args) == 2:
            a, b = (self.scalar(x, frame, env) for x in args)
            (x, y), kind = same_type([a, b])
            pick = F.least(x, y) if name == "MIN" else F.greatest(x, y)
            return Val(F.when(x.isNotNull() & y.isNotNull(), pick), kind)
        if name == "COUNTROWS":
            return self.iterate("COUNTROWS", args or (None,), frame, env)
        first = args[0] if args else None
        if isinstance(first, s.Ref):
            table = self.home(first, env)
            ref = s.Ref(table, self.model.column_name(table, first.column))
            return self.leaf(name, table, (ref, *args[1:]), frame, replace(env, rows=()) if len(args) == 1 else env)
        rel = self.table(first, frame, env)
        return self.over(rel, frame, env, [(name, [rel.cols[0].val, *args[1:]])])[0]

    def home(self, ref: s.Ref, env: Env) -> str:
        table = ref.table or self.model.home_of_column(ref.column)
        if table is None:
            raise UnknownName(f"no column [{ref.column}]")
        return self.model.table_name(table)

    def iterate(self, name: str, args: tuple, frame: Frame, env: Env) -> Val:
        """SUMX(t, e) and its like."""
        over, rest = args[0], tuple(args[1:])
        if isinstance(over, s.Name) and not isinstance(env.vars.get(over.name.lower()), Bound) and self.model.has_table(over.name):
            return self.leaf(name, self.model.table_name(over.name), rest, frame, env)
        if over is None:
            rc = env.rows[-1] if env.rows else None
            if rc is None or rc.rel.base is None:
                raise DaxError(f"{name} needs a table")
            return self.leaf(name, rc.rel.base, rest, frame, env)
        rel = self.table(over, frame, env)
        return self.over(rel, frame, env, [(name, list(rest))])[0]

    def measure(self, name: str, frame: Frame, env: Env) -> Val:
        measure = self.model.measures[name.lower()]
        if measure.name in self._stack:
            raise DaxError(f"[{measure.name}] refers to itself")
        inner = self.transition(frame, env)
        memo = ("measure", measure.name, id(inner.fc), self.model.version)
        if memo in frame.memo:
            return frame.memo[memo][0]
        self._stack.append(measure.name)
        try:
            made = self.scalar(s.parse(measure.expression), frame, replace(inner, vars={}))
        finally:
            self._stack.pop()
        frame.memo[memo] = (made, inner)
        return made

    def transition(self, frame: Frame, env: Env) -> Env:
        """Row contexts become filters: columns of the rows equal their values."""
        if not env.rows:
            return env
        memo = ("transition", id(env.fc), tuple(map(id, env.rows)))
        if memo in self._contexts:
            return replace(env, fc=self._contexts[memo][0], rows=())
        fc = env.fc
        for rc in env.rows:
            from_columns = [o for o in rc.rel.cols if o.lineage]
            if not from_columns:
                continue
            known = {o.lineage for o in from_columns}
            key_of = {t: self.model.keys.get(t) for t in {o.lineage[0] for o in from_columns}}
            # A key says which row it is: the other columns of its table follow from it.
            chosen = [o for o in from_columns if not (k := key_of[o.lineage[0]]) or any((o.lineage[0], c) not in known for c in k) or o.lineage[1] in k]
            fc = fc.without(lambda c, known=known: c in known)
            keys = [Key(o.lineage[0], o.lineage[1], rc.frame.add(q(o.at), "k")) for o in chosen]
            fc = fc.plus(*keys)
        self._contexts[memo] = (fc, env)
        return replace(env, fc=fc, rows=())

    def to_scalar(self, rel: Rel, frame: Frame, env: Env) -> Val:
        """A table of one row and one column as its value."""
        if len(rel.cols) != 1:
            raise DaxError("a table of several columns is no value")
        return self.over(rel, frame, env, [("MAX", [rel.cols[0].val])])[0] if rel.cols[0].type != "bool" else self.over(rel, frame, env, [("ANY", [rel.cols[0].val])])[0]

    # -- tables --------------------------------------------------------------

    def table(self, node: s.Node | None, frame: Frame, env: Env) -> Rel:
        if isinstance(node, s.Name):
            bound = env.vars.get(node.name.lower()) if not node.quoted else None
            if bound is not None:
                if not isinstance(bound.value, Rel):
                    raise DaxError(f"{node.name} is no table")
                return bound.value
            return self.base(self.model.table_name(node.name), env.fc, frame)[0]
        if isinstance(node, s.Let):
            return self.table(node.body, frame, self.bind(node, frame, env))
        if isinstance(node, s.Rows):
            return self.constructed(node, frame, env)
        if isinstance(node, s.Ref):
            return TABLES["VALUES"](self, s.Call("VALUES", (node,)), frame, env)
        if isinstance(node, s.Call):
            if node.name in TABLES:
                return TABLES[node.name](self, node, frame, env)
            if node.name in ("IF", "SWITCH"):
                raise DaxError(f"{node.name} returns no table")
            v = self.scalar(node, frame, env)
            return self.row_of(frame, [("Value", v)])
        if isinstance(node, (s.Literal, s.Binary, s.Unary)):
            return self.row_of(frame, [("Value", self.scalar(node, frame, env))])
        raise DaxError("no table expression")

    def constructed(self, node: s.Rows, frame: Frame, env: Env) -> Rel:
        rows = [[self.scalar(x, frame, env) for x in row] for row in node.rows]
        width = len(rows[0]) if rows else 1
        names = ["Value"] if width == 1 else [f"Value{i + 1}" for i in range(width)]
        typed = [same_type([row[i] for row in rows]) for i in range(width)]
        if all(v.is_const for row in rows for v in row):
            df = self.spark.range(1)
            keys: list[str] = []
        else:
            df, keys = self.distinct_contexts(frame)
        at = [fresh("t") for _ in names]
        array = F.array(*[F.struct(*[typed[i][0][r].alias(at[i]) for i in range(width)]) for r in range(len(rows))])
        one = fresh("row")
        df = df.select(*map(q, keys), F.explode(array).alias(one)).select(*map(q, keys), *[F.col(f"{one}.{a}").alias(a) for a in at])
        return Rel(df, [Out(n, a, typed[i][1]) for i, (n, a) in enumerate(zip(names, at))], keys)

    def distinct_contexts(self, frame: Frame) -> tuple[DataFrame, list[str]]:
        """All columns of the frame as keys."""
        self.flush(frame)
        keys = list(frame.df.columns)
        return frame.df.distinct(), keys

    def row_of(self, frame: Frame, values: list[tuple[str, Val]], lineage: list | None = None) -> Rel:
        """A one-row table per context."""
        if all(v.is_const for _, v in values):
            at = [fresh("t") for _ in values]
            df = self.spark.range(1).select(*[v.col.alias(a) for (_, v), a in zip(values, at)])
            return Rel(df, [Out(n, a, v.type) for (n, v), a in zip(values, at)])
        self.flush(frame)
        at = [frame.add(v.col, "t") for _, v in values]
        # The values are columns of the frame: its own columns are the keys.
        keys = [c for c in frame.df.columns if c not in at]
        renamed = {a: fresh("t") for a in at}
        df = frame.df.select(*map(q, keys), *[q(a).alias(r) for a, r in renamed.items()]).distinct()
        outs = [Out(n, renamed[a], v.type, (lineage or [None] * len(values))[i]) for i, ((n, v), a) in enumerate(zip(values, at))]
        return Rel(df, outs, keys)

    # -- filters of CALCULATE ------------------------------------------------

    def filtered(self, args: tuple, frame: Frame, env: Env) -> Env:
        """The environment inside CALCULATE: transition, then its filter arguments."""
        memo = ("calculate", args, id(env.fc), tuple(map(id, env.rows)), id(env.vars), id(frame))
        if memo in self._contexts:
            return self._contexts[memo][0]
        inner = self.transition(frame, env)
        fc = inner.fc
        for a in args:  # relationship modifiers first: filters are evaluated with them
            if isinstance(a, s.Call) and a.name in ("USERELATIONSHIP", "CROSSFILTER"):
                ends = tuple((self.home(r, env), self.model.column_name(self.home(r, env), r.column)) for r in a.args[:2])
                fc = replace(fc, edges=(*fc.edges, ("use", ends, None) if a.name == "USERELATIONSHIP" else ("cross", ends, keyword(a.args[2]).lower())))
        added, removals = [], []
        for a in args:
            if a is None or isinstance(a, s.Call) and a.name in ("USERELATIONSHIP", "CROSSFILTER"):
                continue
            gone, items = self.filter_argument(a, frame, replace(env, fc=replace(env.fc, edges=fc.edges)))
            removals.append(gone)
            added += items
        for gone in removals:
            if gone is not None:
                fc = gone(fc)
        made = replace(inner, fc=fc.plus(*added))
        self._contexts[memo] = (made, env, frame)
        return made

    def filter_argument(self, node: s.Node, frame: Frame, env: Env):
        """(what it lifts or None, the filters it adds) of one filter argument."""
        lift = lambda cols: lambda fc: fc.without(lambda c: c in cols)
        if isinstance(node, s.Call):
            name = node.name
            if name == "KEEPFILTERS":
                return None, self.filter_argument(node.args[0], frame, env)[1]
            if name in ("ALL", "REMOVEFILTERS", "ALLNOBLANKROW", "ALLCROSSFILTERED") and all(isinstance(a, (s.Name, s.Ref)) for a in node.args):
                if not node.args:
                    return (lambda fc: replace(fc, items=())), []
                return self._lifted(node.args, env), []
            if name == "ALLEXCEPT":
                table = self.model.table_name(node.args[0].name)
                kept = {(self.home(r, env), self.model.column_name(self.home(r, env), r.column)) for r in node.args[1:]}
                above = self.model.expanded(table, env.fc.edges)
                return (lambda fc: fc.without(lambda c: c[0] in above and c not in kept)), []
            if name == "ALLSELECTED":
                if not node.args:
                    return (lambda fc: replace(fc, items=())), list(env.selected.items)
                lifted = self._lifted(node.args, env)
                back = [i for i in env.selected.items if not lifted(FilterContext((i,))).items]
                return lifted, back
            if name == "FILTER":
                quick = self._predicate_filter(node, frame, env)
                if quick is not None:
                    return quick
            if name == "NONVISUAL":
                return self.filter_argument(node.args[0], frame, env)
            if name in ("NOT", "AND", "OR", "TRUE", "FALSE", "ISBLANK", "CONTAINSSTRING", "CONTAINSSTRINGEXACT", "EXACT", "IF", "SEARCH", "FIND", "LEFT", "YEAR", "MONTH") or name not in TABLES:
                return self._boolean(node, frame, env)
            rel = self.table(node, frame, env)
            return self._table_filter(rel)
        if isinstance(node, (s.Binary, s.Unary)):
            return self._boolean(node, frame, env)
        return self._table_filter(self.table(node, frame, env))

    def _lifted(self, args: tuple, env: Env):
        cols: set[Where] = set()
        tables: set[str] = set()
        for a in args:
            if isinstance(a, s.Name):
                tables |= self.model.expanded(self.model.table_name(a.name), env.fc.edges)
            else:
                home = self.home(a, env)
                cols.add((home, self.model.column_name(home, a.column)))
        return lambda fc: fc.without(lambda c: c in cols or c[0] in tables)

    def _own_columns(self, node: s.Node, env: Env) -> set[Where] | None:
        """The columns a row predicate reads; None if it is more than that."""
        cols: set[Where] = set()
        for n in s.walk(node):
            if isinstance(n, s.Ref):
                if n.table is None and (n.column.lower() in self.model.measures or self.model.home_of_column(n.column) is None):
                    return None
                home = self.home(n, env)
                if not self.model.has_column(home, n.column):
                    return None
                cols.add((home, self.model.column_name(home, n.column)))
            elif isinstance(n, s.Name):
                bound = env.vars.get(n.name.lower())
                if bound is not None and not (isinstance(bound.value, Val) and bound.value.is_const):
                    return None
                if bound is None and n.name.upper() not in KEYWORDS:
                    return None
            elif isinstance(n, s.Call) and (n.name in AGGREGATES and not (n.name in ("MIN", "MAX") and len(n.args) == 2) or n.name in ITERATORS or n.name in TABLES or n.name in SPECIAL and n.name not in ROW_SPECIAL):
                return None
            elif isinstance(n, s.Let):
                return None
        return cols

    def _pred(self, node: s.Node, cols: set[Where], frame: Frame, env: Env) -> Pred:
        order = tuple(sorted(cols))

        def test(column: Callable[[str, str], Column]) -> Column:
            outs = {c: Val(column(*c), self.model.column_type(*c)) for c in order}
            return truth(self.row_predicate(node, outs, env))

        return Pred(order, test)

    def row_predicate(self, node: s.Node, outs: dict[Where, Val], env: Env) -> Val:
        """A predicate over given columns only."""
        if isinstance(node, s.Ref):
            home = self.home(node, env)
            return outs[home, self.model.column_name(home, node.column)]
        if isinstance(node, s.Literal):
            return lit(node.value)
        if isinstance(node, s.Name):
            bound = env.vars.get(node.name.lower())
            return bound.value if bound else lit(node.name.upper() == "TRUE") if node.name.upper() in ("TRUE", "FALSE") else lit(node.name.upper())
        if isinstance(node, s.Unary):
            v = self.row_predicate(node.arg, outs, env)
            return Val(~truth(v), "bool") if node.op == "NOT" else Val(-number(v), num_type(v))
        if isinstance(node, s.Binary):
            if node.op == "IN":
                x = self.row_predicate(node.left, outs, env)
                out = F.lit(False)
                for row in node.right.rows:
                    out = out | compare("=", x, self.row_predicate(row[0], outs, env)).col
                return Val(out, "bool")
            a, b = self.row_predicate(node.left, outs, env), self.row_predicate(node.right, outs, env)
            if node.op in ("&&", "||"):
                return Val(truth(a) & truth(b) if node.op == "&&" else truth(a) | truth(b), "bool")
            return arithmetic(node.op, a, b) if node.op in "+-*/^&" else compare(node.op, a, b)
        values = [self.row_predicate(a, outs, env) for a in node.args]
        if node.name in ROW_SPECIAL:
            return ROW_SPECIAL[node.name](values)
        if node.name in ("MIN", "MAX"):
            (x, y), kind = same_type(values)
            return Val(F.when(x.isNotNull() & y.isNotNull(), F.least(x, y) if node.name == "MIN" else F.greatest(x, y)), kind)
        if node.name not in SCALARS:
            raise UnknownName(f"no function {node.name}")
        return SCALARS[node.name](*values)

    def _boolean(self, node: s.Node, frame: Frame, env: Env):
        """T[c] > 5 and its like: FILTER(ALL(T[c]), ...)."""
        cols = self._own_columns(node, env)
        if cols and len({t for t, _ in cols}) == 1:
            return (lambda fc: fc.without(lambda c: c in cols)), [self._pred(node, cols, frame, env)]
        named = [n for n in s.walk(node) if isinstance(n, s.Ref) and (n.table is not None or n.column.lower() not in self.model.measures)]
        inside = {id(r) for n in s.walk(node) if isinstance(n, s.Call) and (n.name in AGGREGATES or n.name in TABLES or n.name in ITERATORS or n.name in ("SELECTEDVALUE", "CALCULATE")) for r in s.walk(n) if isinstance(r, s.Ref)}
        free = tuple(dict.fromkeys(n for n in named if id(n) not in inside))
        if not free:
            raise DaxError("a filter needs a column")
        return self._table_filter(self.table(s.Call("FILTER", (s.Call("ALL", free), node)), frame, env))

    def _predicate_filter(self, node: s.Call, frame: Frame, env: Env):
        """FILTER over a table, ALL or VALUES whose predicate reads only its own columns."""
        over, test = node.args
        cols = self._own_columns(test, env)
        if not cols:
            return None
        if isinstance(over, s.Name) and over.name.lower() not in env.vars:
            table = self.model.table_name(over.name)
            return (None, [replace(self._pred(test, cols, frame, env), whole=True)]) if {t for t, _ in cols} == {table} else None
        if isinstance(over, s.Call) and over.name in ("ALL", "VALUES", "DISTINCT") and over.args:
            if all(isinstance(a, s.Ref) for a in over.args):
                own = {(self.home(a, env), self.model.column_name(self.home(a, env), a.column)) for a in over.args}
                if cols <= own:
                    return (lambda fc: fc.without(lambda c: c in own)) if over.name == "ALL" else None, [self._pred(test, cols, frame, env)]
            if over.name == "ALL" and isinstance(over.args[0], s.Name):
                table = self.model.table_name(over.args[0].name)
                if {t for t, _ in cols} == {table}:
                    above = self.model.expanded(table, env.fc.edges)
                    return (lambda fc: fc.without(lambda c: c[0] in above)), [self._pred(test, cols, frame, env)]
        return None

    def _table_filter(self, rel: Rel):
        outs = [o for o in rel.cols if o.lineage]
        if not outs:
            return None, []
        cols = {o.lineage for o in outs}
        if rel.base is not None and (key := self.model.keys.get(rel.base)):
            kept = [o for o in outs if o.lineage[0] != rel.base or o.lineage[1] in key]
            if {o.lineage[1] for o in kept if o.lineage[0] == rel.base} >= set(key):
                outs = kept
        item = Sub(tuple(o.lineage for o in outs), rel.df, tuple(o.at for o in outs), tuple(rel.keys), rel.base is not None)
        if rel.shift:
            tables = {t for t, _ in cols}
            return (lambda fc: fc.without(lambda c: c[0] in tables)), [item]
        return (lambda fc: fc.without(lambda c: c in cols)), [item]


#: Lazy or variadic functions that a row predicate may use: values -> Val. Filled by functions.logic.
ROW_SPECIAL: dict[str, Callable] = {}
