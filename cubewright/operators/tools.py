"""Data tools: table queries, value search, profiles, row differences, replacement."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewright.errors import DaxError, DaxSyntaxError
from cubewright.model import SemanticModel, dax_type
from cubewright.operators.profiles import distinct_counts
from cubewright.plans.context import q
from cubewright.plans.values import Val, text

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>\[[^\]]+\]|"[^"]+"|[^\W\d]\w*)|(?P<op><>|!=|<=|>=|[=<>(),]))""")


class _Where:
    """Parser of WHERE conditions: comparisons, LIKE, IN, BETWEEN, IS NULL, NOT, AND, OR."""

    def __init__(self, source: str, df: DataFrame) -> None:
        self.df, self.tokens, at = df, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise DaxSyntaxError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def word(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1].upper() if self.at + k < len(self.tokens) else ""

    def eat(self, what: str) -> bool:
        if self.word() == what:
            self.at += 1
            return True
        return False

    def whole(self) -> Column:
        made = self.either()
        if self.at < len(self.tokens):
            raise DaxSyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
        return made

    def either(self) -> Column:
        out = self.both()
        while self.eat("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.eat("AND"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.eat("NOT"):
            return ~self.one()
        if self.eat("("):
            out = self.either()
            if not self.eat(")"):
                raise DaxSyntaxError("expected ')'")
            return out
        c = self.column()
        negated = self.eat("NOT")
        if self.eat("LIKE"):
            out = c.cast("string").ilike(str(self.value()))
        elif self.eat("IN"):
            if not self.eat("("):
                raise DaxSyntaxError("expected '('")
            values = [self.value()]
            while self.eat(","):
                values.append(self.value())
            if not self.eat(")"):
                raise DaxSyntaxError("expected ')'")
            out = c.isin(*[self.typed(v) for v in values])
        elif self.eat("BETWEEN"):
            low = self.typed(self.value())
            if not self.eat("AND"):
                raise DaxSyntaxError("expected AND")
            out = c.between(low, self.typed(self.value()))
        elif self.eat("IS"):
            negated = self.eat("NOT")
            if not self.eat("NULL"):
                raise DaxSyntaxError("expected NULL")
            out = c.isNull()
        else:
            op = self.word()
            self.at += 1
            v = self.typed(self.value())
            out = {"=": c == v, "<>": c != v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}.get(op)
            if out is None:
                raise DaxSyntaxError(f"no operator {op}")
        return ~out if negated else out

    def column(self) -> Column:
        kind, name = self.tokens[self.at]
        if kind != "name":
            raise DaxSyntaxError(f"expected a column, found {name!r}")
        self.at += 1
        return q(column_named(self.df, name.strip('[]"')))

    def value(self) -> object:
        kind, raw = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return raw[1:-1].replace("''", "'")
        if kind == "number":
            return float(raw) if "." in raw else int(raw)
        if raw.upper() in ("TRUE", "FALSE"):
            return raw.upper() == "TRUE"
        raise DaxSyntaxError(f"expected a value, found {raw!r}")

    def typed(self, v: object) -> Column:
        return F.lit(v)


def column_named(df: DataFrame, name: str) -> str:
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        raise DaxError(f"no column {name}")
    return found


def query_table(model: SemanticModel, table: str, columns: list[str] | None = None, where: str | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """SELECT columns FROM table WHERE ... ORDER BY ... LIMIT, as one lazy plan."""
    df = model.tables[model.table_name(table)]
    if where:
        df = df.where(_Where(where, df).whole())
    if order_by:
        orders = []
        for part in order_by.split(","):
            name, _, way = part.strip().rpartition(" ")
            name, down = (name, way.upper() == "DESC") if way.upper() in ("ASC", "DESC") else (part.strip(), False)
            c = q(column_named(df, name.strip('[]"')))
            orders.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        df = df.orderBy(*orders)
    if columns:
        df = df.select(*[q(column_named(df, c)) for c in columns])
    return df.limit(limit) if limit is not None else df


def _texts(df: DataFrame) -> list[tuple[str, Column]]:
    return [(f.name, text(Val(q(f.name), dax_type(f.dataType)))) for f in df.schema.fields if not f.dataType.simpleString().startswith(("array", "map", "struct", "binary"))]


def find_value(model: SemanticModel, value: str, exact: bool = False, tables: list[str] | None = None) -> DataFrame:
    """How often each column has the value: one pass over each table."""
    parts = []
    for t in tables or list(model.tables):
        df = model.tables[model.table_name(t)]
        cols = _texts(df)
        hit = lambda c: (c == value) if exact else F.contains(F.lower(c), F.lit(value.lower()))
        one = df.agg(*[F.count_if(hit(c)).alias(f"n{i}") for i, (_, c) in enumerate(cols)])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(model.table_name(t)).alias("table"), F.lit(n).alias("column"), F.col(f"n{i}").alias("matches")) for i, (n, _) in enumerate(cols)]))))
    return reduce(DataFrame.unionByName, parts).where("matches > 0")


def table_stats(model: SemanticModel, table: str) -> DataFrame:
    """Per column: type, rows, nulls, distinct, min, max, average, text lengths; one aggregation,
    and one of its own for each column's distinct values."""
    df = model.tables[model.table_name(table)]
    cols = [(f.name, dax_type(f.dataType)) for f in df.schema.fields if not f.dataType.simpleString().startswith(("array", "map", "struct", "binary"))]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(cols):
        numbers = kind in ("int", "dbl", "dec")
        aggs += [
            text(Val(F.min(q(c)), kind)).alias(f"min{i}"), text(Val(F.max(q(c)), kind)).alias(f"max{i}"),
            (F.avg(q(c)) if numbers else F.lit(None)).cast("double").alias(f"avg{i}"),
            (F.min(F.length(q(c))) if kind == "str" else F.lit(None)).cast("long").alias(f"short{i}"), (F.max(F.length(q(c))) if kind == "str" else F.lit(None)).cast("long").alias(f"long{i}"),
        ]
    one = df.agg(*aggs)
    each = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("rows"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"avg{i}").alias("avg"), F.col(f"short{i}").alias("min_length"), F.col(f"long{i}").alias("max_length"))
        for i, (c, kind) in enumerate(cols)
    ]
    counted = distinct_counts(df, [c for c, _ in cols]).withColumnRenamed("column", "of")
    made = one.select(F.inline(F.array(*each))).join(counted, F.col("column") == F.col("of"))
    return made.select("column", "type", "rows", "nulls", "distinct", "min", "max", "avg", "min_length", "max_length")


def top_values(model: SemanticModel, table: str, n: int = 5) -> DataFrame:
    """The n most frequent values of each column: counted by column and value, then ranked."""
    from pyspark.sql import Window

    df = model.tables[model.table_name(table)]
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in _texts(df)])))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    over = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)


def data_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added, removed or changed by key, with the columns that changed."""
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*[q(k).alias(f"o_{k}") for k in keys], F.struct(*[q(c) for c in shared]).alias("o")) if shared else old.select(*[q(k).alias(f"o_{k}") for k in keys], F.lit(1).alias("o"))
    b = new.select(*[q(k).alias(f"n_{k}") for k in keys], F.struct(*[q(c) for c in shared]).alias("n")) if shared else new.select(*[q(k).alias(f"n_{k}") for k in keys], F.lit(1).alias("n"))
    on = reduce(lambda x, y: x & y, [q(f"o_{k}").eqNullSafe(q(f"n_{k}")) for k in keys])
    joined = a.join(b, on, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")), F.lit(c)) for c in shared])) if shared else F.array().cast("array<string>")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size("changed") > 0, "changed")
    out = joined.withColumn("changed", F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    return out.select(*[F.coalesce(q(f"o_{k}"), q(f"n_{k}")).alias(k) for k in keys], kind.alias("change"), F.array_join("changed", ",").alias("columns")).where("change IS NOT NULL")


def replace_value(model: SemanticModel, table: str, column: str, old: object, new: object) -> DataFrame:
    """The table with one value of a column replaced."""
    df = model.tables[model.table_name(table)]
    c = column_named(df, column)
    return df.withColumn(c, F.when(q(c).eqNullSafe(F.lit(old)), F.lit(new).cast(df.schema[c].dataType)).otherwise(q(c)))
