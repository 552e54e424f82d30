"""The semantic model: tables as DataFrames, relationships, measures, roles.

Everything stays lazy: a table is a DataFrame, a calculated column a projection
on it, a calculated table the DataFrame of its expression.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubewright.errors import DaxError, UnknownName


@dataclass(frozen=True)
class Relationship:
    """Many side -> one side. ``both``: filters also flow from many to one.

    ``trusted``: every key of the many side is known to exist on the one side, so
    that no BLANK member is looked for (that costs an anti-join otherwise).
    """

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    active: bool = True
    both: bool = False
    trusted: bool = False
    many_to_many: bool = False

    @property
    def ends(self) -> tuple[str, str, str, str]:
        return (self.from_table, self.from_column, self.to_table, self.to_column)


@dataclass(frozen=True)
class Measure:
    name: str
    expression: str
    table: str | None = None
    format: str | None = None


@dataclass
class SemanticModel:
    spark: SparkSession
    name: str = "Model"
    culture: str = "en-US"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    date_columns: dict[str, str] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    measures: dict[str, Measure] = field(default_factory=dict)
    calculated_columns: dict[tuple[str, str], str] = field(default_factory=dict)
    calculated_tables: dict[str, str] = field(default_factory=dict)
    roles: dict[str, dict[str, str]] = field(default_factory=dict)
    sort_by: dict[tuple[str, str], str] = field(default_factory=dict)
    annotations: dict[str, dict] = field(default_factory=dict)
    version: int = 0

    # -- building ---------------------------------------------------------

    def add_table(self, name: str, df: DataFrame, key: str | tuple[str, ...] | None = None, date_column: str | None = None) -> SemanticModel:
        self.tables[name] = normalised(df)
        if key:
            self.keys[name] = (key,) if isinstance(key, str) else tuple(key)
        if date_column:
            self.date_columns[name] = date_column
        self.version += 1
        return self

    def relate(self, many: str, one: str, **options: bool) -> SemanticModel:
        """``relate("F[k]", "K[k]")``; the one side's column becomes its table's key."""
        (ft, fc), (tt, tc) = (self._column(x) for x in (many, one))
        edge = Relationship(ft, fc, tt, tc, **options)
        self.relationships.append(edge)
        if not edge.many_to_many:
            self.keys.setdefault(tt, (tc,))
        self.version += 1
        return self

    def measure(self, name: str, expression: str, table: str | None = None, format: str | None = None) -> SemanticModel:
        self.measures[name.lower()] = Measure(name, expression, self.table_name(table) if table else None, format)
        self.version += 1
        return self

    def calculated_column(self, table: str, name: str, expression: str) -> SemanticModel:
        """Add a column computed per row of ``table``; a projection, nothing is stored."""
        from cubewright.api import with_column

        table = self.table_name(table)
        self.tables[table] = normalised(with_column(self, table, name, expression))
        self.calculated_columns[table, name] = expression
        self.version += 1
        return self

    def calculated_table(self, name: str, expression: str) -> SemanticModel:
        from cubewright.api import table_expression

        self.add_table(name, table_expression(self, expression))
        self.calculated_tables[name] = expression
        return self

    def role(self, name: str, **filters: str) -> SemanticModel:
        """Row-level security: table -> boolean row expression."""
        self.roles[name] = {self.table_name(t): e for t, e in filters.items()}
        return self

    def calculated(self, tables: dict[str, str] | None = None, columns: dict[tuple[str, str], str] | None = None) -> SemanticModel:
        """Add calculated tables and columns given in any order: each after those it refers to."""
        waiting = [((name, None), e) for name, e in (tables or {}).items()] + list((columns or {}).items())
        while waiting:
            names = {(t if c is None else f"{t}[{c}]").lower() for (t, c), _ in waiting}
            ready = [(at, e) for at, e in waiting if not (self._uses(e) | ({at[0].lower()} if at[1] else set())) & names - {(at[0] if at[1] is None else f"{at[0]}[{at[1]}]").lower()}]
            if not ready:
                raise DaxError(f"these refer to each other: {', '.join(sorted(names))}")
            for (table, column), e in ready:
                self.calculated_table(table, e) if column is None else self.calculated_column(table, column, e)
            waiting = [x for x in waiting if x not in ready]
        return self

    def _uses(self, expression: str, seen: frozenset = frozenset()) -> set[str]:
        """Names of tables, and of columns as table[column], in an expression and the measures it calls."""
        from cubewright.plans import syntax

        out: set[str] = set()
        for n in syntax.walk(syntax.parse(expression)):
            if isinstance(n, syntax.Name):
                out.add(n.name.lower())
            elif isinstance(n, syntax.Ref) and n.table:
                out |= {n.table.lower(), f"{n.table}[{n.column}]".lower()}
            elif isinstance(n, syntax.Ref) and n.column.lower() in self.measures and n.column.lower() not in seen:
                out |= self._uses(self.measures[n.column.lower()].expression, seen | {n.column.lower()})
        return out

    # -- editing ----------------------------------------------------------

    def drop_measure(self, name: str) -> SemanticModel:
        if self.measures.pop(name.lower(), None) is None:
            raise UnknownName(f"no measure [{name}]")
        self.version += 1
        return self

    def change_measure(self, name: str, expression: str | None = None, new_name: str | None = None, format: str | None = None) -> SemanticModel:
        if name.lower() not in self.measures:
            raise UnknownName(f"no measure [{name}]")
        old = self.measures.pop(name.lower())
        return self.measure(new_name or old.name, expression or old.expression, old.table, format or old.format)

    def drop_column(self, column: str) -> SemanticModel:
        """``drop_column("F[v]")``: the column, its relationships and its sort order go."""
        table, name = self._column(column)
        self.tables[table] = self.tables[table].drop(name)
        self.relationships = [r for r in self.relationships if (table, name) not in ((r.from_table, r.from_column), (r.to_table, r.to_column))]
        self.calculated_columns.pop((table, name), None)
        self.sort_by = {c: by for c, by in self.sort_by.items() if c != (table, name) and (c[0], by) != (table, name)}
        if name in self.keys.get(table, ()):
            del self.keys[table]
        if self.date_columns.get(table) == name:
            del self.date_columns[table]
        self.version += 1
        return self

    def drop_table(self, name: str) -> SemanticModel:
        """The table and what belongs to it: relationships, its measures, its columns' definitions."""
        table = self.table_name(name)
        for held in (self.tables, self.keys, self.date_columns, self.calculated_tables):
            held.pop(table, None)
        self.relationships = [r for r in self.relationships if table not in (r.from_table, r.to_table)]
        self.measures = {k: x for k, x in self.measures.items() if x.table != table}
        self.calculated_columns = {c: e for c, e in self.calculated_columns.items() if c[0] != table}
        self.sort_by = {c: by for c, by in self.sort_by.items() if c[0] != table}
        self.roles = {r: {t: e for t, e in filters.items() if t != table} for r, filters in self.roles.items()}
        self.version += 1
        return self

    def _relationship(self, many: str, one: str) -> int:
        ends = (*self._column(many), *self._column(one))
        at = next((i for i, r in enumerate(self.relationships) if r.ends == ends), None)
        if at is None:
            raise UnknownName(f"no relationship from {many} to {one}")
        return at

    def drop_relationship(self, many: str, one: str) -> SemanticModel:
        del self.relationships[self._relationship(many, one)]
        self.version += 1
        return self

    def change_relationship(self, many: str, one: str, **options: bool) -> SemanticModel:
        """``change_relationship("F[k]", "K[k]", active=False, both=True)``"""
        at = self._relationship(many, one)
        self.relationships[at] = replace(self.relationships[at], **options)
        self.version += 1
        return self

    def sorted_by(self, column: str, by: str) -> SemanticModel:
        """``sorted_by("D[MonthName]", "Month")``"""
        table, name = self._column(column)
        self.sort_by[table, name] = self.column_name(table, by)
        return self

    def copy(self) -> SemanticModel:
        return replace(self, tables=dict(self.tables), keys=dict(self.keys), date_columns=dict(self.date_columns), relationships=list(self.relationships), measures=dict(self.measures), calculated_columns=dict(self.calculated_columns), calculated_tables=dict(self.calculated_tables), roles=dict(self.roles), sort_by=dict(self.sort_by), annotations=dict(self.annotations))

    # -- looking up -------------------------------------------------------

    def table_name(self, name: str) -> str:
        found = next((t for t in self.tables if t.lower() == name.lower()), None)
        if found is None:
            raise UnknownName(f"no table '{name}'")
        return found

    def has_table(self, name: str) -> bool:
        return any(t.lower() == name.lower() for t in self.tables)

    def column_name(self, table: str, column: str) -> str:
        found = next((c for c in self.tables[table].columns if c.lower() == column.lower()), None)
        if found is None:
            raise UnknownName(f"no column '{table}'[{column}]")
        return found

    def has_column(self, table: str, column: str) -> bool:
        return any(c.lower() == column.lower() for c in self.tables[table].columns)

    def _column(self, text: str) -> tuple[str, str]:
        table, _, column = text.rstrip("]").partition("[")
        table = self.table_name(table.strip().strip("'"))
        return table, self.column_name(table, column)

    def column_type(self, table: str, column: str) -> str:
        return dax_type(self.tables[table].schema[column].dataType)

    def home_of_column(self, column: str) -> str | None:
        found = [t for t in self.tables if self.has_column(t, column)]
        return found[0] if len(found) == 1 else None

    # -- the relationship graph -------------------------------------------

    def edges(self, overrides: tuple = ()) -> list[Relationship]:
        """Active relationships, with the overrides of USERELATIONSHIP and CROSSFILTER."""
        out = list(self.relationships)
        for kind, ends, how in overrides:
            hit = next((r for r in out if {(r.from_table, r.from_column), (r.to_table, r.to_column)} == set(ends)), None)
            if hit is None:
                raise DaxError(f"no relationship between {ends}")
            pair = {hit.from_table, hit.to_table}
            if kind == "use":
                out = [replace(r, active=r is hit) if {r.from_table, r.to_table} == pair else r for r in out]
            elif how == "none":
                out = [replace(r, active=False) if r is hit else r for r in out]
            else:
                out = [replace(r, both=how == "both", active=True) if r is hit else r for r in out]
        return [r for r in out if r.active]

    def path_up(self, start: str, end: str, overrides: tuple = ()) -> list[Relationship] | None:
        """Shortest chain of many -> one steps from ``start`` to ``end``."""
        edges, seen, queue = self.edges(overrides), {start}, deque([(start, [])])
        while queue:
            table, path = queue.popleft()
            if table == end:
                return path
            for r in edges:
                if r.from_table == table and r.to_table not in seen and not r.many_to_many:
                    seen.add(r.to_table)
                    queue.append((r.to_table, [*path, r]))
        return None

    def expanded(self, table: str, overrides: tuple = ()) -> set[str]:
        return {t for t in self.tables if self.path_up(table, t, overrides) is not None}

    def has_orphans(self, edge: Relationship) -> bool:
        """Whether the many side has keys that the one side lacks (the BLANK member)."""
        if edge.trusted:
            return False
        memo = self.__dict__.setdefault("_orphans", {})
        at = (edge.ends, self.version)
        if at not in memo:
            one = self.tables[edge.to_table].select(F.col(f"`{edge.to_column}`").alias("one")).distinct()
            many = self.tables[edge.from_table].select(F.col(f"`{edge.from_column}`").alias("many")).distinct()
            memo[at] = not many.join(one, F.col("many") == F.col("one"), "left_anti").isEmpty()
        return memo[at]

    def has_blank_member(self, table: str) -> bool:
        return any(self.has_orphans(r) for r in self.relationships if r.active and r.to_table == table and not r.many_to_many)

    @cached_property
    def first_day(self) -> str:
        return "Sunday"


def dax_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, T.DecimalType):
        return "dec"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "dbl"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.NullType):
        return "blank"
    return "str"


SPARK_TYPE = {"int": "long", "dbl": "double", "dec": "decimal(19,4)", "bool": "boolean", "date": "timestamp_ntz", "str": "string", "blank": "string"}


def normalised(df: DataFrame) -> DataFrame:
    """Columns of one Spark type per DAX type; the rest passes as it is."""
    to = []
    for f in df.schema.fields:
        kind = dax_type(f.dataType)
        want = SPARK_TYPE[kind]
        keep = f.dataType.simpleString().startswith(("array", "map", "struct", "binary")) or kind == "dec" and f.dataType.simpleString() == "decimal(19,4)"
        c = F.col(f"`{f.name}`")
        to.append(c if keep or T.DataType.simpleString(f.dataType) == {"long": "bigint"}.get(want, want) else c.cast(want).alias(f.name))
    return df.select(*to)
