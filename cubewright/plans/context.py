"""The filter context, row contexts and frames: what an expression is compiled in.

A frame is a DataFrame with one row per evaluation context. Filters that depend
on the context refer to columns of the frame (keys), so that one grouped
aggregation answers all contexts and joins back on the keys that it used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewright.errors import DaxError

from .values import Val

Where = tuple[str, str]  # table, column
_numbers = itertools.count()


def fresh(prefix: str) -> str:
    return f"__{prefix}{next(_numbers)}"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def match(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (q(x).eqNullSafe(q(y)) for x, y in pairs))


@dataclass(frozen=True, eq=False)
class Pred:
    """A condition on columns that doesn't depend on the context.

    ``whole``: it filters whole rows of its table, so tables above it too.
    """

    cols: tuple[Where, ...]
    test: Callable[[Callable[[str, str], Column]], Column]
    keys: tuple[str, ...] = ()
    whole: bool = False


@dataclass(frozen=True, eq=False)
class Key:
    """A column equals the frame's column ``key``."""

    table: str
    column: str
    key: str

    @property
    def cols(self) -> tuple[Where, ...]:
        return ((self.table, self.column),)

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.key,)

    @property
    def whole(self) -> bool:
        return False


@dataclass(frozen=True, eq=False)
class Sub:
    """Columns are in the rows of a DataFrame: ``names`` for ``cols``, ``keys`` of the frame."""

    cols: tuple[Where, ...]
    df: DataFrame
    names: tuple[str, ...]
    keys: tuple[str, ...] = ()
    whole: bool = False


Item = Pred | Key | Sub


@dataclass(frozen=True, eq=False)
class FilterContext:
    items: tuple[Item, ...] = ()
    edges: tuple = ()

    def without(self, gone: Callable[[Where], bool]) -> FilterContext:
        """Filters on the columns that ``gone`` names are lifted; others stay."""
        out: list[Item] = []
        for item in self.items:
            hit = [gone(c) for c in item.cols]
            if not any(hit):
                out.append(item)
            elif isinstance(item, Sub) and not all(hit):
                kept = [(c, n) for c, n, h in zip(item.cols, item.names, hit) if not h]
                names = tuple(n for _, n in kept)
                out.append(Sub(tuple(c for c, _ in kept), item.df.select(*map(q, (*names, *item.keys))).distinct(), names, item.keys))
            elif isinstance(item, Pred) and not all(hit):
                out.append(item)
        return replace(self, items=tuple(out))

    def plus(self, *items: Item) -> FilterContext:
        return replace(self, items=self.items + items)

    def filters(self, where: Callable[[Where], bool]) -> bool:
        return any(where(c) for item in self.items for c in item.cols)


@dataclass(frozen=True)
class Out:
    """A column of a row set: its name, the DataFrame's column, type, and where it comes from."""

    name: str
    at: str
    type: str
    lineage: Where | None = None

    @property
    def val(self) -> Val:
        return Val(q(self.at), self.type)


@dataclass(eq=False)
class Rel:
    """A table value: a DataFrame, its columns, and the outer frame's keys it depends on.

    ``base``: rows are entire rows of that table. ``shift``: it came from a
    time-intelligence function, whose dates replace all filters of their table.
    """

    df: DataFrame
    cols: list[Out]
    keys: list[str] = field(default_factory=list)
    base: str | None = None
    shift: bool = False

    def pick(self, table: str | None, column: str) -> Out | None:
        low = column.lower()
        if table is not None:
            t = table.lower()
            return next((o for o in self.cols if o.lineage and o.lineage[0].lower() == t and o.lineage[1].lower() == low), None)
        return next((o for o in self.cols if o.name.lower() == low), None)


class Frame:
    def __init__(self, df: DataFrame | Callable[[], DataFrame], parent: Frame | None = None, carried: list[str] | None = None) -> None:
        self._df, self.parent, self.carried = df, parent, list(carried or [])
        self.pending: dict[tuple, list] = {}
        self.memo: dict = {}
        self.joined: dict = {}
        self.keep_all = False
        self.group_keys: list[str] = []

    @property
    def lazy(self) -> bool:
        return not isinstance(self._df, DataFrame)

    @property
    def df(self) -> DataFrame:
        if self.lazy:
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df

    def has(self, column: str) -> bool:
        return column in self.df.columns

    def require(self, *columns: str) -> None:
        """Carry columns of the frame around this one."""
        have = set(self.df.columns)
        missing = [c for c in dict.fromkeys(columns) if c not in have]
        if not missing:
            return
        if self.parent is None:
            raise DaxError(f"internal: no outer context has {missing}")
        self.parent.require(*missing)
        self.parent.flush_hook()
        on = [k for k in self.carried]
        renamed = {k: fresh("on") for k in on}
        outer = self.parent.df.select(*[q(k).alias(renamed[k]) for k in on], *map(q, missing)).distinct()
        if on:
            outer = self.df.join(outer, match([(k, renamed[k]) for k in on]))
            self.df = outer.drop(*renamed.values())
        else:
            # A few contexts by the rows of this one: both sides are distinct values.
            self.df = self.df.crossJoin(outer)
        self.carried += missing

    def flush_hook(self) -> None:
        """Set by the planner: compute what is pending."""

    def add(self, column: Column, prefix: str = "c") -> str:
        name = fresh(prefix)
        self.df = self.df.withColumn(name, column)
        return name

    def join_back(self, result: DataFrame, keys: list[str], outs: list[str]) -> None:
        """Left join grouped results on the keys they were grouped by."""
        if not keys:
            self.df = self.df.crossJoin(result.select(*map(q, outs)))
            return
        self.require(*keys)
        renamed = {k: fresh("on") for k in keys}
        result = result.select(*[q(k).alias(renamed[k]) for k in keys], *map(q, outs))
        self.df = self.df.join(result, match([(k, renamed[k]) for k in keys]), "left").drop(*renamed.values())


@dataclass(frozen=True, eq=False)
class RowContext:
    frame: Frame
    rel: Rel


@dataclass(frozen=True, eq=False)
class Env:
    fc: FilterContext
    rows: tuple[RowContext, ...] = ()
    vars: dict = field(default_factory=dict)
    selected: FilterContext = field(default_factory=FilterContext)
    groups: tuple[Where, ...] = ()
    group_rel: Rel | None = None  # CURRENTGROUP

    def row(self, frame: Frame, rel: Rel) -> Env:
        return replace(self, rows=(*self.rows, RowContext(frame, rel)))

    def within(self, fc: FilterContext) -> Env:
        """In a new filter context, which consumes the row contexts."""
        return replace(self, fc=fc, rows=())


@dataclass(eq=False)
class Bound:
    """A variable: a scalar of a frame, or a table value."""

    value: Val | Rel
    frame: Frame
    name: str | None = None
