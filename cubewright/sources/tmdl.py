"""Model definitions as TMDL text: tables, columns, measures, relationships, roles.

The definition tells what the model means; the rows of its tables are given as
DataFrames. Objects nest by indentation; a property stands one level below its
object, an expression of several lines two levels below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewright.errors import DaxError
from cubewright.model import SPARK_TYPE, SemanticModel

#: The format's data types and the engine's.
TYPES = {"int64": "int", "double": "dbl", "decimal": "dec", "string": "str", "boolean": "bool", "dateTime": "date"}
_NAME = r"(?:'(?:[^']|'')*'|[^\s'=:.]+)"
_HEAD = re.compile(rf"(\w+)(?:\s+({_NAME}))?\s*(?:=\s*(.*))?$", re.S)


@dataclass
class Item:
    """One object: what it is, its name, its expression, properties and parts."""

    kind: str
    name: str = ""
    expression: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)


def _plain(name: str) -> str:
    return name[1:-1].replace("''", "'") if name.startswith("'") else name


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"\w+", name) else "'" + name.replace("'", "''") + "'"


def _depth(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip())]
    return lead.count("\t") + lead.count(" ") // 4


def parse(text: str) -> Item:
    """The definition as a tree."""
    top = Item("definition")
    open_: list[tuple[int, Item]] = [(-1, top)]
    for line in text.splitlines():
        said = line.strip()
        if not said or said.startswith("///"):
            continue
        depth, (at, item) = _depth(line), open_[-1]
        if depth >= at + 2 and item is not top:  # a line of the expression
            item.expression = f"{item.expression}\n{said}".strip()
            continue
        while depth <= open_[-1][0]:
            open_.pop()
        item = open_[-1][1]
        if prop := re.match(r"(\w+)\s*:\s*(.*)$", said):
            item.properties[prop[1]] = prop[2].strip()
        elif re.fullmatch(r"\w+", said) and said not in ("definition",):
            item.properties[said] = "true"
        elif head := _HEAD.match(said):
            made = Item(head[1], _plain(head[2] or ""), (head[3] or "").strip())
            item.items.append(made)
            open_.append((depth, made))
        else:
            raise DaxError(f"not understood: {said}")
    return top


def _end(text: str) -> str:
    table, column = re.fullmatch(rf"({_NAME})\.({_NAME})", text).groups()
    return f"{_plain(table)}[{_plain(column)}]"


def read(spark: SparkSession, definition: str, data: dict[str, DataFrame]) -> SemanticModel:
    """The model of ``definition`` (the text, or a folder of .tmdl files) over the rows of ``data`` (by table name)."""
    if "\n" not in definition and Path(definition).is_dir():
        definition = "\n".join(f.read_text(encoding="utf-8") for f in sorted(Path(definition).rglob("*.tmdl")))
    top, m = parse(definition), SemanticModel(spark)
    for item in top.items:
        if item.kind == "model":
            m.name, m.culture = item.name or m.name, item.properties.get("culture", m.culture)
    tables, columns = {}, {}
    for item in (x for x in top.items if x.kind == "table"):
        source = next((x for part in item.items if part.kind == "partition" and part.expression == "calculated" for x in part.items if x.kind == "source"), None)
        if source is not None:
            tables[item.name] = source.expression
            continue
        if item.name not in data:
            raise DaxError(f"no rows are given for table '{item.name}'")
        made, key, day = [], None, None
        for c in (x for x in item.items if x.kind == "column"):
            if c.expression:
                columns[item.name, c.name] = c.expression
                continue
            kind = SPARK_TYPE[TYPES.get(c.properties.get("dataType", "string"), "str")]
            made.append(F.col(f"`{c.properties.get('sourceColumn', c.name)}`").cast(kind).alias(c.name))
            if "isKey" in c.properties:
                key, day = c.name, c.name if kind == "timestamp_ntz" else None
        m.add_table(item.name, data[item.name].select(*made) if made else data[item.name], key, day)
    for item in (x for x in top.items if x.kind == "relationship"):
        p = item.properties
        many = p.get("toCardinality") == "many"
        m.relate(_end(p["fromColumn"]), _end(p["toColumn"]), active=p.get("isActive", "true") != "false", both=p.get("crossFilteringBehavior") == "bothDirections", many_to_many=many)
    for item in (x for x in top.items if x.kind == "table"):
        for x in (x for x in item.items if x.kind == "measure"):
            m.measure(x.name, x.expression, None if item.name in tables else item.name, x.properties.get("formatString"))
    m.calculated(tables, columns)
    for item in top.items:
        if item.kind == "role":
            m.role(item.name, **{x.name: x.expression for x in item.items if x.kind == "tablePermission"})
        for c in item.items if item.kind == "table" else ():
            if c.kind == "column" and "sortByColumn" in c.properties:
                m.sorted_by(f"{item.name}[{c.name}]", _plain(c.properties["sortByColumn"]))
    return m


def write(m: SemanticModel) -> str:
    """The model's definition; ``read`` makes the same model of it and the same rows."""
    back = {v: k for k, v in TYPES.items()}
    out = [f"model {_quoted(m.name)}", f"\tculture: {m.culture}", ""]

    def expression(head: str, e: str) -> list[str]:
        lines = [x.strip() for x in e.strip().splitlines()]
        return [f"\t{head} = {lines[0]}"] if len(lines) == 1 else [f"\t{head} =", *[f"\t\t\t{x}" for x in lines]]

    for t, df in m.tables.items():
        out.append(f"table {_quoted(t)}")
        for x in (x for x in m.measures.values() if x.table == t or x.table is None and t == next(iter(m.tables))):
            out += expression(f"measure {_quoted(x.name)}", x.expression) + ([f"\t\tformatString: {x.format}"] if x.format else [])
        for c in df.columns if t not in m.calculated_tables else ():
            if (t, c) in m.calculated_columns:
                out += expression(f"column {_quoted(c)}", m.calculated_columns[t, c])
            else:
                out += [f"\tcolumn {_quoted(c)}", f"\t\tdataType: {back.get(m.column_type(t, c), 'string')}", f"\t\tsourceColumn: {c}"]
                out += ["\t\tisKey"] * (m.keys.get(t) == (c,))
            out += [f"\t\tsortByColumn: {_quoted(m.sort_by[t, c])}"] if (t, c) in m.sort_by else []
        if t in m.calculated_tables:
            out += [f"\tpartition {_quoted(t)} = calculated", f"\t\tsource = {' '.join(m.calculated_tables[t].split())}"]
        out.append("")
    for i, r in enumerate(m.relationships):
        out += [f"relationship r{i}", f"\tfromColumn: {_quoted(r.from_table)}.{_quoted(r.from_column)}", f"\ttoColumn: {_quoted(r.to_table)}.{_quoted(r.to_column)}"]
        out += ["\tisActive: false"] * (not r.active) + ["\tcrossFilteringBehavior: bothDirections"] * r.both + ["\ttoCardinality: many"] * r.many_to_many + [""]
    for name, filters in m.roles.items():
        out += [f"role {_quoted(name)}", "\tmodelPermission: read", *[f"\ttablePermission {_quoted(t)} = {' '.join(e.split())}" for t, e in filters.items()], ""]
    return "\n".join(out)
