"""INFO functions and COLUMNSTATISTICS: the model's catalog as tables.

Catalog rows are few and made from the model's description; nothing is scanned
but by COLUMNSTATISTICS.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewright.functions.aggregates import AGGREGATES, ITERATORS
from cubewright.model import SPARK_TYPE, SemanticModel
from cubewright.operators.profiles import distinct_counts
from cubewright.plans import syntax as s
from cubewright.plans.context import Env, Frame, Out, Rel, fresh, q
from cubewright.plans.planner import SCALARS, SPECIAL, TABLES, Planner, table_function
from cubewright.plans.values import Val, text

ROW_NUMBER = "RowNumber"

#: kind -> columns and their types (the empty kinds share one).
COLUMNS: dict[str, list[tuple[str, str]]] = {
    "tables": [("ID", "int"), ("Name", "str"), ("ModelID", "int"), ("IsHidden", "bool")],
    "columns": [("ID", "int"), ("TableID", "int"), ("Table", "str"), ("Name", "str"), ("DataType", "str"), ("IsKey", "bool")],
    "measures": [("Name", "str"), ("Expression", "str"), ("TableName", "str")],
    "relationships": [("ID", "int"), ("FromTable", "str"), ("FromColumn", "str"), ("ToTable", "str"), ("ToColumn", "str"), ("IsActive", "bool")],
    "rel_storage": [("ID", "int"), ("Name", "str")],
    "partitions": [("ID", "int"), ("TableID", "int"), ("Name", "str")],
    "one": [("ID", "int"), ("Name", "str"), ("Culture", "str")],
    "functions": [("FUNCTION_NAME", "str")],
    "dependencies": [("OBJECT_TYPE", "str"), ("OBJECT", "str"), ("REFERENCED_TABLE", "str"), ("REFERENCED_OBJECT", "str")],
    "storage_tables": [("ID", "int"), ("Name", "str")],
    "column_storages": [("ID", "int"), ("Name", "str")],
    "annotations": [("ID", "int"), ("Object", "str"), ("Name", "str"), ("Value", "str")],
    "properties": [("Name", "str"), ("Value", "str")],
    "storage_files": [("ID", "int"), ("Name", "str")],
    "storage_folders": [("ID", "int"), ("Name", "str")],
    "segments": [("ID", "int"), ("Name", "str")],
    "roles": [("ID", "int"), ("Name", "str")],
    "permissions": [("ID", "int"), ("Role", "str"), ("Table", "str"), ("FilterExpression", "str")],
    "empty": [("ID", "int"), ("Name", "str")],
}

_SUFFIXES = {
    "tables": "TABLES VIEW.TABLES",
    "columns": "COLUMNS VIEW.COLUMNS ATTRIBUTEHIERARCHIES ATTRIBUTEHIERARCHYSTORAGES",
    "measures": "MEASURES VIEW.MEASURES",
    "relationships": "RELATIONSHIPS VIEW.RELATIONSHIPS",
    "rel_storage": "RELATIONSHIPSTORAGES RELATIONSHIPINDEXSTORAGES",
    "partitions": "PARTITIONS",
    "one": "MODEL CATALOGS CULTURES CSDLMETADATA",
    "functions": "FUNCTIONS",
    "dependencies": "DEPENDENCIES CALCDEPENDENCY",
    "storage_tables": "STORAGETABLES TABLESTORAGES PARTITIONSTORAGES SEGMENTMAPSTORAGES",
    "column_storages": "COLUMNSTORAGES DICTIONARYSTORAGES SEGMENTSTORAGES STORAGETABLECOLUMNS COLUMNPARTITIONSTORAGES",
    "annotations": "ANNOTATIONS",
    "properties": "PROPERTIES",
    "storage_files": "STORAGEFILES",
    "storage_folders": "STORAGEFOLDERS",
    "segments": "STORAGETABLECOLUMNSEGMENTS",
    "roles": "ROLES",
    "permissions": "TABLEPERMISSIONS",
    "empty": "ALTERNATEOFDEFINITIONS CALCULATIONGROUPS CALCULATIONITEMS CHANGEDPROPERTIES COLUMNPERMISSIONS DATASOURCES DELTATABLEMETADATASTORAGES DETAILROWSDEFINITIONS EXPRESSIONS EXTENDEDPROPERTIES FORMATSTRINGDEFINITIONS GENERALSEGMENTMAPSEGMENTMETADATASTORAGES GROUPBYCOLUMNS HIERARCHIES HIERARCHYSTORAGES KPIS LEVELS LINGUISTICMETADATA OBJECTTRANSLATIONS PARQUETFILESTORAGES PERSPECTIVECOLUMNS PERSPECTIVEHIERARCHIES PERSPECTIVEMEASURES PERSPECTIVES PERSPECTIVETABLES QUERYGROUPS REFRESHPOLICIES RELATEDCOLUMNDETAILS ROLEMEMBERSHIPS VARIATIONS",
}
KINDS = {f"INFO.{name}": kind for kind, names in _SUFFIXES.items() for name in names.split()}


def _columns(m: SemanticModel) -> list[tuple[str, str, str, bool]]:
    out = []
    for t, df in m.tables.items():
        out += [(t, c, m.column_type(t, c), c in m.keys.get(t, ())) for c in df.columns]
        out.append((t, ROW_NUMBER, "int", True))
    return out


def _storages(m: SemanticModel) -> list[str]:
    stored = [f"{t}.{c}" for t, c, _, _ in _columns(m)]
    hierarchies = [f"H${t}.{c}" for t, c, _, _ in _columns(m) if c != ROW_NUMBER]
    return stored + [f"{h}.{part}" for h in hierarchies for part in ("ID_TO_POS", "POS_TO_ID")] + [f"R$.{i}" for i, _ in enumerate(m.relationships)]


def _tables_of_storage(m: SemanticModel) -> list[str]:
    return list(m.tables) + [f"H${t}.{c}" for t, c, _, _ in _columns(m) if c != ROW_NUMBER] + [f"R$.{i}" for i, _ in enumerate(m.relationships)]


def rows(m: SemanticModel, kind: str) -> list[tuple]:
    titles = {"int": "Int64", "dbl": "Double", "dec": "Decimal", "str": "String", "bool": "Boolean", "date": "DateTime", "blank": "String"}
    number = {t: i + 1 for i, t in enumerate(m.tables)}
    numbered = lambda names: [(i + 1, n) for i, n in enumerate(names)]
    if kind == "tables":
        return [(i, t, 1, False) for t, i in number.items()]
    if kind == "columns":
        return [(i + 1, number[t], t, c, titles[k], key) for i, (t, c, k, key) in enumerate(_columns(m))]
    if kind == "measures":
        return [(x.name, x.expression, x.table) for x in m.measures.values()]
    if kind == "relationships":
        return [(i + 1, *r.ends, r.active) for i, r in enumerate(m.relationships)]
    if kind == "rel_storage":
        return numbered(f"R$.{i}" for i, _ in enumerate(m.relationships))
    if kind == "partitions":
        return [(i, i, t) for t, i in number.items()]
    if kind == "one":
        return [(1, m.name, m.culture)]
    if kind == "functions":
        return [(n,) for n in sorted({*SCALARS, *SPECIAL, *TABLES, *AGGREGATES, *ITERATORS})]
    if kind == "dependencies":
        return dependencies(m)
    if kind == "storage_tables" or kind == "storage_folders":
        return numbered(_tables_of_storage(m))
    if kind in ("column_storages", "segments"):
        return numbered(_storages(m))
    if kind == "annotations":
        own = [(f"'{t}'[{c}]", "SummarizationSetBy", "Automatic") for t, c, _, _ in _columns(m) if c != ROW_NUMBER] + [(f"[{x.name}]", "FormatHint", x.format or "") for x in m.measures.values()]
        own += [(o, k, json.dumps(v) if not isinstance(v, str) else v) for o, a in m.annotations.items() for k, v in a.items()]
        return [(i + 1, *x) for i, x in enumerate(own)]
    if kind == "properties":
        return [("Name", m.name), ("Culture", m.culture), ("Tables", str(len(m.tables))), ("Measures", str(len(m.measures))), ("Relationships", str(len(m.relationships))), ("CompatibilityLevel", "1600")]
    if kind == "storage_files":
        return numbered([f"{n}.{x}" for n in _storages(m) for x in ("idf", "dictionary")] + [f"{t}.tbl.xml" for t in m.tables])
    if kind == "roles":
        return numbered(m.roles)
    if kind == "permissions":
        return [(i + 1, *x) for i, x in enumerate((r, t, e) for r, filters in m.roles.items() for t, e in filters.items())]
    return []


def dependencies(m: SemanticModel) -> list[tuple[str, str, str | None, str]]:
    """What measures and active relationships refer to, from the syntax trees."""
    out: list[tuple[str, str, str | None, str]] = []
    for x in m.measures.values():
        for n in s.walk(s.parse(x.expression)):
            if isinstance(n, s.Ref) and n.table and m.has_table(n.table):
                t = m.table_name(n.table)
                out.append(("MEASURE", x.name, t, m.column_name(t, n.column) if m.has_column(t, n.column) else n.column))
            elif isinstance(n, s.Ref) and n.column.lower() in m.measures:
                out.append(("MEASURE", x.name, None, m.measures[n.column.lower()].name))
            elif isinstance(n, s.Name) and m.has_table(n.name):
                out.append(("MEASURE", x.name, m.table_name(n.name), m.table_name(n.name)))
    for r in m.relationships:
        if r.active:
            out += [("ACTIVE_RELATIONSHIP", f"{r.from_table}->{r.to_table}", r.from_table, r.from_column), ("ACTIVE_RELATIONSHIP", f"{r.from_table}->{r.to_table}", r.to_table, r.to_column)]
    return list(dict.fromkeys(out))


@table_function(*KINDS)
def info(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    kind = KINDS[node.name]
    names = [(c, fresh("i"), k) for c, k in COLUMNS[kind]]
    return Rel(local(p.spark, rows(p.model, kind), [(at, SPARK_TYPE[k]) for _, at, k in names]), [Out(c, at, k) for c, at, k in names])


def _literal(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v)


def local(spark: SparkSession, made: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """Few rows as a local relation: the optimizer works on them without a job."""
    cast = ", ".join(f"CAST(c{i} AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(columns))
    given = made or [(None,) * len(columns)]
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in given)
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(f'c{i}' for i in range(len(columns)))})" + ("" if made else " WHERE FALSE"))


def column_statistics(m: SemanticModel) -> DataFrame:
    """One row per column, and one for each table's row numbers."""
    parts = []
    for t, df in m.tables.items():
        cols = [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "binary"))]
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(cols):
            v = Val(q(c), m.column_type(t, c))
            aggs += [text(Val(F.min(q(c)), v.type)).alias(f"a{i}"), text(Val(F.max(q(c)), v.type)).alias(f"b{i}")]
            aggs.append((F.max(F.length(q(c))).cast("long") if v.type == "str" else F.lit(None).cast("long")).alias(f"l{i}"))
        one = df.agg(*aggs)
        each = [F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(f"a{i}").alias("lo"), F.col(f"b{i}").alias("hi"), F.lit(None).cast("long").alias("n"), F.col(f"l{i}").alias("l")) for i, c in enumerate(cols)]
        each.append(F.struct(F.lit(t).alias("t"), F.lit(ROW_NUMBER).alias("c"), F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"), F.col("__n").alias("n"), F.lit(None).cast("long").alias("l")))
        # BLANK counts as a value of its own.
        counted = distinct_counts(df, cols).select(F.col("column").alias("of"), (F.col("distinct") + (F.col("nulls") > 0).cast("long")).alias("m"))
        made = one.select(F.inline(F.array(*each))).join(counted, F.col("c") == F.col("of"), "left")
        # The name as a literal: a filter on it leaves the other tables unread.
        parts.append(made.select(F.lit(t).alias("t"), "c", "lo", "hi", F.coalesce("n", "m").alias("n"), "l").toDF("Table Name", "Column Name", "Min", "Max", "Cardinality", "Max Length"))
    return reduce(DataFrame.unionByName, parts)


@table_function("COLUMNSTATISTICS")
def _column_statistics(p: Planner, node: s.Call, frame: Frame, env: Env) -> Rel:
    df = column_statistics(p.model)
    kinds = ["str", "str", "str", "str", "int", "int"]
    names = [fresh("i") for _ in kinds]
    return Rel(df.toDF(*names), [Out(c, n, k) for c, n, k in zip(df.columns, names, kinds)])
