"""Sources and sinks: everything ends as a table of a model or a file of Spark's."""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubewright.errors import DaxError
from cubewright.model import SPARK_TYPE, SemanticModel

#: Names of types on input (fixed values), to the engine's types.
TYPE_NAMES = {
    "string": "str", "text": "str", "str": "str", "int64": "int", "int": "int", "integer": "int", "long": "int", "whole number": "int", "double": "dbl", "float": "dbl", "number": "dbl",
    "decimal": "dec", "currency": "dec", "fixed decimal": "dec", "datetime": "date", "date": "date", "boolean": "bool", "bool": "bool",
}
#: JDBC drivers by kind of database (fixed values): url prefix and default port.
JDBC = {"sqlite": ("jdbc:sqlite:", None), "mysql": ("jdbc:mysql://", 3306), "mariadb": ("jdbc:mariadb://", 3306), "sqlserver": ("jdbc:sqlserver://", 1433), "azuresql": ("jdbc:sqlserver://", 1433), "postgresql": ("jdbc:postgresql://", 5432)}


def schema_of(columns: dict[str, str]) -> T.StructType:
    """Column name -> type name; an unknown type is refused."""
    bad = {k for k in columns.values() if k.lower() not in TYPE_NAMES}
    if bad:
        raise DaxError(f"unknown types: {sorted(bad)}")
    return T.StructType([T.StructField(c, T._parse_datatype_string(SPARK_TYPE[TYPE_NAMES[k.lower()]])) for c, k in columns.items()])


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header; the schema is declared, so no pass is spent on guessing it."""
    return spark.read.csv(path, header=True, schema=schema_of(columns), mode="FAILFAST", multiLine=False)


def ndjson(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.json(path, schema=schema_of(columns))


def json_document(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.json(path, schema=schema_of(columns), multiLine=True)


def rows(spark: SparkSession, values: list, columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(values, schema_of(columns))


def entered(spark: SparkSession, packed: str, columns: dict[str, str]) -> DataFrame:
    """Entered data: base64 of deflated JSON rows."""
    data = json.loads(zlib.decompress(base64.b64decode(packed), -15))
    schema = schema_of(columns)
    plain = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.createDataFrame([[None if x is None else str(x) for x in row] for row in data], plain)
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def jdbc(spark: SparkSession, kind: str, table: str, *, server: str = "", database: str = "", port: int | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down, reads split by ``partition``
    (column, low, high, parts). The driver's jar must be on the class path."""
    if kind not in JDBC:
        raise DaxError(f"unknown database '{kind}'")
    prefix, default = JDBC[kind]
    if kind == "sqlite":
        url = prefix + database
    elif kind in ("sqlserver", "azuresql"):
        url = f"{prefix}{server}:{port or default};databaseName={database}"
    else:
        url = f"{prefix}{server}:{port or default}/{database}"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet; needs pandas with an engine for the format on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def append(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.unionByName(more.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields]))


# -- sinks


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def export_csv(model: SemanticModel, folder: str, tables: list[str] | None = None) -> list[str]:
    out = []
    for t in tables or list(model.tables):
        write_csv(model.tables[model.table_name(t)], f"{folder}/{t}")
        out.append(f"{folder}/{t}")
    return out


# -- model files


def save_model(model: SemanticModel, folder: str) -> None:
    """Tables as Parquet, the description as JSON beside them."""
    for t, df in model.tables.items():
        write_parquet(df, f"{folder}/{t}.parquet")
    description = {
        "name": model.name, "culture": model.culture, "tables": list(model.tables), "keys": {t: list(k) for t, k in model.keys.items()}, "date_columns": model.date_columns,
        "relationships": [vars(r) for r in model.relationships], "measures": [vars(m) for m in model.measures.values()], "roles": model.roles, "calculated_tables": model.calculated_tables,
        "sort_by": [[t, c, by] for (t, c), by in model.sort_by.items()], "annotations": model.annotations,
    }
    text = model.spark.createDataFrame([(json.dumps(description),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/model.json")


def open_model(spark: SparkSession, folder: str) -> SemanticModel:
    from cubewright.model import Measure, Relationship

    d = json.loads(spark.read.text(f"{folder}/model.json", wholetext=True).first()["value"])
    m = SemanticModel(spark, d["name"], d["culture"])
    for t in d["tables"]:
        m.add_table(t, spark.read.parquet(f"{folder}/{t}.parquet"), tuple(d["keys"].get(t, ())) or None, d["date_columns"].get(t))
    m.relationships = [Relationship(**r) for r in d["relationships"]]
    m.measures = {x["name"].lower(): Measure(**x) for x in d["measures"]}
    m.roles, m.calculated_tables, m.annotations = d["roles"], d["calculated_tables"], d["annotations"]
    m.sort_by = {(t, c): by for t, c, by in d["sort_by"]}
    return m


__all__ = ["append", "csv", "entered", "excel", "export_csv", "jdbc", "json_document", "ndjson", "open_model", "parquet", "rows", "save_model", "schema_of", "write_csv", "write_parquet"]
