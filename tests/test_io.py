"""Sources, sinks, model files and streams."""

import base64
import json
import zlib

import pytest

from cubewright import api, sources, streaming
from cubewright.errors import DaxError
from cubewright.sources import tmdl

from .models import workshop


def test_files(spark, tmp_path):
    kinds = {"k": "int64", "s": "text", "d": "datetime", "v": "number"}
    (tmp_path / "a.csv").write_text("k,s,d,v\n1,x,2024-01-02T00:00:00,1.5\n2,,,\n")
    (tmp_path / "a.json").write_text('{"k": 1, "s": "x", "d": "2024-01-02T00:00:00", "v": 1.5}\n{"k": 2}\n')
    a, b = sources.csv(spark, str(tmp_path / "a.csv"), kinds), sources.ndjson(spark, str(tmp_path / "a.json"), kinds)
    assert a.collect() == b.collect() and a.schema == b.schema
    (tmp_path / "b.json").write_text(json.dumps([{"k": 3, "s": "y"}]))
    more = sources.append(a, sources.json_document(spark, str(tmp_path / "b.json"), kinds))
    assert more.count() == 3
    sources.write_csv(more, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    with pytest.raises(DaxError):
        sources.schema_of({"x": "complex"})


def test_entered(spark):
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = base64.b64encode(pack.compress(json.dumps([["1", "a"], ["x", None]]).encode()) + pack.flush()).decode()
    assert [tuple(r) for r in sources.entered(spark, data, {"k": "int", "s": "string"}).collect()] == [(1, "a"), (None, None)]


def test_model_file(spark, tmp_path):
    sources.save_model(workshop(spark), str(tmp_path / "m"))
    m = sources.open_model(spark, str(tmp_path / "m"))
    assert api.evaluate(m, ["Fees"], filters={"Tool.kind": ["saw"]}).first()[0] == 30


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "id long, t string, user long, v double").selectExpr("id", "to_timestamp_ntz(t) AS ts", "user", "v")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = streaming.source(spark, str(tmp_path / "e"), events, per_trigger=3)
    query = streaming.tumbling(stream, ["user"], "v", "15 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    want = streaming.tumbling(events, ["user"], "v", "15 minutes")
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == sorted(map(tuple, want.collect()))
    assert streaming.sessions(events, ["user"], "5 minutes").agg({"n": "sum"}).first()[0] == 200
    query = streaming.deduplicated(stream, ["user"]).writeStream.format("memory").queryName("d").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("d").count() == 3


DEFINITION = """
model Yard
\tculture: en-GB

/// what is stacked where
table Stack
\tmeasure 'Volume (m3)' = SUM(Stack[m3])
\t\tformatString: 0.0
\tmeasure Mean =
\t\t\tVAR n = COUNTROWS(Stack)
\t\t\tRETURN DIVIDE([Volume (m3)], n)
\tcolumn m3
\t\tdataType: double
\t\tsourceColumn: volume
\tcolumn bay
\t\tdataType: int64
\tcolumn Twice = Stack[m3] * 2 + Stack[Once]
\tcolumn Once = Stack[m3]

table Bay
\tcolumn id
\t\tdataType: int64
\t\tisKey
\tcolumn Row
\t\tdataType: string
\t\tsortByColumn: id

table Large
\tpartition Large = calculated
\t\tsource = FILTER(Used, Used[m3] > 3)

table Used
\tpartition Used = calculated
\t\tsource = FILTER(Stack, Stack[m3] > 0)

relationship 1f
\tfromColumn: Stack.bay
\ttoColumn: Bay.id
\tcrossFilteringBehavior: bothDirections

role North
\tmodelPermission: read
\ttablePermission Bay = Bay[Row] = "N"
"""


def test_tmdl(spark, tmp_path):
    data = {"Stack": spark.createDataFrame([(2.0, 1), (5.0, 1), (0.0, 2), (4.0, 2)], "volume double, bay int"), "Bay": spark.createDataFrame([(1, "N"), (2, "S")], "id int, Row string")}
    m = tmdl.read(spark, DEFINITION, data)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "model.tmdl").write_text(tmdl.write(m))
    again = tmdl.read(spark, str(tmp_path / "d"), {t: m.tables[t] for t in ("Stack", "Bay")})
    for x in (m, again):
        assert api.evaluate(x, {"v": "[Volume (m3)]", "n": "[Mean]", "t": "SUM(Stack[Twice])", "l": "COUNTROWS(Large)"}).first().asDict() == {"v": 11.0, "n": 2.75, "t": 33.0, "l": 2}
        assert api.evaluate(x, ["Mean"], role="North").first()[0] == 3.5
        assert x.culture == "en-GB" and x.sort_by == {("Bay", "Row"): "id"} and x.relationships[0].both and x.measures["volume (m3)"].format == "0.0"
    with pytest.raises(DaxError):
        m.calculated({"A": "FILTER(B, TRUE())", "B": "FILTER(A, TRUE())"})


def test_editing(spark):
    m = workshop(spark)
    m.change_measure("Fees", "SUM(Hire[fee]) * 2").change_relationship("Hire[tool]", "Tool[k]", active=False)
    assert api.evaluate(m, ["Fees"], filters={"Tool.kind": ["saw"]}).first()[0] == 160
    m.change_relationship("Hire[tool]", "Tool[k]", active=True)
    assert api.evaluate(m, ["Fees"], filters={"Tool.kind": ["saw"]}).first()[0] == 60
    m.change_measure("Fees", new_name="Double").drop_column("Hire[day]").drop_table("Staff")
    assert [r.to_table for r in m.relationships] == ["Tool"] and "Staff" not in m.tables and list(m.measures) == ["double"]
    m.drop_relationship("Hire[tool]", "Tool[k]").drop_measure("Double")
    assert not m.relationships and not m.measures
    for bad in (lambda: m.drop_measure("Double"), lambda: m.drop_table("Staff"), lambda: m.drop_column("Hire[day]"), lambda: m.drop_relationship("Hire[tool]", "Tool[k]")):
        with pytest.raises(DaxError):
            bad()
