"""Filter context, relationships, time intelligence and tools on small models."""

import datetime as dt
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubewright import api
from cubewright.model import SemanticModel
from cubewright.operators import ranks, tools

from .models import crops, workshop


def groups(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def one(model, expression, **options):
    return api.evaluate(model, {"x": expression}, **options).first()["x"]


@pytest.fixture(scope="module")
def bakes(spark):
    rows = [("apple pie", 5), ("apple tart", 8), ("plum cake", 13), ("fig roll", 21)]
    return SemanticModel(spark).add_table("Bake", spark.createDataFrame(rows, "what string, n long"))


@pytest.mark.parametrize(
    "predicate,want",
    [
        ("Bake[n] > 5 && Bake[n] < 20", 21), ("NOT(Bake[n] > 8)", 13), ('Bake[what] IN {"fig roll"} || Bake[n] < 8', 26), ('LEFT(Bake[what], 5) = "apple"', 13), ("FILTER(Bake, Bake[n] > AVERAGE(Bake[n]))", 34), ("KEEPFILTERS(Bake[n] >= 13)", 34),
        ('TREATAS({"plum cake", "none"}, Bake[what])', 13), ("TOPN(1, Bake, Bake[n], ASC)", 5), ("Bake[n] = MIN(Bake[n])", 5), ('NOT Bake[what] IN {"apple pie", "apple tart"}', 34), ("8 <= Bake[n]", 42), ("ISBLANK(Bake[what])", None), ("Bake[n] * 2 > 20", 34),
    ],
)
def test_predicates(bakes, predicate, want):
    assert one(bakes, f"CALCULATE(SUM(Bake[n]), {predicate})") == want


@pytest.mark.parametrize(
    "spec,want",
    [
        (["plum cake", "fig roll"], 34), ({"op": "<>", "value": "fig roll"}, 26), ({"contains": "APPLE"}, 13), ({"starts_with": "fig"}, 21), ({"ends_with": "CAKE"}, 13), ({"not_in": ["fig roll", "plum cake"]}, 13), ({"is_blank": False}, 47), ({"all": [{"contains": "p"}, {"not_in": ["plum cake"]}]}, 13),
    ],
)
def test_filter_language(bakes, spec, want):
    assert one(bakes, "SUM(Bake[n])", filters={"Bake.what": spec}) == want


def test_filters_pass_two_tables(spark):
    """Shops in cities in countries; one country has no shop."""
    m = SemanticModel(spark)
    m.add_table("Country", spark.createDataFrame([("no", "Norway"), ("pt", "Portugal"), ("fr", "France")], "code string, name string"))
    m.add_table("City", spark.createDataFrame([(1, "no"), (2, "pt"), (3, "pt"), (4, "fr")], "id long, code string"))
    m.add_table("Shop", spark.createDataFrame([("a", 1, 2.5), ("b", 2, 4.0), ("c", 3, 1.5), ("d", 3, 3.0)], "shop string, city long, till double"))
    m.relate("City[code]", "Country[code]").relate("Shop[city]", "City[id]").measure("Tills", "SUM(Shop[till])")
    assert groups(api.evaluate_grouped(m, ["Tills"], ["Country[name]"], keep_blank=True), "name", "Tills") == {"Norway": 2.5, "Portugal": 8.5, "France": None}
    assert one(m, "[Tills]", filters={"Country.name": ["France"]}) is None and one(m, "[Tills]", filters={"Country.name": ["France", "Norway"]}) == 2.5
    assert groups(api.evaluate_grouped(m, {"t": "[Tills] + 0"}, ["Country[name]"]), "name", "t") == {"Norway": 2.5, "Portugal": 8.5, "France": 0.0}


def test_a_dimension_in_two_roles(spark):
    m = SemanticModel(spark)
    m.add_table("Trip", spark.createDataFrame([("A", "B", 7), ("B", "C", 11), ("C", "A", 2), ("A", "C", 5)], "off string, on string, km long")).add_table("Port", spark.createDataFrame([("A",), ("B",), ("C",)], "p string"))
    m.relate("Trip[off]", "Port[p]").relate("Trip[on]", "Port[p]", active=False)
    f = {"Port.p": ["A"]}
    assert one(m, "SUM(Trip[km])", filters=f) == 12
    assert one(m, "CALCULATE(SUM(Trip[km]), USERELATIONSHIP(Trip[on], Port[p]))", filters=f) == 2
    assert one(m, "CALCULATE(SUM(Trip[km]), CROSSFILTER(Trip[off], Port[p], NONE))", filters=f) == 25
    assert one(m, "CALCULATE(COUNTROWS(Port), Trip[km] > 6, CROSSFILTER(Trip[off], Port[p], BOTH))") == 2


@pytest.mark.parametrize(
    "measure,want",
    [
        ("CALCULATE([Tons], ALLSELECTED())", [20] * 4), ("CALCULATE([Tons], ALLEXCEPT(Crop, Crop[side]))", [20] * 4), ("CALCULATE(MIN(Crop[t]), ALLSELECTED(), VALUES(Crop[side]))", [3, 1, 1, 3]), ("CALCULATE([Tons], ALL(Crop[field]), VALUES(Crop[side]))", [9, 11, 11, 9]),
        ("RANKX(ALL(Crop[field]), [Tons])", [3, 4, 1, 2]), ("ROWNUMBER(ALLSELECTED(Crop[field]), ORDERBY([Tons]))", [2, 1, 4, 3]), ("CALCULATE([Tons], WINDOW(1, ABS, 0, REL, ALLSELECTED(Crop[field]), ORDERBY(Crop[field])))", [3, 4, 14, 20]),
        ("CALCULATE([Tons], OFFSET(1, ALLSELECTED(Crop[field]), ORDERBY(Crop[field])))", [1, 10, 6, None]), ("SUMX(FILTER(ALL(Crop), Crop[t] >= MAX(Crop[t])), Crop[t])", [19, 20, 10, 16]), ("IF(ISINSCOPE(Crop[field]), SELECTEDVALUE(Crop[side]))", ["east", "west", "west", "east"]),
        ("VAR own = [Tons] RETURN COUNTROWS(FILTER(ALL(Crop), Crop[t] < own))", [1, None, 3, 2]), ("AVERAGEX(ALL(Crop[field]), CALCULATE([Tons]))", [5] * 4), ("CALCULATE([Tons], WINDOW(-1, REL, 1, REL, ALL(Crop[field]), ORDERBY(Crop[field])))", [4, 14, 17, 16]),
    ],
)
def test_grouped(spark, measure, want):
    df = api.evaluate_grouped(crops(spark), {"m": measure}, ["Crop[field]"], keep_blank=True)
    assert groups(df, "field", "m") == dict(zip("pqrs", want))


def test_slicer_stays_with_allselected(spark):
    df = api.evaluate_grouped(crops(spark), {"m": "CALCULATE([Tons], ALLSELECTED(Crop[field]))"}, ["Crop[field]"], filters={"Crop.field": ["p", "s"]})
    assert groups(df, "field", "m") == {"p": 9, "s": 9}


def test_shift_moves_each_run(spark):
    day = lambda y, m: dt.datetime(y, m, 10)
    m = SemanticModel(spark).add_table("Cal", spark.createDataFrame([(day(2021, 2), 1, 4), (day(2021, 8), 2, 6), (day(2022, 2), 1, 5), (day(2022, 8), 2, 9)], "Date timestamp_ntz, Half long, v long"), date_column="Date")
    for shift in ("SAMEPERIODLASTYEAR(Cal[Date])", "DATEADD(Cal[Date], -1, YEAR)"):
        assert one(m, f"CALCULATE(SUM(Cal[v]), {shift})", filters={"Cal.Half": [2]}) == 6
    assert one(m, "TOTALYTD(SUM(Cal[v]), Cal[Date])") == 14
    assert one(m, "CALCULATE(SUM(Cal[v]), PREVIOUSMONTH(Cal[Date]))") is None


def test_blank_member(spark):
    m = SemanticModel(spark).add_table("D", spark.createDataFrame([(1, "a"), (2, "b")], "k long, c string")).add_table("F", spark.createDataFrame([(1, 5), (9, 7), (None, 1)], "k long, v long")).relate("F[k]", "D[k]")
    assert groups(api.evaluate_grouped(m, {"v": "SUM(F[v])"}, ["D[c]"]), "c", "v") == {"a": 5, None: 8}
    assert one(m, "COUNTROWS(ALL(D[c]))") == 3 and one(m, "COUNTROWS(ALLNOBLANKROW(D[c]))") == 2 and one(m, "COUNTROWS(VALUES(D[c]))") == 3


def test_empty_tables(spark):
    m = SemanticModel(spark).add_table("E", spark.createDataFrame([], "n long, s string"))
    row = api.evaluate(m, {"a": "SUM(E[n])", "b": "COUNTROWS(E)", "c": "DISTINCTCOUNT(E[n])", "d": "AVERAGEX(E, E[n])", "e": "MAX(E[s])", "f": 'CONCATENATEX(E, E[s])', "g": "ISEMPTY(E)", "h": "MEDIAN(E[n])"}).first()
    assert row.asDict() == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": None, "g": True, "h": None}
    assert api.evaluate_grouped(m, {"a": "SUM(E[n])"}, ["E[s]"]).count() == 0


def test_grouped_equals_one_at_a_time(spark):
    """Every group's value is that of its own filter context."""
    m = workshop(spark)
    exprs = {"a": "SUM(Hire[fee])", "b": "DISTINCTCOUNT(Hire[tool])", "c": "AVERAGEX(Hire, Hire[fee] * 2)", "d": "DIVIDE([Fees], CALCULATE([Fees], ALL(Tool)))", "e": "COUNTROWS(Hire) + 0"}
    got = {r["kind"]: r.asDict() for r in api.evaluate_grouped(m, exprs, ["Tool[kind]"], keep_blank=True).collect()}
    assert len(got) == 4
    for kind, row in got.items():
        alone = api.evaluate(m, exprs, filters={"Tool.kind": [kind]}).first().asDict()
        assert {k: v for k, v in row.items() if k != "kind"} == pytest.approx(alone)


def test_calculated_and_roles(spark):
    m = workshop(spark)
    m.calculated_column("Hire", "kind", "RELATED(Tool[kind])").calculated_column("Hire", "so far", "CALCULATE(SUM(Hire[fee]), FILTER(ALL(Hire), Hire[day] <= EARLIER(Hire[day])))")
    assert [tuple(r) for r in m.tables["Hire"].orderBy("day", "tool").select("kind", "so far").collect()] == [("saw", 19.0), ("drill", 19.0), ("drill", 28.0), ("drill", 32.0), ("press", 62.0), ("saw", 80.0)]
    m.calculated_table("Dear", "FILTER(Hire, Hire[fee] > 10)")
    assert one(m, "COUNTROWS(Dear)") == 3
    m.role("wood", Tool='Tool[kind] = "saw"')
    assert one(m, "[Fees]", role="wood") == 30


def test_tools(spark):
    m = workshop(spark)
    assert [r[0] for r in tools.query_table(m, "Reading", ["n"], "tag LIKE '%F%' OR level IS NULL AND NOT (n IN (2, 4))", "n DESC").collect()] == [8, 6]
    assert {(r["table"], r["column"], r["matches"]) for r in tools.find_value(m, "r").collect()} == {("Tool", "kind", 3), ("Reading", "tag", 1), ("Reading", "good", 3)}  # "TRUE" has one
    stats = {r["column"]: r for r in tools.table_stats(m, "Reading").collect()}
    assert stats["level"]["nulls"] == 1 and stats["tag"]["max_length"] == 3 and stats["n"]["avg"] == 6 and stats["good"]["distinct"] == 2
    new = tools.replace_value(m, "Tool", "kind", "lathe", "vice").where("k <> 10")
    assert {(r["k"], r["change"], r["columns"]) for r in tools.data_diff(m.tables["Tool"], new, ["k"]).collect()} == {(10, "removed", ""), (50, "changed", "kind")}
    assert {r["name"]: r["status"] for r in api.status(m, {"a": "[Fees]", "b": "BLANK()", "c": "DATESWTD(Day[Date])", "d": "SUM(Hire[z])"}).collect()} == {"a": "ok", "b": "blank", "c": "unsupported", "d": "error"}


def test_format(spark):
    m = workshop(spark)
    cases = {
        'FORMAT(1234.5, "#,##0.00")': "1,234.50", 'FORMAT(-1234.5, "#,##0.00;(#,##0.00)")': "(1,234.50)", 'FORMAT(0.256, "0.0%")': "25.6%", 'FORMAT(1234567, "#,##0,")': "1,235", 'FORMAT(12, "0000")': "0012", 'FORMAT(DATE(2024, 3, 5), "yyyy-mm-dd")': "2024-03-05",
        'FORMAT(DATE(2024, 3, 5), "dddd d mmmm")': "Tuesday 5 March", 'FORMAT(BLANK(), "0")': "", 'FORMAT(TRUE, "Yes/No")': "Yes", 'FORMAT(12345.678, "0.00E+00")': "1.23E+04", 'FORMAT(1234.5, "#,##0.00", "de-DE")': "1.234,50", 'FORMAT(5, """n=""0")': "n=5", 'FORMAT(0, "0;-0;zero")': "zero",
    }
    row = api.evaluate(m, {f"c{i}": e for i, e in enumerate(cases)}).first()
    assert list(row) == list(cases.values())


def test_spread_ranks_equal_one_window(spark):
    from pyspark.sql import functions as F

    from cubewright.operators.ranks import running

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("n"))
    for down in (True, False):
        one = running(df, "v", "n", down, True, 0)
        spread = running(df, "v", "n", down, True, 1 << 40)
        assert sorted(map(tuple, one.select("v", "__before", "__row").collect())) == sorted(map(tuple, spread.select("v", "__before", "__row").collect()))


def test_many_to_many_and_both_ways(spark):
    m = SemanticModel(spark)
    m.add_table("F", spark.createDataFrame([(1, 10), (1, 20), (2, 5), (3, 1)], "k long, v long")).add_table("G", spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "k long, c string"))
    m.relate("F[k]", "G[k]", many_to_many=True)
    assert groups(api.evaluate_grouped(m, {"v": "SUM(F[v])"}, ["G[c]"]), "c", "v") == {"a": 30, "b": 35}
    assert one(m, "SUM(F[v])", filters={"G.c": ["b"]}) == 35 and one(m, "SUM(F[v])") == 36
    bridge = SemanticModel(spark)
    bridge.add_table("Cust", spark.createDataFrame([(1, "x"), (2, "y")], "id long, n string")).add_table("Link", spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "cust long, acc long")).add_table("Acc", spark.createDataFrame([(7, 100), (8, 50)], "id long, bal long"))
    bridge.relate("Link[cust]", "Cust[id]").relate("Link[acc]", "Acc[id]", both=True)
    assert groups(api.evaluate_grouped(bridge, {"b": "SUM(Acc[bal])"}, ["Cust[n]"]), "n", "b") == {"x": 150, "y": 50}


def test_table_constructors_and_nested_rows(spark):
    m = workshop(spark)
    rows = api.table_expression(m, '{("one", NAMEOF(Tool[kind]), 4), ("two", NAMEOF([Fees]), 5)}').collect()
    assert [tuple(r) for r in rows] == [("one", "'Tool'[kind]", 4), ("two", "'Hire'[Fees]", 5)]
    assert one(m, "SUMX(Tool, VAR own = Tool[k] RETURN SUMX(FILTER(Hire, Hire[tool] = own), Hire[fee] * own))") == 10 * 30 + 20 * 16 + 30 * 4 + 40 * 30
    assert one(m, "MINX({5, 2, 9}, [Value] - 1)") == 1
    assert one(m, "SUMX(GENERATESERIES(2, 4), VAR n = [Value] RETURN COUNTROWS(GENERATESERIES(1, n)))") == 9
    assert one(m, "MAXX(VALUES(Tool[kind]), CALCULATE(COUNTROWS(Hire)))") == 3
    assert one(m, "CALCULATE([Fees], FILTER(VALUES(Tool[kind]), [Fees] < 25))") == 20


@pytest.fixture
def large(monkeypatch):
    """A few dozen rows count as many."""
    for name, value in {"ROWS": 20, "COUNTED": 0, "BUCKETS": 8, "EACH": 3}.items():
        monkeypatch.setattr(ranks, name, value, raising=False)


def one_task(df):
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


def marks(spark):
    """Sixty marks, with ties and blanks, and whole rows that come twice."""
    rows = [(None if i % 7 == 0 else i * 5 % 11, "ab"[i % 3 == 0], i // 2) for i in range(60)]
    return SemanticModel(spark).add_table("Mark", spark.createDataFrame(rows, "m long, side string, id long"))


def in_order(rows, *keys):
    """Sorted by the columns of ``keys``, descending where True, BLANK as the smallest."""
    for c, down in reversed(keys):
        rows = sorted(rows, key=lambda r: (r[c] is not None, r[c] or 0), reverse=down)  # noqa: B023
    return rows


def sampled(spark, call, down, n):
    m = marks(spark)
    df = api.table_expression(m, f'SELECTCOLUMNS({call}, "m", Mark[m], "side", Mark[side], "id", Mark[id])')
    assert not one_task(df)
    rows = in_order([tuple(r) for r in m.tables["Mark"].collect()], (0, down), (0, False), (1, False), (2, False))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(rows[round(i * 59 / (n - 1))]) for i in range(n))


def test_cartesian_sample_of_many_rows(spark, large):
    sampled(spark, "SAMPLECARTESIANPOINTSBYCOVER(9, Mark, Mark[m], Mark[side])", False, 9)


def test_axis_sample_of_many_rows(spark, large):
    sampled(spark, "SAMPLEAXISWITHLOCALMINMAX(6, Mark, Mark[id], Mark[m])", False, 6)


def test_even_sample_of_many_rows(spark, large):
    sampled(spark, "SAMPLE(15, Mark, Mark[m], DESC)", True, 15)


def test_ranks_of_many_rows(spark, large):
    """Ranks and row numbers whose ties and partitions cross buckets; no partition, or one of few values, lies in one task."""
    m = marks(spark)
    rows = [tuple(r) for r in m.tables["Mark"].collect()]
    order = "ORDERBY(Mark[m], DESC)"
    df = api.table_expression(m, f'SELECTCOLUMNS(Mark, "m", Mark[m], "side", Mark[side], "id", Mark[id], "s", RANK(SKIP, Mark, {order}), "d", RANK(DENSE, Mark, {order}, PARTITIONBY(Mark[side])), "r", ROWNUMBER(Mark, {order}, PARTITIONBY(Mark[side])))')
    value = lambda r: -1 if r[0] is None else r[0]
    want = []
    for r in rows:
        side = sorted((x for x in rows if x[1] == r[1]), key=lambda x: (-value(x), x[2]))
        want.append((*r, 1 + sum(value(x) > value(r) for x in rows), 1 + len({value(x) for x in side if value(x) > value(r)}), 1 + side.index(r)))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_numbers_are_made_in_buckets(spark, large):
    """A partition of all rows is parted, and so is a tie of most of them."""
    rows = spark.range(0, 400, 1, 3).selectExpr("id", "CASE WHEN id < 300 THEN 1 ELSE id END AS v", "'p' AS p")
    cut = ranks.bucketed(rows, 400, [("p", False), ("v", True), ("id", False)]).groupBy("__bucket").count().collect()
    assert len(cut) > 5 and max(r["count"] for r in cut) < 200
    got = ranks.numbered(rows, ["p"], [("v", True)], ["id"], ["at", "rank", "dense", "of"]).collect()
    assert sorted((r["at"], r["rank"], r["dense"], r["of"]) for r in got) == [(i + 1, min(i, 100) + 1, min(i, 100) + 1, 400) for i in range(400)]


def counted_and_taken(spark, rows, keys, positions):
    """at_positions and a plain row number, as sorted texts."""
    got = ranks.at_positions(rows, rows.count(), keys, positions)
    want = rows.withColumn("__at", F.row_number().over(Window.orderBy(*ranks.sorting(keys))) - 1).where(F.col("__at").isin(positions))
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*rows.columns).collect())
    return got, text(got), text(want)


@pytest.mark.parametrize("runs", [16, 0])
def test_positions_of_every_order(spark, large, monkeypatch, runs):
    """Bounds on the first key, at BLANKs, NaN, both infinities and both directions, leave no wanted row out."""
    monkeypatch.setattr(ranks, "RUNS", runs, raising=False)
    value = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 10 = 1 THEN double('NaN') WHEN id % 25 = 2 THEN double('-Infinity') ELSE id * 7 % 40 / 3.0D END AS v"
    rows = spark.range(0, 240, 1, 3).selectExpr(value, "CASE WHEN id % 4 > 0 THEN timestamp_seconds(id * 1e9 % 7e9) END AS t", "CASE WHEN id % 3 > 0 THEN string(id % 50) END AS s", "id")
    for keys in (["v", "t", "s", "id"], ["t", "id", "s", "v"], ["s", "v", "id", "t"]):
        for down in (False, True):
            for positions in ([0, 60, 61, 180, 239], list(range(0, 240, 7))):
                _, got, want = counted_and_taken(spark, rows, [(c, down != (i % 2 == 1)) for i, c in enumerate(keys)], positions)
                assert got == want and len(got) == len(positions), (keys, down, positions)


def test_copies_do_not_fill_a_task(spark, large):
    """Rows that are equal in all columns reach the sort as one, and cuts are no part of a row."""
    rows = spark.range(0, 400, 1, 3).selectExpr("CASE WHEN id < 390 THEN 5 ELSE id END AS v", "'p' AS p")
    df, got, want = counted_and_taken(spark, rows, [("v", True), ("p", False)], [0, 9, 10, 11, 200, 399])
    assert got == want and len(got) == 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window .*\n\W*Aggregate ", plan) and plan.count("Join") == 1


def test_even_sample_of_copies(spark, large):
    """SAMPLE takes a row once for each of its positions, also where a single row fills nearly all of them."""
    rows = spark.range(0, 300, 1, 3).selectExpr("CASE WHEN id < 290 THEN 4 ELSE id END AS m")
    df = api.table_expression(SemanticModel(spark).add_table("Mark", rows), 'SELECTCOLUMNS(SAMPLE(7, Mark, Mark[m], ASC), "m", Mark[m])')
    assert sorted(r[0] for r in df.collect()) == [4] * 6 + [299]
    assert re.search(r"Window .*\n\W*Aggregate ", df._jdf.queryExecution().optimizedPlan().toString())


def test_rows_that_compress_well_are_counted(spark, monkeypatch, tmp_path):
    """A file of a few kilobytes may hold more rows than a task should sort; Spark's estimate only sees its bytes."""
    monkeypatch.setattr(ranks, "ROWS", 1000)
    spark.range(0, 20000, 1, 1).selectExpr("id", "1L AS m").write.parquet(str(tmp_path / "mark"))
    rows = spark.read.parquet(str(tmp_path / "mark"))
    df = api.table_expression(SemanticModel(spark).add_table("Mark", rows), 'SELECTCOLUMNS(SAMPLE(7, Mark, Mark[m], ASC), "id", Mark[id])')
    assert ranks.many_rows(rows) == 20000 and not one_task(df)
    assert sorted(r[0] for r in df.collect()) == [round(i * 19999 / 6) for i in range(7)]
    assert ranks.many_rows(rows.limit(1000)) == ranks.many_rows(spark.range(1000)) == 0


@pytest.mark.parametrize("n", [9, 100, 299, 400])
def test_positions_of_large_samples_are_not_listed(spark, large, monkeypatch, n):
    """More positions than buckets are found by arithmetic, without a row for each; a row that is taken often comes in runs."""
    monkeypatch.setattr(ranks, "REPEAT", 16, raising=False)
    rows = spark.range(0, 300, 1, 3).selectExpr("CASE WHEN id BETWEEN 90 AND 220 THEN 90 WHEN id > 4 THEN id END AS m", "id % 2 AS side")
    df = api.table_expression(SemanticModel(spark).add_table("Mark", rows), f'SELECTCOLUMNS(SAMPLE({n}, Mark, Mark[m], DESC), "m", Mark[m], "side", Mark[side])')
    assert not one_task(df) and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = in_order([tuple(r) for r in rows.collect()], (0, True), (1, False))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(want[round(i * 299 / (n - 1))]) for i in range(n)) if n < 300 else df.count() == 300
