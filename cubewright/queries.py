"""The engine's queries over the star schema, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewright import api
from cubewright.model import SemanticModel
from cubewright.operators import tools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


_OPEN: dict[tuple, SemanticModel] = {}


def tpch(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """The star schema, opened once per session: a model is a description, no data is kept."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = _opened(spark, sf_dir)
    return _OPEN[key].copy()


def _opened(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """Every key of a many side is known to resolve."""
    m = SemanticModel(spark, "Trade")
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}
    for t, key in keys.items():
        m.add_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), key=key)
    for many, one in (
        ("lineitem[l_orderkey]", "orders[o_orderkey]"), ("lineitem[l_partkey]", "part[p_partkey]"), ("lineitem[l_suppkey]", "supplier[s_suppkey]"),
        ("orders[o_custkey]", "customer[c_custkey]"), ("customer[c_nationkey]", "nation[n_nationkey]"), ("nation[n_regionkey]", "region[r_regionkey]"),
    ):
        m.relate(many, one, trusted=True)
    m.relate("supplier[s_nationkey]", "nation[n_nationkey]", active=False, trusted=True)
    days = spark.range(2557).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("Date"))
    days = days.select("Date", F.year("Date").alias("Year"), F.month("Date").alias("Month"), F.quarter("Date").alias("Quarter"), (F.year("Date") * 100 + F.month("Date")).alias("YearMonth"))
    m.add_table("calendar", days, key="Date", date_column="Date")
    m.relate("orders[o_orderdate]", "calendar[Date]", trusted=True)
    m.relate("lineitem[l_shipdate]", "calendar[Date]", active=False, trusted=True)
    m.measure("Revenue", "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))", "lineitem")
    m.measure("Sales", "SUM(orders[o_totalprice])", "orders")
    m.measure("Orders", "COUNTROWS(orders)", "orders")
    m.measure("Quantity", "SUM(lineitem[l_quantity])", "lineitem")
    return m


def grouped(name: str, measures: dict[str, str], by: list[str], sql: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: api.evaluate_grouped(tpch(spark, sf_dir), measures, by, **options)
    SQL[name] = sql


def scalar(name: str, measures: dict[str, str], sql: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: api.evaluate(tpch(spark, sf_dir), measures, **options)
    SQL[name] = sql


def table(name: str, expression: str, sql: str | None, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: api.table_expression(tpch(spark, sf_dir), expression, **options)
    if sql:
        SQL[name] = sql


def custom(name: str, f: Query, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# Joins that the SQL of several queries shares.
_REV = "sum(l_extendedprice * (1 - l_discount))"
_LOCN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_OCN = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_DAYS = "(SELECT CAST(range AS TIMESTAMP) AS d FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY))"

# -- aggregations ------------------------------------------------------------
grouped("agg_sum_by_nation", {"revenue": "ROUND([Revenue], 2)"}, ["nation[n_name]"], f"SELECT n_name, round({_REV}, 2) AS revenue FROM {_LOCN} GROUP BY n_name")
grouped("agg_avg", {"price": "ROUND(AVERAGE(lineitem[l_extendedprice]), 4)", "nonzero": "ROUND(AVERAGEX(lineitem, IF(lineitem[l_discount] > 0, lineitem[l_discount])), 6)"}, ["lineitem[l_returnflag]"],
        "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS price, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS nonzero FROM lineitem GROUP BY 1")
grouped("agg_count_family", {"n": "COUNT(orders[o_orderkey])", "na": "COUNTA(orders[o_orderpriority])", "r": "COUNTROWS(orders)", "x": 'COUNTX(orders, IF(orders[o_totalprice] > 100000, 1))', "nb": "COUNTBLANK(orders[o_orderstatus])"}, ["customer[c_mktsegment]"],
        "SELECT c_mktsegment, count(o_orderkey) AS n, count(o_orderpriority) AS na, count(*) AS r, nullif(count(CASE WHEN o_totalprice > 100000 THEN 1 END), 0) AS x, nullif(count(*) FILTER (WHERE o_orderstatus IS NULL), 0) AS nb FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
grouped("agg_distinctcount_blank", {"customers": "DISTINCTCOUNT(orders[o_custkey])", "parts": "DISTINCTCOUNTNOBLANK(lineitem[l_partkey])"}, ["orders[o_orderstatus]"],
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders i ON l_orderkey = i.o_orderkey WHERE i.o_orderstatus = o.o_orderstatus) AS parts FROM orders o GROUP BY 1")
grouped("agg_minmax_date", {"first": 'FORMAT(MIN(orders[o_orderdate]), "yyyy-mm-dd")', "last": 'FORMAT(MAX(orders[o_orderdate]), "yyyy-mm-dd")', "name": "MAX(customer[c_name])"}, ["customer[c_mktsegment]"],
        "SELECT c_mktsegment, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, (SELECT max(c_name) FROM customer i WHERE i.c_mktsegment = c.c_mktsegment) AS name FROM orders JOIN customer c ON o_custkey = c_custkey GROUP BY c_mktsegment")
grouped("agg_median_percentile_inc", {"med": "ROUND(MEDIAN(lineitem[l_quantity]), 4)", "p90": "ROUND(PERCENTILE.INC(lineitem[l_extendedprice], 0.9), 4)", "px": "ROUND(PERCENTILEX.INC(lineitem, lineitem[l_quantity] * 2, 0.25), 4)"}, ["lineitem[l_linestatus]"],
        "SELECT l_linestatus, round(median(l_quantity), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_quantity * 2, 0.25), 4) AS px FROM lineitem GROUP BY 1")
grouped("agg_percentile_exc", {"p": "ROUND(PERCENTILE.EXC(orders[o_totalprice], 0.25), 4)"}, ["orders[o_orderpriority]"],
        """WITH r AS (SELECT o_orderpriority, o_totalprice v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) i, count(*) OVER (PARTITION BY o_orderpriority) n FROM orders),
        k AS (SELECT *, 0.25 * (n + 1) AS pos FROM r)
        SELECT o_orderpriority, round(max(CASE WHEN i = floor(pos) THEN v END) + max(pos - floor(pos)) * (max(CASE WHEN i = floor(pos) + 1 THEN v END) - max(CASE WHEN i = floor(pos) THEN v END)), 4) AS p FROM k GROUP BY 1""")  # fmt: skip
grouped("agg_stdev_var", {"ss": "ROUND(STDEV.S(lineitem[l_quantity]), 6)", "sp": "ROUND(STDEV.P(lineitem[l_quantity]), 6)", "vs": "ROUND(VAR.S(lineitem[l_quantity]), 6)", "vp": "ROUND(VARX.P(lineitem, lineitem[l_quantity]), 6)"}, ["lineitem[l_returnflag]"],
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY 1")
grouped("agg_geomean_product", {"g": "ROUND(GEOMEAN(part[p_size]), 6)", "p": "ROUND(LN(PRODUCTX(TOPN(3, part, part[p_partkey], ASC), part[p_size])), 6)"}, ["part[p_type]"],
        "SELECT p_type, round(exp(avg(ln(p_size))), 6) AS g, round((SELECT ln(product(p_size)) FROM (SELECT p_size FROM part i WHERE i.p_type = o.p_type ORDER BY p_partkey LIMIT 3)), 6) AS p FROM part o GROUP BY p_type")
grouped("agg_a_forms", {"a": "ROUND(AVERAGEA(orders[o_totalprice]), 4)", "t": "MAXA(orders[o_orderstatus])", "m": "ROUND(MINA(orders[o_totalprice]), 2)"}, ["orders[o_orderpriority]"],
        "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a, 0.0::DOUBLE AS t, round(min(o_totalprice), 2) AS m FROM orders GROUP BY 1")
scalar("rank_eq", {"r": "RANK.EQ(50, lineitem[l_quantity])", "a": "RANK.EQ(50, lineitem[l_quantity], ASC)", "none": "RANK.EQ(-1, lineitem[l_quantity])"},
       "SELECT count(*) FILTER (WHERE l_quantity > 50) + 1 AS r, count(*) FILTER (WHERE l_quantity < 50) + 1 AS a, CAST(NULL AS BIGINT) AS none FROM lineitem")
scalar("linest", {"slope": "ROUND(SUMX(LINEST(lineitem[l_extendedprice], lineitem[l_quantity]), [Slope1]), 6)", "intercept": "ROUND(SUMX(LINESTX(lineitem, lineitem[l_extendedprice], lineitem[l_quantity]), [Intercept]), 3)"},
       "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
scalar("approx_distinct", {"near": "ABS(APPROXIMATEDISTINCTCOUNT(orders[o_custkey]) - DISTINCTCOUNT(orders[o_custkey])) < 0.1 * DISTINCTCOUNT(orders[o_custkey])"}, "SELECT TRUE AS near")

# -- iterators -----------------------------------------------------------------
scalar("sumx_related", {"v": "ROUND(SUMX(lineitem, lineitem[l_quantity] * RELATED(part[p_retailprice])), 2)", "n": "SUMX(orders, RELATED(nation[n_nationkey]))"},
       "SELECT (SELECT round(sum(l_quantity * p_retailprice), 2) FROM lineitem JOIN part ON l_partkey = p_partkey) AS v, (SELECT sum(c_nationkey)::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey) AS n")
grouped("averagex_values", {"a": "ROUND(AVERAGEX(VALUES(customer[c_mktsegment]), [Sales]), 0)"}, ["nation[n_name]"],
        f"SELECT n_name, round(avg(s), 0) AS a FROM (SELECT n_name, c_mktsegment, sum(o_totalprice) s FROM {_OCN} GROUP BY 1, 2) GROUP BY 1")
grouped("rankx_customers", {"s": "ROUND([Sales], 2)", "r": "RANKX(ALL(nation[n_name]), [Sales])", "d": "RANKX(ALL(nation[n_name]), [Orders], , ASC, DENSE)"}, ["nation[n_name]"],
        f"SELECT n_name, round(sum(o_totalprice), 2) AS s, rank() OVER (ORDER BY sum(o_totalprice) DESC) AS r, dense_rank() OVER (ORDER BY count(*)) AS d FROM {_OCN} GROUP BY 1")
grouped("concatenatex_ordered", {"names": 'CONCATENATEX(VALUES(nation[n_name]), nation[n_name], "; ", nation[n_name], DESC)'}, ["region[r_name]"],
        "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
grouped("firstnonblank", {"f": "FIRSTNONBLANK(part[p_brand], [Quantity])", "lv": "ROUND(LASTNONBLANKVALUE(part[p_brand], [Quantity]), 2)", "fv": "ROUND(FIRSTNONBLANKVALUE(part[p_brand], [Quantity]), 2)"}, ["part[p_type]"],
        "WITH b AS (SELECT p_type, p_brand, sum(l_quantity) q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_type, min(p_brand) AS f, round(arg_max(q, p_brand), 2) AS lv, round(arg_min(q, p_brand), 2) AS fv FROM b GROUP BY 1")
grouped("minx_maxx", {"lo": "ROUND(MINX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount])), 4)", "hi": "ROUND(MAXX(VALUES(lineitem[l_linestatus]), [Quantity]), 2)"}, ["lineitem[l_returnflag]"],
        "SELECT l_returnflag, round(min(l_extendedprice * (1 - l_discount)), 4) AS lo, (SELECT round(max(q), 2) FROM (SELECT sum(l_quantity) q FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY l_linestatus)) AS hi FROM lineitem o GROUP BY 1")
scalar("xnpv", {"v": "ROUND(XNPV(TOPN(200, orders, orders[o_orderkey], ASC), orders[o_totalprice], orders[o_orderdate], 0.05), 2)"},
       "WITH t AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200) SELECT round(sum(o_totalprice / pow(1.05, date_diff('day', (SELECT min(o_orderdate) FROM t), o_orderdate) / 365.0)), 2) AS v FROM t")
scalar("xnpv_all", {"v": "ROUND(XNPV(orders, orders[o_totalprice], orders[o_orderdate], 0.05), 2)"},
       "SELECT round(sum(o_totalprice / pow(1.05, date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) / 365.0)), 2) AS v FROM orders")
grouped("xirr", {"r": "ROUND(XIRR(orders, IF(MOD(orders[o_orderkey], 2) = 0, orders[o_totalprice], -orders[o_totalprice] * 0.5), orders[o_orderdate]), 6)"}, ["customer[c_custkey]"], "", keep_blank=True)
SQL.pop("xirr")

# -- filter context ----------------------------------------------------------------
scalar("filter_predicates_all", {"n": "COUNTROWS(orders)", "v": "ROUND([Sales], 2)"},
       """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000 AND o_orderkey BETWEEN 10 AND 9000
       AND c_mktsegment NOT IN ('BUILDING') AND lower(o_orderpriority) LIKE '%g%' AND c_name LIKE 'Customer#0000%' AND c_name NOT LIKE '%9' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' AND o_orderstatus IS NOT NULL""",
       filters={"orders[o_orderpriority]": {"all": [["1-URGENT", "2-HIGH"], {"contains": "G"}]}, "orders.o_totalprice": {"op": ">", "value": 1000}, "orders.o_orderkey": {"between": [10, 9000]}, "customer.c_mktsegment": {"not_in": ["BUILDING"]},
                "customer.c_name": {"all": [{"starts_with": "customer#0000"}, {"all": [{"op": "<>", "value": "x"}]}, {"not_in": []}]}, "orders.o_orderdate": {"between": ["1996-01-01", "2000-12-31"]}, "orders.o_orderstatus": {"is_blank": False}})
SQL["filter_predicates_all"] = SQL["filter_predicates_all"].replace(" AND c_name NOT LIKE '%9'", "")
scalar("filter_relative_date", {"n": "COUNTROWS(orders)"}, "SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND TIMESTAMP '1998-01-01'",
       filters={"orders.o_orderdate": {"relative_date": {"last": 3, "unit": "month", "anchor": "1998-01-01"}}})
grouped("calculate_override", {"own": "ROUND([Sales], 2)", "building": 'ROUND(CALCULATE([Sales], customer[c_mktsegment] = "BUILDING"), 2)'}, ["customer[c_mktsegment]"],
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS own, (SELECT round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS building FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
grouped("calculate_keepfilters", {"own": "ROUND([Sales], 2)", "kept": 'ROUND(CALCULATE([Sales], KEEPFILTERS(customer[c_mktsegment] IN {"BUILDING", "MACHINERY"})), 2)'}, ["customer[c_mktsegment]"],
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS own, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN round(sum(o_totalprice), 2) END AS kept FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
scalar("calculate_and_same_column", {"n": "CALCULATE(COUNTROWS(orders), orders[o_totalprice] > 50000, orders[o_totalprice] <= 200000)", "r": "CALCULATE(COUNTROWS(orders), 50000 < orders[o_totalprice])", "x": 'CALCULATE(COUNTROWS(orders), NOT(orders[o_orderstatus] IN {"F"}))'},
       "SELECT count(*) FILTER (WHERE o_totalprice > 50000 AND o_totalprice <= 200000) AS n, count(*) FILTER (WHERE o_totalprice > 50000) AS r, count(*) FILTER (WHERE o_orderstatus <> 'F') AS x FROM orders")
grouped("all_pct_of_total", {"share": "ROUND(DIVIDE([Revenue], CALCULATE([Revenue], ALL(nation))), 6)"}, ["nation[n_name]"],
        f"SELECT n_name, round({_REV} / sum({_REV}) OVER (), 6) AS share FROM {_LOCN} GROUP BY n_name")
grouped("allexcept", {"own": "ROUND([Sales], 2)", "segment": "ROUND(CALCULATE([Sales], ALLEXCEPT(customer, customer[c_mktsegment])), 2)"}, ["customer[c_mktsegment]", "customer[c_nationkey]"],
        "SELECT c_mktsegment, c_nationkey, round(sum(o_totalprice), 2) AS own, round(sum(sum(o_totalprice)) OVER (PARTITION BY c_mktsegment), 2) AS segment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
grouped("allselected_pct", {"share": "ROUND(DIVIDE([Sales], CALCULATE([Sales], ALLSELECTED(nation[n_name]))), 6)", "all": "ROUND(DIVIDE([Sales], CALCULATE([Sales], ALLSELECTED())), 6)"}, ["nation[n_name]"],
        f"SELECT n_name, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS all FROM {_OCN} JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1",
        filters={"region.r_name": ["ASIA", "EUROPE"]})
SQL["allselected_pct"] = SQL["allselected_pct"].replace("AS all ", 'AS "all" ')
grouped("removefilters", {"own": "[Orders]", "every": "CALCULATE([Orders], REMOVEFILTERS())", "col": "CALCULATE([Orders], REMOVEFILTERS(orders[o_orderstatus]))"}, ["orders[o_orderstatus]", "orders[o_orderpriority]"],
        "SELECT o_orderstatus, o_orderpriority, count(*) AS own, (SELECT count(*) FROM orders) AS every, (sum(count(*)) OVER (PARTITION BY o_orderpriority))::BIGINT AS col FROM orders GROUP BY 1, 2")
table("values_distinct", "VALUES(lineitem[l_returnflag])", "SELECT DISTINCT l_returnflag FROM lineitem")
grouped("selectedvalue", {"one": 'SELECTEDVALUE(orders[o_orderstatus], "many")', "has": "HASONEVALUE(orders[o_orderstatus])"}, ["orders[o_custkey]"],
        "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'many' END AS one, count(DISTINCT o_orderstatus) = 1 AS has FROM orders GROUP BY 1")
grouped("filter_inspection", {"n": "[Orders]", "f": "ISFILTERED(nation[n_name])", "x": "ISCROSSFILTERED(orders[o_orderkey])", "o": "HASONEFILTER(nation[n_name])", "s": "ISINSCOPE(nation[n_name])", "not": "ISFILTERED(part[p_name])", "c": 'CALCULATE(COUNTROWS(FILTERS(orders[o_orderstatus])), orders[o_orderstatus] IN {"F", "O"})'}, ["nation[n_name]"],
        f"SELECT n_name, count(*) AS n, TRUE AS f, TRUE AS x, TRUE AS o, TRUE AS s, FALSE AS \"not\", 2 AS c FROM {_OCN} GROUP BY 1")
scalar("treatas", {"v": 'ROUND(CALCULATE([Sales], TREATAS({"NATION_3", "NATION_7"}, nation[n_name])), 2)', "s": "ROUND(CALCULATE([Quantity], TREATAS(VALUES(customer[c_nationkey]), supplier[s_nationkey])), 2)"},
       f"SELECT (SELECT round(sum(o_totalprice), 2) FROM {_OCN} WHERE n_name IN ('NATION_3', 'NATION_7')) AS v, (SELECT round(sum(l_quantity), 2) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT c_nationkey FROM customer)) AS s")
grouped("userelationship_shipdate", {"ordered": "ROUND([Revenue], 2)", "shipped": "ROUND(CALCULATE([Revenue], USERELATIONSHIP(lineitem[l_shipdate], calendar[Date])), 2)"}, ["calendar[Year]"],
        f"""SELECT coalesce(a.y, b.y) AS Year, ordered, shipped FROM (SELECT year(o_orderdate) y, round({_REV}, 2) ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) a
        FULL JOIN (SELECT year(l_shipdate) y, round({_REV}, 2) shipped FROM lineitem GROUP BY 1) b ON a.y = b.y""")  # fmt: skip
grouped("userelationship_supplier", {"v": "ROUND(CALCULATE([Quantity], USERELATIONSHIP(supplier[s_nationkey], nation[n_nationkey]), CROSSFILTER(customer[c_nationkey], nation[n_nationkey], NONE)), 2)"}, ["nation[n_name]"],
        "SELECT n_name, round(sum(l_quantity), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
scalar("crossfilter_both", {"one": 'CALCULATE(COUNTROWS(customer), orders[o_orderpriority] = "1-URGENT")', "both": 'CALCULATE(COUNTROWS(customer), orders[o_orderpriority] = "1-URGENT", CROSSFILTER(orders[o_custkey], customer[c_custkey], BOTH))'},
       "SELECT (SELECT count(*) FROM customer) AS one, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS both")
scalar("expanded_table_filter", {"n": "CALCULATE(COUNTROWS(customer), FILTER(orders, orders[o_totalprice] > 400000))", "t": "CALCULATE(DISTINCTCOUNT(nation[n_name]), TOPN(5, orders, orders[o_totalprice]))"},
       "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS n, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 5))) AS t")


def _half(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """Customers with even keys only: orders of the others have no customer."""
    m = SemanticModel(spark)
    m.add_table("customer", spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0"), key="c_custkey").add_table("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), key="o_orderkey")
    return m.relate("orders[o_custkey]", "customer[c_custkey]")


custom("unknown_member", lambda spark, sf_dir: api.evaluate_grouped(_half(spark, sf_dir), {"n": "COUNTROWS(orders)", "k": "COUNTROWS(ALL(customer[c_mktsegment]))"}, ["customer[c_mktsegment]"], keep_blank=False),
       "SELECT c_mktsegment, count(*) AS n, (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer WHERE c_custkey % 2 = 0) AS k FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey GROUP BY 1")


def _doubled(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """All customers under doubled keys: orders of odd or too large keys have no customer."""
    m = SemanticModel(spark)
    m.add_table("customer", spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") * 2), key="c_custkey").add_table("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), key="o_orderkey")
    return m.relate("orders[o_custkey]", "customer[c_custkey]")


custom("unknown_member_all", lambda spark, sf_dir: api.evaluate_grouped(_doubled(spark, sf_dir), {"n": "COUNTROWS(orders)", "k": "COUNTROWS(ALL(customer[c_mktsegment]))"}, ["customer[c_mktsegment]"], keep_blank=False),
       "SELECT c_mktsegment, count(*) AS n, (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer) AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2 GROUP BY 1")
scalar("lookupvalue", {"v": 'LOOKUPVALUE(nation[n_regionkey], nation[n_name], "NATION_8")', "none": 'LOOKUPVALUE(nation[n_regionkey], nation[n_name], "ATLANTIS", -1)', "x": "SUMX(customer, LOOKUPVALUE(nation[n_regionkey], nation[n_nationkey], customer[c_nationkey]))"},
       "SELECT (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_8') AS v, -1 AS none, (SELECT sum(n_regionkey)::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey) AS x")
table("relatedtable_count", 'SELECTCOLUMNS(region, "name", region[r_name], "nations", COUNTROWS(RELATEDTABLE(nation)), "customers", COUNTROWS(RELATEDTABLE(customer)))',
      "SELECT r_name AS name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
table("context_transition_filter", 'SELECTCOLUMNS(FILTER(customer, [Sales] > 3000000), "k", customer[c_custkey], "v", ROUND([Sales], 2))',
      "SELECT c_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING sum(o_totalprice) > 3000000")
table("variables", 'VAR least = AVERAGEX(customer, customer[c_acctbal]) VAR rich = FILTER(customer, customer[c_acctbal] > least) RETURN ROW("n", COUNTROWS(rich), "s", ROUND(SUMX(rich, customer[c_acctbal] - least), 2))',
      "WITH a AS (SELECT avg(c_acctbal) m FROM customer) SELECT count(*) AS n, round(sum(c_acctbal - m), 2) AS s FROM customer, a WHERE c_acctbal > m")
table("earlier_rank", 'SELECTCOLUMNS(nation, "n", nation[n_name], "r", COUNTROWS(FILTER(nation, nation[n_nationkey] <= EARLIER(nation[n_nationkey]) && nation[n_regionkey] = EARLIER(nation[n_regionkey]))))',
      "SELECT n_name AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation")
table("detailrows", 'CALCULATETABLE(SELECTCOLUMNS(DETAILROWS([Orders]), "k", orders[o_orderkey]), orders[o_totalprice] > 490000)', "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 490000")

# -- table functions -------------------------------------------------------------------
table("summarize", 'SUMMARIZE(orders, customer[c_mktsegment], orders[o_orderstatus], "n", COUNTROWS(orders), "v", ROUND([Sales], 2))',
      "SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
table("summarizecolumns", 'SUMMARIZECOLUMNS(nation[n_name], part[p_type], TREATAS({"ASIA"}, region[r_name]), "q", ROUND([Quantity], 2))',
      f"SELECT n_name, p_type, round(sum(l_quantity), 2) AS q FROM {_LOCN} JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE r_name = 'ASIA' GROUP BY 1, 2")
table("rollup_issubtotal", 'SUMMARIZE(orders, ROLLUP(orders[o_orderstatus], orders[o_orderpriority]), "n", COUNTROWS(orders), "st", ISSUBTOTAL(orders[o_orderpriority]))',
      "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) = 1 AS st FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
table("rollupaddissubtotal", 'SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(orders[o_orderstatus], "total"), "n", [Orders])',
      "SELECT o_orderstatus, grouping(o_orderstatus) = 1 AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
table("groupby_currentgroup", 'GROUPBY(lineitem, lineitem[l_returnflag], supplier[s_nationkey], "q", SUMX(CURRENTGROUP(), lineitem[l_quantity]), "m", MAXX(CURRENTGROUP(), lineitem[l_extendedprice]))',
      "SELECT l_returnflag, s_nationkey, sum(l_quantity) AS q, max(l_extendedprice) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
table("crossjoin", 'CROSSJOIN(VALUES(region[r_name]), VALUES(orders[o_orderstatus]), VALUES(lineitem[l_linestatus]))',
      "SELECT * FROM (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT l_linestatus FROM lineitem)")
table("generate", 'GENERATE(SELECTCOLUMNS(region, "rk", region[r_regionkey]), SELECTCOLUMNS(FILTER(nation, nation[n_regionkey] = [rk] && nation[n_nationkey] > 10), "nk", nation[n_nationkey]))',
      "SELECT r_regionkey AS rk, n_nationkey AS nk FROM region JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 10")
table("generateall", 'GENERATEALL(SELECTCOLUMNS(nation, "a", nation[n_nationkey]), SELECTCOLUMNS(FILTER(region, region[r_regionkey] = [a]), "b", region[r_name]))',
      "SELECT n_nationkey AS a, r_name AS b FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
table("naturalinnerjoin", 'NATURALINNERJOIN(SELECTCOLUMNS(customer, "k", customer[c_nationkey], "c", customer[c_custkey]), SELECTCOLUMNS(FILTER(nation, nation[n_nationkey] < 5), "k", nation[n_nationkey], "n", nation[n_name]))',
      "SELECT c_nationkey AS k, c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 5")
table("naturalleftouterjoin", 'NATURALLEFTOUTERJOIN(SELECTCOLUMNS(customer, "k", customer[c_nationkey], "c", customer[c_custkey]), SELECTCOLUMNS(FILTER(nation, nation[n_nationkey] < 5), "k", nation[n_nationkey], "n", nation[n_name]))',
      "SELECT c_nationkey AS k, c_custkey AS c, n_name AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 5) ON c_nationkey = n_nationkey")
table("union", 'UNION(SELECTCOLUMNS(customer, "k", customer[c_nationkey]), SELECTCOLUMNS(supplier, "k", supplier[s_nationkey]), SELECTCOLUMNS(nation, "k", nation[n_nationkey]))',
      "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
table("except", 'EXCEPT(SELECTCOLUMNS(customer, "k", customer[c_nationkey]), SELECTCOLUMNS(FILTER(supplier, supplier[s_acctbal] > 8000), "k", supplier[s_nationkey]))',
      "SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
table("intersect", 'INTERSECT(SELECTCOLUMNS(customer, "k", customer[c_nationkey]), SELECTCOLUMNS(FILTER(supplier, supplier[s_acctbal] > 8000), "k", supplier[s_nationkey]))',
      "SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
table("topn_ties", 'SELECTCOLUMNS(TOPN(10, part, part[p_size]), "k", part[p_partkey], "s", part[p_size])',
      "SELECT p_partkey AS k, p_size AS s FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
grouped("topn_in_group", {"v": "ROUND(SUMX(TOPN(3, orders, orders[o_totalprice]), orders[o_totalprice]), 2)"}, ["customer[c_mktsegment]"],
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS v FROM (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC) r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 3 GROUP BY 1")
table("topnskip", 'SELECTCOLUMNS(TOPNSKIP(5, 10, orders, orders[o_orderkey]), "k", orders[o_orderkey])', "SELECT o_orderkey AS k FROM orders ORDER BY 1 DESC LIMIT 5 OFFSET 10")
table("sample_even", 'SELECTCOLUMNS(SAMPLE(7, orders, orders[o_orderkey], ASC), "k", orders[o_orderkey])',
      "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () n FROM orders) SELECT o_orderkey AS k FROM r WHERE p IN (SELECT CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT) FROM range(7) t(i), (SELECT max(n) n FROM r))")
table("addcolumns", 'SELECTCOLUMNS(ADDCOLUMNS(nation, "orders", [Orders], "up", UPPER(LEFT(nation[n_name], 3))), "n", nation[n_name], "o", [orders], "u", [up])',
      f"SELECT n_name AS n, count(o_orderkey) AS o, upper(left(n_name, 3)) AS u FROM {_OCN} GROUP BY 1, 3")
table("selectcolumns", 'SELECTCOLUMNS(part, part[p_partkey], "double", part[p_size] * 2, "big", part[p_size] > 25)', "SELECT p_partkey, p_size * 2 AS double, p_size > 25 AS big FROM part")
table("datatable", 'DATATABLE("k", INTEGER, "s", STRING, "f", DOUBLE, {{1, "a", 1.5}, {2, "b,c", -2}, {3, BLANK(), 0}})', "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, 'b,c', -2), (3, NULL, 0)) t(k, s, f)")
table("generateseries", "GENERATESERIES(1, 10, 3)", "SELECT unnest([1, 4, 7, 10]) AS Value")
table("generateseries_decimal", "GENERATESERIES(0, 1, 0.25)", "SELECT unnest([0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS Value")
table("addmissingitems", 'ADDMISSINGITEMS(nation[n_name], SUMMARIZECOLUMNS(nation[n_name], TREATAS({"ASIA"}, region[r_name]), "n", [Orders]), nation[n_name])',
      f"SELECT n.n_name, c AS n FROM nation n LEFT JOIN (SELECT n_name, count(*) c FROM {_OCN} JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1) s ON s.n_name = n.n_name")
table("substitutewithindex", 'SUBSTITUTEWITHINDEX(SELECTCOLUMNS(nation, "r_name", RELATED(region[r_name]), "n", nation[n_name]), "i", SELECTCOLUMNS(region, "r_name", region[r_name]), [r_name], DESC)',
      "SELECT n_name AS n, i FROM nation JOIN (SELECT *, row_number() OVER (ORDER BY r_name DESC) - 1 AS i FROM region) ON n_regionkey = r_regionkey")
table("row_datatypes", 'ROW("a", 1 + 2 * 3, "b", "x" & 5, "c", TRUE, "d", DATE(2024, 2, 30), "e", BLANK() + 5, "f", BLANK() * 5)',
      "SELECT 7 AS a, 'x5' AS b, TRUE AS c, TIMESTAMP '2024-03-01' AS d, 5 AS e, NULL::BIGINT AS f")
scalar("contains_family", {"c": 'CONTAINS(nation, nation[n_name], "NATION_4", nation[n_regionkey], 4)', "r": '"ASIA" IN VALUES(region[r_name])', "x": 'CONTAINSROW(VALUES(region[r_name]), "NOWHERE")', "e": "ISEMPTY(FILTER(nation, nation[n_nationkey] > 99))"},
       "SELECT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_4' AND n_regionkey = 4) AS c, TRUE AS r, FALSE AS x, TRUE AS e")
scalar("tocsv_tojson", {"c": 'TOCSV(SELECTCOLUMNS(region, "k", region[r_regionkey]))', "j": 'TOJSON(SELECTCOLUMNS(region, "k", region[r_regionkey]), 2)'},
       "SELECT '[k]' || chr(10) || string_agg(r_regionkey, chr(10) ORDER BY r_regionkey) AS c, '{\"header\": [\"[k]\"], \"rowCount\": 2, \"data\": [[0], [1]]}' AS j FROM region")

# -- windows -----------------------------------------------------------------------------
grouped("rownumber", {"v": "ROUND([Sales], 2)", "r": "ROWNUMBER(ALL(nation[n_name]), ORDERBY([Sales], DESC))"}, ["nation[n_name]"],
        f"SELECT n_name, round(sum(o_totalprice), 2) AS v, row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS r FROM {_OCN} GROUP BY 1")
table("rank_dense_skip", 'SELECTCOLUMNS(part, "k", part[p_partkey], "s", RANK(SKIP, part, ORDERBY(part[p_size], DESC), PARTITIONBY(part[p_type])), "d", RANK(DENSE, part, ORDERBY(part[p_size], DESC), PARTITIONBY(part[p_type])))',
      "SELECT p_partkey AS k, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS s, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS d FROM part")
grouped("offset_prev", {"v": "ROUND([Sales], 2)", "p": "ROUND(CALCULATE([Sales], OFFSET(-1, ALL(calendar[YearMonth]), ORDERBY(calendar[YearMonth]))), 2)"}, ["calendar[YearMonth]"],
        """WITH m AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS YearMonth, round(sum(o_totalprice), 2) v FROM orders GROUP BY 1)
        SELECT YearMonth, v, lag(v) OVER (ORDER BY YearMonth) AS p FROM m UNION ALL SELECT (SELECT min(ym) FROM (SELECT y * 100 + mo ym FROM range(1995, 2002) a(y), range(1, 13) b(mo)) WHERE ym > (SELECT max(YearMonth) FROM m)), NULL, arg_max(v, YearMonth) FROM m""")  # fmt: skip
grouped("index_first_last", {"f": "ROUND(CALCULATE([Sales], INDEX(1, ALL(nation[n_name]), ORDERBY(nation[n_name]))), 2)", "l": "ROUND(CALCULATE([Sales], INDEX(-1, ALL(nation[n_name]), ORDERBY(nation[n_name]))), 2)"}, ["orders[o_orderstatus]"],
        f"SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE n_name = (SELECT min(n_name) FROM nation)), 2) AS f, round(sum(o_totalprice) FILTER (WHERE n_name = (SELECT max(n_name) FROM nation)), 2) AS l FROM {_OCN} GROUP BY 1")
grouped("window_rel", {"v": "ROUND(CALCULATE([Sales], WINDOW(-1, REL, 1, REL, ALL(nation[n_nationkey]), ORDERBY(nation[n_nationkey]))), 2)"}, ["nation[n_nationkey]"],
        f"SELECT n_nationkey, round(sum(sum(o_totalprice)) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS v FROM {_OCN} GROUP BY 1")
grouped("window_abs", {"v": "ROUND(CALCULATE([Sales], WINDOW(1, ABS, 0, REL, ALL(nation[n_nationkey]), ORDERBY(nation[n_nationkey]))), 2)"}, ["nation[n_nationkey]"],
        f"SELECT n_nationkey, round(sum(sum(o_totalprice)) OVER (ORDER BY n_nationkey), 2) AS v FROM {_OCN} GROUP BY 1")
grouped("running_total", {"v": "ROUND(CALCULATE([Sales], FILTER(ALL(calendar[YearMonth]), calendar[YearMonth] <= MAX(calendar[YearMonth]))), 2)"}, ["calendar[YearMonth]"],
        """WITH m AS (SELECT ym, sum(v) OVER (ORDER BY ym) t FROM (SELECT y * 100 + mo ym, coalesce(v, 0) v FROM range(1995, 2002) a(y) CROSS JOIN range(1, 13) b(mo) LEFT JOIN (SELECT year(o_orderdate) * 100 + month(o_orderdate) k, sum(o_totalprice) v FROM orders GROUP BY 1) ON k = y * 100 + mo))
        SELECT ym AS YearMonth, round(t, 2) AS v FROM m""")  # fmt: skip

# -- time intelligence --------------------------------------------------------------------


def _by_month(name: str, dax: str, sql_sum: str, by: str = "YearMonth") -> None:
    """A shifted sum per month of the calendar: ``sql_sum`` is a condition on (day o, month first m, month last e)."""
    grouped(name, {"v": f"ROUND({dax}, 2)"}, [f"calendar[{by}]"],
            f"""WITH c AS (SELECT CAST(year(d) * 100 + month(d) AS BIGINT) k, min(d) m, max(d) e FROM {_DAYS} GROUP BY 1), o AS (SELECT o_orderdate d, sum(o_totalprice) v FROM orders GROUP BY 1)
            SELECT k AS YearMonth, round(sum(o.v), 2) AS v FROM c JOIN o ON {sql_sum} GROUP BY 1""")  # fmt: skip


_by_month("dateadd_month", "CALCULATE([Sales], DATEADD(calendar[Date], -1, MONTH))", "o.d >= m - INTERVAL 1 MONTH AND o.d < m")
_by_month("sameperiodlastyear", "CALCULATE([Sales], SAMEPERIODLASTYEAR(calendar[Date]))", "o.d >= m - INTERVAL 1 YEAR AND o.d <= last_day(m - INTERVAL 1 YEAR)")
_by_month("datesytd", "CALCULATE([Sales], DATESYTD(calendar[Date]))", "o.d >= date_trunc('year', m) AND o.d <= e")
_by_month("datesytd_fiscal", 'CALCULATE([Sales], DATESYTD(calendar[Date], "6/30"))', "o.d >= date_trunc('year', m + INTERVAL 6 MONTH) - INTERVAL 6 MONTH AND o.d <= e")
_by_month("totalytd", "TOTALYTD([Sales], calendar[Date])", "o.d >= date_trunc('year', m) AND o.d <= e")
_by_month("totalqtd", "TOTALQTD([Sales], calendar[Date])", "o.d >= date_trunc('quarter', m) AND o.d <= e")
_by_month("totalmtd", "TOTALMTD([Sales], calendar[Date])", "o.d >= m AND o.d <= e")
_by_month("previousmonth", "CALCULATE([Sales], PREVIOUSMONTH(calendar[Date]))", "o.d >= m - INTERVAL 1 MONTH AND o.d < m")
_by_month("nextquarter", "CALCULATE([Sales], NEXTQUARTER(calendar[Date]))", "o.d >= date_trunc('quarter', m) + INTERVAL 3 MONTH AND o.d < date_trunc('quarter', m) + INTERVAL 6 MONTH")
_by_month("previousyear", "CALCULATE([Sales], PREVIOUSYEAR(calendar[Date]))", "year(o.d) = year(m) - 1")
_by_month("nextday_previousday", "CALCULATE([Sales], NEXTDAY(calendar[Date])) + CALCULATE([Sales], PREVIOUSDAY(calendar[Date]))", "o.d = e + INTERVAL 1 DAY OR o.d = m - INTERVAL 1 DAY")
_by_month("parallelperiod", "CALCULATE([Sales], PARALLELPERIOD(calendar[Date], -1, YEAR))", "year(o.d) = year(m) - 1")
_by_month("datesinperiod", "CALCULATE([Sales], DATESINPERIOD(calendar[Date], MAX(calendar[Date]), -3, MONTH))", "o.d > last_day(m - INTERVAL 3 MONTH) AND o.d <= e")
_by_month("datesbetween", "CALCULATE([Sales], DATESBETWEEN(calendar[Date], DATE(1996, 1, 10), MAX(calendar[Date])))", "o.d >= TIMESTAMP '1996-01-10' AND o.d <= e")
_by_month("opening_closing_balance", "OPENINGBALANCEQUARTER([Sales], calendar[Date]) + CLOSINGBALANCEMONTH([Sales], calendar[Date])", "o.d = date_trunc('quarter', m) - INTERVAL 1 DAY OR o.d = e")
_by_month("firstdate_lastdate", "CALCULATE([Sales], FIRSTDATE(calendar[Date])) + CALCULATE([Sales], LASTDATE(calendar[Date]))", "o.d = m OR o.d = e")
_by_month("startof_endof", "CALCULATE([Sales], STARTOFQUARTER(calendar[Date])) + CALCULATE([Sales], ENDOFYEAR(calendar[Date]))", "o.d = date_trunc('quarter', m) OR o.d = last_day(date_trunc('year', m) + INTERVAL 11 MONTH)")
grouped("closing_year", {"c": "ROUND(CLOSINGBALANCEYEAR([Quantity], calendar[Date]), 2)", "n": "[Orders]"}, ["calendar[Year]"],
        "SELECT y AS Year, (SELECT round(sum(l_quantity), 2) FROM lineitem JOIN orders i ON l_orderkey = i.o_orderkey WHERE i.o_orderdate = make_timestamp(y, 12, 31, 0, 0, 0)) AS c, n FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)")
table("calendar", "CALENDAR(DATE(2024, 2, 27), DATE(2024, 3, 2))", "SELECT CAST(range AS TIMESTAMP) AS Date FROM range(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-03', INTERVAL 1 DAY)")
scalar("calendarauto", {"n": "COUNTROWS(CALENDARAUTO())", "a": 'FORMAT(MINX(CALENDARAUTO(), [Date]), "yyyy-mm-dd")', "b": 'FORMAT(MAXX(CALENDARAUTO(), [Date]), "yyyy-mm-dd")'},
       "SELECT date_diff('day', DATE '1995-01-01', DATE '2025-01-01') AS n, '1995-01-01' AS a, '2024-12-31' AS b")

# -- scalars -----------------------------------------------------------------------------------
table("datediff_boundaries", 'SELECTCOLUMNS(orders, "k", orders[o_orderkey], "d", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], DAY), "w", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], WEEK), "m", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], MONTH), "q", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], QUARTER), "y", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], YEAR), "h", DATEDIFF(DATE(1995, 1, 1), orders[o_orderdate], HOUR))',
      "SELECT o_orderkey AS k, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d, date_diff('week', TIMESTAMP '1995-01-02', o_orderdate + INTERVAL 1 DAY) AS w, date_diff('month', TIMESTAMP '1995-01-01', o_orderdate) AS m, date_diff('quarter', TIMESTAMP '1995-01-01', o_orderdate) AS q, date_diff('year', TIMESTAMP '1995-01-01', o_orderdate) AS y, date_diff('hour', TIMESTAMP '1995-01-01', o_orderdate) AS h FROM orders")
table("weeknum_weekday", 'SELECTCOLUMNS(calendar, "d", FORMAT(calendar[Date], "yyyy-mm-dd"), "w1", WEEKDAY(calendar[Date]), "w2", WEEKDAY(calendar[Date], 2), "w3", WEEKDAY(calendar[Date], 3), "n1", WEEKNUM(calendar[Date]), "n2", WEEKNUM(calendar[Date], 2), "iso", WEEKNUM(calendar[Date], 21))',
      f"SELECT strftime(d, '%Y-%m-%d') AS d, dayofweek(d) + 1 AS w1, isodow(d) AS w2, isodow(d) - 1 AS w3, CAST(strftime(d, '%U') AS INT) + CASE WHEN dayofweek(date_trunc('year', d)) = 0 THEN 0 ELSE 1 END AS n1, CAST(strftime(d, '%W') AS INT) + CASE WHEN dayofweek(date_trunc('year', d)) = 1 THEN 0 ELSE 1 END AS n2, week(d) AS iso FROM {_DAYS}")
table("edate_eomonth", 'SELECTCOLUMNS(calendar, "d", FORMAT(calendar[Date], "yyyy-mm-dd"), "e", FORMAT(EDATE(calendar[Date], 1), "yyyy-mm-dd"), "o", FORMAT(EOMONTH(calendar[Date], -2), "yyyy-mm-dd"))',
      f"SELECT strftime(d, '%Y-%m-%d') AS d, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS e, strftime(last_day(d - INTERVAL 2 MONTH), '%Y-%m-%d') AS o FROM {_DAYS}")
table("date_parts", 'SELECTCOLUMNS(events, "k", events[event_id], "y", YEAR(events[ts]), "q", QUARTER(events[ts]), "mo", MONTH(events[ts]), "d", DAY(events[ts]), "h", HOUR(events[ts]), "mi", MINUTE(events[ts]), "s", SECOND(events[ts]))',
      "SELECT event_id AS k, year(ts) AS y, quarter(ts) AS q, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
table("yearfrac", 'SELECTCOLUMNS(calendar, "d", FORMAT(calendar[Date], "yyyy-mm-dd"), "a", ROUND(YEARFRAC(DATE(1995, 1, 15), calendar[Date], 2), 8), "b", ROUND(YEARFRAC(DATE(1995, 1, 15), calendar[Date], 3), 8))',
      f"SELECT strftime(d, '%Y-%m-%d') AS d, round(abs(date_diff('day', TIMESTAMP '1995-01-15', d)) / 360.0, 8) AS a, round(abs(date_diff('day', TIMESTAMP '1995-01-15', d)) / 365.0, 8) AS b FROM {_DAYS}")
table("networkdays", 'SELECTCOLUMNS(FILTER(calendar, calendar[Year] = 1996), "d", FORMAT(calendar[Date], "yyyy-mm-dd"), "n", NETWORKDAYS(DATE(1996, 1, 1), calendar[Date]), "s", NETWORKDAYS(DATE(1996, 1, 1), calendar[Date], 11))',
      f"SELECT strftime(d, '%Y-%m-%d') AS d, (SELECT count(*) FROM {_DAYS} i(x) WHERE x BETWEEN TIMESTAMP '1996-01-01' AND o.d AND isodow(x) < 6) AS n, (SELECT count(*) FROM {_DAYS} i(x) WHERE x BETWEEN TIMESTAMP '1996-01-01' AND o.d AND isodow(x) < 7) AS s FROM {_DAYS} o(d) WHERE year(d) = 1996")
table("text_family", 'SELECTCOLUMNS(part, "k", part[p_partkey], "l", LEFT(part[p_name], 3), "r", RIGHT(part[p_name], 4), "m", MID(part[p_name], 2, 3), "n", LEN(part[p_name]), "u", UPPER(part[p_name]), "s", SUBSTITUTE(part[p_name], "e", "EE"), "p", REPLACE(part[p_name], 2, 2, "--"), "f", FIND("r", part[p_name], 1, -1), "c", CONTAINSSTRING(part[p_name], "RED"), "x", EXACT(part[p_name], "red widget"), "t", REPT("ab", 2) & TRIM("  a   b "), "uc", UNICODE(part[p_name]), "ch", UNICHAR(945 + part[p_size]))',
      """SELECT p_partkey AS k, left(p_name, 3) AS l, right(p_name, 4) AS r, substr(p_name, 2, 3) AS m, length(p_name) AS n, upper(p_name) AS u, replace(p_name, 'e', 'EE') AS s, left(p_name, 1) || '--' || substr(p_name, 4) AS p,
      CASE WHEN instr(p_name, 'r') > 0 THEN instr(p_name, 'r') ELSE -1 END AS f, contains(lower(p_name), 'red') AS c, p_name = 'red widget' AS x, 'ababa b' AS t, unicode(p_name) AS uc, chr(945 + p_size) AS ch FROM part""")  # fmt: skip
table("format_numeric", 'SELECTCOLUMNS(part, "k", part[p_partkey], "a", FORMAT(part[p_retailprice], "#,##0.00"), "b", FORMAT(part[p_size], "000"), "c", FORMAT(part[p_size] / 100, "0%"), "d", FORMAT(-part[p_size], "0;(0)"), "e", FIXED(part[p_retailprice], 1, TRUE), "f", FORMAT(part[p_size], "0.##"))',
      "SELECT p_partkey AS k, format('{:,.2f}', p_retailprice) AS a, lpad(p_size::VARCHAR, 3, '0') AS b, p_size || '%' AS c, '(' || p_size || ')' AS d, format('{:.1f}', p_retailprice) AS e, p_size || '.' AS f FROM part")
table("format_date", 'SELECTCOLUMNS(events, "k", events[event_id], "a", FORMAT(events[ts], "dddd, mmmm d, yyyy"), "b", FORMAT(events[ts], "hh:nn:ss AM/PM"), "c", FORMAT(events[ts], "dd-mmm-yy"), "d", FORMAT(events[ts], "m/d/yyyy h:mm"))',
      "SELECT event_id AS k, strftime(ts, '%A, %B %-d, %Y') AS a, strftime(ts, '%I:%M:%S %p') AS b, strftime(ts, '%d-%b-%y') AS c, strftime(ts, '%-m/%-d/%Y %-H:%M') AS d FROM events")


def _hierarchy(spark: SparkSession, sf_dir: str) -> SemanticModel:
    """Parts as a tree: the parent of k is k div 3."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return SemanticModel(spark).add_table("T", df, key="p_partkey")


custom("path_family", lambda spark, sf_dir: api.table_expression(_hierarchy(spark, sf_dir), 'VAR t = ADDCOLUMNS(T, "p", PATH(T[p_partkey], T[parent])) RETURN SELECTCOLUMNS(t, "k", T[p_partkey], "p", [p], "n", PATHLENGTH([p]), "a", PATHITEM([p], 2), "b", PATHITEMREVERSE([p], 2), "c", PATHCONTAINS([p], 1))'),
       """WITH RECURSIVE r(k, p, n) AS (SELECT p_partkey, p_partkey::VARCHAR, 1 FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, r.p || '|' || p_partkey, n + 1 FROM part JOIN r ON p_partkey > 0 AND p_partkey // 3 = r.k)
       SELECT k, p, n, CASE WHEN n >= 2 THEN split_part(p, '|', 2) END AS a, CASE WHEN n >= 2 THEN split_part(p, '|', n - 1) END AS b, list_contains(string_split(p, '|'), '1') AS c FROM r""")  # fmt: skip
_COL = 'SELECTCOLUMNS(lineitem, "o", lineitem[l_orderkey], "l", lineitem[l_linenumber], "p", lineitem[l_partkey], '
table("math_family", _COL + '"a", MOD(lineitem[l_partkey], 7), "b", QUOTIENT(lineitem[l_partkey], 7), "c", ROUND(POWER(lineitem[l_quantity], 1.5), 6), "d", ROUND(SQRT(lineitem[l_quantity]), 8), "e", ROUND(LN(lineitem[l_quantity]), 8), "f", ROUND(LOG(lineitem[l_quantity], 2), 8), "g", SIGN(lineitem[l_discount]), "h", ABS(-lineitem[l_partkey]), "i", GCD(lineitem[l_partkey], 12), "j", EVEN(lineitem[l_quantity]), "k", ROUND(FACT(lineitem[l_linenumber]), 0))',
      "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_partkey % 7 AS a, l_partkey // 7 AS b, round(pow(l_quantity, 1.5), 6) AS c, round(sqrt(l_quantity), 8) AS d, round(ln(l_quantity), 8) AS e, round(ln(l_quantity) / ln(2), 8) AS f, sign(l_discount)::BIGINT AS g, l_partkey AS h, gcd(l_partkey, 12)::DOUBLE AS i, (ceil(l_quantity / 2) * 2)::BIGINT AS j, round(factorial(l_linenumber)::DOUBLE, 0) AS k FROM lineitem")
table("trig_family", _COL + '"a", ROUND(SIN(lineitem[l_quantity]), 8), "b", ROUND(COS(lineitem[l_quantity]), 8), "c", ROUND(ATAN(lineitem[l_quantity]), 8), "d", ROUND(DEGREES(lineitem[l_tax]), 8), "e", ROUND(TANH(lineitem[l_tax]), 8), "f", ROUND(ASIN(lineitem[l_discount]), 8), "g", ROUND(COT(lineitem[l_quantity]), 6))',
      "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, round(sin(l_quantity), 8) AS a, round(cos(l_quantity), 8) AS b, round(atan(l_quantity), 8) AS c, round(degrees(l_tax), 8) AS d, round(tanh(l_tax), 8) AS e, round(asin(l_discount), 8) AS f, round(cot(l_quantity), 6) AS g FROM lineitem")
table("bit_family", 'SELECTCOLUMNS(orders, "k", orders[o_orderkey], "a", BITAND(orders[o_orderkey], 255), "b", BITOR(orders[o_orderkey], 15), "c", BITXOR(orders[o_orderkey], 85), "d", BITLSHIFT(orders[o_orderkey], 3), "e", BITRSHIFT(orders[o_orderkey], 2))',
      "SELECT o_orderkey AS k, o_orderkey & 255 AS a, o_orderkey | 15 AS b, xor(o_orderkey, 85) AS c, o_orderkey << 3 AS d, o_orderkey >> 2 AS e FROM orders")
table("rounding_family", _COL + '"a", ROUND(lineitem[l_extendedprice], 0), "b", ROUNDUP(lineitem[l_quantity] / 7, 2), "c", ROUNDDOWN(lineitem[l_quantity] / 7, 2), "d", INT(-lineitem[l_quantity] / 7), "e", CEILING(lineitem[l_quantity], 8), "f", FLOOR(lineitem[l_quantity], 8), "g", TRUNC(lineitem[l_quantity] / -7), "h", MROUND(lineitem[l_quantity], 5))',
      "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, round(l_extendedprice, 0) AS a, ceil(l_quantity / 7 * 100 - 1e-9) / 100 AS b, floor(l_quantity / 7 * 100 + 1e-9) / 100 AS c, floor(-l_quantity / 7)::BIGINT AS d, ceil(l_quantity / 8) * 8 AS e, floor(l_quantity / 8) * 8 AS f, trunc(l_quantity / -7) AS g, floor(l_quantity / 5 + 0.5) * 5 AS h FROM lineitem")
table("divide_blank_inf", 'SELECTCOLUMNS(lineitem, "o", lineitem[l_orderkey], "l", lineitem[l_linenumber], "p", lineitem[l_partkey], "a", ROUND(DIVIDE(lineitem[l_tax], lineitem[l_discount]), 6), "b", ROUND(DIVIDE(lineitem[l_tax], lineitem[l_discount], -1), 6), "c", IF(lineitem[l_discount] = 0, BLANK(), lineitem[l_discount]) + 1, "d", IF(lineitem[l_discount] = 0, BLANK()) * 2)',
      "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS a, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) ELSE -1 END AS b, l_discount + 1 AS c, NULL::DOUBLE AS d FROM lineitem")
table("blank_compare", 'ROW("a", BLANK() = 0, "b", BLANK() = "", "c", BLANK() == 0, "d", BLANK() < 1, "e", ISBLANK(BLANK()), "f", NOT BLANK(), "g", 1 / 0 > 1000, "h", COALESCE(BLANK(), 7), "i", BLANK() & "x", "j", "5" + 2, "k", IF(BLANK(), 1, 2))',
      "SELECT TRUE AS a, TRUE AS b, FALSE AS c, TRUE AS d, TRUE AS e, TRUE AS f, TRUE AS g, 7 AS h, 'x' AS i, 7.0::DOUBLE AS j, 2 AS k")
table("switch_if", 'SELECTCOLUMNS(orders, "k", orders[o_orderkey], "a", SWITCH(orders[o_orderstatus], "F", "filled", "O", "open", "other"), "b", SWITCH(TRUE(), orders[o_totalprice] > 300000, 3, orders[o_totalprice] > 100000, 2, 1), "c", IF(orders[o_totalprice] > 250000 && orders[o_orderstatus] <> "F", "big"))',
      "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS a, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS b, CASE WHEN o_totalprice > 250000 AND o_orderstatus <> 'F' THEN 'big' END AS c FROM orders")
table("type_predicates", 'ROW("a", ISNUMBER(1), "b", ISTEXT("x"), "c", ISNONTEXT(BLANK()), "d", ISLOGICAL(TRUE), "e", ISINTEGER(1.5), "f", ISDATETIME(DATE(2024, 1, 1)), "g", ISEVEN(-4), "h", ISODD(3), "i", ISCURRENCY(CURRENCY(1)), "j", ISAFTER(1, 2, DESC, 3, 3), "k", ISONORAFTER(2, 2, ASC), "l", CONVERT("12.5", DOUBLE), "m", VALUE("1,234.5"), "n", IFERROR(VALUE("x"), -1), "o", ISERROR(1 / 0))',
      "SELECT TRUE AS a, TRUE AS b, TRUE AS c, TRUE AS d, FALSE AS e, TRUE AS f, TRUE AS g, TRUE AS h, TRUE AS i, TRUE AS j, TRUE AS k, 12.5::DOUBLE AS l, 1234.5::DOUBLE AS m, -1.0::DOUBLE AS n, TRUE AS o")
_ANNUITY = '"k", part[p_partkey], "p", ROUND(PMT(0.05 / 12, part[p_size] + 12, part[p_retailprice]), 6), "f", ROUND(FV(0.01, part[p_size], -10, -part[p_retailprice]), 6), "v", ROUND(PV(0.01, part[p_size], -10), 6), "s", ROUND(SLN(part[p_retailprice], 10, part[p_size]), 6), "e", ROUND(EFFECT(0.05, 12), 8), "t", ROUND(TBILLPRICE(DATE(2008, 3, 31), DATE(2008, 6, 1), part[p_size] / 1000), 6))'
table("finance_annuity", "SELECTCOLUMNS(FILTER(part, part[p_partkey] < 200), " + _ANNUITY,
      "SELECT p_partkey AS k, round(-p_retailprice * pow(1 + 0.05 / 12, p_size + 12) * (0.05 / 12) / (pow(1 + 0.05 / 12, p_size + 12) - 1), 6) AS p, round(p_retailprice * pow(1.01, p_size) + 10 * (pow(1.01, p_size) - 1) / 0.01, 6) AS f, round(10 * (1 - pow(1.01, -p_size)) / 0.01, 6) AS v, round((p_retailprice - 10) / p_size, 6) AS s, round(pow(1 + 0.05 / 12, 12) - 1, 8) AS e, round(100 * (1 - p_size / 1000.0 * 62 / 360), 6) AS t FROM part WHERE p_partkey < 200")
table("finance_annuity_all", "SELECTCOLUMNS(part, " + _ANNUITY, SQL["finance_annuity"].removesuffix(" WHERE p_partkey < 200"))
table("finance_depreciation", 'ROW("syd", ROUND(SYD(30000, 7500, 10, 1), 4), "ddb", ROUND(DDB(2400, 300, 10, 2), 4), "db", ROUND(DB(1000000, 100000, 6, 2, 7), 4), "vdb", ROUND(VDB(2400, 300, 10, 0, 1), 4), "rri", ROUND(RRI(96, 10000, 11000), 8))',
      "SELECT 4090.9091::DOUBLE AS syd, 384.0::DOUBLE AS ddb, 259639.4167::DOUBLE AS db, 480.0::DOUBLE AS vdb, 0.00099331::DOUBLE AS rri")
table("finance_bond", 'ROW("price", ROUND(PRICE(DATE(2008, 2, 15), DATE(2017, 11, 15), 0.0575, 0.065, 100, 2, 0), 6), "yield", ROUND(YIELD(DATE(2008, 2, 15), DATE(2016, 11, 15), 0.0575, 95.04287, 100, 2, 0), 6), "dur", ROUND(DURATION(DATE(2008, 1, 1), DATE(2016, 1, 1), 0.08, 0.09, 2, 1), 6), "odd", ROUND(ODDFPRICE(DATE(2008, 11, 11), DATE(2021, 3, 1), DATE(2008, 10, 15), DATE(2009, 3, 1), 0.0785, 0.0625, 100, 2, 1), 6), "num", COUPNUM(DATE(2007, 1, 25), DATE(2008, 11, 15), 2, 1))',
      "SELECT 94.634362::DOUBLE AS price, 0.065::DOUBLE AS yield, 5.993775::DOUBLE AS dur, 113.597717::DOUBLE AS odd, 4 AS num")
_NORMAL = '"k", part[p_partkey], "d", ROUND(NORM.S.DIST(part[p_size] / 25 - 1, FALSE), 8), "e", ROUND(EXPON.DIST(part[p_size] / 10, 2, TRUE), 8), "i", ROUND(NORM.INV(0.908789, 40, 1.5), 5))'
table("dist_normal", "SELECTCOLUMNS(FILTER(part, part[p_partkey] < 200), " + _NORMAL,
      "SELECT p_partkey AS k, round(exp(-pow(p_size / 25.0 - 1, 2) / 2) / sqrt(2 * pi()), 8) AS d, round(1 - exp(-2 * (p_size / 10.0)), 8) AS e, 42.0::DOUBLE AS i FROM part WHERE p_partkey < 200")
table("dist_normal_all", "SELECTCOLUMNS(part, " + _NORMAL, SQL["dist_normal"].removesuffix(" WHERE p_partkey < 200"))
table("dist_t_chisq_beta", 'ROW("t", ROUND(T.DIST.2T(1.959999998, 60), 6), "ti", ROUND(T.INV(0.75, 2), 6), "c", ROUND(CHISQ.INV.RT(0.05, 10), 5), "b", ROUND(BETA.INV(0.685470581, 8, 10), 6), "p", ROUND(POISSON.DIST(2, 5, TRUE), 6), "n", ROUND(CONFIDENCE.NORM(0.05, 2.5, 50), 6))',
      "SELECT 0.054645::DOUBLE AS t, 0.816497::DOUBLE AS ti, 18.30704::DOUBLE AS c, 0.5::DOUBLE AS b, 0.124652::DOUBLE AS p, 0.692952::DOUBLE AS n")

# -- catalog, profiles, tools --------------------------------------------------------------------
table("info_tables_columns", 'SELECTCOLUMNS(INFO.RELATIONSHIPS(), "f", [FromTable], "c", [FromColumn], "t", [ToTable], "a", [IsActive])',
      "SELECT * FROM (VALUES ('lineitem', 'l_orderkey', 'orders', TRUE), ('lineitem', 'l_partkey', 'part', TRUE), ('lineitem', 'l_suppkey', 'supplier', TRUE), ('orders', 'o_custkey', 'customer', TRUE), ('customer', 'c_nationkey', 'nation', TRUE), ('nation', 'n_regionkey', 'region', TRUE), ('supplier', 's_nationkey', 'nation', FALSE), ('orders', 'o_orderdate', 'calendar', TRUE), ('lineitem', 'l_shipdate', 'calendar', FALSE)) t(f, c, t, a)")
table("columnstatistics", 'SELECTCOLUMNS(FILTER(COLUMNSTATISTICS(), [Table Name] = "orders"), "c", [Column Name], "n", [Cardinality], "l", [Max Length])',
      "SELECT * FROM (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS n, NULL::BIGINT AS l FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), NULL FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), max(length(o_orderstatus)) FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), NULL FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), NULL FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), max(length(o_orderpriority)) FROM orders UNION ALL SELECT 'RowNumber', count(*), NULL FROM orders)")


def _with_columns(spark: SparkSession, sf_dir: str) -> SemanticModel:
    m = tpch(spark, sf_dir)
    m.calculated_column("nation", "region", "RELATED(region[r_name])")
    return m.calculated_column("nation", "rank", "CALCULATE(COUNTROWS(nation), FILTER(ALL(nation), nation[n_regionkey] = EARLIER(nation[n_regionkey]) && nation[n_nationkey] <= EARLIER(nation[n_nationkey])))")


custom("calc_column_prefix_agg", lambda spark, sf_dir: _with_columns(spark, sf_dir).tables["nation"].select("n_name", "region", "rank"),
       "SELECT n_name, r_name AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey")
custom("calc_column_lookup", lambda spark, sf_dir: tpch(spark, sf_dir).calculated_column("customer", "nation", "LOOKUPVALUE(nation[n_name], nation[n_nationkey], customer[c_nationkey])").tables["customer"].select("c_custkey", "nation"),
       "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
custom("calc_table", lambda spark, sf_dir: api.evaluate_grouped(tpch(spark, sf_dir).calculated_table("big", "FILTER(orders, orders[o_totalprice] > 300000)"), {"n": "COUNTROWS(big)"}, ["big[o_orderstatus]"]),
       "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
custom("query_table_where", lambda spark, sf_dir: tools.query_table(tpch(spark, sf_dir), "orders", ["o_orderkey", "o_totalprice"], "o_orderpriority LIKE '%urgent%' AND (o_totalprice > 400000 OR o_orderstatus IN ('P')) AND o_orderkey NOT BETWEEN 5 AND 10", "o_totalprice DESC"),
       "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND (o_totalprice > 400000 OR o_orderstatus IN ('P')) AND o_orderkey NOT BETWEEN 5 AND 10")
custom("find_value", lambda spark, sf_dir: tools.find_value(tpch(spark, sf_dir), "asia", tables=["region", "nation", "customer"]), "SELECT 'region' AS \"table\", 'r_name' AS \"column\", count(*) AS matches FROM region WHERE lower(r_name) LIKE '%asia%'")
custom("table_stats", lambda spark, sf_dir: tools.table_stats(tpch(spark, sf_dir), "customer").select("column", "rows", "nulls", "distinct", F.round("avg", 4).alias("avg"), "max_length"),
       "SELECT * FROM (SELECT 'c_custkey' AS \"column\", count(*) AS rows, 0 AS nulls, count(DISTINCT c_custkey) AS \"distinct\", round(avg(c_custkey), 4) AS avg, NULL::BIGINT AS max_length FROM customer UNION ALL SELECT 'c_name', count(*), 0, count(DISTINCT c_name), NULL, max(length(c_name)) FROM customer UNION ALL SELECT 'c_nationkey', count(*), 0, count(DISTINCT c_nationkey), round(avg(c_nationkey), 4), NULL FROM customer UNION ALL SELECT 'c_acctbal', count(*), 0, count(DISTINCT c_acctbal), round(avg(c_acctbal), 4), NULL FROM customer UNION ALL SELECT 'c_mktsegment', count(*), 0, count(DISTINCT c_mktsegment), NULL, max(length(c_mktsegment)) FROM customer)")
custom("top_values", lambda spark, sf_dir: tools.top_values(tpch(spark, sf_dir), "nation", 2).where("column = 'n_regionkey'").select("column", "value", "count"),
       "SELECT 'n_regionkey' AS \"column\", n_regionkey::VARCHAR AS value, count(*) AS count FROM nation GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 2")


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tpch(spark, sf_dir).tables["customer"]
    new = old.where("c_custkey % 10 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 4, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = new.union(old.where("c_custkey < 5").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return tools.data_diff(old, new, ["c_custkey"])


custom("data_diff", _diff, "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN c_custkey % 10 = 3 THEN '' ELSE 'c_acctbal' END AS columns FROM customer WHERE c_custkey % 10 IN (3, 4) UNION ALL SELECT c_custkey + 10000000, 'added', '' FROM customer WHERE c_custkey < 5")
custom("replace_value", lambda spark, sf_dir: tools.replace_value(tpch(spark, sf_dir), "orders", "o_orderstatus", "F", "FULL").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE o_orderstatus WHEN 'F' THEN 'FULL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
custom("rls_filter", lambda spark, sf_dir: api.evaluate_grouped(tpch(spark, sf_dir).role("asia", region='region[r_name] = "ASIA"'), {"n": "[Orders]"}, ["nation[n_name]"], role="asia"),
       f"SELECT n_name, count(*) AS n FROM {_OCN} JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
grouped("grouped_top_n", {"v": "ROUND([Revenue], 2)"}, ["part[p_brand]", "supplier[s_name]"], "SELECT p_brand, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", top_n=20, order_by="v")
custom("result_status", lambda spark, sf_dir: api.status(tpch(spark, sf_dir), {"a": "[Orders]", "b": "BLANK()", "c": "RUNNINGSUM([Orders])", "d": "SUM(orders[nothing])"}).select("name", "status", "data_type"),
       "SELECT * FROM (VALUES ('a', 'ok', 'Int64'), ('b', 'blank', 'Blank'), ('c', 'unsupported', NULL), ('d', 'error', NULL)) t(name, status, data_type)")
