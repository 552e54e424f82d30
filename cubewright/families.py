"""Queries that take the function families one by one over whole columns of the star schema.

They are added to the registry of ``queries``. Where SQL lacks a function, arguments
are chosen for which the function has a closed form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cubewright import api
from cubewright.functions.info import KINDS
from cubewright.model import SemanticModel
from cubewright.queries import _OCN, _by_month, custom, grouped, scalar, table, tpch

# -- aggregations and their X-forms ----------------------------------------------------
grouped("agg_product_varp", {"p": "PRODUCT(lineitem[l_linenumber])", "v": "ROUND(VAR.P(lineitem[l_quantity]), 6)"}, ["lineitem[l_orderkey]"],
        "SELECT l_orderkey, product(l_linenumber) AS p, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
grouped("x_spread", {"c": "COUNTAX(lineitem, lineitem[l_linestatus])", "m": "ROUND(MEDIANX(lineitem, lineitem[l_quantity] * 2), 4)", "g": "ROUND(GEOMEANX(lineitem, lineitem[l_quantity]), 6)",
                     "ss": "ROUND(STDEVX.S(lineitem, lineitem[l_quantity]), 6)", "sp": "ROUND(STDEVX.P(lineitem, lineitem[l_quantity]), 6)", "vs": "ROUND(VARX.S(lineitem, lineitem[l_quantity]), 6)"}, ["lineitem[l_returnflag]"],
        """SELECT l_returnflag, count(l_linestatus) AS c, round(median(l_quantity * 2), 4) AS m, round(exp(avg(ln(l_quantity))), 6) AS g, round(stddev_samp(l_quantity), 6) AS ss,
        round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY 1""")  # fmt: skip
grouped("percentilex_exc", {"p": "ROUND(PERCENTILEX.EXC(orders, orders[o_totalprice] * 2, 0.75), 4)"}, ["orders[o_orderpriority]"],
        """WITH r AS (SELECT o_orderpriority, 2 * o_totalprice v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) i, count(*) OVER (PARTITION BY o_orderpriority) n FROM orders),
        k AS (SELECT *, 0.75 * (n + 1) AS pos FROM r)
        SELECT o_orderpriority, round(max(CASE WHEN i = floor(pos) THEN v END) + max(pos - floor(pos)) * (max(CASE WHEN i = floor(pos) + 1 THEN v END) - max(CASE WHEN i = floor(pos) THEN v END)), 4) AS p FROM k GROUP BY 1""")  # fmt: skip
grouped("lastnonblank", {"l": "LASTNONBLANK(part[p_brand], [Quantity])"}, ["part[p_type]"], "SELECT p_type, max(p_brand) AS l FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
scalar("xirr_all", {"r": "ROUND(XIRR(orders, IF(orders[o_orderdate] < DATE(1996, 1, 1), -orders[o_totalprice], 0.25 * orders[o_totalprice]), orders[o_orderdate]), 6)"},
       """WITH RECURSIVE f AS (SELECT o_orderdate::DATE d, sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN -o_totalprice ELSE 0.25 * o_totalprice END) v FROM orders GROUP BY 1),
       t AS (SELECT date_diff('day', min(d) OVER (), d) / 365.0 AS y, v FROM f),
       b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 10.0::DOUBLE UNION ALL
         SELECT i + 1, CASE WHEN n > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN n > 0 THEN hi ELSE (lo + hi) / 2 END
         FROM (SELECT i, lo, hi, sum(v / pow(1 + (lo + hi) / 2, y)) AS n FROM b, t WHERE i < 60 GROUP BY i, lo, hi))
       SELECT round(lo, 6) AS r FROM b WHERE i = 60""")  # fmt: skip

# -- filter context and rows -------------------------------------------------------------
scalar("all_kinds", {"a": "COUNTROWS(ALLNOBLANKROW(nation))", "b": "CALCULATE([Orders], ALLCROSSFILTERED(orders))", "t": "COUNTROWS(TABLEOF([Sales]))", "n": "COUNTROWS(NONVISUAL(VALUES(nation[n_name])))"},
       f"""SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM orders) AS b, (SELECT count(*) FROM {_OCN} JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS t,
       (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS n""", filters={"region.r_name": ["ASIA"]})  # fmt: skip
table("earliest", 'SELECTCOLUMNS(ADDCOLUMNS(nation, "c", COUNTROWS(FILTER(ALL(nation), nation[n_regionkey] = EARLIEST(nation[n_regionkey])))), "n", nation[n_name], "c", [c])',
      "SELECT n_name AS n, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation")
table("matchby", 'SELECTCOLUMNS(part, "k", part[p_partkey], "r", ROWNUMBER(part, ORDERBY(part[p_retailprice], DESC, part[p_partkey]), PARTITIONBY(part[p_brand]), MATCHBY(part[p_partkey])))',
      "SELECT p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part")
table("ignore_group", 'SUMMARIZECOLUMNS(nation[n_name], "n", [Orders], "one", IGNORE(1))', f"SELECT n_name, count(*) AS n, 1 AS one FROM {_OCN} GROUP BY 1")
table("rollupgroup", 'SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(ROLLUPGROUP(orders[o_orderstatus], orders[o_orderpriority]), "total"), "n", [Orders])',
      "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) = 1 AS total, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), ())")
_EVEN = "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () n FROM orders) SELECT o_orderkey AS k FROM r WHERE p IN (SELECT CAST(round_even(i * (n - 1) / 8.0, 0) AS BIGINT) FROM range(9) t(i), (SELECT max(n) n FROM r))"
table("sample_axis", 'SELECTCOLUMNS(SAMPLEAXISWITHLOCALMINMAX(9, orders, orders[o_totalprice], orders[o_orderkey]), "k", orders[o_orderkey])', _EVEN)
table("sample_cartesian", 'SELECTCOLUMNS(SAMPLECARTESIANPOINTSBYCOVER(9, orders, orders[o_orderkey], orders[o_totalprice]), "k", orders[o_orderkey])', _EVEN)

# -- types, session, errors ------------------------------------------------------------------
table("type_session_more", 'ROW("a", ISBOOLEAN(TRUE), "b", ISSTRING("x"), "c", ISNUMERIC(1.5), "d", ISINT64(3), "e", ISDECIMAL(CURRENCY(2)), "f", ISDOUBLE(1.5), "g", ISDOUBLE(1), "h", IF.EAGER(1 > 2, "y", "n"), "i", EVALUATEANDLOG(6 * 7), "j", NAMEOF(orders[o_orderkey]), "k", IFERROR(ERROR("no"), "caught"), "l", USERNAME() & "u", "m", USERPRINCIPALNAME() & "p", "n", ISBLANK(CUSTOMDATA()), "o", USERCULTURE(), "p", LEN(USEROBJECTID()) > 0)',
      "SELECT TRUE AS a, TRUE AS b, TRUE AS c, TRUE AS d, TRUE AS e, TRUE AS f, FALSE AS g, 'n' AS h, 42 AS i, '''orders''[o_orderkey]' AS j, 'caught' AS k, 'u' AS l, 'p' AS m, TRUE AS n, 'en-US' AS o, TRUE AS p")
table("or_precedence", 'SELECTCOLUMNS(orders, "k", orders[o_orderkey], "a", orders[o_orderstatus] = "F" || orders[o_orderstatus] = "O" && orders[o_totalprice] > 200000, "b", -2 ^ 2 + 3 * 4 & "x") // the comment ends here',
      "SELECT o_orderkey AS k, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 200000) AS a, '8x' AS b FROM orders")

# -- maths --------------------------------------------------------------------------------------
_PART = 'SELECTCOLUMNS(part, "k", part[p_partkey], '
table("math_more", _PART + '"a", ISO.CEILING(part[p_retailprice], 10), "b", ROUND(SQRTPI(part[p_size]), 8), "c", ROUND(EXP(part[p_size] / 25), 8), "d", ROUND(LOG10(part[p_size]), 8), "e", ODD(part[p_size]), "f", LCM(part[p_size], 12), "g", COMBIN(part[p_size] + 5, 3), "h", COMBINA(part[p_size], 2), "i", PERMUT(part[p_size] + 5, 2), "j", ROUND(PI(), 10), "l", ROUND(RADIANS(part[p_size]), 10))',
      """SELECT p_partkey AS k, ceil(p_retailprice / 10) * 10 AS a, round(sqrt(p_size * pi()), 8) AS b, round(exp(p_size / 25.0), 8) AS c, round(log10(p_size), 8) AS d, p_size + 1 - p_size % 2 AS e, lcm(p_size, 12)::DOUBLE AS f,
      ((p_size + 5) * (p_size + 4) * (p_size + 3) / 6)::DOUBLE AS g, (p_size * (p_size + 1) / 2)::DOUBLE AS h, ((p_size + 5) * (p_size + 4))::DOUBLE AS i, round(pi(), 10) AS j, round(radians(p_size), 10) AS l FROM part""")  # fmt: skip
table("trig_more", _PART + '"a", ROUND(TAN(part[p_size]), 6), "b", ROUND(ACOS(part[p_size] / 100), 8), "c", ROUND(ACOT(part[p_size]), 8), "d", ROUND(SINH(part[p_size] / 25), 8), "e", ROUND(COSH(part[p_size] / 25), 8), "f", ROUND(COTH(part[p_size] / 25), 8), "g", ROUND(ASINH(part[p_size]), 8), "h", ROUND(ACOSH(part[p_size]), 8), "i", ROUND(ATANH(part[p_size] / 100), 8), "j", ROUND(ACOTH(part[p_size] + 1), 8))',
      """SELECT p_partkey AS k, round(tan(p_size), 6) AS a, round(acos(p_size / 100.0), 8) AS b, round(pi() / 2 - atan(p_size), 8) AS c, round((exp(p_size / 25.0) - exp(-p_size / 25.0)) / 2, 8) AS d, round((exp(p_size / 25.0) + exp(-p_size / 25.0)) / 2, 8) AS e,
      round((exp(p_size / 12.5) + 1) / (exp(p_size / 12.5) - 1), 8) AS f, round(ln(p_size + sqrt(p_size * p_size + 1)), 8) AS g, round(ln(p_size + sqrt(p_size * p_size - 1)), 8) AS h, round(ln((1 + p_size / 100.0) / (1 - p_size / 100.0)) / 2, 8) AS i,
      round(ln((p_size + 2) / p_size::DOUBLE) / 2, 8) AS j FROM part""")  # fmt: skip
table("random_bounds", _PART + '"a", RAND() >= 0 && RAND() < 1, "b", RANDBETWEEN(3, 5) >= 3 && RANDBETWEEN(3, 5) <= 5)', "SELECT p_partkey AS k, TRUE AS a, TRUE AS b FROM part")

# -- distributions, by arguments that have closed forms ----------------------------------------------
table("dist_closed_forms", _PART + '"a", ROUND(CHISQ.DIST(part[p_size] / 10, 2, TRUE), 6), "b", ROUND(CHISQ.DIST.RT(part[p_size] / 10, 2), 6), "c", ROUND(CHISQ.INV(part[p_size] / 51, 2), 6), "d", ROUND(T.DIST(part[p_size] / 10, 1, TRUE), 6), "e", ROUND(T.DIST.RT(part[p_size] / 10, 1), 6), "f", ROUND(T.INV.2T(part[p_size] / 51, 1), 5), "g", ROUND(BETA.DIST(part[p_size] / 51, 1, 3, TRUE), 6), "h", ROUND(NORM.DIST(part[p_size], 25, 10, FALSE), 8), "i", ROUND(NORM.S.INV(NORM.S.DIST(part[p_size] / 25 - 1, TRUE)), 6), "j", ROUND(CONFIDENCE.T(part[p_size] / 51, 3, 2), 5), "l", ROUND(NORM.DIST(part[p_size], 25, 10, TRUE) + NORM.DIST(50 - part[p_size], 25, 10, TRUE), 8))',
      """SELECT p_partkey AS k, round(1 - exp(-p_size / 20.0), 6) AS a, round(exp(-p_size / 20.0), 6) AS b, round(-2 * ln(1 - p_size / 51.0), 6) AS c, round(0.5 + atan(p_size / 10.0) / pi(), 6) AS d, round(0.5 - atan(p_size / 10.0) / pi(), 6) AS e,
      round(tan(pi() * (1 - p_size / 51.0) / 2), 5) AS f, round(1 - pow(1 - p_size / 51.0, 3), 6) AS g, round(exp(-pow((p_size - 25) / 10.0, 2) / 2) / (10 * sqrt(2 * pi())), 8) AS h, round(p_size / 25.0 - 1, 6) AS i,
      round(tan(pi() * (1 - p_size / 51.0) / 2) * 3 / sqrt(2), 5) AS j, 1.0::DOUBLE AS l FROM part""")  # fmt: skip

# -- text, dates -----------------------------------------------------------------------------------------
table("text_more", _PART + '"a", CONCATENATE(LEFT(part[p_name], 2), "-"), "b", COMBINEVALUES("|", part[p_type], part[p_brand]), "c", LOWER(part[p_brand]), "d", PROPER(part[p_name]), "e", SEARCH("D", part[p_name], 1, -1), "f", CONTAINSSTRINGEXACT(part[p_brand], "brand"))',
      """SELECT p_partkey AS k, left(p_name, 2) || '-' AS a, p_type || '|' || p_brand AS b, lower(p_brand) AS c, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS d,
      CASE WHEN contains(p_name, 'd') THEN instr(p_name, 'd') ELSE -1 END AS e, contains(p_brand, 'brand') AS f FROM part""")  # fmt: skip
table("date_more", 'ROW("a", FORMAT(TIME(12, 30, 15), "hh:nn:ss"), "b", DATEVALUE("2024-03-05"), "c", FORMAT(TIMEVALUE("18:05:00"), "hh:nn:ss"), "d", NOW() >= TODAY(), "e", UTCNOW() >= UTCTODAY(), "f", TODAY() > DATE(2020, 1, 1))',
      "SELECT '12:30:15' AS a, TIMESTAMP '2024-03-05' AS b, '18:05:00' AS c, TRUE AS d, TRUE AS e, TRUE AS f")

# -- time intelligence -------------------------------------------------------------------------------------
_QUARTER = "date_trunc('quarter', m)"
_by_month("datesqtd", "CALCULATE([Sales], DATESQTD(calendar[Date]))", f"o.d >= {_QUARTER} AND o.d <= e")
_by_month("datesmtd", "CALCULATE([Sales], DATESMTD(calendar[Date]))", "o.d >= m AND o.d <= e")
_by_month("previousquarter", "CALCULATE([Sales], PREVIOUSQUARTER(calendar[Date]))", f"o.d >= {_QUARTER} - INTERVAL 3 MONTH AND o.d < {_QUARTER}")
_by_month("nextmonth", "CALCULATE([Sales], NEXTMONTH(calendar[Date]))", "o.d > e AND o.d < m + INTERVAL 2 MONTH")
_by_month("nextyear", "CALCULATE([Sales], NEXTYEAR(calendar[Date]))", "year(o.d) = year(m) + 1")
_by_month("startofmonth_endofmonth", "CALCULATE([Sales], STARTOFMONTH(calendar[Date])) + CALCULATE([Sales], ENDOFMONTH(calendar[Date]))", "o.d = m OR o.d = e")
_by_month("startofyear_endofquarter", "CALCULATE([Sales], STARTOFYEAR(calendar[Date])) + CALCULATE([Sales], ENDOFQUARTER(calendar[Date]))", f"o.d = date_trunc('year', m) OR o.d = last_day({_QUARTER} + INTERVAL 2 MONTH)")
_by_month("openingbalancemonth", "OPENINGBALANCEMONTH([Sales], calendar[Date])", "o.d = m - INTERVAL 1 DAY")
_by_month("openingbalanceyear", "OPENINGBALANCEYEAR([Sales], calendar[Date])", "o.d = date_trunc('year', m) - INTERVAL 1 DAY")
_by_month("closingbalancequarter", "CLOSINGBALANCEQUARTER([Sales], calendar[Date])", f"o.d = last_day({_QUARTER} + INTERVAL 2 MONTH)")

# -- finance ---------------------------------------------------------------------------------------------------
_PMT = "(-p_retailprice * 0.01 / (1 - pow(1.01, -(p_size + 12))))"
table("finance_loans", _PART + '"a", ROUND(NPER(0.01, -50, part[p_retailprice]), 6), "b", ROUND(RATE(12, -100, 100 * (1 - POWER(1 + part[p_size] / 1000, -12)) / (part[p_size] / 1000)), 8), "c", ROUND(IPMT(0.01, 2, part[p_size] + 12, part[p_retailprice]), 6), "d", ROUND(PPMT(0.01, 1, part[p_size] + 12, part[p_retailprice]), 6), "e", ROUND(CUMIPMT(0.01, part[p_size] + 12, part[p_retailprice], 1, 2, 0), 6), "f", ROUND(CUMPRINC(0.01, part[p_size] + 12, part[p_retailprice], 1, 1, 0), 6), "g", ROUND(ISPMT(0.01, 1, part[p_size] + 12, part[p_retailprice]), 6), "h", ROUND(NOMINAL(part[p_size] / 100, 12), 8), "i", ROUND(PDURATION(0.025, part[p_retailprice], 2 * part[p_retailprice]), 6), "j", ROUND(DOLLARDE(part[p_size] + 0.02, 16), 6), "l", ROUND(DOLLARFR(part[p_size] + 0.125, 16), 6))',
      f"""SELECT p_partkey AS k, round(ln(50 / (50 - p_retailprice * 0.01)) / ln(1.01), 6) AS a, round(p_size / 1000.0, 8) AS b, round(-(p_retailprice * 1.01 + {_PMT}) * 0.01, 6) AS c, round({_PMT} + p_retailprice * 0.01, 6) AS d,
      round(-p_retailprice * 0.01 - (p_retailprice * 1.01 + {_PMT}) * 0.01, 6) AS e, round({_PMT} + p_retailprice * 0.01, 6) AS f, round(p_retailprice * 0.01 * (1.0 / (p_size + 12) - 1), 6) AS g, round(12 * (pow(1 + p_size / 100.0, 1 / 12.0) - 1), 8) AS h,
      round(ln(2) / ln(1.025), 6) AS i, round(p_size + 2 / 16.0, 6) AS j, round(p_size + 0.02, 6) AS l FROM part""")  # fmt: skip
_S, _M, _I = "DATE(2008, 2, 15)", "DATE(2008, 5, 15)", "DATE(2007, 11, 15)"
table("finance_discount", _PART + f'"a", ROUND(DISC({_S}, {_M}, 90 + part[p_size] / 10, 100, 0), 8), "b", ROUND(INTRATE({_S}, {_M}, part[p_retailprice], part[p_retailprice] + part[p_size], 0), 8), "c", ROUND(RECEIVED({_S}, {_M}, part[p_retailprice], part[p_size] / 1000, 0), 6), "d", ROUND(PRICEDISC({_S}, {_M}, part[p_size] / 1000, 100, 0), 6), "e", ROUND(YIELDDISC({_S}, {_M}, 90 + part[p_size] / 10, 100, 0), 8), "f", ROUND(ACCRINTM({_S}, {_M}, part[p_size] / 1000, 1000, 0), 6), "g", ROUND(ACCRINT(DATE(2008, 3, 1), DATE(2008, 8, 31), DATE(2008, 5, 1), part[p_size] / 1000, 1000, 2, 0), 6), "h", ROUND(PRICEMAT({_S}, {_M}, {_I}, 0.06, part[p_size] / 1000, 0), 6), "i", ROUND(YIELDMAT({_S}, {_M}, {_I}, 0.06, 90 + part[p_size] / 10, 0), 8), "j", ROUND(TBILLEQ(DATE(2008, 3, 31), DATE(2008, 6, 1), part[p_size] / 1000), 8), "l", ROUND(TBILLYIELD(DATE(2008, 3, 31), DATE(2008, 6, 1), 90 + part[p_size] / 10), 8))',
      """SELECT p_partkey AS k, round((10 - p_size / 10.0) / 100 * 4, 8) AS a, round(p_size / p_retailprice * 4, 8) AS b, round(p_retailprice / (1 - p_size / 4000.0), 6) AS c, round(100 - p_size / 40.0, 6) AS d,
      round((10 - p_size / 10.0) / (90 + p_size / 10.0) * 4, 8) AS e, round(p_size / 4.0, 6) AS f, round(p_size / 6.0, 6) AS g, round((100 + 0.5 * 6) / (1 + p_size / 4000.0) - 0.25 * 6, 6) AS h,
      round(((1 + 0.5 * 0.06) / ((90 + p_size / 10.0) / 100 + 0.25 * 0.06) - 1) * 4, 8) AS i, round(365 * (p_size / 1000.0) / (360 - p_size / 1000.0 * 62), 8) AS j, round((10 - p_size / 10.0) / (90 + p_size / 10.0) * 360 / 62, 8) AS l FROM part""")  # fmt: skip
table("finance_coupons", 'ROW("a", COUPDAYBS(DATE(2011, 1, 25), DATE(2011, 11, 15), 2, 1), "b", COUPDAYS(DATE(2011, 1, 25), DATE(2011, 11, 15), 2, 1), "c", COUPDAYSNC(DATE(2011, 1, 25), DATE(2011, 11, 15), 2, 1), "d", FORMAT(COUPNCD(DATE(2011, 1, 25), DATE(2011, 11, 15), 2, 1), "yyyy-mm-dd"), "e", FORMAT(COUPPCD(DATE(2011, 1, 25), DATE(2011, 11, 15), 2, 1), "yyyy-mm-dd"), "f", ROUND(MDURATION(DATE(2008, 1, 1), DATE(2016, 1, 1), 0.08, 0.09, 2, 1), 5))',
      "SELECT 71.0::DOUBLE AS a, 181.0::DOUBLE AS b, 110.0::DOUBLE AS c, '2011-05-15' AS d, '2010-11-15' AS e, 5.73567::DOUBLE AS f")
table("finance_odd_periods", 'ROW("a", ROUND(ODDFYIELD(DATE(2008, 11, 11), DATE(2021, 3, 1), DATE(2008, 10, 15), DATE(2009, 3, 1), 0.0575, 84.5, 100, 2, 0), 6), "b", ROUND(ODDLPRICE(DATE(2008, 2, 7), DATE(2008, 6, 15), DATE(2007, 10, 15), 0.0375, 0.0405, 100, 2, 0), 6), "c", ROUND(ODDLYIELD(DATE(2008, 4, 20), DATE(2008, 6, 15), DATE(2007, 12, 24), 0.0375, 99.875, 100, 2, 0), 6), "d", AMORDEGRC(2400, DATE(2008, 8, 19), DATE(2008, 12, 31), 300, 1, 0.15, 1), "e", AMORLINC(2400, DATE(2008, 8, 19), DATE(2008, 12, 31), 300, 1, 0.15, 1))',
      "SELECT 0.077246::DOUBLE AS a, 99.878286::DOUBLE AS b, 0.045192::DOUBLE AS c, 776.0::DOUBLE AS d, 360.0::DOUBLE AS e")

# -- catalog ------------------------------------------------------------------------------------------------------
#: The model: 9 tables, 4 measures, 9 relationships (7 active); the calendar's 5 columns are no table's of the star schema.
_COLUMNS = "(SELECT " + " + ".join(f"(SELECT count(*) FROM (DESCRIBE {t}))" for t in "region nation customer supplier part orders lineitem events".split()) + " + 5)"
_HIERARCHIES = f"({_COLUMNS} + 9 + {_COLUMNS})"
_SIZES = {
    "tables": "9", "columns": f"{_COLUMNS} + 9", "measures": "4", "relationships": "9", "rel_storage": "9", "partitions": "9", "one": "1", "storage_tables": f"9 + {_COLUMNS} + 9", "storage_folders": f"9 + {_COLUMNS} + 9",
    "column_storages": f"{_COLUMNS} + 9 + 2 * {_COLUMNS} + 9", "segments": f"{_COLUMNS} + 9 + 2 * {_COLUMNS} + 9", "annotations": f"{_COLUMNS} + 4", "properties": "6", "storage_files": f"2 * ({_COLUMNS} + 9 + 2 * {_COLUMNS} + 9) + 9",
}
_COUNTED = {name: _SIZES[kind] for name, kind in KINDS.items() if kind in _SIZES}
_NAMED = {name: name.lower().replace(".", "_") for name in KINDS}
scalar("info_counts", {_NAMED[name]: f"COUNTROWS({name}())" for name in _COUNTED}, "SELECT " + ", ".join(f"{n} AS {_NAMED[name]}" for name, n in _COUNTED.items()))
_NONE = [name for name, kind in KINDS.items() if kind in ("empty", "roles", "permissions")]
scalar("info_without_content", {_NAMED[name]: f"COUNTROWS({name}()) + 0" for name in _NONE}, "SELECT " + ", ".join(f"0 AS {_NAMED[name]}" for name in _NONE))
table("info_names", 'UNION(SELECTCOLUMNS(INFO.VIEW.TABLES(), "k", "table", "n", [Name]), SELECTCOLUMNS(INFO.VIEW.MEASURES(), "k", "measure", "n", [Name]), SELECTCOLUMNS(FILTER(INFO.VIEW.COLUMNS(), [Table] = "region" && [Name] <> "RowNumber"), "k", "column", "n", [Name]), SELECTCOLUMNS(FILTER(INFO.FUNCTIONS(), [FUNCTION_NAME] IN {"SUMX", "XIRR"}), "k", "function", "n", [FUNCTION_NAME]))',
      "SELECT * FROM (VALUES ('table', 'region'), ('table', 'nation'), ('table', 'customer'), ('table', 'supplier'), ('table', 'part'), ('table', 'orders'), ('table', 'lineitem'), ('table', 'events'), ('table', 'calendar'), ('measure', 'Revenue'), ('measure', 'Sales'), ('measure', 'Orders'), ('measure', 'Quantity'), ('column', 'r_regionkey'), ('column', 'r_name'), ('function', 'SUMX'), ('function', 'XIRR')) t(k, n)")
_USES = "SELECT * FROM (VALUES ('Revenue', 'lineitem', 'lineitem'), ('Revenue', 'lineitem', 'l_extendedprice'), ('Revenue', 'lineitem', 'l_discount'), ('Sales', 'orders', 'o_totalprice'), ('Orders', 'orders', 'orders'), ('Quantity', 'lineitem', 'l_quantity')) t(o, t, r)"
table("info_dependencies", 'SELECTCOLUMNS(FILTER(INFO.DEPENDENCIES(), [OBJECT_TYPE] = "MEASURE"), "o", [OBJECT], "t", [REFERENCED_TABLE], "r", [REFERENCED_OBJECT])', _USES)
table("info_calcdependency", 'SELECTCOLUMNS(FILTER(INFO.CALCDEPENDENCY(), [OBJECT_TYPE] = "MEASURE"), "o", [OBJECT], "t", [REFERENCED_TABLE], "r", [REFERENCED_OBJECT])', _USES)


def _with_roles(spark: SparkSession, sf_dir: str) -> SemanticModel:
    return tpch(spark, sf_dir).role("asia", region='region[r_name] = "ASIA"').role("small", part="part[p_size] < 5", orders="orders[o_totalprice] < 1000")


custom("info_roles", lambda spark, sf_dir: api.table_expression(_with_roles(spark, sf_dir), 'UNION(SELECTCOLUMNS(INFO.ROLES(), "r", [Name], "t", "", "e", ""), SELECTCOLUMNS(INFO.TABLEPERMISSIONS(), "r", [Role], "t", [Table], "e", [FilterExpression]))'),
       """SELECT * FROM (VALUES ('asia', '', ''), ('small', '', ''), ('asia', 'region', 'region[r_name] = "ASIA"'), ('small', 'part', 'part[p_size] < 5'), ('small', 'orders', 'orders[o_totalprice] < 1000')) t(r, t, e)""")  # fmt: skip
