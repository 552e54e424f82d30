"""Small models with values that can be worked out by hand."""

import datetime as dt

from cubewright.model import SemanticModel


def workshop(spark) -> SemanticModel:
    """Tools for hire: 80 in fees (saw 30, drill 20, press 30, the lathe never hired); readings with blanks; who answers to whom."""
    day = lambda m, d: dt.datetime(2023, m, d)
    m = SemanticModel(spark)
    m.add_table("Tool", spark.createDataFrame([(10, "saw"), (20, "drill"), (30, "drill"), (40, "press"), (50, "lathe")], "k long, kind string"))
    m.add_table("Hire", spark.createDataFrame([(10, 12.0, day(3, 3)), (20, 7.0, day(3, 3)), (20, 9.0, day(4, 20)), (30, 4.0, day(5, 1)), (40, 30.0, day(5, 9)), (10, 18.0, day(6, 30))], "tool long, fee double, day timestamp_ntz"))
    m.add_table("Day", spark.createDataFrame([(day(*x), x[0]) for x in ((3, 3), (4, 20), (5, 1), (5, 9), (6, 30))], "Date timestamp_ntz, M long"), date_column="Date")
    m.add_table("Reading", spark.createDataFrame([(4.0, 2, True, "oak"), (1.0, 4, True, "Elm"), (None, 6, False, "ash"), (2.0, 8, False, "Fir"), (8.0, 10, True, None)], "level double, n long, good boolean, tag string"))
    m.add_table("Staff", spark.createDataFrame([(7, None), (3, 7), (9, 3), (4, 9)], "id long, boss long"))
    m.relate("Hire[tool]", "Tool[k]").relate("Hire[day]", "Day[Date]")
    return m.measure("Fees", "SUM(Hire[fee])", "Hire")


def crops(spark) -> SemanticModel:
    """Four fields on two sides of a road: 20 tons in all."""
    m = SemanticModel(spark)
    return m.add_table("Crop", spark.createDataFrame([("p", "east", 3), ("q", "west", 1), ("r", "west", 10), ("s", "east", 6)], "field string, side string, t long")).measure("Tons", "SUM(Crop[t])")
