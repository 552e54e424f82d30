"""Loads every function module, and says which catalog names are refused."""

from __future__ import annotations

from cubewright.functions import dates, distributions, finance, info, logic, maths, texts
from cubewright.functions.aggregates import AGGREGATES, ITERATORS
from cubewright.operators import filters, iterators, tables, timeintel, windows
from cubewright.plans.planner import REFUSED, SCALARS, SPECIAL, TABLES

MODULES = (dates, distributions, finance, info, logic, maths, texts, filters, iterators, tables, timeintel, windows)

#: Names that are read inside other calls.
MARKERS = ("ORDERBY", "PARTITIONBY", "MATCHBY", "IGNORE", "ROLLUP", "ROLLUPGROUP", "ISSUBTOTAL", "ROLLUPADDISSUBTOTAL", "ROLLUPISSUBTOTAL", "USERELATIONSHIP", "CROSSFILTER")

_WEEK = "needs a calendar object with weeks"
_VISUAL = "is for calculations inside a visual"
_GROUP = "needs a calculation group"
REFUSED |= dict.fromkeys(("CLOSINGBALANCEWEEK", "DATESWTD", "ENDOFWEEK", "NEXTWEEK", "OPENINGBALANCEWEEK", "PREVIOUSWEEK", "STARTOFWEEK", "TOTALWTD"), _WEEK)
REFUSED |= dict.fromkeys(("COLLAPSE", "COLLAPSEALL", "EXPAND", "EXPANDALL", "FIRST", "LAST", "NEXT", "PREVIOUS", "RANGE", "RUNNINGSUM", "MOVINGAVERAGE", "LOOKUP", "LOOKUPWITHTOTALS", "ISATLEVEL"), _VISUAL)
REFUSED |= dict.fromkeys(("ISSELECTEDMEASURE", "SELECTEDMEASURE", "SELECTEDMEASUREFORMATSTRING", "SELECTEDMEASURENAME"), _GROUP)
REFUSED |= dict.fromkeys(("EXTERNALMEASURE", "NATURALJOINUSAGE"), "is internal to other engines")
REFUSED |= dict.fromkeys(("INFO.DATACOVERAGEDEFINITIONS", "INFO.EXCLUDEDARTIFACTS", "INFO.USERDEFINEDFUNCTIONS"), "isn't kept by the model")


def function_names() -> list[str]:
    """Every function that can be called."""
    return sorted({*SCALARS, *SPECIAL, *TABLES, *AGGREGATES, *ITERATORS, *MARKERS})
