"""Query registry: name -> (Spark callable(spark, sf_dir), oracle SQL or None).

Every query reads the given tables (or frames Spark derives from them) in
full.  ``None`` as oracle marks iterative or library-convention outputs that
SQL cannot express; those are checked by tests against brute force instead.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures as FX
from . import oracle as O
from .univariate import univariate_report, univariate_sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# --- Entry A: univariate studies ------------------------------------------------------

@register("univariate_price_on_quantity",
          univariate_sql("", "lineitem", "l_quantity", "l_extendedprice / 1000.0", FX.LINEITEM_KEY))
def q_uni_qty(spark, sf):
    return univariate_report(FX.lineitem_xy(spark, sf), "l_quantity", "price", FX.LINEITEM_KEY)


@register("univariate_price_on_discount",
          univariate_sql("", "lineitem", "l_discount", "l_extendedprice / 1000.0", FX.LINEITEM_KEY))
def q_uni_disc(spark, sf):
    return univariate_report(FX.lineitem_xy(spark, sf), "l_discount", "price", FX.LINEITEM_KEY)


@register("univariate_value_on_risk", univariate_sql(O.LANDING, "landing", "risk", "time_to_food", ["key"]))
def q_uni_risk(spark, sf):
    return univariate_report(FX.landings(spark, sf), "risk", "time_to_food", ["key"])


@register("univariate_landings_on_arrivals",
          univariate_sql(O.OBSERVATION, "observation", "arrival_number", "landing_number", ["time"]))
def q_uni_arrivals(spark, sf):
    return univariate_report(FX.observations(spark, sf), "arrival_number", "landing_number", ["time"])


@register("univariate_food_on_arrivals",
          univariate_sql(O.OBSERVATION, "observation", "arrival_number", "food_availability", ["time"]))
def q_uni_food(spark, sf):
    return univariate_report(FX.observations(spark, sf), "arrival_number", "food_availability", ["time"])


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# query modules register themselves on import (kept last: they import ``register``)
from . import prep_queries  # noqa: E402,F401
from . import model_queries  # noqa: E402,F401
from . import diag_queries  # noqa: E402,F401
from . import report_queries  # noqa: E402,F401
