"""Mapping of the driver's test tables onto the inputs of the analysis (FIXTURES.md).

Fixture A: ``landings`` (one row per event) and ``observations`` (one row per
30-minute bucket).  Fixture B: one row per order with per-order lineitem
aggregates.  Fixture C: lineitem for the univariate study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from .tables import read_table

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("key"),
        F.col("ts").alias("start_time"),
        X.date_string("ts").alias("date"),
        X.nan_to_null("value").alias("time_to_food"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("risk"),
        F.pmod(F.col("user_id"), F.lit(2)).cast("int").alias("reward"),
        F.pmod(F.minute("ts"), F.lit(C.BUCKET_MINUTES)).cast("double").alias("min_after_arrival"),
        F.month("ts").alias("month"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three kinds counted per 30-minute bucket (partial + final hash
    aggregate; the output has one row per bucket, bounded by the time span)."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    et = F.col("event_type")
    return (
        ev.where(et.isin("error", "purchase", "signup"))
        .withColumn("time", X.floor_to_minutes("ts"))
        .groupBy("time")
        .agg(
            F.count_if(et == "error").alias("arrival_number"),
            F.count_if(et == "signup").alias("landing_number"),
            F.least(F.count_if(et == "purchase"), F.lit(4)).cast("double").alias("food_availability"),
            F.sum(F.when(et == "error", X.nan_to_null("value"))).alias("arrival_minutes"),
        )
        .select("time", X.date_string("time").alias("date"), "arrival_number", "landing_number",
                "food_availability", "arrival_minutes", F.month("time").alias("month"))
    )


#: Fixture D: a night has this many minutes of observation; rows are dealt over them by key.
NIGHT_MINUTES = 240


def _night(day: str, minute) -> "F.Column":
    return F.col(day) + F.make_dt_interval(mins=minute.cast("int"))


def order_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D: orders as landings, over all months."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    minute = F.pmod(F.col("o_orderkey") * 7, F.lit(NIGHT_MINUTES))
    return o.select(
        F.col("o_orderkey").alias("key"),
        _night("o_orderdate", minute).alias("start_time"),
        X.date_string("o_orderdate").alias("date"),
        (X.nan_to_null("o_totalprice") / 1000.0).alias("time_to_food"),
        F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("risk"),
        F.pmod(F.col("o_custkey"), F.lit(2)).cast("int").alias("reward"),
        F.pmod(F.col("o_orderkey") * 13, F.lit(97)).cast("double").alias("min_after_arrival"),
        minute.cast("double").alias("min_after_sunset"),
        F.month("o_orderdate").alias("month"),
    )


def shipment_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D: lineitem rows counted per 30-minute bucket (one row per bucket)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity"])
    kind = F.col("l_returnflag")
    minute = F.pmod(F.col("l_partkey") * 3 + F.col("l_suppkey"), F.lit(NIGHT_MINUTES))
    return (
        li.withColumn("at", _night("l_shipdate", minute)).withColumn("time", X.floor_to_minutes("at"))
        .groupBy("time")
        .agg(
            F.count_if(kind == "R").alias("arrival_number"),
            F.count_if(kind == "A").alias("landing_number"),
            F.least(F.count_if(kind == "N"), F.lit(4)).cast("double").alias("food_availability"),
            F.sum(F.when(kind == "R", X.nan_to_null("l_quantity"))).alias("arrival_minutes"),
        )
        .select("time", X.date_string("time").alias("date"), "arrival_number", "landing_number",
                "food_availability", "arrival_minutes", F.month("time").alias("month"))
    )


def order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B. lineitem is aggregated per order *before* the join (partial
    aggregation map-side, so a hot order key never reaches one task whole);
    the join is then 1:1 on the order key."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_discount", "l_tax"])
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_quantity").alias("avg_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.avg("l_tax").alias("avg_tax"),
    )
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    season = X.season_of(F.month("o_orderdate"))
    # 1:1 join of two order-sized tables: sort-merge on the order key (the
    # aggregate is already hash-partitioned on it, so only orders moves; the
    # sort spills under memory pressure); never a broadcast of an input-sized side
    joined = o.join(per_order.hint("merge"), o.o_orderkey == per_order.l_orderkey, "left")
    return joined.select(
        F.col("o_orderkey").alias("key"),
        (F.col("o_totalprice") / 1000.0).alias("target"),
        F.col("n_lines").cast("double").alias("n_lines"),
        "avg_qty", "avg_disc", "avg_tax",
        X.as_flag(F.col("o_orderpriority").startswith("1")).alias("urgent"),
        season.alias("season"),
        F.when(season == "Winter", F.lit("winter")).otherwise(F.lit("not_winter")).alias("atom"),
    )


def lineitem_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C: price (in thousands) with quantity and discount; 4-part row key."""
    li = read_table(spark, sf_dir, "lineitem", LINEITEM_KEY + ["l_quantity", "l_extendedprice", "l_discount"])
    return li.select(*LINEITEM_KEY, "l_quantity", "l_discount",
                     (F.col("l_extendedprice") / 1000.0).alias("price"))
