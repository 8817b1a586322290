
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import features as FE
from ..session import ensure_checkpoint_dir, materialize
from ..sources import fixtures as FX
from ..sources import tables as S
from . import oracle as O
from . import prepare as P
from .registry import register


def ts_text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def _r(c: str):
    return X.rounded(c).alias(c)


def _b(c: str):
    return F.col(c).cast("bigint").alias(c)


def _d(c: str):
    """Counts that can be null on the right side of an outer join leave as doubles:
    a nullable integer column has no single representation across engines."""
    return F.col(c).cast("double").alias(c)


# --- SRC1-3 ------------------------------------------------------------------------------

LANDING_COLS = ["key", "start_time", "date", "time_to_food", "risk", "reward", "min_after_arrival", "month"]


def landing_out(df):
    return df.select(_b("key"), ts_text("start_time").alias("start_time"), "date", _r("time_to_food"),
                     _b("risk"), _b("reward"), _r("min_after_arrival"), _b("month"))


LANDING_OUT_SQL = (f"SELECT CAST(key AS BIGINT) AS key, {O.ts_text('start_time')} AS start_time, date, "
                   f"{O.r('time_to_food')} AS time_to_food, CAST(risk AS BIGINT) AS risk, "
                   f"CAST(reward AS BIGINT) AS reward, {O.r('min_after_arrival')} AS min_after_arrival, "
                   f"CAST(month AS BIGINT) AS month FROM landing")


@register("profile_landings", O.profile_sql(O.LANDING, "landing", LANDING_COLS))
def q_profile_landings(spark, sf):
    """SRC2."""
    return S.profile(FX.landings(spark, sf))


@register("preview_landings", f"WITH {O.LANDING}\n{LANDING_OUT_SQL} ORDER BY key LIMIT 5")
def q_preview_landings(spark, sf):
    """SRC3: first five rows in key order."""
    return landing_out(S.preview(FX.landings(spark, sf), ["key"], 5))


def _folder(spark, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


@register("csv_roundtrip_scan", f"WITH {O.LANDING}\n{LANDING_OUT_SQL}")
def q_csv_roundtrip(spark, sf):
    """SRC1, DAT1: landings written as CSV and scanned back with inferred types; the text
    timestamps are parsed."""
    folder = _folder(spark, "csv")
    S.write_csv(FX.landings(spark, sf), folder)
    back = S.read_csv(spark, folder)
    return landing_out(back.withColumn("start_time", X.parse_timestamp("start_time")))


LANDING_SCHEMA = ("key bigint, start_time timestamp_ntz, date string, time_to_food double, risk bigint, "
                  "reward bigint, min_after_arrival double, month bigint")


@register("csv_rejects", f"""WITH {O.LANDING}
SELECT key, column_name, value, reason FROM (
  SELECT CAST(key AS VARCHAR) AS key, 'start_time' AS column_name, 'day ' || date AS value, 'not a timestamp_ntz' AS reason
  FROM landing WHERE key % 89 = 0 AND key % 97 <> 1
  UNION ALL SELECT CAST(key AS VARCHAR), 'risk', 'n/a', 'not a bigint' FROM landing WHERE key % 83 = 2 AND key % 97 <> 1
  UNION ALL SELECT CAST(key AS VARCHAR), NULL, key || ',' || date, 'wrong number of fields' FROM landing WHERE key % 97 = 1)""")
def q_csv_rejects(spark, sf):
    """SRC1: the reject table of a damaged copy of the landings (words for timestamps and
    numbers, lines cut short)."""
    key = F.col("key")
    damaged = FX.landings(spark, sf).select(
        key, F.when(key % 89 == 0, F.concat(F.lit("day "), "date")).otherwise(F.col("start_time").cast("string")).alias("start_time"), "date",
        F.col("time_to_food").cast("string").alias("time_to_food"), F.when(key % 83 == 2, "n/a").otherwise(F.col("risk").cast("string")).alias("risk"),
        "reward", F.col("min_after_arrival").cast("string").alias("min_after_arrival"), "month")
    # concat_ws leaves nulls out, which would cut the line short
    whole = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in damaged.columns])
    folder = _folder(spark, "damaged")
    damaged.select(F.when(key % 97 == 1, F.concat_ws(",", "key", "date")).otherwise(whole).alias("line")).write.text(folder)
    found = S.csv_rejects(spark, folder, LANDING_SCHEMA, header=False)
    return found.select(F.col("fields")["key"].alias("key"), "column_name", "value", "reason")


# --- JON1 / JON2 -----------------------------------------------------------------------------

@register("bucket_join", f"""WITH {O.LANDING},\n{O.OBSERVATION},\n{O.joined_sql()}
SELECT CAST(key AS BIGINT) AS key, date, {O.ts_text('start_time_interval')} AS start_bucket,
       {O.ts_text('time_interval')} AS obs_bucket, CAST(arrival_number AS DOUBLE) AS arrival_number,
       CAST(landing_number AS DOUBLE) AS landing_number,
       {O.r('food_availability')} AS food_availability, {O.r('arrival_minutes')} AS arrival_minutes,
       CAST(month_x AS BIGINT) AS month_x, CAST(month_y AS DOUBLE) AS month_y, CAST(bucket_count AS DOUBLE) AS bucket_count
FROM joined""")
def q_bucket_join(spark, sf):
    j = P.joined_a(spark, sf)
    return j.select(_b("key"), "date", ts_text("start_time_interval").alias("start_bucket"),
                    ts_text("time_interval").alias("obs_bucket"), _d("arrival_number"), _d("landing_number"),
                    _r("food_availability"), _r("arrival_minutes"), _b("month_x"), _d("month_y"),
                    _d("bucket_count"))


_NULL_SAFE_JOINED = O.joined_sql().replace(
    "ON lb.date = ob.date AND lb.start_time_interval = ob.time_interval",
    "ON lb.date IS NOT DISTINCT FROM ob.date AND lb.start_time_interval IS NOT DISTINCT FROM ob.time_interval")


@register("bucket_join_null_safe", f"""WITH {O.LANDING},\n{O.OBSERVATION},\n{_NULL_SAFE_JOINED}
SELECT CAST(key AS BIGINT) AS key, date, {O.ts_text('start_time_interval')} AS start_bucket,
       {O.ts_text('time_interval')} AS obs_bucket, CAST(arrival_number AS DOUBLE) AS arrival_number,
       CAST(landing_number AS DOUBLE) AS landing_number,
       {O.r('food_availability')} AS food_availability, {O.r('arrival_minutes')} AS arrival_minutes,
       CAST(month_x AS BIGINT) AS month_x, CAST(month_y AS DOUBLE) AS month_y, CAST(bucket_count AS DOUBLE) AS bucket_count
FROM joined""")
def q_bucket_join_null_safe(spark, sf):
    """JON1 with null keys matching null keys (as the original merge does)."""
    from ..operators.timebucket import bucket_join_counted
    j = bucket_join_counted(FX.landings(spark, sf), FX.observations(spark, sf), "start_time", "time",
                            count_col="bucket_count", null_safe=True)
    return j.select(_b("key"), "date", ts_text("start_time_interval").alias("start_bucket"),
                    ts_text("time_interval").alias("obs_bucket"), _d("arrival_number"), _d("landing_number"),
                    _r("food_availability"), _r("arrival_minutes"), _b("month_x"), _d("month_y"),
                    _d("bucket_count"))


FEATURE_OUT = ["arrival_present", "food_fraction", "month_num", "season", "arrivals_exceed",
               "risk_arrivals", "risk_food", "risk_reward"]


@register("landing_features", f"""WITH {O.FIXTURE_A}
SELECT CAST(key AS BIGINT) AS key, CAST(arrival_present AS BIGINT) AS arrival_present,
       {O.r('food_fraction')} AS food_fraction, CAST(month_num AS BIGINT) AS month_num, season,
       CAST(arrivals_exceed AS BIGINT) AS arrivals_exceed, CAST(risk_arrivals AS BIGINT) AS risk_arrivals,
       {O.r('risk_food')} AS risk_food, {O.r('risk_reward')} AS risk_reward
FROM feat3""")
def q_landing_features(spark, sf):
    df = P.features_a(spark, sf)
    return df.select(_b("key"), _b("arrival_present"), _r("food_fraction"), _b("month_num"), "season",
                     _b("arrivals_exceed"), _b("risk_arrivals"), _r("risk_food"), _r("risk_reward"))


CLEAN_COLS = ["key", "start_time", "date", "time_to_food", "risk", "reward", "min_after_arrival",
              "arrival_number", "landing_number", "arrival_minutes", "bucket_count", "arrival_present",
              "food_fraction", "month", "season", "arrivals_exceed", "risk_arrivals", "risk_food", "risk_reward"]


@register("profile_clean", O.profile_sql(
    O.FIXTURE_A + ",\nclean AS (SELECT * EXCLUDE (time, time_interval, start_time_interval, food_availability, "
    "month_y, month_x, month_num), month_num AS month FROM feat3)", "clean", CLEAN_COLS))
def q_profile_clean(spark, sf):
    """PRJ3 + PRJ4 + SRC2: columns of the cleaned frame, in order."""
    return S.profile(P.clean_a(spark, sf))


@register("clean_columns", f"""WITH {O.FIXTURE_A},
clean AS (SELECT * EXCLUDE (time, time_interval, start_time_interval, food_availability, month_y, month_x,
                            month_num), month_num AS month FROM feat3)
SELECT CAST(key AS BIGINT) AS key, {O.ts_text('start_time')} AS start_time, date,
       {O.r('time_to_food')} AS time_to_food, CAST(risk AS BIGINT) AS risk, CAST(reward AS BIGINT) AS reward,
       {O.r('min_after_arrival')} AS min_after_arrival, CAST(arrival_number AS DOUBLE) AS arrival_number,
       CAST(landing_number AS DOUBLE) AS landing_number, {O.r('arrival_minutes')} AS arrival_minutes,
       CAST(bucket_count AS DOUBLE) AS bucket_count, CAST(arrival_present AS BIGINT) AS arrival_present,
       {O.r('food_fraction')} AS food_fraction, CAST(month AS BIGINT) AS month, season,
       CAST(arrivals_exceed AS BIGINT) AS arrivals_exceed, CAST(risk_arrivals AS BIGINT) AS risk_arrivals,
       {O.r('risk_food')} AS risk_food, {O.r('risk_reward')} AS risk_reward
FROM clean""")
def q_clean_columns(spark, sf):
    """PRJ1-4 + CNV1: the cleaned frame (helpers and collided months dropped,
    month renamed, numeric coercion of the target)."""
    df = P.clean_a(spark, sf).withColumn("time_to_food", X.to_double("time_to_food"))
    return df.select(_b("key"), ts_text("start_time").alias("start_time"), "date", _r("time_to_food"), _b("risk"),
                     _b("reward"), _r("min_after_arrival"), _d("arrival_number"), _d("landing_number"),
                     _r("arrival_minutes"), _d("bucket_count"), _b("arrival_present"), _r("food_fraction"),
                     _b("month"), "season", _b("arrivals_exceed"), _b("risk_arrivals"), _r("risk_food"),
                     _r("risk_reward"))


# --- AGG1-3 -------------------------------------------------------------------------------------

@register("group_size", f"""WITH {O.LANDING},\n{O.OBSERVATION},\n{O.joined_sql()}
SELECT date, {O.ts_text('start_time_interval')} AS bucket, count(*) AS n FROM joined GROUP BY 1, 2""")
def q_group_size(spark, sf):
    """AGG1: rows per (date, bucket) after the join."""
    j = P.joined_a(spark, sf)
    return j.groupBy("date", ts_text("start_time_interval").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("value_counts_arrival_present", f"""WITH {O.FIXTURE_A}
SELECT CAST(arrival_present AS BIGINT) AS arrival_present, count(*) AS n FROM feat3
WHERE arrival_present IS NOT NULL GROUP BY 1""")
def q_vc_present(spark, sf):
    """AGG2."""
    df = P.features_a(spark, sf).where(F.col("arrival_present").isNotNull())
    return df.groupBy(_b("arrival_present")).agg(F.count(F.lit(1)).alias("n"))


@register("value_counts_season", f"""WITH {O.ORDER_FRAME}
SELECT season, count(*) AS n FROM ordf GROUP BY 1""")
def q_vc_season(spark, sf):
    """AGG2 on the order frame (three seasons)."""
    return FX.order_frame(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@register("distinct_food_fraction", f"""WITH {O.FIXTURE_A}
SELECT DISTINCT {O.r('food_fraction')} AS food_fraction FROM feat3""")
def q_distinct_food(spark, sf):
    """AGG3: distinct values, null kept."""
    return P.features_a(spark, sf).select(_r("food_fraction")).distinct()


# --- FEA1 / FEA2 / DIA7 ------------------------------------------------------------------------

CLEAN_SQL = (O.FIXTURE_A + ",\nclean AS (SELECT * EXCLUDE (time, time_interval, start_time_interval, "
             "food_availability, month_y, month_x, month_num), month_num AS month FROM feat3)")


def _fence_sql() -> str:
    parts = []
    for c in C.A_REPAIR_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
       quantile_cont({x}, 0.75) AS q3 FROM clean""")
    return "fq AS (" + "\nUNION ALL\n".join(parts) + """),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fq)"""


FENCES_SQL = f"WITH {CLEAN_SQL},\n{_fence_sql()}"


@register("outlier_fences", FENCES_SQL + "\n" + f"""SELECT column_name, {O.r('q1')} AS q1, {O.r('median')} AS median,
       {O.r('q3')} AS q3, {O.r('lo')} AS lo_fence, {O.r('hi')} AS hi_fence FROM f""")
def q_outlier_fences(spark, sf):
    """FEA1: exact quartiles, median and fences of the repaired columns."""
    fences = FE.iqr_fences(materialize(P.clean_a(spark, sf).select(*C.A_REPAIR_COLUMNS)), C.A_REPAIR_COLUMNS)
    rows = [(c, f["q1"], f["median"], f["q3"], f["lo"], f["hi"]) for c, f in fences.items()]
    schema = "column_name string, q1 double, median double, q3 double, lo_fence double, hi_fence double"
    df = spark.createDataFrame(rows, schema)
    return df.select("column_name", *[_r(c) for c in ["q1", "median", "q3", "lo_fence", "hi_fence"]])


def _repair_sql_expr(c: str) -> str:
    x = f"CAST(clean.{c} AS DOUBLE)"
    return (f"CASE WHEN {x} < (SELECT lo FROM f WHERE column_name = '{c}') OR {x} > (SELECT hi FROM f WHERE "
            f"column_name = '{c}') THEN (SELECT median FROM f WHERE column_name = '{c}') ELSE {x} END")


@register("outlier_repair", FENCES_SQL + "\nSELECT CAST(key AS BIGINT) AS key, " + ", ".join(
    f"{O.r(_repair_sql_expr(c))} AS {c}" for c in C.A_REPAIR_COLUMNS) + " FROM clean")
def q_outlier_repair(spark, sf):
    """FEA2: repaired values (all rows, before any split)."""
    rep = P.repaired_a(spark, sf)
    return rep.select(_b("key"), *[_r(c) for c in C.A_REPAIR_COLUMNS])


def _box_sql(stage: str, src: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{stage}' AS stage, '{c}' AS column_name, {O.r('q1')} AS q1, {O.r('median')} AS median,
       {O.r('q3')} AS q3, {O.r('lo')} AS lo_fence, {O.r('hi')} AS hi_fence,
       {O.r(f'(SELECT min({x}) FROM {src} WHERE {x} >= lo AND {x} <= hi)')} AS whisker_lo,
       {O.r(f'(SELECT max({x}) FROM {src} WHERE {x} >= lo AND {x} <= hi)')} AS whisker_hi,
       (SELECT count(*) FROM {src} WHERE {x} < lo OR {x} > hi) AS n_fliers
FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3
  FROM {src}))"""


@register("boxplot_stats", FENCES_SQL + ",\nrep AS (SELECT " + ", ".join(
    f"{_repair_sql_expr(c)} AS {c}" for c in C.A_REPAIR_COLUMNS) + " FROM clean)\n"
    + _box_sql("before", "clean", "time_to_food") + "\nUNION ALL\n" + _box_sql("after", "rep", "time_to_food"))
def q_boxplot(spark, sf):
    """DIA7 before and after the repair: the plotted column alone is written, and one search
    serves the first plot and the repair."""
    column = ["time_to_food"]
    clean = materialize(P.clean_a(spark, sf).select(*column))
    fences = FE.iqr_fences(clean, column)
    before = FE.boxplot_stats(clean, column, fences=fences)
    after = FE.boxplot_stats(FE.repair_outliers(clean, column, fences), column)
    out = before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    return out.select("stage", "column_name", *[_r(c) for c in
                                                ["q1", "median", "q3", "lo_fence", "hi_fence", "whisker_lo",
                                                 "whisker_hi"]], "n_fliers")


# --- FEA3 / PRJ8 ----------------------------------------------------------------------------------

@register("onehot_season", f"""WITH {O.ORDER_FRAME}
SELECT key, CASE WHEN season = 'Spring' THEN 1.0 ELSE 0.0 END AS season_Spring,
       CASE WHEN season = 'Winter' THEN 1.0 ELSE 0.0 END AS season_Winter FROM ordf""")
def q_onehot(spark, sf):
    """FEA3 with discovered categories (sorted, first dropped)."""
    enc, names = FE.onehot(FX.order_frame(spark, sf).select("key", "season"), "season")
    return enc.select("key", *names)
