"""Entry A: "does x explain y?" -- split, fit on train, score on test, compare
with the mean baseline.  One lazy plan: the fit is a one-row aggregate used
through one scalar subquery, so nothing is collected while the plan is built and
the input is read twice (fit, scores)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import metrics as MET
from . import oracle as O

REPORT_METRICS = ("mae", "mse", "rmse", "nrmse", "r2")


def split_and_fit(df: DataFrame, x: str, y: str, key_cols: Sequence[str],
                  seed: int = C.UNIVARIATE_SEED, test_size: float = C.TEST_SIZE):
    """The complete rows (keys, x, y, is_test), and the training fit (b0, b1, ybar,
    n_train) as one scalar subquery."""
    base = df.select(*key_cols, X.to_double(x).alias("x"), X.to_double(y).alias("y")) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull()) \
        .withColumn("is_test", X.is_test_row(list(key_cols), seed, test_size))
    fit = base.where(~F.col("is_test")).agg(
        F.regr_intercept("y", "x").alias("b0"), F.regr_slope("y", "x").alias("b1"),
        F.avg("y").alias("ybar"), F.count(F.lit(1)).cast("double").alias("n_train"))
    return base, fit.select(F.struct("b0", "b1", "ybar", "n_train").alias("fit")).scalar()


def fitted_line(df: DataFrame, x: str, y: str, key_cols: Sequence[str], **kw) -> DataFrame:
    """DIA9 + DIA10: the test points (keys, x, y) and the fitted line at them."""
    base, fit = split_and_fit(df, x, y, key_cols, **kw)
    return base.where(F.col("is_test")).select(*key_cols, "x", "y", (fit["b0"] + fit["b1"] * F.col("x")).alias("fitted"))


def univariate_report(df: DataFrame, x: str, y: str, key_cols: Sequence[str],
                      seed: int = C.UNIVARIATE_SEED, test_size: float = C.TEST_SIZE) -> DataFrame:
    """(model, metric, value): intercept, slope, train mean and test metrics."""
    base, fit = split_and_fit(df, x, y, key_cols, seed, test_size)
    b0, b1, ybar = fit["b0"], fit["b1"], fit["ybar"]
    test = base.where(F.col("is_test"))
    scores = MET.evaluate(test, "y", {
        "linear": (F.lit(True), b0 + b1 * F.col("x")),
        "baseline": (F.lit(True), ybar),
    })
    long = MET.long_metrics(scores, ["model"], REPORT_METRICS)
    params = df.sparkSession.range(1).select(fit.alias("f")).select("f.*").selectExpr("stack(4, 'linear', 'intercept', b0, 'linear', 'slope', b1, "
                            "'baseline', 'mean', ybar, 'linear', 'n_train', n_train) as (model, metric, value)")
    out = params.unionByName(long).where(~((F.col("model") == "baseline") & (F.col("metric") == "r2")))
    return out.select("model", "metric", X.rounded("value").alias("value"))


def fitted_line_sql(fixture_cte: str, src: str, key: str, x: str, y: str, seed: int = C.UNIVARIATE_SEED,
                    test_size: float = C.TEST_SIZE) -> str:
    """``key``: SQL of the output key; rows are split by it."""
    return f"""WITH {fixture_cte},
base AS (SELECT {key} AS key, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {O.is_test_sql([key], seed, test_size)} AS is_test
         FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
fit AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM base WHERE NOT is_test)
SELECT key, {O.r('x')} AS x, {O.r('y')} AS y, {O.r('b0 + b1 * x')} AS fitted FROM base, fit WHERE is_test"""


def univariate_sql(fixture_ctes: str, src: str, x: str, y: str, key_cols: Sequence[str],
                   seed: int = C.UNIVARIATE_SEED, test_size: float = C.TEST_SIZE) -> str:
    ms = O.metric_select("y", "yhat")
    pick = {m: e for m, e in zip(("n", *REPORT_METRICS), ms)}
    parts = []
    for model in ("linear", "baseline"):
        for metric in REPORT_METRICS:
            if model == "baseline" and metric == "r2":
                continue
            expr = pick[metric].rsplit(" AS ", 1)[0]
            parts.append(f"SELECT '{model}' AS model, '{metric}' AS metric, {expr} AS value "
                         f"FROM sc WHERE model = '{model}'")
    body = f"""
SELECT 'linear' AS model, 'intercept' AS metric, {O.r('b0')} AS value FROM fit
UNION ALL SELECT 'linear', 'slope', {O.r('b1')} FROM fit
UNION ALL SELECT 'baseline', 'mean', {O.r('ybar')} FROM fit
UNION ALL SELECT 'linear', 'n_train', {O.r('n')} FROM fit
UNION ALL """ + "\nUNION ALL ".join(parts)
    prefix = (fixture_ctes + ",\n") if fixture_ctes else ""
    return f"""WITH {prefix}base AS (
  SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {O.is_test_sql(key_cols, seed, test_size)} AS is_test
  FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND NOT isnan(CAST({y} AS DOUBLE))),
fit AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, avg(y) AS ybar, count(*) AS n FROM base WHERE NOT is_test),
sc AS (
  SELECT 'linear' AS model, y, b0 + b1 * x AS yhat FROM base, fit WHERE is_test
  UNION ALL
  SELECT 'baseline' AS model, y, ybar AS yhat FROM base, fit WHERE is_test)
{body}"""
