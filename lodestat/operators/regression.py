"""REG1-9: least-squares models from grouped moments.

Rows never leave the executors: a model is fitted from one grouped moments
aggregation (``by`` = the disjoint atoms of the segments, plus fold or split
columns), merged per segment on the driver, and solved on k x k numbers.
Scoring is a column expression with the coefficients as literals, so it stays
inside whole-stage codegen and needs no join.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linalg import LinearFit, ols_no_intercept, ols_with_intercept
from .moments import Moments, collect_moments, merge_all


# --- fitting ------------------------------------------------------------------

def fit_segments(df: DataFrame, features: dict[str, list[str]], target: str,
                 segments: dict[str, list[str]] | None = None, atom_col: str | None = None,
                 train: Column | None = None, intercept: bool = True, standardise: bool = True,
                 extra_by: Sequence[str] = ()) -> dict:
    """REG2/REG3/REG6: one model per segment (and per ``extra_by`` value, e.g. fold).

    ``segments`` maps a segment name to the atoms (values of ``atom_col``) it
    unions; ``features`` maps a segment to its feature list.  Listwise deletion
    is per model (rows complete on that model's columns).  ONE aggregation pass
    whatever the number of segments and feature lists; segment moments are
    merged on the driver, so a segment that contains others (the whole year)
    costs nothing extra.  Keys of the result are the segment name, or
    (segment, *extra) tuples.
    """
    if atom_col is None:
        segments = {seg: [None] for seg in features}
    data = df.where(train) if train is not None else df
    lists, list_of = _feature_lists(features, target)
    by = ([atom_col] if atom_col else []) + list(extra_by)
    parts = _collect(data, lists, by)
    if atom_col is None:
        parts = {lid: {(None, *k): v for k, v in p.items()} for lid, p in parts.items()}
    out: dict = {}
    for seg, feats in features.items():
        lp = parts[list_of[seg]]
        extras = sorted({k[1:] for k in lp}) if extra_by else [()]
        for ex in extras:
            fit = fit_from_parts(lp, feats, target, segments[seg], keep=lambda key, ex=ex: key[1:] == ex,
                                 intercept=intercept, standardise=standardise)
            out[(seg, *ex) if extra_by else seg] = fit
    return out


def _feature_lists(features: dict[str, list[str]], target: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    lists: dict[str, list[str]] = {}
    list_of: dict[str, str] = {}
    seen: dict[tuple, str] = {}
    for seg, feats in features.items():
        key = tuple(feats)
        if key not in seen:
            seen[key] = f"l{len(seen)}"
            lists[seen[key]] = list(feats) + [target]
        list_of[seg] = seen[key]
    return lists, list_of


def _collect(df: DataFrame, lists: dict[str, list[str]], by: list[str]) -> dict[str, dict[tuple, Moments]]:
    from .moments import collect_moments_multi
    return collect_moments_multi(df, lists, by)


def segment_fold_models(df: DataFrame, features: dict[str, list[str]], target: str,
                        segments: dict[str, list[str]], atom_col: str, fold_col: str, split_col: str | None,
                        k: int, intercept: bool = True, standardise: bool = True) -> tuple[dict, dict]:
    """Training-split models per segment AND k cross-validation models per
    segment from one aggregation grouped by (atom, fold, split)."""
    lists, list_of = _feature_lists(features, target)
    by = [atom_col, fold_col] + ([split_col] if split_col else [])
    parts = _collect(df, lists, by)
    fits, cv = {}, {}
    for seg, feats in features.items():
        lp = parts[list_of[seg]]
        atoms = segments[seg]
        if split_col:
            fits[seg] = fit_from_parts(lp, feats, target, atoms, keep=lambda key: key[2] is False,
                                       intercept=intercept, standardise=standardise)
        for f in range(k):
            cv[(seg, f)] = fit_from_parts(lp, feats, target, atoms, keep=lambda key, f=f: key[1] != f,
                                          intercept=intercept, standardise=standardise)
    return fits, cv


def _solve(m: Moments, feats: list[str], target: str, intercept: bool, standardise: bool) -> LinearFit:
    if intercept:
        return ols_with_intercept(m, feats, target, standardise)
    return ols_no_intercept(m, feats, target)


# --- scoring ----------------------------------------------------------------------

def predict(fit: LinearFit) -> Column:
    """REG4: intercept + sum b_i x_i (null if any feature is null)."""
    expr = F.lit(float(fit.intercept))
    for c, b in zip(fit.features, fit.coef):
        expr = expr + F.lit(float(b) if np.isfinite(b) else None).cast("double") * F.col(c)
    return expr


def predict_by(fits: dict, keys: Sequence[Column]) -> Column:
    """Prediction under the model selected by the row's key values (a CASE over
    a bounded set of models)."""
    out = F.lit(None).cast("double")
    for k, fit in fits.items():
        k = k if isinstance(k, tuple) else (k,)
        cond = None
        for col, v in zip(keys, k):
            c = col == F.lit(v)
            cond = c if cond is None else cond & c
        out = F.when(cond, predict(fit)).otherwise(out)
    return out


# --- REG7: coefficient tables ------------------------------------------------------

COEF_SCHEMA = T.StructType([
    T.StructField("segment", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("coef", T.DoubleType()), T.StructField("abs_coef", T.DoubleType()),
])


def coefficient_table(spark: SparkSession, fits: dict[str, LinearFit], scaled: bool = True,
                      with_intercept: bool = True) -> DataFrame:
    """(segment, term, coef, abs_coef); ``scaled`` reports coefficients on the
    standardised features (as the fitted model sees them)."""
    rows = []
    for seg, fit in fits.items():
        coefs = fit.coef_scaled if (scaled and fit.coef_scaled is not None) else fit.coef
        if with_intercept and fit.fit_intercept:
            icpt = fit.intercept if not scaled else _scaled_intercept(fit)
            rows.append((seg, "(intercept)", _f(icpt), _f(abs(icpt))))
        for c, b in zip(fit.features, coefs):
            rows.append((seg, c, _f(b), _f(abs(b))))
    return spark.createDataFrame(rows, COEF_SCHEMA)


def _scaled_intercept(fit: LinearFit) -> float:
    # on standardised features the intercept is the training mean of the target
    if fit.mean is None:
        return fit.intercept
    return float(fit.intercept + fit.coef @ fit.mean)


def _f(v) -> float | None:
    v = float(v)
    return v if np.isfinite(v) else None


def top_k_terms(coefs: DataFrame, k: int) -> DataFrame:
    """ORD3: the k largest |coef| per segment (window over a k-bounded table)."""
    from pyspark.sql import Window
    w = Window.partitionBy("segment").orderBy(F.col("abs_coef").desc(), F.col("term"))
    return coefs.where(F.col("term") != "(intercept)").withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def label_segments(df: DataFrame, segments: dict[str, list[str]], atom_col: str,
                   col: str = "segment") -> DataFrame:
    """One output row per (row, segment holding it): a generator over a
    bounded list of segment names, no join and no extra scan."""
    names = F.array(*[F.lit(s) for s in segments])
    member = {s: F.col(atom_col).isin(*atoms) for s, atoms in segments.items()}

    def holds(s):
        out = F.lit(False)
        for name, cond in member.items():
            out = F.when(s == F.lit(name), cond).otherwise(out)
        return out

    return df.withColumn(col, F.explode(F.filter(names, holds)))


def fit_from_parts(parts: dict[tuple, Moments], feats: list[str], target: str, atoms: Sequence[str],
                   keep=lambda key: True, intercept: bool = True, standardise: bool = True) -> LinearFit:
    """Solve one model from pre-aggregated moment parts keyed (atom, *rest);
    ``keep`` selects the parts (e.g. training rows, or every fold but one)."""
    cols = list(feats) + [target]
    m = merge_all([p.sub(cols) for key, p in parts.items() if key[0] in atoms and keep(key)], cols)
    return _solve(m, list(feats), target, intercept, standardise)
