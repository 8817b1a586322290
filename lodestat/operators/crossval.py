"""CVA1 / CVA2: K-fold cross-validation in two passes over the rows.

Pass 1 aggregates moments per (atom, fold).  The training statistics of fold
f are the merge of every other fold's moments (merging centred moments, no
subtraction of raw sums), so k models per segment are solved on the driver
without touching rows again.  Pass 2 scores each row with the model that did
not see its fold and aggregates the validation errors per (segment, fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as MET
from .regression import predict, segment_fold_models


def fold_models(df: DataFrame, features: dict[str, list[str]], target: str, segments: dict[str, list[str]],
                atom_col: str, fold_col: str, k: int, intercept: bool = True, standardise: bool = True) -> dict:
    _, cv = segment_fold_models(df, features, target, segments, atom_col, fold_col, None, k,
                                intercept, standardise)
    return cv


def score_folds(df: DataFrame, fits: dict, target: str, segments: dict[str, list[str]], atom_col: str,
                fold_col: str, k: int) -> DataFrame:
    """Each row scored by the model that did not see its fold; metrics per
    (segment, fold) in one aggregation."""
    fold = F.col(fold_col)
    models = {}
    for seg, atoms in segments.items():
        pred = F.lit(None).cast("double")
        for f in range(k):
            pred = F.when(fold == f, predict(fits[(seg, f)])).otherwise(pred)
        models[seg] = (F.col(atom_col).isin(*atoms), pred)
    res = MET.evaluate(df, target, models, by=[fold_col])
    return res.select(F.col("model").alias("segment"), F.col(fold_col).cast("bigint").alias("fold"),
                      "n", "mse", "rmse", "r2")


def cross_validate(df: DataFrame, features: dict[str, list[str]], target: str, segments: dict[str, list[str]],
                   atom_col: str, fold_col: str = "fold", k: int = 5, intercept: bool = True,
                   standardise: bool = True) -> DataFrame:
    """CVA1: (segment, fold, n, mse, rmse, r2) on the validation fold."""
    fits = fold_models(df, features, target, segments, atom_col, fold_col, k, intercept, standardise)
    return score_folds(df, fits, target, segments, atom_col, fold_col, k)


def cv_average(scores: DataFrame) -> DataFrame:
    """CVA2: mean MSE, mean of the fold RMSEs (not sqrt of mean MSE), mean R^2."""
    return scores.groupBy("segment").agg(
        F.avg("mse").alias("avg_mse"), F.avg("rmse").alias("avg_rmse"), F.avg("r2").alias("avg_r2"),
        F.count(F.lit(1)).alias("n_folds"))
