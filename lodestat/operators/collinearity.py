"""AGG9, FLT6, FLT7, PRJ11, FEA8, FEA9: correlation and variance inflation."""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .linalg import SweptGram
from .gram import pairwise_correlation
from .moments import collect_moments
from .qr import ONE, factor, vifs


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG9: Pearson correlation of every ordered pair, pairwise complete.

    One pass of per-task partial co-moments (see ``gram``); the k x k
    result becomes a small frame.  A column that is constant on the rows it
    shares with its partner gives null (``corr`` would divide by zero under
    ANSI mode).  Output: (col_i, col_j, corr) for all i, j including the diagonal.
    """
    cols = list(cols)
    corr = pairwise_correlation(df, cols)
    rows = [(a, b, _finite(corr[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    schema = "col_i string, col_j string, corr double"
    return df.sparkSession.createDataFrame(rows, schema)


def high_corr_pairs(corr: DataFrame, threshold: float = C.CORR_THRESHOLD, absolute: bool = False) -> DataFrame:
    """FLT6: ordered pairs i != j above the threshold.  ``absolute=False`` keeps
    the original rule (``corr > |t|``: strong negative pairs are missed)."""
    value = F.abs(F.col("corr")) if absolute else F.col("corr")
    return corr.where((F.col("col_i") != F.col("col_j")) & (value > F.lit(abs(threshold))))


def vif_values(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """FEA8: one factorisation of the rows, then k x k algebra on the driver."""
    f = factor(df.withColumn(ONE, F.lit(1.0)), [*cols, ONE])
    return dict(zip(cols, vifs(f, list(cols)), strict=True))


def vif_table(spark: SparkSession, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    vals = vif_values(df, cols)
    rows = [(i, c, None if np.isnan(v) else float(v)) for i, (c, v) in enumerate(vals.items())]
    schema = T.StructType([T.StructField("position", T.LongType()), T.StructField("feature", T.StringType()),
                           T.StructField("vif", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def _finite(v: float) -> float | None:
    return float(v) if np.isfinite(v) else None


def vif_elimination(df: DataFrame, cols: Sequence[str], threshold: float = C.VIF_THRESHOLD,
                    max_rounds: int = C.VIF_MAX_ROUNDS) -> tuple[list[dict], list[str]]:
    """FEA9: drop the column with the highest VIF while it exceeds ``threshold``.

    One Spark pass for the Gram matrix of all candidates, swept once; a round
    reads all VIFs from it and removes a column by one reverse sweep.  Ties go to the first column in order (FLT7).  Returns the
    rounds (round, removed, vif; removed None once nothing exceeds) and the
    kept list.
    """
    cols = list(cols)
    return vif_elimination_from_moments(collect_moments(df, cols)[()], cols, threshold, max_rounds)


def vif_elimination_from_moments(m, cols: Sequence[str], threshold: float = C.VIF_THRESHOLD,
                                 max_rounds: int = C.VIF_MAX_ROUNDS) -> tuple[list[dict], list[str]]:
    """FEA9 on already collected moments (no Spark job)."""
    swept = SweptGram(m, list(cols))
    rounds = []
    for rnd in range(1, max_rounds + 1):
        if not swept.kept.any():
            break
        v = swept.vifs()
        worst = int(np.argmax(np.where(np.isnan(v), -np.inf, v)))
        drop = bool(v[worst] > threshold)
        rounds.append({"round": rnd, "removed": cols[worst] if drop else None, "vif": float(v[worst])})
        if drop:
            swept.remove(worst)
    return rounds, [c for c, k in zip(cols, swept.kept, strict=True) if k]


def vif_state(v: float) -> tuple[float | None, str]:
    """A VIF as a number where it is finite, and finite, infinite or undefined."""
    return (float(v), "finite") if np.isfinite(v) else (None, "undefined" if np.isnan(v) else "infinite")
