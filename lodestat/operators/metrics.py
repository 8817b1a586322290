"""MET1-7: regression metrics as one aggregation over scored rows.

Several models (segments that overlap, a model and its mean baseline, train
and test) are evaluated in the same pass with conditional aggregates; no row
is duplicated to serve two models.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("n", "mae", "mse", "rmse", "nrmse", "r2")


def _inputs(y: Column, yhat: Column, member: Column, tag: str) -> list[Column]:
    """Per-model error and target, projected once before the aggregation (a
    prediction expression is then evaluated once per row, not once per
    aggregate, and the generated code stays small)."""
    valid = member & y.isNotNull() & yhat.isNotNull()
    return [F.when(valid, y - yhat).alias(f"{tag}__e"), F.when(valid, y).alias(f"{tag}__y")]


def _stats(tag: str) -> list[Column]:
    e = F.col(f"{tag}__e")
    yv = F.col(f"{tag}__y")
    return [
        F.count(e).alias(f"{tag}__n"),
        F.avg(F.abs(e)).alias(f"{tag}__mae"),
        F.avg(e * e).alias(f"{tag}__mse"),
        F.sum(e * e).alias(f"{tag}__sse"),
        F.var_pop(yv).alias(f"{tag}__vy"),
        F.max(yv).alias(f"{tag}__ymax"),
        F.min(yv).alias(f"{tag}__ymin"),
    ]


def _finish(tag: str) -> dict[str, Column]:
    n = F.col(f"{tag}__n")
    mse = F.col(f"{tag}__mse")
    sse = F.col(f"{tag}__sse")
    sst = F.col(f"{tag}__vy") * n
    rng = F.col(f"{tag}__ymax") - F.col(f"{tag}__ymin")
    rmse = F.sqrt(mse)
    # R^2 convention of the usual metrics library: undefined below 2 rows;
    # a constant target scores 1 for a perfect fit, else 0.
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(sst > 0, F.lit(1.0) - sse / sst)
          .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return {
        "n": n.cast("bigint"),
        "mae": F.col(f"{tag}__mae"),
        "mse": mse,
        "rmse": rmse,
        "nrmse": F.when(rng > 0, rmse / rng),
        "r2": r2,
    }


def evaluate(df: DataFrame, y: str | Column, models: dict[str, tuple[Column, Column]],
             by: Sequence[str] = ()) -> DataFrame:
    """One pass: for each model name, ``(member condition, prediction)``.

    Output: (by..., model, n, mae, mse, rmse, nrmse, r2), one row per group and model.
    """
    y = F.col(y) if isinstance(y, str) else y
    aggs, proj = [], []
    tags = {}
    for i, (name, (member, pred)) in enumerate(models.items()):
        tag = f"m{i}"
        tags[name] = tag
        proj += _inputs(y, pred, member, tag)
        aggs += _stats(tag)
    stats = df.select(*by, *proj).groupBy(*by).agg(*aggs)
    rows = []
    for name, tag in tags.items():
        fin = _finish(tag)
        rows.append(F.struct(F.lit(name).alias("model"), *[fin[m].alias(m) for m in METRICS]))
    return stats.select(*by, F.inline(F.array(*rows)))


def long_metrics(wide: DataFrame, id_cols: Sequence[str], metrics: Sequence[str] = METRICS[1:]) -> DataFrame:
    """MET6: (ids..., metric, value) with value double."""
    args = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return wide.selectExpr(*[f"`{c}`" for c in id_cols], f"stack({len(metrics)}, {args}) as (metric, value)")
