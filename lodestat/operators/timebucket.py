"""JON1 / JON2: interval-bucket left join and the per-bucket count of joined rows.

Detail rows (many per bucket) are left-joined to interval rows on
``(date, floor(time, 30 min))``.  The interval side is small (one row per
bucket, bounded by the time span), so AQE broadcasts it from measured
shuffle statistics; past the threshold the join stays sort-merge and AQE's
skew-join handling splits a hot bucket on the detail side.

The count of joined rows per bucket (JON2) is *not* computed with a window
over the joined rows -- that would put every row of a hot bucket in one task.
It is ``rows of the bucket on the left x max(1, rows of the bucket on the
right)``: a partial aggregate of the detail side and a count over the small
interval side, both taken before the join.
Rows with a null key get a null count (grouping drops null keys).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X


def _key_cond(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool):
    conds = []
    for lk, rk in pairs:
        conds.append(left[lk].eqNullSafe(right[rk]) if null_safe else left[lk] == right[rk])
    return conds


def _suffix_collisions(left: DataFrame, right: DataFrame, shared_keys: Sequence[str],
                       suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    clash = (set(left.columns) & set(right.columns)) - set(shared_keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left, right


def bucket_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
                on: Sequence[str] = ("date",), minutes: int = C.BUCKET_MINUTES,
                left_bucket: str = "start_time_interval", right_bucket: str = "time_interval",
                null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """JON1: many-to-one (or many-to-many) left join on shared keys plus time bucket."""
    left = left.withColumn(left_bucket, X.floor_to_minutes(left_time, minutes))
    right = right.withColumn(right_bucket, X.floor_to_minutes(right_time, minutes))
    left, right = _suffix_collisions(left, right, on, suffixes)
    r_named = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = _key_cond(left, r_named, [(k, f"__r_{k}") for k in on] + [(left_bucket, right_bucket)], null_safe)
    return left.join(r_named, cond, "left").drop(*[f"__r_{k}" for k in on])


def bucket_join_counted(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
                        count_col: str = "bucket_count", on: Sequence[str] = ("date",),
                        minutes: int = C.BUCKET_MINUTES, left_bucket: str = "start_time_interval",
                        right_bucket: str = "time_interval", null_safe: bool = False,
                        suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """JON1 + JON2 with one pass over each input.

    The interval side (small: about one row per bucket) gets the number of its
    rows per key by a window over that side only.  ``R`` = per-key counts of
    the detail side (a partial aggregate) left-joined to it: one row per left
    key and matching interval row, carrying ``left rows x max(1, right rows)``.
    The detail rows then take a single left join to ``R``.
    """
    keys_l = [*on, left_bucket]
    left = left.withColumn(left_bucket, X.floor_to_minutes(left_time, minutes))
    right = right.withColumn(right_bucket, X.floor_to_minutes(right_time, minutes))
    left, right = _suffix_collisions(left, right, on, suffixes)

    n_left = left.groupBy(*keys_l).agg(F.count(F.lit(1)).alias("__n_left"))
    r_keys = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    r_part = [f"__r_{k}" for k in on] + [right_bucket]
    r_counted = r_keys.withColumn("__n_right", F.count(F.lit(1)).over(Window.partitionBy(*r_part)))
    pairs = [(k, f"__r_{k}") for k in on] + [(left_bucket, right_bucket)]
    right_rows = n_left.join(r_counted, _key_cond(n_left, r_counted, pairs, null_safe), "left")
    cnt = F.col("__n_left") * F.coalesce(F.col("__n_right"), F.lit(1))
    right_rows = right_rows.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys_l],
        *[c for c in r_keys.columns if c not in r_part],
        right_bucket,
        F.when(X.all_not_null(keys_l), cnt).cast("bigint").alias(count_col))
    cond = _key_cond(left, right_rows, [(k, f"__k_{k}") for k in keys_l], null_safe)
    out = left.join(right_rows, cond, "left").drop(*[f"__k_{k}" for k in keys_l])
    ordered = [c for c in out.columns if c != count_col] + [count_col]
    return out.select(*ordered)
