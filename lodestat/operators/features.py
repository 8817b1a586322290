"""Feature preparation: landing features, cleaning, outlier repair, one-hot,
standardisation, splits and folds (FEA1-7, PRJ2-9, FLT2-5, DAT3-4, CNV1)."""

from __future__ import annotations

import math
from hashlib import md5
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from .quantiles import quantiles
from .ranking import global_rank


# --- PRJ2 / PRJ3 / PRJ4 ---------------------------------------------------------

def select_except(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """PRJ2: all columns except an exclusion set, in frame order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def drop_checked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ3: drop columns, failing on a missing name (Spark's drop ignores them)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ4."""
    return df.withColumnsRenamed(mapping)


# --- landing features (fixture A after the bucket join) ---------------------------

def landing_features(joined: DataFrame, count_col: str = "bucket_count") -> DataFrame:
    """FLT2, PRJ5-7, DAT3-4, FLT3 on the joined landings (narrow: no shuffle)."""
    month_num = X.month_of(F.to_date(F.col("date")))
    df = joined.withColumns({
        "arrival_present": X.as_flag(X.present("arrival_number")),
        "food_fraction": X.scaled_fraction("food_availability"),
        "month_num": month_num,
        "season": X.season_of(month_num),
    })
    df = df.withColumn("arrivals_exceed", X.as_flag(F.col("arrival_number") > F.col(count_col)))
    df = df.withColumns({
        "risk_arrivals": X.product("arrivals_exceed", "risk"),
        "risk_food": X.product("food_fraction", "risk"),
    })
    return df.withColumn("risk_reward", X.product("risk_arrivals", "risk_food", "reward"))


CLEAN_DROP = ["time", "time_interval", "start_time_interval", "food_availability", "month_y", "month_x"]


def clean_columns(df: DataFrame, drop: Sequence[str] = CLEAN_DROP) -> DataFrame:
    """PRJ3 + PRJ4 after the join: drop helpers and collided months, keep one month."""
    return rename(drop_checked(df, drop), {"month_num": "month"})


# --- FEA1 / FEA2: IQR outliers replaced by the median ------------------------------

def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = C.IQR_FACTOR, **kw) -> dict[str, dict]:
    """q1, q3, median and fences per column, all from the unrepaired rows (exact)."""
    q = quantiles(df, cols, [C.OUTLIER_QUANTILES[0], 0.5, C.OUTLIER_QUANTILES[1]], **kw)
    out = {}
    for c in cols:
        q1, med, q3 = (q[c][C.OUTLIER_QUANTILES[0]], q[c][0.5], q[c][C.OUTLIER_QUANTILES[1]])
        if q1 is None:
            out[c] = {"q1": None, "median": None, "q3": None, "lo": None, "hi": None}
            continue
        iqr = q3 - q1
        out[c] = {"q1": q1, "median": med, "q3": q3, "lo": q1 - factor * iqr, "hi": q3 + factor * iqr}
    return out


def repair_outliers(df: DataFrame, cols: Sequence[str], fences: dict[str, dict] | None = None,
                    **kw) -> DataFrame:
    """FEA2: values outside the fences replaced by the column median (narrow)."""
    fences = fences or iqr_fences(df, cols, **kw)
    repl = {}
    for c in cols:
        f = fences[c]
        if f["lo"] is None:
            continue
        value = X.to_double(c)
        mask = X.outside_fences(value, F.lit(f["lo"]), F.lit(f["hi"]))
        repl[c] = X.overwrite(mask, F.lit(f["median"]), value)
    return df.withColumns(repl)


def boxplot_stats(df: DataFrame, cols: Sequence[str], factor: float = C.IQR_FACTOR,
                  fences: dict[str, dict] | None = None, **kw) -> DataFrame:
    """DIA7: quartiles, whiskers (extreme values inside the fences) and flier count; known
    ``fences`` of the same rows spare the search."""
    fences = fences or iqr_fences(df, cols, factor, **kw)
    aggs = []
    for i, c in enumerate(cols):
        f = fences[c]
        x = X.to_double(c)
        if f["lo"] is None:
            inside = F.lit(False)
        else:
            inside = (x >= F.lit(f["lo"])) & (x <= F.lit(f["hi"]))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"nf{i}")]
    stats = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        f = fences[c]
        lit = lambda v: F.lit(v).cast("double")
        parts.append(stats.select(
            F.lit(c).alias("column_name"), lit(f["q1"]).alias("q1"), lit(f["median"]).alias("median"),
            lit(f["q3"]).alias("q3"), lit(f["lo"]).alias("lo_fence"), lit(f["hi"]).alias("hi_fence"),
            F.col(f"wl{i}").alias("whisker_lo"), F.col(f"wh{i}").alias("whisker_hi"),
            F.col(f"nf{i}").cast("bigint").alias("n_fliers")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- FEA3: one-hot ---------------------------------------------------------------------

def onehot(df: DataFrame, col: str, categories: Sequence[str] | None = None,
           drop_first: bool = C.ONEHOT_DROP_FIRST, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """FEA3: sorted categories, first dropped, double columns ``{col}_{cat}``,
    source column removed.  Without ``categories`` one small distinct job fixes
    the output schema."""
    if categories is None:
        found = df.select(col).where(F.col(col).isNotNull()).distinct().collect()
        categories = [r[0] for r in found]
    cats = sorted(categories)
    if drop_first:
        cats = cats[1:]
    prefix = prefix or col
    names = [f"{prefix}_{c}" for c in cats]
    out = df.withColumns({n: F.when(F.col(col) == F.lit(c), 1.0).otherwise(0.0) for n, c in zip(names, cats)})
    return out.drop(col), names


# --- FEA4: standardisation (train statistics, population std) ---------------------------


# --- FEA5 / FEA6: splits and folds ------------------------------------------------------------

def add_split(df: DataFrame, key_cols: Sequence[str], seed: int = C.SPLIT_SEED,
              test_size: float = C.TEST_SIZE, col: str = "is_test") -> DataFrame:
    """FEA5 hash split: a row's side depends only on its key and the seed."""
    return df.withColumn(col, X.is_test_row(list(key_cols), seed, test_size))


def add_folds(df: DataFrame, key_cols: Sequence[str], seed: int = C.FOLD_SEED,
              k: int = C.N_FOLDS, col: str = "fold") -> DataFrame:
    """FEA6 hash folds."""
    return df.withColumn(col, X.fold_of(list(key_cols), seed, k))


def exact_split(df: DataFrame, key_cols: Sequence[str], seed: int = C.SPLIT_SEED,
                test_size: float = C.TEST_SIZE, within: Sequence[str] = (), k: int = C.N_FOLDS) -> DataFrame:
    """FEA5/FEA6 exact sizes: rows ordered by (hash, key) inside each group; the first
    ceil(test_size * n) are test rows; folds are contiguous rank ranges where the first
    n mod k folds take one extra row.  Adds split_rank (from 1), is_test and fold.

    Every row is ranked by the distributed rank (RNK1), so rows with equal keys have ranks
    of their own.  Groups are configuration, such as segments: their number bounds what
    reaches the driver."""
    keys = list(key_cols)
    # a null key counts as the empty text, and comes last among keys with its hash
    empty = int(md5(f"{seed}:".encode()).hexdigest()[:8], 16)
    hashed = df.withColumn("__h", F.coalesce(X.key_hash(keys, seed), F.lit(empty)))
    order = [F.col("__h"), *(F.col(c).asc_nulls_last() for c in keys)]
    ranked = global_rank(hashed, order, within=within, rank_col="split_rank")
    sizes = ranked.groupBy(*within).agg(F.count(F.lit(1)).alias("__n")).collect()
    is_test, fold, rank = F.lit(False), F.lit(0), F.col("split_rank")
    for row in sizes:
        member = F.lit(True)
        for c in within:
            member = member & F.col(c).eqNullSafe(F.lit(row[c]))
        test, *ends = _last_ranks(row["__n"], test_size, k)
        is_test = F.when(member, rank <= test + 1).otherwise(is_test)
        fold = F.when(member, sum(((rank > e + 1).cast("int") for e in ends), F.lit(0))).otherwise(fold)
    return ranked.withColumns({"is_test": is_test, "fold": fold.cast("int")}).drop("__h")


def _last_ranks(n: int, test_size: float, k: int) -> list[int]:
    """0-based ranks of the last test row and of the last row of each fold but the last
    (-1 where there is none)."""
    q, rest = divmod(n, k)
    return [math.ceil(n * test_size) - 1, *((f + 1) * q + min(f + 1, rest) - 1 for f in range(k - 1))]


# --- FEA7 / MTH2 -------------------------------------------------------------------------------

def with_logs(df: DataFrame, cols: Sequence[str], prefix: str = "log_") -> DataFrame:
    return df.withColumns({prefix + c: X.shifted_log(c) for c in cols})
