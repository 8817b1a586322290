"""DIA1-12: residual diagnostics and the tables behind the charts.

Per-group statistics (min, max, n, std) are one row per group -- groups are
model segments, a configured, bounded set -- and are joined back by key (AQE
broadcasts them once their size is measured).
Nothing here gathers the rows of a group in one task: histograms and density
curves are partial aggregates, QQ positions come from the distributed rank,
and Durbin-Watson pairs neighbours inside the ranked partitions.
"""

from __future__ import annotations

import math
from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import columns as X
from .gram import decode_group, group_key
from .ranking import global_rank


def _attach(data: DataFrame, stats: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per-group statistics onto rows: an equi-join on the group key (one row
    per group; AQE broadcasts it after measuring its size, which is a handful
    of rows for model segments), or scalar subqueries when there is no group."""
    if by:
        return data.join(stats.select(*by, *cols), list(by))
    return data.withColumns({c: stats.select(c).scalar() for c in cols})



def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = C.HIST_BINS) -> DataFrame:
    """DIA3: ``bins`` equal-width bins from min to max, the last bin closed;
    empty bins are kept with count 0.  Output (by..., bin, bin_lo, bin_hi, count)."""
    by = list(by)
    x = F.col(value)
    data = df.where(x.isNotNull())
    stats = data.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo"))
    idx = F.least(F.floor((x - F.col("__lo")) / width * F.lit(bins)) + 1, F.lit(bins))
    idx = F.when(width > 0, idx).otherwise(F.lit(1)).cast("int")
    joined = _attach(data, stats, by, ["__lo", "__hi"])
    counts = joined.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(*by, "__lo", "__hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    w = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return (grid.join(counts, [*by, "bin"], "left")
            .select(*by, F.col("bin").cast("bigint").alias("bin"),
                    (F.col("__lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                    (F.col("__lo") + F.col("bin") * w).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def bin_counts_2d(df: DataFrame, x: str, y: str, by: Sequence[str] = (), bins: int = C.HIST_BINS) -> DataFrame:
    """DIA2 at scale: the scatter of (x, y) as counts on a bins x bins grid
    spanning each group's ranges (same edge rule as ``histogram``).  Only
    non-empty cells are returned: (by..., bx, by_, count)."""
    by = list(by)
    return _grid(df, x, y, by, bins).groupBy(*by, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def _grid(df: DataFrame, x: str, y: str, by: list[str], bins: int) -> DataFrame:
    """The rows that have both values, with the cell (from 1) of their group's grid."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = data.groupBy(*by).agg(F.min(x).alias("__xlo"), F.max(x).alias("__xhi"),
                                  F.min(y).alias("__ylo"), F.max(y).alias("__yhi"))
    joined = _attach(data, stats, by, ["__xlo", "__xhi", "__ylo", "__yhi"])

    def index(v, lo, hi):
        w = F.col(hi) - F.col(lo)
        i = F.least(F.floor((F.col(v) - F.col(lo)) / w * F.lit(bins)) + 1, F.lit(bins))
        return F.when(w > 0, i).otherwise(F.lit(1)).cast("bigint")

    return joined.withColumns({"bin_x": index(x, "__xlo", "__xhi"), "bin_y": index(y, "__ylo", "__yhi")})


def scatter_sample(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = (), bins: int = C.HIST_BINS,
                   k: int = C.SCATTER_EACH, seed: int = C.SPLIT_SEED) -> DataFrame:
    """DIA2 / DIA8 / DIA9 for any number of rows: of each cell of the ``bins`` x ``bins`` grid
    (see ``bin_counts_2d``) the ``k`` points of smallest (key hash, key), and the cell's number
    of points.  Output (by..., bin_x, bin_y, count, key, x, y), at most bins^2 * k rows a group.

    The sample is mergeable: a task keeps the ``k`` smallest of each cell that it meets and
    passes on those, with its count, so only cells x k x tasks rows are shuffled."""
    by = list(by)
    cells = _grid(df, x, y, by, bins)
    picked = cells.select(*[F.col(b).cast("string").alias(b) for b in by], "bin_x", "bin_y", X.key_hash([key], seed).alias("__h"),
                          F.col(key).cast("bigint").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    names = picked.columns
    cell, order = [*by, "bin_x", "bin_y"], ["__h", "key"]

    def smallest(batches):
        import pandas as pd

        def trimmed(parts):
            made = pd.concat(parts, ignore_index=True)
            made["__n"] = made.groupby(cell, dropna=False)["__n"].transform("sum")
            made = made.sort_values([*cell, *order], kind="stable").groupby(cell, dropna=False, sort=False).head(k)
            made.loc[made.duplicated(cell), "__n"] = 0  # the cell's count stands on its first row
            return made

        held = None
        for b in batches:
            own = b.to_pandas().assign(__n=1)
            held = trimmed([own] if held is None else [held, own])
        if held is not None:
            yield pa.RecordBatch.from_pandas(held[[*names, "__n"]], preserve_index=False)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields), "__n bigint"])
    some = picked.mapInArrow(smallest, schema)
    per_cell = Window.partitionBy(*cell)
    ranked = some.select("*", F.sum("__n").over(per_cell).alias("count"), F.row_number().over(per_cell.orderBy(*order)).alias("__r"))
    return ranked.where(F.col("__r") <= k).select(*cell, "count", "key", "x", "y")


KDE_CUT = 40.0   # bandwidths; exp(-0.5 * 40^2) underflows to 0.0
#: Cells of this many bandwidths, and terms of the expansion about a cell's centre.
KDE_CELL, KDE_TERMS = 0.5, 16


def kde_curve(df: DataFrame, value: str, by: Sequence[str] = (), grid: int = C.KDE_GRID,
              bins: int = C.HIST_BINS) -> DataFrame:
    """DIA4: Gaussian kernel density with Scott's bandwidth h = n^(-1/5) * sample std,
    on ``grid`` points from min to max, also scaled to histogram counts
    (n * bin width).

    No row meets a grid point.  Rows are aggregated to cells of h / 2: a cell keeps the
    power sums of u = (x - centre) / h, and at a point t bandwidths from the centre the sum
    of the cell's kernels is exp(-t^2 / 2) * sum_k He_k(t) * sum(u^k) / k!, He_k being the
    Hermite polynomials.  As |u| <= 1/4 and |He_k(t)| exp(-t^2 / 2) <= 1.09 sqrt(k!), the
    terms left out come to less than 1e-16 of a row's kernel.  A cell meets the points
    within ``KDE_CUT`` bandwidths, beyond which the kernel is 0.0 in double precision."""
    by = list(by)
    x = F.col(value)
    data = df.where(x.isNotNull())
    stats = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp(value).alias("__sd"),
        F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    stats = stats.withColumn("__h", F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.col("__sd")).where(F.col("__h") > 0)
    joined = _attach(data, stats, by, ["__lo", "__h"])
    cell = F.floor((x - F.col("__lo")) / (F.col("__h") * F.lit(KDE_CELL)))
    u = (x - F.col("__lo")) / F.col("__h") - (F.col("__cell") + F.lit(0.5)) * F.lit(KDE_CELL)
    placed = joined.select(*by, x, "__lo", "__h", cell.alias("__cell")).select(*by, "__cell", u.alias("__u"))
    powers, power = [], F.lit(1.0)
    for _ in range(KDE_TERMS):
        powers.append(F.sum(power))
        power = power * F.col("__u")
    cells = placed.groupBy(*by, "__cell").agg(F.array(*powers).alias("__m"))
    cells = _attach(cells, stats, by, ["__lo", "__hi", "__h"])
    step = (F.col("__hi") - F.col("__lo")) / F.lit(grid - 1)
    centre = F.col("__lo") + (F.col("__cell") + F.lit(0.5)) * F.lit(KDE_CELL) * F.col("__h")
    reach = F.lit(KDE_CUT + KDE_CELL) * F.col("__h")
    first = F.greatest(F.lit(0), F.ceil((centre - reach - F.col("__lo")) / step).cast("int"))
    last = F.least(F.lit(grid - 1), F.floor((centre + reach - F.col("__lo")) / step).cast("int"))
    met = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    pts = cells.select(*by, "__m", "__lo", "__h", centre.alias("__c"), step.alias("__step"), F.explode(met).alias("point"))
    t = (F.col("__lo") + F.col("point") * F.col("__step") - F.col("__c")) / F.col("__h")
    # He_k+1 = t He_k - k He_k-1, carried along with 1 / k!
    state = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("he"), F.lit(0.0).alias("before"), F.lit(0.0).alias("k"), F.lit(1.0).alias("f"))
    series = F.aggregate("__m", state, lambda a, m: F.struct(
        (a["s"] + a["he"] * a["f"] * m).alias("s"), (F.col("__t") * a["he"] - a["k"] * a["before"]).alias("he"), a["he"].alias("before"),
        (a["k"] + F.lit(1.0)).alias("k"), (a["f"] / (a["k"] + F.lit(1.0))).alias("f")))["s"]
    pts = pts.withColumn("__t", t)
    sums = pts.groupBy(*by, "point").agg(F.sum(F.exp(F.lit(-0.5) * F.col("__t") * F.col("__t")) * series).alias("__s"))
    # every grid point of every group with a usable bandwidth; a point that no cell
    # reaches has density exactly 0, and so has one where the series rounds below it
    grid_pts = stats.select(*by, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    sums = grid_pts.join(sums, [*by, "point"], "left").withColumn("__s", F.greatest(F.coalesce(F.col("__s"), F.lit(0.0)), F.lit(0.0)))
    out = _attach(sums, stats, by, ["__n", "__h", "__lo", "__hi"])
    dens = F.col("__s") / (F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi)))
    binw = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return out.select(*by, F.col("point").cast("bigint").alias("point"),
                      (F.col("__lo") + F.col("point") * (F.col("__hi") - F.col("__lo")) / F.lit(grid - 1)).alias("x"),
                      dens.alias("density"), (dens * F.col("__n") * binw).alias("density_count"))


def qq_points(df: DataFrame, value: str, key_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """DIA6: ordered values against normal quantiles at Filliben's positions.
    Output (by..., rank, theoretical, sample)."""
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, *key_cols, value)
    ranked = global_rank(data, [value, *key_cols], within=by, rank_col="rank")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = _attach(ranked, sizes, by, ["__n"])
    n, i = F.col("__n").cast("double"), F.col("rank").cast("double")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    pos = (F.when(F.col("rank") == F.col("__n"), last)
           .when(F.col("rank") == 1, F.lit(1.0) - last)
           .otherwise((i - F.lit(0.3175)) / (n + F.lit(0.365))))
    staged = X.with_normal_ppf(ranked.withColumn("__pos", pos), "__pos", "theoretical")
    return staged.select(*by, "rank", "theoretical", F.col(value).alias("sample"))


def qq_line(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """DIA6 line: least-squares fit of sample on theoretical, and r (null
    when either side is constant, where ``corr`` would divide by zero)."""
    agg = points.groupBy(*by).agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.covar_pop("sample", "theoretical").alias("__c"),
        F.stddev_pop("sample").alias("__ss"), F.stddev_pop("theoretical").alias("__st"),
        F.count(F.lit(1)).alias("n"))
    den = F.col("__ss") * F.col("__st")
    return agg.select(*by, "slope", "intercept", F.when(den > 0, F.col("__c") / den).alias("r"), "n")


_DW_OUT = T.StructType([
    T.StructField("pid", T.IntegerType()), T.StructField("g", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("sse", T.DoubleType()), T.StructField("sdd", T.DoubleType()),
    T.StructField("first_r", T.LongType()), T.StructField("first_e", T.DoubleType()),
    T.StructField("last_r", T.LongType()), T.StructField("last_e", T.DoubleType()),
])


def _dw_partials():
    """Per partition of the ranked frame (rows in rank order): per group the
    count, sum e^2, sum of squared neighbour differences inside the
    partition, and the first/last (rank, e) for the partition-boundary pairs.
    Shipped by value; refers only to numpy and pandas."""

    def fn(batches):
        import numpy as np
        import pandas as pd
        acc = {}
        order = []
        prev_g, prev_e, pid = None, None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pid = int(pdf["__pid"].iloc[0])
            g = pdf["__g"].to_numpy()
            e = pdf["__e"].to_numpy(dtype=float)
            r = pdf["__r"].to_numpy(dtype=np.int64)
            pg = np.concatenate([[prev_g], g[:-1]]) if prev_g is not None else np.concatenate([[None], g[:-1]])
            pe = np.concatenate([[prev_e if prev_e is not None else np.nan], e[:-1]])
            same = (g == pg)
            d2 = np.where(same, (e - pe) ** 2, 0.0)
            for key in pd.unique(g):
                m = g == key
                st = acc.get(key)
                if st is None:
                    idx = np.flatnonzero(m)[0]
                    st = acc[key] = [0, 0.0, 0.0, int(r[idx]), float(e[idx]), 0, 0.0]
                    order.append(key)
                st[0] += int(m.sum())
                st[1] += float((e[m] ** 2).sum())
                st[2] += float(d2[m].sum())
                last = np.flatnonzero(m)[-1]
                st[5], st[6] = int(r[last]), float(e[last])
            prev_g, prev_e = g[-1], e[-1]
        rows = [(pid, k, *acc[k]) for k in order]
        if rows:        # an empty partition contributes nothing
            yield pd.DataFrame(rows, columns=["pid", "g", "n", "sse", "sdd", "first_r", "first_e", "last_r", "last_e"])

    return fn


def durbin_watson(df: DataFrame, value: str, order_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """DIA5: sum (e_t - e_{t-1})^2 / sum e_t^2 in row order, per group.

    The distributed rank leaves contiguous, sorted runs in its partitions, so
    neighbours are paired inside each partition by one vectorised pass (no
    shuffle); only the pairs that straddle two partitions are joined on the
    driver from one summary row per (partition, group)."""
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, *order_cols, value)
    ranked = global_rank(data, list(order_cols), within=by, rank_col="__r")
    tagged = ranked.select(F.spark_partition_id().alias("__pid"),
                           group_key(by).alias("__g"), "__r", F.col(value).cast("double").alias("__e"))
    parts = tagged.mapInPandas(_dw_partials(), _DW_OUT).collect()
    per_group: dict[str, list] = {}
    for p in sorted(parts, key=lambda p: (p["g"], p["first_r"])):
        per_group.setdefault(p["g"], []).append(p)
    types = [df.schema[b].dataType for b in by]
    rows = []
    for g, chunks in per_group.items():
        n = sum(c["n"] for c in chunks)
        sse = sum(c["sse"] for c in chunks)
        sdd = sum(c["sdd"] for c in chunks)
        for a, b in zip(chunks, chunks[1:]):
            if b["first_r"] == a["last_r"] + 1:
                sdd += (b["first_e"] - a["last_e"]) ** 2
        key = decode_group(g, types)
        rows.append((*key, int(n), sdd / sse if sse > 0 else None))
    schema = T.StructType([*[T.StructField(b, t) for b, t in zip(by, types)],
                           T.StructField("n", T.LongType()), T.StructField("durbin_watson", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)
