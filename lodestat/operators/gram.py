"""Sufficient statistics of many columns from per-task numpy partials.

Every task centres its rows on their own means and turns them into co-moments: for a
pair of columns on the rows that have both (pair complete), or for a list of columns on
the rows that have all of them (listwise).  A value whose partner is missing never
enters the pair's sums, so it cannot spoil them.  A task's partials are merged with the
parallel update of means and co-moments; across tasks the same update is two
aggregations over the partials: the overall means, then each partial's co-moments plus
its mean's deviation from them.  Several column lists share one pass over the rows.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X
from ..session import materialize

_SEP = "\u0001"
_NULL = "\u0000"
_PARTIAL = ("list int, g string, i int, j int, n double, mi double, mj double, c double, vi double, vj double, "
            "lo_i double, hi_i double, lo_j double, hi_j double")


def group_key(by: Sequence[str]) -> Column:
    """One text column that tells the groups apart (nulls are a group)."""
    parts = [F.coalesce(F.col(b).cast("string"), F.lit(_NULL)) for b in by]
    return F.concat_ws(_SEP, *parts) if parts else F.lit("")


def _partials(lists: list[list[int]], listwise: bool):
    """The per-task function.  It is shipped to Python workers by value and refers to
    nothing but numpy, pandas and its own arguments, so the executors need no copy of
    this package."""

    def fn(batches):
        import numpy as np
        import pandas as pd

        def block(x):
            """n, means, co-moments, minimums and maximums of complete rows."""
            m = x.mean(axis=0)
            d = x - m
            return len(x), m, d.T @ d, x.min(axis=0), x.max(axis=0)

        def pairs(x):
            """(columns i, columns j, n, mi, mj, c, vi, vj, lo_i, hi_i, lo_j, hi_j) of each
            pair of sets of columns that are present on the same rows."""
            present = ~np.isnan(x)
            kinds, of = np.unique(present, axis=1, return_inverse=True)
            sets = [np.flatnonzero(of.ravel() == s) for s in range(kinds.shape[1])]
            for a in range(len(sets)):
                for b in range(a, len(sets)):
                    rows = kinds[:, a] & kinds[:, b]
                    if not rows.any():
                        continue
                    cols = sets[a] if a == b else np.concatenate([sets[a], sets[b]])
                    n, m, c, lo, hi = block(x[np.ix_(rows, cols)])
                    k = len(sets[a])
                    for p in range(k):
                        for q in range(p if a == b else k, len(cols)):
                            s, t = (p, q) if cols[p] <= cols[q] else (q, p)
                            yield (int(cols[s]), int(cols[t])), (n, m[s], m[t], c[s, t], c[s, s], c[t, t], lo[s], hi[s], lo[t], hi[t])

        acc = {}
        for pdf in batches:
            values = pdf.iloc[:, 1:].to_numpy(dtype=float, na_value=np.nan)
            codes, groups = pd.factorize(pdf.iloc[:, 0])
            for gi, g in enumerate(groups):
                own = values[codes == gi]
                for li, cols in enumerate(lists):
                    x = own[:, cols]  # pairs are numbered within the list
                    if listwise:
                        x = x[~np.isnan(x).any(axis=1)]
                    if not len(x):
                        continue
                    for ij, new in pairs(x):
                        old = acc.get((li, g, *ij))
                        if old:
                            n, m = old[0] + new[0], old[0] * new[0] / (old[0] + new[0])
                            di, dj = new[1] - old[1], new[2] - old[2]
                            new = (n, old[1] + di * new[0] / n, old[2] + dj * new[0] / n, old[3] + new[3] + di * dj * m,
                                   old[4] + new[4] + di * di * m, old[5] + new[5] + dj * dj * m,
                                   min(old[6], new[6]), max(old[7], new[7]), min(old[8], new[8]), max(old[9], new[9]))
                        acc[(li, g, *ij)] = new
        rows = [(*k, *map(float, v)) for k, v in acc.items()]
        if rows:        # an empty partition contributes nothing
            yield pd.DataFrame(rows)

    return fn


def pair_statistics(df: DataFrame, lists: Sequence[Sequence[str]], by: Sequence[str] = (), listwise: bool = True) -> DataFrame:
    """One row for each list, group and pair i <= j of its columns: n, mean_i, mean_j, the
    centred co-moment c, the spreads v_i and v_j, and whether i and j vary.

    The rows are read once; what is written is lists x groups x k^2 / 2 partials a task."""
    names = list(dict.fromkeys(c for cols in lists for c in cols))
    picked = df.select(group_key(by).alias("__g"), *[X.nan_to_null(c).alias(f"c{i}") for i, c in enumerate(names)])
    parts = materialize(picked.mapInPandas(_partials([[names.index(c) for c in cols] for cols in lists], listwise), _PARTIAL))
    key = ["list", "g", "i", "j"]
    w = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    total = parts.groupBy(*key).agg(w("mi").alias("mean_i"), w("mj").alias("mean_j"))
    di, dj = F.col("mi") - F.col("mean_i"), F.col("mj") - F.col("mean_j")
    return parts.join(total, key).groupBy(*key).agg(
        F.sum("n").alias("n"), F.first("mean_i").alias("mean_i"), F.first("mean_j").alias("mean_j"),
        F.sum(F.col("c") + F.col("n") * di * dj).alias("c"), F.sum(F.col("vi") + F.col("n") * di * di).alias("v_i"),
        F.sum(F.col("vj") + F.col("n") * dj * dj).alias("v_j"),
        (F.min("lo_i") < F.max("hi_i")).alias("varies_i"), (F.min("lo_j") < F.max("hi_j")).alias("varies_j"))


def decode_group(g: str, types: list[T.DataType]) -> tuple:
    """The values of ``by`` that ``group_key`` made a text of."""
    if not types:
        return ()
    vals = []
    for p, t in zip(g.split(_SEP), types):
        if p == _NULL:
            vals.append(None)
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            vals.append(int(p))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            vals.append(float(p))
        elif isinstance(t, T.BooleanType):
            vals.append(p == "true")
        else:
            vals.append(p)
    return tuple(vals)


def pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every pair on the rows where both are present;
    NaN where a column is constant on those rows."""
    k = len(cols)
    corr = np.full((k, k), np.nan)
    for r in pair_statistics(df, [list(cols)], listwise=False).collect():
        if r["varies_i"] and r["varies_j"] and r["v_i"] > 0 and r["v_j"] > 0:
            value = 1.0 if r["i"] == r["j"] else r["c"] / np.sqrt(r["v_i"]) / np.sqrt(r["v_j"])
            corr[r["i"], r["j"]] = corr[r["j"], r["i"]] = min(1.0, max(-1.0, value))
    return corr
