"""Grouped sufficient statistics: count, means and centred co-moments.

``grouped_moments`` is one hash aggregation (partial aggregation map-side, so
the shuffle carries one small row per group and task, whatever the skew of the
group key).  Its result has one row per group with O(k^2) doubles; only that
reaches the driver, where ``Moments`` objects are merged and solved.

Centred co-moments come from ``covar_pop`` (a streaming update merged with the
parallel formula), which avoids the cancellation of raw sums of products.
Uncentred moments, needed by no-intercept models and VIF, are recovered as
``C + n * m m'``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement
from typing import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from .gram import decode_group, pair_statistics



def _alias_mean(i: int) -> str:
    return f"__m{i}"


def _alias_cp(i: int, j: int) -> str:
    return f"__c{i}_{j}"


def moment_exprs(cols: Sequence[str]) -> list[Column]:
    exprs = [F.count(F.lit(1)).alias("__n")]
    exprs += [F.avg(F.col(c)).alias(_alias_mean(i)) for i, c in enumerate(cols)]
    exprs += [
        F.covar_pop(F.col(a), F.col(b)).alias(_alias_cp(i, j))
        for (i, a), (j, b) in combinations_with_replacement(list(enumerate(cols)), 2)
    ]
    return exprs


def grouped_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One aggregation: listwise-complete rows of ``cols`` (NaN counts as missing)."""
    cols = list(cols)
    clean = df.select(*by, *[X.nan_to_null(c).alias(c) for c in cols]).where(X.all_not_null(cols))
    return clean.groupBy(*by).agg(*moment_exprs(cols))


@dataclass
class Moments:
    names: list[str]
    n: float
    mean: np.ndarray
    cp: np.ndarray  # centred co-moments: sum (x_i - m_i)(x_j - m_j)

    @staticmethod
    def empty(names: Sequence[str]) -> "Moments":
        k = len(names)
        return Moments(list(names), 0.0, np.zeros(k), np.zeros((k, k)))

    @staticmethod
    def from_row(row, names: Sequence[str]) -> "Moments":
        k = len(names)
        n = float(row["__n"] or 0)
        mean = np.array([row[_alias_mean(i)] or 0.0 for i in range(k)], dtype=float)
        cp = np.zeros((k, k))
        for i, j in combinations_with_replacement(range(k), 2):
            v = row[_alias_cp(i, j)]
            cp[i, j] = cp[j, i] = (v or 0.0) * n
        return Moments(list(names), n, mean, cp)

    def merge(self, other: "Moments") -> "Moments":
        if other.n == 0:
            return self
        if self.n == 0:
            return other
        n = self.n + other.n
        delta = other.mean - self.mean
        mean = self.mean + delta * (other.n / n)
        cp = self.cp + other.cp + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(self.names, n, mean, cp)

    def index(self, names: Iterable[str]) -> list[int]:
        pos = {c: i for i, c in enumerate(self.names)}
        return [pos[c] for c in names]

    def sub(self, names: Sequence[str]) -> "Moments":
        idx = self.index(names)
        return Moments(list(names), self.n, self.mean[idx], self.cp[np.ix_(idx, idx)])

    def uncentred(self) -> np.ndarray:
        """sum x_i x_j."""
        return self.cp + self.n * np.outer(self.mean, self.mean)

    def var_pop(self) -> np.ndarray:
        return np.diag(self.cp) / self.n if self.n else np.full(len(self.names), np.nan)


def collect_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Listwise moments of one column list, by group (see ``collect_moments_multi``)."""
    out = collect_moments_multi(df, {"": cols}, by)[""]
    if not by and () not in out:       # a global aggregate always has its one row
        out[()] = Moments.empty(cols)
    return out


def merge_all(parts: Iterable[Moments], names: Sequence[str]) -> Moments:
    out = Moments.empty(names)
    for p in parts:
        out = out.merge(p)
    return out


def collect_moments_multi(df: DataFrame, lists: dict[str, Sequence[str]],
                          by: Sequence[str] = ()) -> dict[str, dict[tuple, Moments]]:
    """Moments for several column lists in one pass over the rows.

    Each list keeps its own listwise deletion, so models with different feature
    lists -- and their train, test and fold groups via ``by`` -- cost a single
    scan and two small shuffles of partials.  One path for every number of columns.
    """
    by, names = list(by), list(lists)
    types = [df.schema[b].dataType for b in by]
    out: dict[str, dict[tuple, Moments]] = {name: {} for name in names}
    for r in pair_statistics(df, [list(lists[x]) for x in names], by).collect():
        cols = list(lists[names[r["list"]]])
        k = len(cols)
        m = out[names[r["list"]]].setdefault(decode_group(r["g"], types), Moments(cols, r["n"], np.zeros(k), np.zeros((k, k))))
        i, j = r["i"], r["j"]
        m.mean[i], m.mean[j] = r["mean_i"], r["mean_j"]
        # a constant column's spread is exactly zero
        m.cp[i, j] = m.cp[j, i] = r["c"] if r["varies_i"] and r["varies_j"] else 0.0
    return out
