"""REG2, REG3, FEA8: least squares from a tall-skinny QR factorisation.

Normal equations square the condition number of the columns; the triangular factor R of
the rows does not.  Each task factors its rows batch by batch (the factor so far stacked
on the batch), so it holds one batch and one k x k factor for each group.  Factors are
stacked and factored again in a tree of two steps, each group's spread over ``FAN`` parts
first.  R keeps every inner product of the columns, so any of them can be regressed on
any others from it alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from .gram import group_key

FAN = 32
#: Singular values below this share of the largest (columns of unit norm) count as zero.
RANK_CUT = 1e-13
#: A residual sum of squares below this share of the column's is rounding: explained exactly.
EXACT = 1e-26
ONE = "__one"
_FACTOR = "g string, n long, r binary"


@dataclass
class Factor:
    """The triangular factor of the complete rows of some columns."""

    names: list[str]
    n: int
    r: np.ndarray

    def regress(self, target: str, features: Sequence[str]) -> tuple[np.ndarray, float, int]:
        """Coefficients (of least norm on columns of unit norm), residual sum of squares and
        rank of the regression of one column on others, no intercept added."""
        place = {c: i for i, c in enumerate(self.names)}
        a, y = self.r[:, [place[c] for c in features]], self.r[:, place[target]]
        if not len(features):
            return np.zeros(0), float(y @ y), 0
        norm = np.linalg.norm(a, axis=0)
        norm = np.where(norm > 0, norm, 1.0)
        coef, _, rank, _ = np.linalg.lstsq(a / norm, y, rcond=RANK_CUT)
        left = y - (a / norm) @ coef
        return coef / norm, float(left @ left), int(rank)

    def dot(self, a: str, b: str) -> float:
        """The inner product of two columns."""
        i, j = self.names.index(a), self.names.index(b)
        return float(self.r[:, i] @ self.r[:, j])


def factors(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> dict[str, Factor]:
    """The factor of each group (``group_key`` of ``by``; "" without) over its rows that are
    complete in all columns, NaN being missing; no entry for a group without one.  One pass;
    what reaches the driver is groups x k^2."""
    k = len(cols)
    picked = df.select(group_key(by).alias("g"), *[X.nan_to_null(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    rows = picked.where(X.all_not_null([f"c{i}" for i in range(k)]))

    def stacked(parts):
        return np.linalg.qr(np.vstack(parts), mode="r")

    def first(batches):
        held: dict[str, list] = {}
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], 1)
            kinds, of = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for i, g in enumerate(kinds.tolist()):
                own = x[of == i]
                n, r = held.get(g, (0, np.zeros((0, k))))
                held[g] = n + len(own), stacked([r, own])
        for g, (n, r) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(r, "<f8").tobytes()], pa.binary())], names=["g", "n", "r"])

    def merge(table: pa.Table) -> pa.Table:
        n, r = 0, np.zeros((0, k))
        for more, raw in zip(table.column("n").to_pylist(), table.column("r").to_pylist(), strict=True):
            n, r = n + more, stacked([r, np.frombuffer(raw, "<f8").reshape(-1, k)])
        return pa.table({"g": table.column("g").slice(0, 1), "n": pa.array([n], pa.int64()), "r": pa.array([np.ascontiguousarray(r, "<f8").tobytes()], pa.binary())})

    parts = rows.mapInArrow(first, _FACTOR).withColumn("part", F.pmod(F.xxhash64("r"), F.lit(FAN)))
    made = parts.groupBy("g", "part").applyInArrow(lambda t: merge(t.drop_columns(["part"])), _FACTOR).groupBy("g").applyInArrow(merge, _FACTOR)
    return {r["g"]: Factor(list(cols), r["n"], np.frombuffer(r["r"], "<f8").reshape(-1, k)) for r in made.collect()}


def factor(df: DataFrame, cols: Sequence[str]) -> Factor:
    """The factor of all rows."""
    return factors(df, cols).get("") or Factor(list(cols), 0, np.zeros((0, len(cols))))


def vifs(f: Factor, cols: Sequence[str]) -> np.ndarray:
    """FEA8 of ``cols`` from a factor that also holds the constant ``ONE``: each column is
    regressed on the others without an added intercept; R^2 is centred where the constant
    lies in their span.  +inf for a column explained exactly, NaN without rows."""
    out = np.full(len(cols), np.nan)
    if not f.n:
        return out
    for i, c in enumerate(cols):
        others = [o for o in cols if o != c]
        own = f.dot(c, c)
        _, left, _ = f.regress(c, others)
        if left <= EXACT * max(own, 1e-300):
            out[i] = np.inf
            continue
        _, constant, _ = f.regress(ONE, others)
        total = own - f.dot(c, ONE) ** 2 / f.n if constant <= 1e-9 * f.n else own
        out[i] = total / left
    return out
