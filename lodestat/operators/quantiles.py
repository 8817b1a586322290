"""AGG4 / AGG5: exact quantiles with linear interpolation by radix selection, without
ever gathering a whole column in one task or on the driver.

Spark's exact ``percentile`` keeps a value->count map of the whole column in the final
task of a global aggregate, which does not survive large inputs.  Here each double is
mapped to an unsigned 64-bit key in the same order (its bits, with the sign bit flipped,
or all bits if it is negative), and the wanted ranks of all columns are selected digit by
digit: a pass counts the next digit's values among the keys that share a wanted rank's
prefix, and the digit that holds the rank extends the prefix.  So every search ends after
at most ``ceil(64 / bits)`` passes (6 by default), whatever the values, infinities and
the widest ranges included.  A prefix whose keys are all equal is settled early, so a hot
value or a column of few values takes a pass or two.

What a task passes on is bounded: columns x open prefixes x 2^bits counts, with the least
and greatest key of each.  No other value reaches the driver, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X

BITS = 11
_SIGN = np.uint64(1 << 63)
_HISTOGRAM = "ci int, pi int, digit int, n long, lo long, hi long"


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the doubles (both zeros have one key)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_key(key: int) -> float:
    """The double of a key."""
    k = np.uint64(key)
    return float(np.array([k ^ _SIGN if k & _SIGN else ~k], np.uint64).view(np.float64)[0])


@dataclass
class _Prefix:
    key: int            # the digits known so far
    base: int           # number of keys below those with this prefix
    ranks: list[int] = field(default_factory=list)   # wanted 0-based ranks inside


def _histograms(df: DataFrame, names: Sequence[str], prefixes: dict[int, list[int]], known: int, bits: int) -> dict:
    """{(column, prefix): [(digit, n, least key, greatest key), ...] by digit} of the digit
    of ``bits`` bits after the first ``known`` bits, in one pass."""
    shift = 64 - known - bits
    size = 1 << bits
    keys_of, sign = sortable, _SIGN

    def run(batches):
        n = {c: np.zeros((len(ps), size), np.int64) for c, ps in prefixes.items()}
        lo = {c: np.full((len(ps), size), ~np.uint64(0)) for c, ps in prefixes.items()}
        hi = {c: np.zeros((len(ps), size), np.uint64) for c, ps in prefixes.items()}
        for b in batches:
            for c, ps in prefixes.items():
                column = b.column(c)
                keys = keys_of(column.filter(column.is_valid()).to_numpy(zero_copy_only=False).astype(np.float64))
                for i, p in enumerate(ps):
                    own = keys if not known else keys[(keys >> np.uint64(64 - known)) == np.uint64(p)]
                    digit = ((own >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
                    n[c][i] += np.bincount(digit, minlength=size)
                    np.minimum.at(lo[c][i], digit, own)
                    np.maximum.at(hi[c][i], digit, own)
        for c, ps in prefixes.items():
            for i in range(len(ps)):
                at = np.flatnonzero(n[c][i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), c, np.int32)), pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[c][i][at]),
                     # as signed longs in the same order
                     pa.array((lo[c][i][at] ^ sign).view(np.int64)), pa.array((hi[c][i][at] ^ sign).view(np.int64))],
                    names=["ci", "pi", "digit", "n", "lo", "hi"])

    picked = df.select(*[X.nan_to_null(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = picked.mapInArrow(run, _HISTOGRAM).groupBy("ci", "pi", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["digit"]):
        out.setdefault((r["ci"], r["pi"]), []).append((r["digit"], r["n"], (r["lo"] + (1 << 63)), (r["hi"] + (1 << 63))))
    return out


def order_statistics(df: DataFrame, cols: Sequence[str], wanted, bits: int = BITS) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Per column the number of values (nulls and NaN are none) and the exact values at the
    0-based ranks ``wanted(n)`` in ascending order.  ``wanted`` is asked once for each column,
    after the first pass has counted it."""
    names = list(cols)
    counts = {c: 0 for c in names}
    result: dict[str, dict[int, float]] = {c: {} for c in names}
    open_: dict[int, list[_Prefix]] = {i: [_Prefix(0, 0)] for i in range(len(names))}
    known = 0
    while open_ and known < 64:
        width = min(bits, 64 - known)
        table = _histograms(df, names, {ci: [p.key for p in ps] for ci, ps in open_.items()}, known, width)
        following: dict[int, list[_Prefix]] = {}
        for ci, ps in open_.items():
            for pi, p in enumerate(ps):
                digits = table.get((ci, pi), [])
                if not known:
                    counts[names[ci]] = n = sum(d[1] for d in digits)
                    p.ranks = sorted({r for r in wanted(n) if 0 <= r < n})
                base, ranks = p.base, p.ranks
                for digit, n, lo, hi in digits:
                    inside = [r for r in ranks if base <= r < base + n]
                    if inside and lo == hi:
                        result[names[ci]].update(dict.fromkeys(inside, from_key(lo)))
                    elif inside:
                        following.setdefault(ci, []).append(_Prefix(p.key << width | digit, base, inside))
                    base += n
        open_, known = following, known + width
    return counts, result


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bits: int = BITS) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles (pandas ``quantile``, SQL ``quantile_cont``); None for
    a column without values.  NaN counts as missing; infinities are values."""
    def places(n: int) -> list[tuple[int, int, float]]:
        out = []
        for p in probs:
            h = p * (n - 1)
            lo = int(math.floor(h))
            out.append((lo, min(lo + 1, n - 1), h - lo))
        return out

    counts, found = order_statistics(df, cols, lambda n: [r for lo, hi, _ in places(n) for r in (lo, hi)] if n else [], bits)
    return {c: {p: _between(found[c][lo], found[c][hi], part) for p, (lo, hi, part) in zip(probs, places(counts[c]), strict=True)}
            if counts[c] else dict.fromkeys(probs) for c in cols}


def _between(a: float, b: float, part: float) -> float:
    if a == b or not part:
        return a
    # the difference of two finite doubles may be beyond the largest one
    return a + (b - a) * part if math.isfinite(b - a) else a * (1 - part) + b * part
