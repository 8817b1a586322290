"""Scalar column expressions (all JVM-side, inside whole-stage codegen).

"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- DAT: time ---------------------------------------------------------------

_EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def parse_timestamp(c: ColumnLike) -> Column:
    """DAT1: ISO text or a timestamp as a naive wall-clock timestamp.  Null stays null; other
    text is an error that names it, in any session mode and whatever the session's zone."""
    text = col(c)
    value = text.try_cast("timestamp_ntz")
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), text.cast("string")))
    return F.when(text.isNotNull() & value.isNull(), bad.cast("timestamp_ntz")).otherwise(value)


def floor_to_minutes(c: str, minutes: int = C.BUCKET_MINUTES) -> Column:
    """DAT2: epoch-aligned floor of a timestamp_ntz column to ``minutes``; null stays null.

    Uses exact microsecond arithmetic rather than ``window()`` so rows with a
    null timestamp survive (``window`` filters them out).
    """
    width = int(minutes) * 60 * 1_000_000
    return F.expr(
        f"timestampadd(MICROSECOND, floor(timestampdiff(MICROSECOND, {_EPOCH_NTZ}, {_sql_name(c)}) / {width}) * {width}, {_EPOCH_NTZ})"
    )


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def date_string(c: ColumnLike) -> Column:
    """Calendar date of a timestamp as ``yyyy-MM-dd`` text (the join key is text)."""
    return F.date_format(col(c), "yyyy-MM-dd")


def month_of(c: ColumnLike) -> Column:
    """DAT3: month number 1..12."""
    return F.month(col(c))


def season_of(month: ColumnLike) -> Column:
    """DAT4: month to season; null or any other month gives 'Other'."""
    m = col(month)
    return (
        F.when(m.isin(*C.WINTER_MONTHS), F.lit("Winter"))
        .when(m.isin(*C.SPRING_MONTHS), F.lit("Spring"))
        .otherwise(F.lit("Other"))
    )


# --- MTH / CNV ----------------------------------------------------------------

def shifted_log(c: ColumnLike, shift: float = C.LOG_SHIFT) -> Column:
    """MTH2: ln(x + shift); null when the argument is not positive."""
    return F.ln(col(c) + F.lit(shift))


def to_double(c: ColumnLike) -> Column:
    """CNV1: numeric coercion, bad text becomes null; NaN becomes null."""
    return nan_to_null(col(c).try_cast("double"))


def nan_to_null(c: ColumnLike) -> Column:
    """NaN means missing in the analysis; Spark treats NaN as a value (NaN > 1 is true)."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x.cast("double"))


# --- PRJ / FLT ----------------------------------------------------------------

def scaled_fraction(c: ColumnLike, scale: float = C.FOOD_SCALE, decimals: int = C.FOOD_DECIMALS) -> Column:
    """PRJ5: (x / scale) rounded half-even."""
    return F.bround(col(c) / F.lit(scale), decimals)


def product(*cols: ColumnLike) -> Column:
    """PRJ6: interaction term; null if any factor is null."""
    return reduce(lambda a, b: a * b, [col(c) for c in cols])


def as_flag(cond: Column) -> Column:
    """PRJ7 / FLT3: boolean to 0/1 with null counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def present(c: ColumnLike) -> Column:
    """FLT2: fillna(0) > 0."""
    return F.coalesce(col(c), F.lit(0)) > 0


def outside_fences(c: ColumnLike, lo: Column | float, hi: Column | float) -> Column:
    """FLT4: (x < lo) | (x > hi), null counted as false."""
    x = col(c)
    return F.coalesce((x < lo) | (x > hi), F.lit(False))


def overwrite(mask: Column, value: Column | float, c: ColumnLike) -> Column:
    """FLT5: value where mask holds, else the column."""
    return F.when(mask, value).otherwise(col(c))


def all_not_null(cols: Iterable[ColumnLike]) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols], F.lit(True))


# --- splits -------------------------------------------------------------------

HASH_SPACE = 1 << 32


def key_text(key_cols: list[str]) -> Column:
    """Text form of a (possibly composite) row key, parts joined by ':'."""
    if len(key_cols) == 1:
        return col(key_cols[0]).cast("string")
    return F.concat_ws(":", *[col(k).cast("string") for k in key_cols])


def key_hash(key_cols: list[str], seed: int) -> Column:
    """Unsigned 32-bit hash of ``seed:key`` (first 8 hex digits of md5).

    Deterministic for a row whatever the partition layout, and reproducible
    outside Spark (same bytes, same md5).
    """
    text = F.concat(F.lit(f"{seed}:"), key_text(key_cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def test_threshold(test_size: float) -> int:
    """Integer cut on the 32-bit hash: hash < threshold means test row."""
    return int(math.ceil(test_size * HASH_SPACE))


def is_test_row(key_cols: list[str], seed: int, test_size: float = C.TEST_SIZE) -> Column:
    """FEA5 (hash form): about ``test_size`` of the rows, fixed per key."""
    return key_hash(key_cols, seed) < F.lit(test_threshold(test_size))


def fold_of(key_cols: list[str], seed: int, k: int = C.N_FOLDS) -> Column:
    """FEA6 (hash form): fold id 0..k-1 from an independent hash."""
    return F.pmod(key_hash(key_cols, seed + 1_000_003), F.lit(k)).cast("int")


# --- inverse normal CDF (AS241, Wichura 1988) ---------------------------------
# The published PPND16 coefficients, lowest order first.
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
           2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _horner(coefs: list[float], r):
    acc = coefs[-1]
    for a in reversed(coefs[:-1]):
        acc = acc * r + a
    return acc


def normal_ppf(p: ColumnLike) -> Column:
    """Inverse standard normal CDF as a column expression (0 < p < 1).

    Self-contained but large: inside an aggregate prefer ``with_normal_ppf``,
    which computes the shared terms once as columns."""
    p = col(p)
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(AS241_A, r_c) / _horner(AS241_B, r_c)
    r_t = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    mid = _horner(AS241_C, r_t - F.lit(1.6)) / _horner(AS241_D, r_t - F.lit(1.6))
    far = _horner(AS241_E, r_t - F.lit(5.0)) / _horner(AS241_F, r_t - F.lit(5.0))
    tail = F.when(r_t <= 5.0, mid).otherwise(far)
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.when(q < 0, -tail).otherwise(tail))


def with_normal_ppf(df, p: str, out: str):
    """``normal_ppf`` in stages: q, r and the shifted tail variables become
    columns referenced by the polynomials, so the generated code stays linear
    in size (the one-expression form repeats its argument dozens of times and
    can exceed the JVM's 64 KB method limit inside an aggregation)."""
    q, rc, rt = F.col("__ppf_q"), F.col("__ppf_rc"), F.col("__ppf_rt")
    staged = df.withColumn("__ppf_q", F.col(p) - F.lit(0.5))
    staged = staged.withColumn("__ppf_rc", F.lit(0.180625) - q * q) \
        .withColumn("__ppf_rt", F.sqrt(-F.ln(F.least(F.col(p), F.lit(1.0) - F.col(p)))))
    staged = staged.withColumn("__ppf_r1", rt - F.lit(1.6)).withColumn("__ppf_r5", rt - F.lit(5.0))
    r1, r5 = F.col("__ppf_r1"), F.col("__ppf_r5")
    central = q * _horner(AS241_A, rc) / _horner(AS241_B, rc)
    tail = F.when(rt <= 5.0, _horner(AS241_C, r1) / _horner(AS241_D, r1)) \
        .otherwise(_horner(AS241_E, r5) / _horner(AS241_F, r5))
    value = F.when(F.abs(q) <= 0.425, central).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return staged.withColumn(out, value).drop("__ppf_q", "__ppf_rc", "__ppf_rt", "__ppf_r1", "__ppf_r5")


def normal_ppf_sql(p: str) -> str:
    """The same AS241 formula as SQL text (for oracles); ``p`` is an SQL expression."""

    def horner(coefs, r):
        acc = repr(coefs[-1])
        for a in reversed(coefs[:-1]):
            acc = f"(({acc}) * ({r}) + {a!r})"
        return acc

    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    rt = f"sqrt(-ln(least({p}, 1.0 - ({p}))))"
    central = f"({q} * {horner(AS241_A, rc)} / {horner(AS241_B, rc)})"
    mid = f"({horner(AS241_C, f'{rt} - 1.6')} / {horner(AS241_D, f'{rt} - 1.6')})"
    far = f"({horner(AS241_E, f'{rt} - 5.0')} / {horner(AS241_F, f'{rt} - 5.0')})"
    tail = f"(CASE WHEN {rt} <= 5.0 THEN {mid} ELSE {far} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def normal_ppf_scalar(p: float) -> float:
    """Driver-side scalar version (same formula)."""
    q = p - 0.5
    if abs(q) <= 0.425:
        r = 0.180625 - q * q
        return q * _horner(AS241_A, r) / _horner(AS241_B, r)
    r = math.sqrt(-math.log(min(p, 1.0 - p)))
    if r <= 5.0:
        x = _horner(AS241_C, r - 1.6) / _horner(AS241_D, r - 1.6)
    else:
        x = _horner(AS241_E, r - 5.0) / _horner(AS241_F, r - 5.0)
    return -x if q < 0 else x


def rounded(c: ColumnLike, decimals: int = C.OUT_DECIMALS) -> Column:
    """Output rounding of doubles (half-up, as DuckDB ``round``); adding 0.0
    turns a negative zero into 0.0 so equal values hash equally."""
    return F.round(col(c).cast("double"), decimals) + F.lit(0.0)
