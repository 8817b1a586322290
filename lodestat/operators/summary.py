"""REG8: regression summary of a least-squares fit without intercept.

The complete rows are written once to the checkpoint folder (narrow: order
key, features, target); then three jobs read them: the Gram aggregation, one
residual moment aggregation (count, SSR, skewness, kurtosis, with the
coefficients as literals), and the Durbin-Watson pass (distributed rank +
neighbour join).
Everything else is k x k algebra and scalar tail probabilities on the driver.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..session import materialize
from .diagnostics import durbin_watson
from .linalg import SweptGram, _pinv_solve, condition_number, ols_no_intercept
from .moments import collect_moments
from .regression import predict


# --- scalar special functions (driver side) -------------------------------------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the continued fraction does not converge at a={a}, b={b}, x={x}")


def _lgamma_ratio(a: float, b: float) -> float:
    """ln Gamma(a + b) - ln Gamma(a); for large a by the difference of their Stirling
    series, as the values themselves cancel."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    s = a + b
    tail = sum(c * (s ** -p - a ** -p) for p, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260)))
    return (a - 0.5) * math.log1p(b / a) + b * math.log(s) - b + tail


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where that is known better
    than the subtraction would give it."""
    y = 1.0 - x if y is None else y
    if x <= 0 or y >= 1:
        return 0.0
    if x >= 1 and y <= 0:
        return 1.0
    ratio = _lgamma_ratio(a, b) - math.lgamma(b) if a >= b else _lgamma_ratio(b, a) - math.lgamma(a)
    front = math.exp(ratio + a * (math.log1p(-y) if y < 0.5 else math.log(x)) + b * (math.log(y) if y < 0.5 else math.log1p(-x)))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, y) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    if not math.isfinite(t):
        return 0.0 if t > 0 else 1.0
    if df >= 1e5:
        # Hill's normal deviate of t (G. W. Hill, Student's t-distribution, CACM 13, 1970);
        # the terms left out are below 1e-20 here, where the continued fraction loses digits
        w = math.sqrt((df - 0.5) * math.log1p(t * t / df))
        tail = 0.5 * math.erfc((w + (w ** 3 + 3 * w) / (48 * (df - 0.5) ** 2)) / math.sqrt(2))
        return tail if t >= 0 else 1.0 - tail
    x, y = df / (df + t * t), t * t / (df + t * t)
    # beyond the mean the small tail itself is summed, not one minus the rest
    p = 0.5 * betainc(df / 2.0, 0.5, x, y)
    return p if t >= 0 else 1.0 - p


def t_ppf(q: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 1.0 - t_sf(mid, df) < q:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def skewtest_z(skew: float, n: float) -> float:
    """D'Agostino's transform of sample skewness to a normal score."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = y if y != 0 else 1.0
    return delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))


def kurtosistest_z(kurt_pearson: float, n: float) -> float:
    """Anscombe-Glynn transform of sample (Pearson) kurtosis to a normal score."""
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (kurt_pearson - e) / math.sqrt(varb2)
    sqrtbeta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sqrtbeta1 * (2.0 / sqrtbeta1 + math.sqrt(1 + 4.0 / sqrtbeta1 ** 2))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * math.sqrt(2 / (a - 4.0))
    if denom == 0:
        return float("nan")
    term2 = math.copysign(1.0, denom) * ((1 - 2.0 / a) / abs(denom)) ** (1 / 3.0)
    return (term1 - term2) / math.sqrt(2 / (9.0 * a))


# --- the summary ----------------------------------------------------------------------

def ols_summary_values(df: DataFrame, features: Sequence[str], target: str,
                       order_cols: Sequence[str] = ()) -> dict:
    return ols_summaries(df, {"model": features}, target, order_cols)["model"]


def ols_summaries(df: DataFrame, models: dict[str, Sequence[str]], target: str, order_cols: Sequence[str] = ()) -> dict:
    """The summary fields of several models on the rows that are complete in all their
    columns: the rows are written once, and one moments pass, one residual pass and one
    ranked pass (Durbin-Watson) serve all models."""
    cols = list(dict.fromkeys([c for feats in models.values() for c in feats] + [target]))
    df = materialize(df.select(*order_cols, *cols).where(X.all_not_null(cols)), key=list(order_cols) or None)
    m = collect_moments(df, cols)[()]
    fits = {name: ols_no_intercept(m, list(feats), target) for name, feats in models.items()}
    scored = {name: F.col(target) - predict(f) for name, f in fits.items() if f.n > len(models[name])}
    shapes, dws = {}, {}
    if scored:
        aggs = {"n": lambda e: F.count(e), "ssr": lambda e: F.sum(e * e), "skew": F.skewness, "kurt": F.kurtosis}
        row = df.agg(*[f(e).alias(f"{stat}{i}") for i, e in enumerate(scored.values()) for stat, f in aggs.items()]).first()
        shapes = {name: {stat: row[f"{stat}{i}"] for stat in aggs} for i, name in enumerate(scored)}
    if scored and order_cols:
        errors = F.array(*[F.struct(F.lit(name).alias("__model"), e.alias("__e")) for name, e in scored.items()])
        found = durbin_watson(df.select(*order_cols, F.inline(errors)), "__e", list(order_cols), by=["__model"]).collect()
        dws = {r["__model"]: r["durbin_watson"] for r in found}
    return {name: _summary(m, fits[name], list(models[name]), target, shapes.get(name), dws.get(name)) for name in models}


def _summary(m, fit, feats: list[str], target: str, rm: dict | None, dw: float | None) -> dict:
    """The fields of one model from the moments, the fit and its residuals' moments."""
    n = fit.n
    if rm is None:      # nothing to estimate: every field is undefined
        nan = float("nan")
        model = dict.fromkeys(["n", "df_model", "df_resid", "r2", "adj_r2", "f_stat", "f_pvalue", "log_likelihood",
                               "aic", "bic", "omnibus", "omnibus_p", "skew", "kurtosis", "jarque_bera",
                               "jarque_bera_p", "durbin_watson", "cond_no"], nan)
        model["n"] = n
        terms = {c: dict.fromkeys(["coef", "std_err", "t", "p_value", "ci_low", "ci_high"], nan) for c in feats}
        return {"model": model, "terms": terms}
    gram = fit.extra["gram"]
    ssr = float(rm["ssr"])
    yty = fit.extra["yty"]
    has_const = SweptGram(m, feats).spans_constant()
    k_const = 1 if has_const else 0
    tss = m.sub([target]).cp[0, 0] if has_const else yty
    df_resid = n - fit.rank
    df_model = fit.rank - k_const
    r2 = 1 - ssr / tss if tss > 0 else float("nan")
    adj = 1 - (n - k_const) / df_resid * (1 - r2)
    ess = tss - ssr
    fval = (ess / df_model) / (ssr / df_resid) if df_model > 0 and ssr > 0 else float("nan")
    # a perfect fit has no finite likelihood, and so no information criteria
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else float("nan")
    inv, _ = _pinv_inverse(gram)
    cov = ssr / df_resid * inv
    se = np.sqrt(np.diag(cov))
    tq = t_ppf(0.975, df_resid)
    nan = float("nan")
    skew = nan if rm["skew"] is None else float(rm["skew"])
    kurt = nan if rm["kurt"] is None else float(rm["kurt"]) + 3.0
    # the normality transforms are not defined below eight rows
    zs, zk = (skewtest_z(skew, n), kurtosistest_z(kurt, n)) if n >= 8 and math.isfinite(skew) else (nan, nan)
    omni = zs * zs + zk * zk
    jb = n / 6.0 * (skew ** 2 + (kurt - 3) ** 2 / 4.0)
    model = {
        "n": n, "df_model": float(df_model), "df_resid": float(df_resid), "r2": r2, "adj_r2": adj,
        "f_stat": fval, "f_pvalue": f_sf(fval, df_model, df_resid) if df_model > 0 and ssr > 0 else float("nan"),
        "log_likelihood": llf, "aic": -2 * llf + 2 * fit.rank, "bic": -2 * llf + fit.rank * math.log(n),
        "omnibus": omni, "omnibus_p": math.exp(-omni / 2.0), "skew": skew, "kurtosis": kurt,
        "jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2.0), "durbin_watson": dw,
        "cond_no": condition_number(gram),
    }
    terms = {}
    for i, c in enumerate(feats):
        t = fit.coef[i] / se[i] if se[i] > 0 else float("nan")
        terms[c] = {"coef": float(fit.coef[i]), "std_err": float(se[i]), "t": float(t),
                    "p_value": 2 * t_sf(abs(t), df_resid) if not math.isnan(t) else nan, "ci_low": float(fit.coef[i] - tq * se[i]),
                    "ci_high": float(fit.coef[i] + tq * se[i])}
    return {"model": model, "terms": terms}


def _pinv_inverse(a: np.ndarray):
    k = a.shape[0]
    cols = [_pinv_solve(a, np.eye(k)[:, j])[0] for j in range(k)]
    return np.column_stack(cols), k


def ols_summary(spark: SparkSession, df: DataFrame, models: dict[str, Sequence[str]], target: str,
                order_cols: Sequence[str] = ()) -> DataFrame:
    """Long table (candidate, term, stat, value) of several models; term 'model' holds
    model-level fields."""
    rows = []
    for name, v in ols_summaries(df, models, target, order_cols).items():
        rows += [(name, "model", k, _num(x)) for k, x in v["model"].items()]
        rows += [(name, term, k, _num(x)) for term, stats in v["terms"].items() for k, x in stats.items()]
    return spark.createDataFrame(rows, "candidate string, term string, stat string, value double")


def _num(x):
    if x is None:
        return None
    x = float(x)
    return x if math.isfinite(x) else None
