"""Queries of the modelling half: collinearity, standardisation, splits,
seasonal OLS, metrics, CV and the no-intercept log study."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import collinearity as CO
from ..operators import crossval as CV
from ..operators import features as FE
from ..operators import metrics as MET
from ..operators import qr as QR
from ..operators import regression as RG
from ..operators.moments import collect_moments
from ..sources import fixtures as FX
from . import oracle as O
from . import prepare as P
from .registry import register


def _r(c: str):
    return X.rounded(c).alias(c)


# --- shared SQL ------------------------------------------------------------------------

B_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*C.B_FEATURES, C.B_TARGET])
B_BASE = f"""{O.ORDER_FRAME},
bsplit AS (
  SELECT *, {O.is_test_sql(['key'], C.SPLIT_SEED)} AS is_test, {O.fold_sql(['key'], C.FOLD_SEED)} AS fold
  FROM ordf),
bcomp AS (SELECT * FROM bsplit WHERE {B_COMPLETE}),
seg AS ({O.segments_union('bcomp', C.B_SEGMENTS)})"""

_gs_b, B_SCORED, B_COEF = O.gs_ctes("g", "seg", ["segment"], ["key", "is_test", "fold"], C.B_FEATURES,
                                    C.B_TARGET, "NOT is_test")
B_MODEL = B_BASE + ",\n" + ",\n".join(_gs_b)

A_CLEAN = (O.FIXTURE_A + ",\nclean AS (SELECT * EXCLUDE (time, time_interval, start_time_interval, "
           "food_availability, month_y, month_x, month_num), month_num AS month FROM feat3),\n"
           "enc AS (SELECT * EXCLUDE (season), CASE WHEN season = 'Spring' THEN 1.0 ELSE 0.0 END AS season_Spring, "
           "CASE WHEN season = 'Winter' THEN 1.0 ELSE 0.0 END AS season_Winter FROM clean),\n"
           "enc2 AS (SELECT *, season_Winter * arrival_present AS seasonal_arrival_present, "
           "season_Winter * food_fraction AS seasonal_food, "
           "CASE WHEN season_Winter = 1.0 THEN 'winter' ELSE 'spring' END AS atom FROM enc)")

A_CANDIDATES = ["risk", "reward", "min_after_arrival", "arrival_number", "landing_number", "arrival_minutes",
                "bucket_count", "arrival_present", "food_fraction", "arrivals_exceed", "risk_arrivals", "risk_food",
                "risk_reward", "season_Spring", "season_Winter", "seasonal_arrival_present", "seasonal_food"]


def _encoded_a(spark, sf):
    return P.encode_a(P.clean_a(spark, sf))


def _candidates(enc) -> list[str]:
    """PRJ2: every numeric column but the exclusion set (A_CANDIDATES spells
    the same list out for the SQL side)."""
    return P.candidate_features(enc)


# --- AGG9 / FLT6 / PRJ11 / DIA11 ----------------------------------------------------------

def _corr_sql(cols, where: str = "", head: str = f"WITH {A_CLEAN}", src: str = "enc2") -> str:
    aggs = [f"var_pop(CAST({c} AS DOUBLE)) AS v{i}" for i, c in enumerate(cols)]
    for i, j in combinations(range(len(cols)), 2):
        a, b = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
        aggs += [f"covar_pop({a}, {b}) AS c{i}_{j}",
                 f"var_pop({a}) FILTER (WHERE {b} IS NOT NULL) AS va{i}_{j}",
                 f"var_pop({b}) FILTER (WHERE {a} IS NOT NULL) AS vb{i}_{j}"]
    parts = [f"SELECT '{c}' AS col_i, '{c}' AS col_j, CASE WHEN v{i} > 0 THEN 1.0 END AS corr FROM st"
             for i, c in enumerate(cols)]
    for i, j in combinations(range(len(cols)), 2):
        e = f"CASE WHEN sqrt(va{i}_{j} * vb{i}_{j}) > 0 THEN c{i}_{j} / sqrt(va{i}_{j} * vb{i}_{j}) END"
        parts.append(f"SELECT '{cols[i]}', '{cols[j]}', {e} FROM st")
        parts.append(f"SELECT '{cols[j]}', '{cols[i]}', {e} FROM st")
    return (f"{head},\nst AS (SELECT {', '.join(aggs)} FROM {src}),\ncm AS (\n"
            + "\nUNION ALL\n".join(parts) + f")\nSELECT col_i, col_j, {O.r('corr')} AS corr FROM cm {where}")


@register("correlation_matrix", _corr_sql(A_CANDIDATES))
def q_corr(spark, sf):
    """AGG9: pairwise-complete Pearson matrix of the candidate features."""
    enc = _encoded_a(spark, sf)
    return CO.correlation_long(enc, _candidates(enc)).select("col_i", "col_j", _r("corr"))


@register("high_corr_pairs", _corr_sql(A_CANDIDATES, f"WHERE col_i <> col_j AND corr > {abs(C.CORR_THRESHOLD)}"))
def q_high_corr(spark, sf):
    """FLT6 (rule as in the analysis: corr > |0.5|, both orders)."""
    enc = _encoded_a(spark, sf)
    corr = CO.correlation_long(enc, _candidates(enc))
    return CO.high_corr_pairs(corr, C.CORR_THRESHOLD).select("col_i", "col_j", _r("corr"))


@register("corr_heatmap_winter", _corr_sql(C.A_WINTER_FEATURES))
def q_heatmap(spark, sf):
    """PRJ11 / DIA11: heat-map cells of the winter feature list."""
    return CO.correlation_long(_encoded_a(spark, sf), C.A_WINTER_FEATURES).select("col_i", "col_j", _r("corr"))


@register("corr_heatmap_spring", _corr_sql(C.A_SPRING_FEATURES))
def q_heatmap_spring(spark, sf):
    """PRJ11 / DIA11: heat-map cells of the spring feature list."""
    return CO.correlation_long(_encoded_a(spark, sf), C.A_SPRING_FEATURES).select("col_i", "col_j", _r("corr"))


@register("corr_heatmap_spring_all_months", O.on_orders(_corr_sql(C.D_SPRING_FEATURES)))
def q_heatmap_spring_all_months(spark, sf):
    """PRJ11 / DIA11: the six variables of the spring list on fixture D, which has all months."""
    return CO.correlation_long(P.encode_a(P.clean_a(spark, sf, "D")), C.D_SPRING_FEATURES).select("col_i", "col_j", _r("corr"))


@register("corr_heatmap_v2", _corr_sql(C.HEATMAP_V2, head="WITH " + O.FIXTURE_A, src="feat3"))
def q_heatmap_v2(spark, sf):
    """DIA11 of the second analysis: five variables, food availability unscaled."""
    return CO.correlation_long(P.features_a(spark, sf), C.HEATMAP_V2).select("col_i", "col_j", _r("corr"))


@register("corr_heatmap_v3", O.on_orders(_corr_sql(
    C.HEATMAP_V3, head=f"WITH {O.FIXTURE_A},\nlogs AS (SELECT * EXCLUDE (month_x, month_y, month_num), month_num AS month, "
    f"ln(arrivals_exceed + {C.LOG_SHIFT}) AS log_arrivals_exceed FROM feat3)", src="logs")))
def q_heatmap_v3(spark, sf):
    """DIA11 of the third analysis on fixture D: fifteen variables with the target, the
    month and the logged flag."""
    df = FE.with_logs(P.clean_a(spark, sf, "D"), ["arrivals_exceed"])
    return CO.correlation_long(df, C.HEATMAP_V3).select("col_i", "col_j", _r("corr"))


# --- FEA8 / FEA9 ---------------------------------------------------------------------------

def _vif_sql() -> str:
    ctes, parts = [], []
    feats = C.B_FEATURES
    for i, c in enumerate(feats):
        others = [f for f in feats if f != c]
        cte, scored, _ = O.gs_ctes(f"v{i}", "bcomp", [], [], others, c, "TRUE", intercept=False)
        ctes += cte
        parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS feature, "
                     f"{O.r('sum(__y * __y) / sum((__y - __yhat) * (__y - __yhat))')} AS vif FROM {scored}")
    return "WITH " + B_BASE + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("vif", _vif_sql())
def q_vif(spark, sf):
    """FEA8 on the order features (no constant in their span: uncentred R^2)."""
    return CO.vif_table(spark, P.order_b(spark, sf), C.B_FEATURES).select("position", "feature", _r("vif"))


def _vif_ctes(r: int) -> str:
    """v{r}: the VIF of each column of k{r}.  Another route than the library's: each column's
    matrix is eliminated by the others, one by one (a recursive CTE), down to what they
    leave of it and of the constant."""
    k = len(A_CANDIDATES)
    places = f"range(1, {k + 2})"
    one = f"g[{k + 1}][{k + 1}]"
    return f"""e{r} AS (
  SELECT unnest(kept) AS i, 0 AS j, g AS m FROM k{r}, gram
  UNION ALL
  SELECT i, j + 1, CASE WHEN j + 1 <> i AND list_contains(kept, j + 1) AND m[j + 1][j + 1] > 1e-11 * g[j + 1][j + 1]
    THEN [[m[a][b] - m[a][j + 1] * m[j + 1][b] / m[j + 1][j + 1] FOR b IN {places}] FOR a IN {places}] ELSE m END
  FROM e{r}, k{r}, gram WHERE j < {k}),
v{r} AS (SELECT i, CASE WHEN {one} = 0 THEN NULL WHEN m[i][i] <= 1e-11 * g[i][i] THEN 'infinity'::DOUBLE
    ELSE (g[i][i] - CASE WHEN m[{k + 1}][{k + 1}] <= 1e-9 * {one} THEN g[i][{k + 1}] * g[i][{k + 1}] / {one} ELSE 0 END) / m[i][i] END AS vif
  FROM e{r}, gram WHERE j = {k})"""


def _elimination_ctes() -> str:
    """The rounds of FEA9: w{r} is the worst column of round r, k{r + 1} what it leaves."""
    cols = [f"CAST({c} AS DOUBLE)" for c in A_CANDIDATES] + ["1.0"]
    gram = "[" + ", ".join("[" + ", ".join(f"coalesce(sum({a} * {b}), 0)" for b in cols) + "]" for a in cols) + "]"
    ctes = [f"gram AS MATERIALIZED (SELECT {gram} AS g FROM enc2 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in A_CANDIDATES) + ")",
            f"k1 AS (SELECT range(1, {len(cols)}) AS kept)"]
    for r in range(1, C.VIF_MAX_ROUNDS + 1):
        ctes += [_vif_ctes(r), f"w{r} AS (SELECT i, vif, vif > {C.VIF_THRESHOLD} AS dropped FROM v{r} ORDER BY vif DESC NULLS LAST, i LIMIT 1)",
                 f"k{r + 1} AS (SELECT CASE WHEN dropped THEN [x FOR x IN kept IF x <> i] ELSE kept END AS kept FROM k{r}, w{r})"]
    return A_CLEAN.join(["WITH RECURSIVE ", ",\n"]) + ",\n".join(ctes)


_NAMES = "[" + ", ".join(f"'{c}'" for c in A_CANDIDATES) + "]"
_STATE = "CASE WHEN vif IS NULL THEN 'undefined' WHEN isinf(vif) THEN 'infinite' ELSE 'finite' END AS state"
_FINITE = f"CASE WHEN isfinite(vif) THEN {O.r('vif')} END AS vif"


@register("vif_elimination", _elimination_ctes() + "\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({r} AS BIGINT) AS round, CASE WHEN dropped THEN {_NAMES}[i] END AS removed, {_FINITE}, {_STATE} FROM w{r}"
    for r in range(1, C.VIF_MAX_ROUNDS + 1)))
def q_vif_elim(spark, sf):
    """FEA9 on the candidate features of fixture A."""
    enc = _encoded_a(spark, sf)
    rounds, _ = CO.vif_elimination(enc, _candidates(enc))
    rows = [(r["round"], r["removed"], *CO.vif_state(r["vif"])) for r in rounds]
    return spark.createDataFrame(rows, "round bigint, removed string, vif double, state string").select("round", "removed", _r("vif"), "state")


@register("vif_kept", f"""{_elimination_ctes()},
{_vif_ctes(C.VIF_MAX_ROUNDS + 1)}
SELECT CAST(list_position(kept, i) - 1 AS BIGINT) AS position, {_NAMES}[i] AS feature, {_FINITE}, {_STATE}
FROM v{C.VIF_MAX_ROUNDS + 1}, k{C.VIF_MAX_ROUNDS + 1}""")
def q_vif_kept(spark, sf):
    """FEA8 after FEA9: VIF of the columns that the elimination keeps (the same single Gram
    pass)."""
    from ..operators.linalg import vif_from_moments
    from ..operators.moments import collect_moments
    enc = _encoded_a(spark, sf)
    cols = _candidates(enc)
    m = collect_moments(enc, cols)[()]
    _, kept = CO.vif_elimination_from_moments(m, cols)
    rows = [(i, c, *CO.vif_state(x)) for i, (c, x) in enumerate(zip(kept, vif_from_moments(m, kept)))]
    return spark.createDataFrame(rows, "position bigint, feature string, vif double, state string") \
        .select("position", "feature", _r("vif"), "state")


# --- FEA4 / FEA5 / FEA6 / RNK1 ----------------------------------------------------------------

@register("standardised_features", "WITH " + B_BASE + "\n" + "\nUNION ALL\n".join(
    f"SELECT segment, '{c}' AS feature, {O.r(f'avg({c})')} AS mean, "
    f"{O.r(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END')} AS scale "
    f"FROM seg WHERE NOT is_test GROUP BY segment" for c in C.B_FEATURES))
def q_standardised(spark, sf):
    """FEA4: training mean and population std (0 -> 1) per segment."""
    fits = _season_fits(P.order_b(spark, sf))
    rows = [(seg, c, float(m), float(s)) for seg, fit in fits.items()
            for c, m, s in zip(fit.features, fit.mean, fit.scale)]
    return spark.createDataFrame(rows, "segment string, feature string, mean double, scale double") \
        .select("segment", "feature", _r("mean"), _r("scale"))


def _std_rows_sql() -> str:
    stats = ", ".join(f"avg({c}) FILTER (WHERE NOT is_test) AS m_{c}, "
                      f"CASE WHEN stddev_pop({c}) FILTER (WHERE NOT is_test) > 0 "
                      f"THEN stddev_pop({c}) FILTER (WHERE NOT is_test) ELSE 1 END AS s_{c}" for c in C.B_FEATURES)
    cols = ", ".join(f"{O.r(f'({c} - m_{c}) / s_{c}')} AS z_{c}" for c in C.B_FEATURES)
    return (f"WITH {B_BASE},\nst AS (SELECT segment, {stats} FROM seg GROUP BY segment)\n"
            f"SELECT segment, key, is_test, {cols} FROM seg JOIN st USING (segment)")


@register("standardised_rows", _std_rows_sql())
def q_standardised_rows(spark, sf):
    """FEA4 applied: every complete row of a segment (train and test) scaled
    with that segment's training mean and population std."""
    df = P.order_b(spark, sf)
    fits = _season_fits(df)
    lab = RG.label_segments(df.where(X.all_not_null([*C.B_FEATURES, C.B_TARGET])), C.B_SEGMENTS, "atom")
    seg = F.col("segment")
    exprs = {}
    for i, c in enumerate(C.B_FEATURES):
        z = F.lit(None).cast("double")
        for name, fit in fits.items():
            z = F.when(seg == name, (F.col(c) - F.lit(float(fit.mean[i]))) / F.lit(float(fit.scale[i]))).otherwise(z)
        exprs[f"z_{c}"] = X.rounded(z)
    return lab.select("segment", "key", "is_test", *[e.alias(n) for n, e in exprs.items()])


@register("split_counts", f"WITH {B_BASE}\nSELECT atom, is_test, count(*) AS n FROM bsplit GROUP BY 1, 2")
def q_split_counts(spark, sf):
    """FEA5 (hash split, about 20 % test)."""
    return P.order_b(spark, sf).groupBy("atom", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("fold_counts", f"WITH {B_BASE}\nSELECT atom, CAST(fold AS BIGINT) AS fold, count(*) AS n FROM bsplit GROUP BY 1, 2")
def q_fold_counts(spark, sf):
    """FEA6 (hash folds)."""
    return P.order_b(spark, sf).groupBy("atom", F.col("fold").cast("bigint").alias("fold")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("exact_split", f"""WITH {O.ORDER_FRAME},
rk AS (SELECT atom, key, row_number() OVER (PARTITION BY atom ORDER BY {O.key_hash_sql(['key'], C.SPLIT_SEED)}, key) AS r,
              count(*) OVER (PARTITION BY atom) AS n FROM ordf),
fz AS (SELECT *, n // {C.N_FOLDS} AS q, n - (n // {C.N_FOLDS}) * {C.N_FOLDS} AS rem FROM rk)
SELECT atom, key, CAST(r AS BIGINT) AS split_rank, r <= ceil(n * {C.TEST_SIZE}) AS is_test,
       CAST(CASE WHEN r <= rem * (q + 1) THEN (r - 1) // (q + 1) ELSE rem + (r - 1 - rem * (q + 1)) // q END AS INTEGER) AS fold
FROM fz""")
def q_exact_split(spark, sf):
    """FEA5/FEA6 exact sizes through the distributed rank (RNK1)."""
    df = FX.order_frame(spark, sf).select("atom", "key")
    out = FE.exact_split(df, ["key"], C.SPLIT_SEED, C.TEST_SIZE, within=["atom"], k=C.N_FOLDS)
    return out.select("atom", "key", "split_rank", "is_test", "fold")


# --- REG2 / REG6 / REG7 / ORD1-3 / DIA12 --------------------------------------------------------

def _season_fits(df):
    """Training-split model per segment; a segment without complete training
    rows has no model (and no output rows)."""
    fits = RG.fit_segments(df, P.b_features(), C.B_TARGET, C.B_SEGMENTS, "atom", train=~F.col("is_test"))
    return {seg: f for seg, f in fits.items() if f.n > 0}


def _coef_sql(select: str) -> str:
    parts = [f"SELECT segment, '(intercept)' AS term, my AS coef FROM {B_COEF} JOIN g_m USING (segment)"]
    for i, c in enumerate(C.B_FEATURES):
        parts.append(f"SELECT segment, '{c}', s{i + 1} FROM {B_COEF}")
    return f"WITH {B_MODEL},\ncoefs AS (" + "\nUNION ALL\n".join(parts) + ")\n" + select


@register("season_models", _coef_sql(f"SELECT segment, term, {O.r('coef')} AS coef, {O.r('abs(coef)')} AS abs_coef FROM coefs"))
def q_season_models(spark, sf):
    """REG2 + REG6 + REG7: standardised coefficients per segment (winter,
    not winter, whole year) fitted on the training rows."""
    fits = _season_fits(P.order_b(spark, sf))
    return RG.coefficient_table(spark, fits).select("segment", "term", _r("coef"), _r("abs_coef"))


@register("season_coefficients_top", _coef_sql(
    f"SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY abs(coef) DESC, term) AS BIGINT) AS rank, "
    f"term, {O.r('coef')} AS coef FROM coefs WHERE term <> '(intercept)' QUALIFY rank <= {C.TOP_K_COEF}"))
def q_top_coef(spark, sf):
    """ORD1 + ORD3 + MTH3: largest |coef| first, top k per segment."""
    coefs = RG.coefficient_table(spark, _season_fits(P.order_b(spark, sf)))
    return RG.top_k_terms(coefs, C.TOP_K_COEF).select("segment", "rank", "term", _r("coef"))


@register("coef_bars", _coef_sql(
    "SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY abs(coef), term) AS BIGINT) AS position, "
    f"term, {O.r('coef')} AS coef FROM coefs WHERE term <> '(intercept)'"))
def q_coef_bars(spark, sf):
    """DIA12 + ORD2: bar order by ascending |coef|."""
    from pyspark.sql import Window
    coefs = RG.coefficient_table(spark, _season_fits(P.order_b(spark, sf))).where(F.col("term") != "(intercept)")
    w = Window.partitionBy("segment").orderBy(F.col("abs_coef").asc(), F.col("term"))
    return coefs.select("segment", F.row_number().over(w).cast("bigint").alias("position"), "term", _r("coef"))


# --- MET7 ---------------------------------------------------------------------------------------

@register("season_metrics", f"WITH {B_MODEL}\nSELECT segment, CASE WHEN __t THEN 'train' ELSE 'test' END AS split, "
          + ", ".join(O.metric_select("__y", "__yhat")) + f" FROM {B_SCORED} GROUP BY 1, 2")
def q_season_metrics(spark, sf):
    """MET2-5 + MET7: train and test metrics of every segment model in one pass."""
    df = P.order_b(spark, sf)
    fits = _season_fits(df)
    models = {}
    for seg, atoms in C.B_SEGMENTS.items():
        if seg not in fits:
            continue
        member = F.col("atom").isin(*atoms)
        models[f"{seg}|train"] = (member & ~F.col("is_test"), RG.predict(fits[seg]))
        models[f"{seg}|test"] = (member & F.col("is_test"), RG.predict(fits[seg]))
    if not models:
        return spark.createDataFrame([], "segment string, split string, n bigint, mae double, mse double, "
                                         "rmse double, nrmse double, r2 double")
    res = MET.evaluate(df, C.B_TARGET, models).where(F.col("n") > 0)
    parts = F.split(F.col("model"), "\\|")
    return res.select(parts[0].alias("segment"), parts[1].alias("split"), "n",
                      *[_r(m) for m in ("mae", "mse", "rmse", "nrmse", "r2")])


# --- CVA1 / CVA2 ---------------------------------------------------------------------------------

def _cv_sql() -> str:
    ctes, scored, _ = O.gs_ctes("cv", "cvb", ["segment", "mf"], ["key", "fold"], C.B_FEATURES, C.B_TARGET,
                                "fold <> mf")
    ms = O.metric_select("__y", "__yhat", rounded=False)
    keep = [m for m in ms if m.endswith((" AS n", " AS mse", " AS rmse", " AS r2"))]
    return ("WITH " + B_BASE + f",\ncvb AS (SELECT s.*, f.mf FROM seg s, (SELECT CAST(unnest(range({C.N_FOLDS})) AS INTEGER) AS mf) f),\n"
            + ",\n".join(ctes) + f",\ncvs AS (SELECT segment, CAST(mf AS BIGINT) AS fold, {', '.join(keep)} "
            f"FROM {scored} WHERE fold = mf GROUP BY 1, 2)\n")


@register("cv_scores", _cv_sql() + "SELECT segment, fold, n, " + ", ".join(f"{O.r(m)} AS {m}" for m in ("mse", "rmse", "r2")) + " FROM cvs")
def q_cv_scores(spark, sf):
    """CVA1: 5-fold scores per segment (fold statistics merged, no refit pass)."""
    res = CV.cross_validate(P.order_b(spark, sf), P.b_features(), C.B_TARGET, C.B_SEGMENTS, "atom", "fold",
                            C.N_FOLDS).where(F.col("n") > 0)
    return res.select("segment", "fold", "n", _r("mse"), _r("rmse"), _r("r2"))


@register("cv_average", _cv_sql() + "SELECT segment, " + O.r("avg(mse)") + " AS avg_mse, " + O.r("avg(rmse)")
          + " AS avg_rmse, " + O.r("avg(r2)") + " AS avg_r2, count(*) AS n_folds FROM cvs GROUP BY 1")
def q_cv_average(spark, sf):
    """CVA2: mean MSE, mean of fold RMSEs, mean R^2."""
    res = CV.cross_validate(P.order_b(spark, sf), P.b_features(), C.B_TARGET, C.B_SEGMENTS, "atom", "fold",
                            C.N_FOLDS).where(F.col("n") > 0)
    avg = CV.cv_average(res)
    return avg.select("segment", _r("avg_mse"), _r("avg_rmse"), _r("avg_r2"), "n_folds")


# --- REG3 / REG8 / REG9 / FEA7 / MTH2 ------------------------------------------------------------

A_LOG_COLS = [*C.A_LOG_BASE, C.A_TARGET]


def _log_frame(spark, sf):
    df = P.clean_a(spark, sf)
    return FE.with_logs(df, C.A_LOG_CANDIDATES)


def _candidate_lists() -> dict[str, list[str]]:
    out = {"baseline": list(C.A_LOG_BASE)}
    for c in C.A_LOG_CANDIDATES:
        out[f"log_{c}"] = [f"log_{c}" if f == c else f for f in C.A_LOG_BASE]
    return out


A_LOG_SQL = (O.FIXTURE_A + ",\nclean AS (SELECT * EXCLUDE (time, time_interval, start_time_interval, "
             "food_availability, month_y, month_x, month_num), month_num AS month FROM feat3),\n"
             "logs AS (SELECT *, " + ", ".join(f"ln({c} + {C.LOG_SHIFT}) AS log_{c}" for c in C.A_LOG_CANDIDATES)
             + " FROM clean)")


def _no_intercept_sql() -> str:
    comp = " AND ".join(f"{c} IS NOT NULL" for c in A_LOG_COLS)
    ctes, scored, coef = O.gs_ctes("ni", "nib", [], [], C.A_LOG_BASE, C.A_TARGET, "TRUE", intercept=False)
    parts = [f"SELECT '{c}' AS name, {O.r(f'b{i + 1}')} AS value FROM {coef}" for i, c in enumerate(C.A_LOG_BASE)]
    parts.append(f"SELECT 'r2_uncentred', {O.r('1 - sum((__y - __yhat) * (__y - __yhat)) / sum(__y * __y)')} FROM {scored}")
    parts.append(f"SELECT 'n', CAST(count(*) AS DOUBLE) FROM {scored}")
    return ("WITH " + A_LOG_SQL + f",\nnib AS (SELECT * FROM logs WHERE {comp}),\n" + ",\n".join(ctes) + "\n"
            + "\nUNION ALL\n".join(parts))


@register("no_intercept_ols", _no_intercept_sql())
def q_no_intercept(spark, sf):
    """REG3: OLS without intercept on all complete landing rows, from their triangular
    factor; (name, value)."""
    f = QR.factor(P.clean_a(spark, sf), A_LOG_COLS)
    coef, ssr, _ = f.regress(C.A_TARGET, C.A_LOG_BASE)
    total = f.dot(C.A_TARGET, C.A_TARGET)
    rows = [(c, float(b) if f.n else None) for c, b in zip(C.A_LOG_BASE, coef, strict=True)]
    rows += [("r2_uncentred", 1 - ssr / total if total > 0 else None), ("n", float(f.n))]
    return spark.createDataFrame(rows, "name string, value double").select("name", _r("value"))


def _log_candidates_sql() -> str:
    cands = _candidate_lists()
    delta = "r2 - (SELECT r2 FROM res WHERE candidate = 'baseline')"
    all_cols = sorted({c for fs in cands.values() for c in fs} | {C.A_TARGET})
    comp = " AND ".join(f"{c} IS NOT NULL" for c in all_cols)
    ctes, parts = [], []
    for j, (name, feats) in enumerate(cands.items()):
        cte, scored, _ = O.gs_ctes(f"lc{j}", "lcb", [], [], feats, C.A_TARGET, "TRUE", intercept=False)
        ctes += cte
        parts.append(f"SELECT '{name}' AS candidate, 1 - sum((__y - __yhat) * (__y - __yhat)) / sum(__y * __y) AS r2 "
                     f"FROM {scored}")
    return ("WITH " + A_LOG_SQL + f",\nlcb AS (SELECT * FROM logs WHERE {comp}),\n" + ",\n".join(ctes)
            + ",\nres AS (" + "\nUNION ALL\n".join(parts) + ")\n"
            + f"SELECT candidate, {O.r('r2')} AS r2, {O.r(delta)} AS delta, "
            "r2 > (SELECT r2 FROM res WHERE candidate = 'baseline') AS keep FROM res")


@register("log_candidates", _log_candidates_sql())
def q_log_candidates(spark, sf):
    """REG9 + FEA7 + MTH2: baseline no-intercept model and five one-swap log
    variants from ONE Gram aggregation; keep a variant if R^2 rises."""
    cands = _candidate_lists()
    cols = sorted({c for fs in cands.values() for c in fs} | {C.A_TARGET})
    m = collect_moments(_log_frame(spark, sf), cols)[()]
    r2 = {}
    for name, feats in cands.items():
        fit = RG.ols_no_intercept(m, feats, C.A_TARGET)
        e = fit.extra
        ssr = e["yty"] - 2 * fit.coef @ e["xty"] + fit.coef @ e["gram"] @ fit.coef
        r2[name] = float(1 - ssr / e["yty"]) if e["yty"] > 0 else None
    base = r2["baseline"]
    rows = [(k, v, None if v is None or base is None else v - base, None if v is None or base is None else v > base)
            for k, v in r2.items()]
    return spark.createDataFrame(rows, "candidate string, r2 double, delta double, keep boolean") \
        .select("candidate", _r("r2"), _r("delta"), "keep")
