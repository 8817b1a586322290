"""Queries behind the residual diagnostics and charts (DIA1-12, REG8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import diagnostics as DG
from ..operators import regression as RG
from ..operators import summary as SM
from ..session import materialize
from ..sources import fixtures as FX
from . import oracle as O
from . import prepare as P
from . import univariate as U
from .model_queries import A_LOG_SQL, B_MODEL, B_SCORED, _candidate_lists, _season_fits
from .registry import register


def _r(c: str):
    return X.rounded(c).alias(c)


def scored_b(spark, sf, shared: bool = False):
    """Every complete order row once per segment holding it, with the
    segment model's prediction and residual.  ``shared``: the order frame is
    materialised first, so the fit and the scoring read it instead of both
    re-aggregating lineitem."""
    df = P.order_b(spark, sf)
    if shared:
        df = materialize(df, key=["key"])
    fits = _season_fits(df)
    lab = RG.label_segments(df, C.B_SEGMENTS, "atom")
    pred = RG.predict_by(fits, [F.col("segment")])
    out = lab.withColumn("predicted", pred).where(F.col("predicted").isNotNull() & F.col(C.B_TARGET).isNotNull())
    return out.withColumn("residual", F.col(C.B_TARGET) - F.col("predicted"))


def train_residuals(spark, sf, shared: bool = True, ranked: bool = False):
    """Training residuals per segment.  ``shared``: the chart queries run
    several jobs on them, so they are materialised once per query, except those
    that go to the global rank (``ranked``), which writes them itself."""
    res = scored_b(spark, sf, shared).where(~F.col("is_test")).select("segment", "key", "predicted", "residual")
    return materialize(res, key=["segment", "key"]) if shared and not ranked else res


RES_SQL = f"WITH {B_MODEL},\nres AS (SELECT segment, key, __yhat AS predicted, __y - __yhat AS e FROM {B_SCORED} WHERE __t)"


@register("residuals", RES_SQL + f"\nSELECT segment, key, {O.r('predicted')} AS predicted, {O.r('e')} AS residual FROM res")
def q_residuals(spark, sf):
    """DIA1 + DIA2: training residuals against predictions, per segment."""
    return train_residuals(spark, sf, shared=False).select("segment", "key", _r("predicted"), _r("residual"))


@register("actual_vs_predicted", f"WITH {B_MODEL}\nSELECT segment, key, {O.r('__y')} AS actual, "
          f"{O.r('__yhat')} AS predicted FROM {B_SCORED} WHERE NOT __t")
def q_avp(spark, sf):
    """DIA8 + PRJ10: test rows, actual and predicted, labelled by segment."""
    s = scored_b(spark, sf).where(F.col("is_test"))
    return s.select("segment", "key", X.rounded(C.B_TARGET).alias("actual"), _r("predicted"))


@register("actual_range", f"WITH {B_MODEL}\nSELECT segment, {O.r('min(__y)')} AS actual_min, {O.r('max(__y)')} AS actual_max, "
          f"{O.r('min(__yhat)')} AS predicted_min, {O.r('max(__yhat)')} AS predicted_max FROM {B_SCORED} WHERE NOT __t GROUP BY 1")
def q_actual_range(spark, sf):
    """AGG7: ends of the identity line of the actual-vs-predicted chart."""
    s = scored_b(spark, sf).where(F.col("is_test"))
    out = s.groupBy("segment").agg(F.min(C.B_TARGET).alias("actual_min"), F.max(C.B_TARGET).alias("actual_max"),
                                   F.min("predicted").alias("predicted_min"), F.max("predicted").alias("predicted_max"))
    return out.select("segment", *[_r(c) for c in ("actual_min", "actual_max", "predicted_min", "predicted_max")])


B = C.HIST_BINS
HIST_SQL = RES_SQL + f""",
st AS (SELECT segment, min(e) AS lo, max(e) AS hi FROM res GROUP BY 1),
bn AS (SELECT segment, CASE WHEN hi - lo > 0 THEN least(floor((e - lo) / (hi - lo) * {B}) + 1, {B}) ELSE 1 END AS bin
       FROM res JOIN st USING (segment)),
cnt AS (SELECT segment, bin, count(*) AS c FROM bn GROUP BY 1, 2),
grid AS (SELECT segment, lo, hi, unnest(range(1, {B + 1})) AS bin FROM st)
SELECT g.segment, CAST(g.bin AS BIGINT) AS bin, {O.r(f'g.lo + (g.bin - 1) * ((g.hi - g.lo) / {B})')} AS bin_lo,
       {O.r(f'g.lo + g.bin * ((g.hi - g.lo) / {B})')} AS bin_hi, CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt ON g.segment = cnt.segment AND g.bin = cnt.bin"""


@register("residual_histogram", HIST_SQL)
def q_hist(spark, sf):
    """DIA3: 30 equal bins of the training residuals, empty bins kept."""
    h = DG.histogram(train_residuals(spark, sf), "residual", by=["segment"], bins=B)
    return h.select("segment", "bin", _r("bin_lo"), _r("bin_hi"), "count")


BIN2D_SQL = RES_SQL + f""",
st AS (SELECT segment, min(predicted) AS xlo, max(predicted) AS xhi, min(e) AS ylo, max(e) AS yhi FROM res GROUP BY 1)
SELECT segment,
       CAST(CASE WHEN xhi - xlo > 0 THEN least(floor((predicted - xlo) / (xhi - xlo) * {B}) + 1, {B}) ELSE 1 END AS BIGINT) AS bin_x,
       CAST(CASE WHEN yhi - ylo > 0 THEN least(floor((e - ylo) / (yhi - ylo) * {B}) + 1, {B}) ELSE 1 END AS BIGINT) AS bin_y,
       count(*) AS count
FROM res JOIN st USING (segment) GROUP BY 1, 2, 3"""


@register("residual_bins_2d", BIN2D_SQL)
def q_bins_2d(spark, sf):
    """DIA2 in scale form: residual against prediction as 30 x 30 bin counts."""
    return DG.bin_counts_2d(train_residuals(spark, sf), "predicted", "residual", by=["segment"], bins=B)


SCATTER_SQL = RES_SQL + f""",
st AS (SELECT segment, min(predicted) AS xlo, max(predicted) AS xhi, min(e) AS ylo, max(e) AS yhi FROM res GROUP BY 1),
cell AS (SELECT segment, key, predicted, e,
       CAST(CASE WHEN xhi - xlo > 0 THEN least(floor((predicted - xlo) / (xhi - xlo) * {B}) + 1, {B}) ELSE 1 END AS BIGINT) AS bin_x,
       CAST(CASE WHEN yhi - ylo > 0 THEN least(floor((e - ylo) / (yhi - ylo) * {B}) + 1, {B}) ELSE 1 END AS BIGINT) AS bin_y
  FROM res JOIN st USING (segment)),
rk AS (SELECT *, count(*) OVER (PARTITION BY segment, bin_x, bin_y) AS n,
              row_number() OVER (PARTITION BY segment, bin_x, bin_y ORDER BY {O.key_hash_sql(['key'], C.SPLIT_SEED)}, key) AS i FROM cell)
SELECT segment, bin_x, bin_y, n AS count, CAST(key AS BIGINT) AS key, {O.r('predicted')} AS x, {O.r('e')} AS y
FROM rk WHERE i <= {C.SCATTER_EACH}"""


@register("scatter_sample", SCATTER_SQL)
def q_scatter_sample(spark, sf):
    """DIA2 / DIA9 bounded: a few points of each cell of the residual chart, with its count."""
    made = DG.scatter_sample(train_residuals(spark, sf), "predicted", "residual", "key", by=["segment"], bins=B)
    return made.select("segment", "bin_x", "bin_y", "count", "key", _r("x"), _r("y"))


G = C.KDE_GRID
KDE_SQL = RES_SQL + f""",
st AS (SELECT segment, count(*) AS n, stddev_samp(e) AS sd, min(e) AS lo, max(e) AS hi,
              pow(CAST(count(*) AS DOUBLE), -0.2) * stddev_samp(e) AS h FROM res GROUP BY 1),
pts AS (SELECT segment, unnest(range(0, {G})) AS point FROM st),
sm AS (SELECT p.segment, p.point, sum(exp(-0.5 * pow((st.lo + p.point * ((st.hi - st.lo) / {G - 1}) - res.e) / st.h, 2))) AS s
       FROM pts p JOIN st USING (segment) JOIN res USING (segment) WHERE st.h > 0 GROUP BY 1, 2)
SELECT segment, CAST(point AS BIGINT) AS point, {O.r(f'lo + point * (hi - lo) / {G - 1}')} AS x,
       {O.r(f's / (n * h * {math.sqrt(2 * math.pi)!r})')} AS density,
       {O.r(f's / (n * h * {math.sqrt(2 * math.pi)!r}) * n * ((hi - lo) / {B})')} AS density_count
FROM sm JOIN st USING (segment)"""


@register("residual_kde", KDE_SQL)
def q_kde(spark, sf):
    """DIA4: Gaussian KDE (Scott bandwidth) on 200 points, and scaled to counts."""
    k = DG.kde_curve(train_residuals(spark, sf), "residual", by=["segment"], grid=G, bins=B)
    return k.select("segment", "point", _r("x"), _r("density"), _r("density_count"))


QQ_SQL = RES_SQL + f""",
rk AS (SELECT segment, e, row_number() OVER (PARTITION BY segment ORDER BY e, key) AS i,
              count(*) OVER (PARTITION BY segment) AS n FROM res),
ps AS (SELECT segment, i, e, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                               ELSE (i - 0.3175) / (n + 0.365) END AS p FROM rk),
qq AS (SELECT segment, i, e AS sample, {X.normal_ppf_sql('p')} AS theoretical FROM ps)"""


@register("qq_points", QQ_SQL + f"\nSELECT segment, CAST(i AS BIGINT) AS rank, {O.r('theoretical')} AS theoretical, "
          f"{O.r('sample')} AS sample FROM qq")
def q_qq(spark, sf):
    """DIA6: ordered residuals against normal quantiles (distributed rank)."""
    pts = DG.qq_points(train_residuals(spark, sf, ranked=True), "residual", ["key"], by=["segment"])
    return pts.select("segment", "rank", _r("theoretical"), _r("sample"))


@register("qq_line", QQ_SQL + f"\nSELECT segment, {O.r('regr_slope(sample, theoretical)')} AS slope, "
          f"{O.r('regr_intercept(sample, theoretical)')} AS intercept, {O.r('corr(sample, theoretical)')} AS r, "
          f"count(*) AS n FROM qq GROUP BY 1")
def q_qq_line(spark, sf):
    """DIA6 reference line: least-squares slope, intercept and r."""
    pts = DG.qq_points(train_residuals(spark, sf, ranked=True), "residual", ["key"], by=["segment"])
    return DG.qq_line(pts, ["segment"]).select("segment", _r("slope"), _r("intercept"), _r("r"), "n")


@register("durbin_watson", RES_SQL + f""",
lg AS (SELECT segment, e, lag(e) OVER (PARTITION BY segment ORDER BY key) AS prev FROM res)
SELECT segment, count(*) AS n, {O.r('sum(pow(e - prev, 2)) / sum(e * e)')} AS durbin_watson FROM lg GROUP BY 1""")
def q_dw(spark, sf):
    """DIA5: Durbin-Watson of training residuals in key order."""
    d = DG.durbin_watson(train_residuals(spark, sf, ranked=True), "residual", ["key"], by=["segment"])
    return d.select("segment", "n", _r("durbin_watson"))


# --- DIA9 / DIA10 -------------------------------------------------------------------------------

def _scatter_sql() -> str:
    parts = [f"SELECT CAST(key AS BIGINT) AS key, '{c}' AS feature, {O.r(f'CAST({c} AS DOUBLE)')} AS value, "
             f"{O.r(f'log_{c}')} AS log_value, {O.r(C.A_TARGET)} AS target FROM logs"
             for c in C.A_LOG_CANDIDATES]
    return "WITH " + A_LOG_SQL + "\n" + "\nUNION ALL\n".join(parts)


@register("scatter_points", _scatter_sql())
def q_scatter(spark, sf):
    """DIA9: each log candidate, raw and logged, against the target."""
    from ..operators import features as FE
    df = FE.with_logs(P.clean_a(spark, sf), C.A_LOG_CANDIDATES)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               F.col(f"log_{c}").alias("log_value")) for c in C.A_LOG_CANDIDATES])
    out = df.select(F.col("key").cast("bigint").alias("key"), F.col(C.A_TARGET).alias("target"),
                    F.inline(pairs))
    return out.select("key", "feature", _r("value"), _r("log_value"), _r("target"))


@register("fitted_line", U.fitted_line_sql(O.LANDING, "landing", "CAST(key AS BIGINT)", "risk", "time_to_food"))
def q_fitted_line(spark, sf):
    """DIA9 + DIA10: test points of the univariate risk study and the fitted line."""
    line = U.fitted_line(FX.landings(spark, sf).withColumn("key", F.col("key").cast("bigint")), "risk", "time_to_food", ["key"])
    return line.select("key", _r("x"), _r("y"), _r("fitted"))


def _observation_line(spark, sf, y: str):
    obs = FX.observations(spark, sf).withColumn("key", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return U.fitted_line(obs, "arrival_number", y, ["key"]).select("key", _r("x"), _r("y"), _r("fitted"))


@register("fitted_line_landings", U.fitted_line_sql(O.OBSERVATION, "observation", O.ts_text("time"), "arrival_number", "landing_number"))
def q_fitted_line_landings(spark, sf):
    """DIA9 + DIA10 of the study of landings on arrivals."""
    return _observation_line(spark, sf, "landing_number")


@register("fitted_line_food", U.fitted_line_sql(O.OBSERVATION, "observation", O.ts_text("time"), "arrival_number", "food_availability"))
def q_fitted_line_food(spark, sf):
    """DIA9 + DIA10 of the study of food on arrivals."""
    return _observation_line(spark, sf, "food_availability")


# --- REG8 ---------------------------------------------------------------------------------------------

FIT_STATS = ["n", "df_model", "df_resid", "r2", "adj_r2", "f_stat", "log_likelihood", "aic", "bic", "skew",
             "kurtosis", "jarque_bera", "jarque_bera_p", "omnibus", "omnibus_p", "durbin_watson"]
TERM_STATS = ["coef", "std_err", "t"]


def _summary_frame(spark, sf):
    from ..operators import features as FE
    return FE.with_logs(P.clean_a(spark, sf), C.A_LOG_CANDIDATES)


def _fit_ctes(tag: str, feats: list[str], src: str) -> tuple[list[str], str]:
    """CTEs of one no-intercept model on the complete rows ``src``, ending with fin_{tag} (its
    fit, shape and error terms), and the name of its coefficients' CTE."""
    k = len(feats)
    ctes, scored, coef = O.gs_ctes(f"sm{tag}", src, [], ["key"], feats, C.A_TARGET, "TRUE", intercept=False)
    ssr_parts = []
    for i, c in enumerate(feats):
        others = [f for f in feats if f != c]
        cte, sc, _ = O.gs_ctes(f"sx{tag}{i}", src, [], [], others, c, "TRUE", intercept=False)
        ctes += cte
        ssr_parts.append(f"(SELECT sum((__y - __yhat) * (__y - __yhat)) FROM {sc}) AS ssr{i}")
    e = "(__y - __yhat)"
    zs = """(delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)))"""
    ctes.append(f"""st_{tag} AS (SELECT count(*) AS n, sum({e} * {e}) AS ssr, sum(__y * __y) AS tss, avg({e}) AS me FROM {scored}),
cm_{tag} AS (SELECT avg(pow({e} - me, 2)) AS m2, avg(pow({e} - me, 3)) AS m3, avg(pow({e} - me, 4)) AS m4
       FROM {scored}, st_{tag}),
dw_{tag} AS (SELECT sum(pow(d, 2)) AS num FROM (SELECT {e} - lag({e}) OVER (ORDER BY key) AS d FROM {scored})),
base_{tag} AS (SELECT n, ssr, tss, n - {k} AS dfr, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt, num AS dwn,
                {', '.join(ssr_parts)} FROM st_{tag}, cm_{tag}, dw_{tag}),
sk_{tag} AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y0,
              3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
              3.0 * (n - 1) / (n + 1) AS e_k,
              24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5)) AS varb2,
              6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
       FROM base_{tag}),
sk2_{tag} AS (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, CASE WHEN y0 = 0 THEN 1 ELSE y0 END AS y,
               (kurt - e_k) / sqrt(varb2) AS xk,
               6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM sk_{tag}),
sk3_{tag} AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
               1 + xk * sqrt(2 / (a - 4.0)) AS den FROM sk2_{tag}),
sk4_{tag} AS (SELECT *, {zs} AS zs,
               (1 - 2 / (9.0 * a) - sign(den) * pow((1 - 2.0 / a) / abs(den), 1 / 3.0)) / sqrt(2 / (9.0 * a)) AS zk
        FROM sk3_{tag}),
fin_{tag} AS (SELECT *, 1 - ssr / tss AS r2, -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf, ((tss - ssr) / {k}) / (ssr / dfr) AS f,
               n / 6.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4.0) AS jb, zs * zs + zk * zk AS omni FROM sk4_{tag})""")
    return ctes, coef


def _fit_rows(k: int) -> list[tuple[str, str]]:
    return [
        ("n", "n"), ("df_model", f"{k}"), ("df_resid", "dfr"), ("r2", "r2"),
        ("adj_r2", "1 - n / dfr * (1 - r2)"), ("f_stat", "f"),
        ("log_likelihood", "llf"), ("aic", f"-2 * llf + 2 * {k}"), ("bic", f"-2 * llf + {k} * ln(n)"),
        ("skew", "skew"), ("kurtosis", "kurt"), ("jarque_bera", "jb"), ("jarque_bera_p", "exp(-jb / 2)"),
        ("omnibus", "omni"), ("omnibus_p", "exp(-omni / 2)"), ("durbin_watson", "dwn / ssr"),
    ]


def _complete(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _fit_stats_sql() -> str:
    feats = _candidate_lists()["log_arrivals_exceed"]
    ctes, coef = _fit_ctes("f", feats, "smb")
    sel = [f"SELECT 'model' AS term, '{name}' AS stat, {O.r(expr)} AS value FROM fin_f" for name, expr in _fit_rows(len(feats))]
    for i, c in enumerate(feats):
        se = f"sqrt(ssr / dfr / ssr{i})"
        sel.append(f"SELECT '{c}', 'coef', {O.r(f'b{i + 1}')} FROM fin_f, {coef}")
        sel.append(f"SELECT '{c}', 'std_err', {O.r(se)} FROM fin_f")
        sel.append(f"SELECT '{c}', 't', {O.r(f'b{i + 1} / {se}')} FROM fin_f, {coef}")
    return ("WITH " + A_LOG_SQL + f",\nsmb AS (SELECT * FROM logs WHERE {_complete([*feats, C.A_TARGET])}),\n" + ",\n".join(ctes)
            + "\n" + "\nUNION ALL\n".join(sel))


@register("ols_fit_stats", _fit_stats_sql())
def q_ols_fit_stats(spark, sf):
    """REG8: fit, information criteria, residual shape tests, Durbin-Watson, coefficients,
    standard errors and t values of one model."""
    feats = _candidate_lists()["log_arrivals_exceed"]
    v = SM.ols_summary_values(_summary_frame(spark, sf), feats, C.A_TARGET, order_cols=["key"])
    num = SM._num
    rows = [("model", s, num(v["model"][s])) for s in FIT_STATS]
    rows += [(t, s, num(v["terms"][t][s])) for t in feats for s in TERM_STATS]
    return spark.createDataFrame(rows, "term string, stat string, value double").select("term", "stat", _r("value"))


#: Steps of Simpson's rule in the oracle's tail integrals, and rounds of its iterations.
STEPS, NEWTON, SWEEPS = 1000, 8, 12


def _simpson(f: str, lo: str, width: str) -> str:
    """The integral of ``f`` (an expression in u) over [lo, lo + width]."""
    u = f"({lo} + {width} * i / {STEPS}.0)"
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({width} / {3 * STEPS}.0 * list_sum([{weight} * {f.replace('u_', u)} FOR i IN range(0, {STEPS + 1})]))"


def _t_tail(t: str, df: str) -> str:
    """P(T > t) for t >= 0 as an integral over the angle atan(t / sqrt(df)); the density
    falls by over 1e-30 within 12 / sqrt(df) of it."""
    angle = f"atan(({t}) / sqrt({df}))"
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"({scale} * {_simpson(f'pow(cos(u_), {df} - 1)', angle, f'least(pi() / 2 - {angle}, 12 / sqrt({df}))')})"


def _f_tail(f: str, d1: str, d2: str) -> str:
    """P(F > f): the beta integral below d2 / (d2 + d1 f), over minus its logarithm."""
    a, b, y = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * ({f})))"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({y}))"
    return f"({front} * {_simpson(f'exp(-{a} * u_) * pow(1 - {y} * exp(-u_), {b} - 1)', '0', f'((4 * {b} + 60) / {a})')})"


def _summary_sql() -> str:
    """Every field of every model.  Tails are integrals, the t quantile a Newton iteration and
    the condition number Jacobi rotations (recursive CTEs), where the library takes continued
    fractions, bisection and an eigenvalue routine."""
    models = _candidate_lists()
    every = list(dict.fromkeys([*(c for feats in models.values() for c in feats), C.A_TARGET]))
    ctes = [f"smb AS MATERIALIZED (SELECT * FROM logs WHERE {_complete(every)})"]
    out = []
    for j, (name, feats) in enumerate(models.items()):
        tag, k = f"s{j}", len(feats)
        more, coef = _fit_ctes(tag, feats, "smb")
        places, pairs = f"range(1, {k + 1})", [(p, q) for p in range(1, k) for q in range(p + 1, k + 1)]
        gram = "[" + ", ".join("[" + ", ".join(f"sum({x}::DOUBLE * {y})" for y in feats) + "]" for x in feats) + "]"
        ctes += more + [f"""tq_{tag} AS (
  SELECT 0 AS k, 1.96::DOUBLE AS t, dfr FROM fin_{tag}
  UNION ALL
  SELECT k + 1, t + ({_t_tail('t', 'dfr')} - 0.025) / (exp(lgamma((dfr + 1) / 2.0) - lgamma(dfr / 2.0)) / sqrt(pi() * dfr) * pow(1 + t * t / dfr, -(dfr + 1) / 2.0)), dfr
  FROM tq_{tag} WHERE k < {NEWTON}),
pairs_{tag} AS (SELECT {[list(x) for x in pairs]} AS pq),
ja_{tag} AS (
  SELECT 0 AS k, {gram} AS m FROM smb
  UNION ALL
  SELECT k + 1, [[CASE WHEN a = p THEN c * m[p][b] - s * m[q][b] WHEN a = q THEN s * m[p][b] + c * m[q][b] ELSE m[a][b] END FOR b IN {places}] FOR a IN {places}]
  FROM (SELECT k, p, q, c, s, [[CASE WHEN b = p THEN c * m[a][p] - s * m[a][q] WHEN b = q THEN s * m[a][p] + c * m[a][q] ELSE m[a][b] END FOR b IN {places}] FOR a IN {places}] AS m
    FROM (SELECT *, t * c AS s FROM (SELECT *, 1 / sqrt(1 + t * t) AS c FROM (
      SELECT *, CASE WHEN m[p][q] = 0 THEN 0 WHEN tau < 0 THEN -1 / (sqrt(1 + tau * tau) - tau) ELSE 1 / (sqrt(1 + tau * tau) + tau) END AS t FROM (
        SELECT *, (m[q][q] - m[p][p]) / (2 * CASE WHEN m[p][q] = 0 THEN 1 ELSE m[p][q] END) AS tau FROM (
          SELECT k, m, pq[k % {len(pairs)} + 1][1] AS p, pq[k % {len(pairs)} + 1][2] AS q FROM ja_{tag}, pairs_{tag} WHERE k < {SWEEPS * len(pairs)}))))))),
full_{tag} AS (SELECT f.*, c.*, tq.t AS tq, sqrt(list_max(ev) / list_min(ev)) AS cond FROM fin_{tag} f, {coef} c, (SELECT t FROM tq_{tag} WHERE k = {NEWTON}) tq,
  (SELECT [m[a][a] FOR a IN {places}] AS ev FROM ja_{tag} WHERE k = {SWEEPS * len(pairs)}) e)"""]
        rows = [("model", n, expr) for n, expr in [*_fit_rows(k), ("f_pvalue", _f_tail("f", str(k), "dfr")), ("cond_no", "cond")]]
        for i, c in enumerate(feats):
            b, se = f"b{i + 1}", f"sqrt(ssr / dfr / ssr{i})"
            rows += [(c, "coef", b), (c, "std_err", se), (c, "t", f"{b} / {se}"), (c, "p_value", f"2 * {_t_tail(f'abs({b} / {se})', 'dfr')}"),
                     (c, "ci_low", f"{b} - tq * {se}"), (c, "ci_high", f"{b} + tq * {se}")]
        out += [f"SELECT '{name}' AS candidate, '{term}' AS term, '{stat}' AS stat, {O.r(expr)} AS value FROM full_{tag}" for term, stat, expr in rows]
    return "WITH RECURSIVE " + A_LOG_SQL + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(out)


@register("ols_summary", _summary_sql())
def q_ols_summary(spark, sf):
    """REG8 + REG9: full no-intercept OLS summaries of the log study's baseline and its
    five one-swap models, from one moments pass, one residual pass and one ranked pass."""
    made = SM.ols_summary(spark, _summary_frame(spark, sf), _candidate_lists(), C.A_TARGET, order_cols=["key"])
    return made.select("candidate", "term", "stat", _r("value"))
