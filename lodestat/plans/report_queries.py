
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import crossval as CV
from ..operators import features as FE
from ..operators import metrics as MET
from ..operators import regression as RG
from . import oracle as O
from . import prepare as P
from .prep_queries import FENCES_SQL, _repair_sql_expr
from .registry import register

A_FEATURES = {"winter": list(C.A_WINTER_FEATURES), "spring": list(C.A_SPRING_FEATURES)}
D_FEATURES = {"winter": list(C.A_WINTER_FEATURES), "spring": list(C.D_SPRING_FEATURES)}


def _used(features: dict[str, list[str]]) -> list[str]:
    return [c for feats in features.values() for c in feats]


def v1_frame(spark, sf, features=A_FEATURES, fixture="A"):
    """Cleaned landings, outliers repaired on all rows, encoded, split, folded."""
    enc = P.encode_a(P.repaired_a(spark, sf, fixture, _used(features)))
    enc = FE.add_split(enc, ["key"], C.SPLIT_SEED, C.TEST_SIZE)
    return FE.add_folds(enc, ["key"], C.FOLD_SEED, C.N_FOLDS)


def segment_report(df, features, target, segments, atom_col="atom"):
    """(segment, stage, n, mse, rmse, r2): train, test and 5-fold CV average.
    One moments pass grouped by (atom, fold, split) serves the split models and
    all fold models; one final job scores train/test and the folds."""
    fits, cv_fits = RG.segment_fold_models(df, features, target, segments, atom_col, "fold", "is_test",
                                           C.N_FOLDS)
    models = {}
    for seg, atoms in segments.items():
        member = F.col(atom_col).isin(*atoms)
        models[f"{seg}|train"] = (member & ~F.col("is_test"), RG.predict(fits[seg]))
        models[f"{seg}|test"] = (member & F.col("is_test"), RG.predict(fits[seg]))
    tt = MET.evaluate(df, target, models)
    parts = F.split(F.col("model"), "\\|")
    tt = tt.select(parts[0].alias("segment"), parts[1].alias("stage"), "n", "mse", "rmse", "r2")
    cv = CV.score_folds(df, cv_fits, target, segments, atom_col, "fold", C.N_FOLDS)
    cva = cv.where(F.col("n") > 0).groupBy("segment").agg(
        F.sum("n").alias("n"), F.avg("mse").alias("mse"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))
    cva = cva.select("segment", F.lit("cv").alias("stage"), F.col("n").cast("bigint").alias("n"), "mse", "rmse", "r2")
    out = tt.unionByName(cva).where(F.col("n") > 0)
    return out.select("segment", "stage", "n", *[X.rounded(c).alias(c) for c in ("mse", "rmse", "r2")])


def _segments_sql(features: dict[str, list[str]], segments: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Oracle CTEs over ``enc2`` (atom, is_test, fold): per segment a
    Gram-Schmidt fit on the training rows and one per CV fold."""
    ctes, selects = [], []
    for seg, feats in features.items():
        comp = " AND ".join(f"{c} IS NOT NULL" for c in [*feats, C.A_TARGET])
        atoms = ", ".join(f"'{a}'" for a in segments[seg])
        ctes.append(f"s_{seg} AS (SELECT '{seg}' AS segment, * FROM enc2 WHERE atom IN ({atoms}) AND {comp})")
        g, scored, _ = O.gs_ctes(f"m_{seg}", f"s_{seg}", ["segment"], [], feats, C.A_TARGET, "NOT is_test")
        ctes += g
        ms = O.metric_select("__y", "__yhat", rounded=False)
        keep = [m for m in ms if m.endswith((" AS n", " AS mse", " AS rmse", " AS r2"))]
        ctes.append(f"tt_{seg} AS (SELECT segment, CASE WHEN __t THEN 'train' ELSE 'test' END AS stage, "
                    f"{', '.join(keep)} FROM {scored} GROUP BY 1, 2)")
        ctes.append(f"cvb_{seg} AS (SELECT s.*, f.mf FROM s_{seg} s, "
                    f"(SELECT CAST(unnest(range({C.N_FOLDS})) AS INTEGER) AS mf) f)")
        g, scored, _ = O.gs_ctes(f"c_{seg}", f"cvb_{seg}", ["segment", "mf"], ["fold"], feats, C.A_TARGET,
                                 "fold <> mf")
        ctes += g
        ctes.append(f"cvs_{seg} AS (SELECT segment, mf, {', '.join(keep)} FROM {scored} WHERE fold = mf GROUP BY 1, 2)")
        ctes.append(f"cva_{seg} AS (SELECT segment, 'cv' AS stage, CAST(sum(n) AS BIGINT) AS n, avg(mse) AS mse, "
                    f"avg(rmse) AS rmse, avg(r2) AS r2 FROM cvs_{seg} WHERE n > 0 GROUP BY 1)")
        selects += [f"SELECT * FROM tt_{seg}", f"SELECT * FROM cva_{seg}"]
    return ctes, selects


_ENCODE_SQL = ("enc AS (SELECT * EXCLUDE (season), CASE WHEN season = 'Spring' THEN 1.0 ELSE 0.0 END AS season_Spring, "
               "CASE WHEN season = 'Winter' THEN 1.0 ELSE 0.0 END AS season_Winter FROM {src}),\n"
               "enc2 AS (SELECT *, CASE WHEN season_Winter = 1.0 THEN 'winter' ELSE 'spring' END AS atom, "
               f"{O.is_test_sql(['key'], C.SPLIT_SEED)} AS is_test, {O.fold_sql(['key'], C.FOLD_SEED)} AS fold FROM enc)")


def _report_sql(head: str, src: str, features: dict[str, list[str]], segments: dict[str, list[str]]) -> str:
    ctes, selects = _segments_sql(features, segments)
    body = ("SELECT segment, stage, CAST(n AS BIGINT) AS n, " + ", ".join(f"{O.r(m)} AS {m}" for m in ("mse", "rmse", "r2"))
            + " FROM (" + " UNION ALL ".join(selects) + ") WHERE n > 0")
    return head + ",\n" + _ENCODE_SQL.format(src=src) + ",\n" + ",\n".join(ctes) + "\n" + body


def _v1_sql(features=A_FEATURES) -> str:
    rep_cols = ", ".join(f"{_repair_sql_expr(c)} AS {c}" for c in C.A_REPAIR_COLUMNS)
    head = FENCES_SQL + f",\nrep AS (SELECT * REPLACE ({rep_cols}) FROM clean)"
    return _report_sql(head, "rep", features, P.A_SEGMENTS)


@register("seasonal_report_landings", _v1_sql())
def q_report_landings(spark, sf):
    """Entry B on fixture A: join, features, clean, IQR repair, one-hot, per-
    segment feature lists, split, standardise, fit, train/test/CV scores."""
    return segment_report(v1_frame(spark, sf), A_FEATURES, C.A_TARGET, P.A_SEGMENTS)


@register("seasonal_report_all_months", O.on_orders(_v1_sql(D_FEATURES)))
def q_report_all_months(spark, sf):
    """Entry B on fixture D, whose landings cover all months: both segments, each with
    its own feature list (season_Winter is constant in each)."""
    return segment_report(v1_frame(spark, sf, D_FEATURES, "D"), D_FEATURES, C.A_TARGET, P.A_SEGMENTS)


def _year_sql() -> str:
    from .model_queries import _cv_sql
    ms = O.metric_select("__y", "__yhat", rounded=False)
    keep = [m for m in ms if m.endswith((" AS n", " AS mse", " AS rmse", " AS r2"))]
    g, scored, _ = O.gs_ctes("g", "seg", ["segment"], ["key", "is_test", "fold"], C.B_FEATURES, C.B_TARGET,
                             "NOT is_test")
    head = _cv_sql()
    return (head.rstrip("\n") + ",\n" + ",\n".join(g)
            + f",\ntt AS (SELECT segment, CASE WHEN __t THEN 'train' ELSE 'test' END AS stage, {', '.join(keep)} "
            f"FROM {scored} GROUP BY 1, 2),\n"
            "cva AS (SELECT segment, 'cv' AS stage, CAST(sum(n) AS BIGINT) AS n, avg(mse) AS mse, avg(rmse) AS rmse, "
            "avg(r2) AS r2 FROM cvs WHERE n > 0 GROUP BY 1)\n"
            "SELECT segment, stage, CAST(n AS BIGINT) AS n, " + ", ".join(f"{O.r(m)} AS {m}" for m in ("mse", "rmse", "r2"))
            + " FROM (SELECT * FROM tt UNION ALL SELECT * FROM cva) WHERE n > 0")


@register("seasonal_report_orders", _year_sql())
def q_report_orders(spark, sf):
    """Entry C's three-segment report (winter, not winter, whole year) on the
    order frame."""
    return segment_report(P.order_b(spark, sf), P.b_features(), C.B_TARGET, C.B_SEGMENTS)


# --- entry C on the landings: no repair, log-recoded flag, whole year beside the seasons ----------

A_V3_FEATURES = {
    "winter": [*C.A_LOG_BASE[:4], "log_arrivals_exceed", "season_Winter"],
    "spring": list(C.A_SPRING_FEATURES),
    "year": [*C.A_LOG_BASE[:4], "log_arrivals_exceed"],
}
D_V3_FEATURES = A_V3_FEATURES | {"spring": list(C.D_SPRING_FEATURES)}
A_V3_SEGMENTS = {"winter": ["winter"], "spring": ["spring"], "year": ["winter", "spring"]}


def v3_frame(spark, sf, features=A_V3_FEATURES, fixture="A"):
    """Cleaned landings (no outlier repair) with the kept log column derived
    before segmenting, encoded, split and folded."""
    df = FE.with_logs(P.clean_a_materialized(spark, sf, fixture, [*_used(features), "arrivals_exceed"]), ["arrivals_exceed"])
    enc = P.encode_a(df)
    enc = FE.add_split(enc, ["key"], C.SPLIT_SEED, C.TEST_SIZE)
    return FE.add_folds(enc, ["key"], C.FOLD_SEED, C.N_FOLDS)


def _v3_sql(features=A_V3_FEATURES) -> str:
    from .model_queries import A_LOG_SQL
    head = "WITH " + A_LOG_SQL
    return _report_sql(head, "logs", features, A_V3_SEGMENTS)


@register("seasonal_report_landings_v3", _v3_sql())
def q_report_landings_v3(spark, sf):
    """Entry C on fixture A: winter, spring and whole-year models with the
    log-recoded flag, train/test/CV scores, from one moments pass."""
    return segment_report(v3_frame(spark, sf), A_V3_FEATURES, C.A_TARGET, A_V3_SEGMENTS)


@register("seasonal_report_all_months_v3", O.on_orders(_v3_sql(D_V3_FEATURES)))
def q_report_all_months_v3(spark, sf):
    """Entry C on fixture D: winter, spring and whole-year models that differ."""
    return segment_report(v3_frame(spark, sf, D_V3_FEATURES, "D"), D_V3_FEATURES, C.A_TARGET, A_V3_SEGMENTS)


# --- REG7 on the landings (v1: repaired, per-segment feature lists) -----------------------------

def _v1_coef_sql(features=A_FEATURES) -> str:
    rep_cols = ", ".join(f"{_repair_sql_expr(c)} AS {c}" for c in C.A_REPAIR_COLUMNS)
    head = FENCES_SQL + f",\nrep AS (SELECT * REPLACE ({rep_cols}) FROM clean)"
    ctes, parts = [], []
    for seg, feats in features.items():
        comp = " AND ".join(f"{c} IS NOT NULL" for c in [*feats, C.A_TARGET])
        ctes.append(f"k_{seg} AS (SELECT '{seg}' AS segment, * FROM enc2 WHERE atom = '{seg}' AND {comp})")
        g, _, coef = O.gs_ctes(f"w_{seg}", f"k_{seg}", ["segment"], [], feats, C.A_TARGET, "NOT is_test")
        ctes += g
        parts.append(f"SELECT segment, '(intercept)' AS term, my AS coef FROM {coef} JOIN w_{seg}_m USING (segment)")
        parts += [f"SELECT segment, '{c}', s{i + 1} FROM {coef}" for i, c in enumerate(feats)]
    body = ("SELECT segment, term, " + O.r("coef") + " AS coef, " + O.r("abs(coef)") + " AS abs_coef FROM ("
            + " UNION ALL ".join(parts) + ")")
    return head + ",\n" + _ENCODE_SQL.format(src="rep") + ",\n" + ",\n".join(ctes) + "\n" + body


@register("season_models_landings", _v1_coef_sql())
def q_season_models_landings(spark, sf):
    """REG2 + REG7 on the repaired landings with the winter and spring feature
    lists (the constant season dummy gets coefficient 0; an empty segment
    has no model)."""
    return _landing_models(spark, v1_frame(spark, sf), A_FEATURES)


@register("season_models_all_months", O.on_orders(_v1_coef_sql(D_FEATURES)))
def q_season_models_all_months(spark, sf):
    """REG6 + REG7 on fixture D: winter and spring models with their own feature lists."""
    return _landing_models(spark, v1_frame(spark, sf, D_FEATURES, "D"), D_FEATURES)


def _landing_models(spark, df, features):
    fits = RG.fit_segments(df, features, C.A_TARGET, P.A_SEGMENTS, "atom", train=~F.col("is_test"))
    fits = {seg: f for seg, f in fits.items() if f.n > 0}
    return RG.coefficient_table(spark, fits).select("segment", "term", X.rounded("coef").alias("coef"),
                                                   X.rounded("abs_coef").alias("abs_coef"))
