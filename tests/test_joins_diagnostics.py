"""Bucket join edge cases, chart tables and the regression summary."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import diagnostics as DG
from lodestat.operators import summary as SM
from lodestat.operators.timebucket import bucket_join, bucket_join_counted
from lodestat.functions import columns as X

T0 = dt.datetime(2024, 1, 1, 10, 0)


def _frames(spark):
    left = spark.createDataFrame([
        (1, "2024-01-01", T0 + dt.timedelta(minutes=5), 1),
        (2, "2024-01-01", T0 + dt.timedelta(minutes=29, seconds=59), 1),
        (3, "2024-01-01", T0 + dt.timedelta(minutes=30), 1),
        (4, None, None, 1),
        (5, "2024-01-01", T0 + dt.timedelta(hours=5), 1),
    ], "key bigint, date string, start_time timestamp_ntz, month int")
    right = spark.createDataFrame([
        ("2024-01-01", T0, 7, 1),
        ("2024-01-01", T0, 8, 1),                      # duplicate bucket: fan-out
        ("2024-01-01", T0 + dt.timedelta(minutes=30), 9, 1),
        (None, None, 10, 1),
    ], "date string, time timestamp_ntz, arrivals bigint, month int")
    return left, right


def test_bucket_join_fanout_and_count(spark):
    left, right = _frames(spark)
    out = bucket_join_counted(left, right, "start_time", "time").toPandas()
    assert {"month_x", "month_y", "bucket_count"} <= set(out.columns)
    by_key = out.groupby("key")
    assert by_key.size().to_dict() == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    counts = out.set_index("key").bucket_count
    assert set(counts.loc[[1, 2]]) == {4}       # 2 landings x 2 observation rows
    assert counts.loc[3] == 1 and counts.loc[5] == 1
    assert pd.isna(counts.loc[4])                # null key: no count
    assert pd.isna(out.set_index("key").arrivals.loc[4])
    plain = bucket_join(left, right, "start_time", "time").count()
    assert plain == len(out)


def test_bucket_join_null_safe(spark):
    left, right = _frames(spark)
    out = bucket_join_counted(left, right, "start_time", "time", null_safe=True).toPandas().set_index("key")
    assert out.arrivals.loc[4] == 10             # null key matches null key
    assert pd.isna(out.bucket_count.loc[4])


def test_histogram_edges(spark):
    df = spark.createDataFrame([("s", v) for v in [0.0, 1.0, 1.5, 3.0]] + [("c", 5.0), ("c", 5.0)],
                               "g string, v double")
    h = DG.histogram(df, "v", by=["g"], bins=3).toPandas()
    s = h[h.g == "s"].sort_values("bin")
    assert s["count"].tolist() == np.histogram([0.0, 1.0, 1.5, 3.0], bins=3)[0].tolist()   # [1, 2, 1]
    c = h[h.g == "c"]
    assert c["count"].sum() == 2 and len(c) == 3


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": x}))
    k = DG.kde_curve(df, "v", by=["g"], grid=20, bins=30).toPandas().sort_values("point")
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(x.min(), x.max(), 20)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(k.density, dens, rtol=1e-9)
    assert np.allclose(k.x, grid, rtol=1e-12)


def test_qq_points_and_line(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(2, 3, 200)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "k": np.arange(200), "v": x}))
    pts = DG.qq_points(df, "v", ["k"], by=["g"]).toPandas().sort_values("rank")
    n = 200
    pos = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    pos[-1] = 0.5 ** (1 / n)
    pos[0] = 1 - pos[-1]
    want = [X.normal_ppf_scalar(p) for p in pos]
    assert np.allclose(pts.theoretical, want, rtol=1e-10)
    assert np.allclose(pts["sample"], np.sort(x))
    line = DG.qq_line(DG.qq_points(df, "v", ["k"], by=["g"]), ["g"]).first()
    slope, icpt = np.polyfit(want, np.sort(x), 1)
    assert line.slope == pytest.approx(slope, rel=1e-9) and line.intercept == pytest.approx(icpt, rel=1e-9)


def test_durbin_watson(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=500)
    keys = rng.permutation(500)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "k": keys, "e": e}))
    got = DG.durbin_watson(df, "e", ["k"], by=["g"]).first().durbin_watson
    order = np.argsort(keys)
    es = e[order]
    assert got == pytest.approx((np.diff(es) ** 2).sum() / (es ** 2).sum(), rel=1e-10)


def test_special_functions():
    # textbook values
    assert SM.t_sf(2.0, 10) == pytest.approx(0.036694017385370196, rel=1e-9)
    assert SM.t_sf(-1.0, 5) == pytest.approx(1 - 0.18160873382456127, rel=1e-9)
    assert SM.t_ppf(0.975, 20) == pytest.approx(2.0859634472658364, rel=1e-8)
    assert SM.f_sf(3.0, 4, 20) == pytest.approx(0.0432010, rel=1e-5)   # by numerical integration
    assert SM.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)


def test_ols_summary_against_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"k": np.arange(n), "a": rng.normal(3, 1, n), "b": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = 2 * pdf.a - pdf.b + rng.normal(0, 1, n)
    df = spark.createDataFrame(pdf)
    v = SM.ols_summary_values(df, ["a", "b"], "y", order_cols=["k"])
    lr = LinearRegression(featuresCol="f", labelCol="y", fitIntercept=False, solver="normal", regParam=0.0)
    model = lr.fit(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df))
    s = model.summary
    assert [v["terms"][c]["coef"] for c in ("a", "b")] == pytest.approx(list(model.coefficients), rel=1e-8)
    assert [v["terms"][c]["std_err"] for c in ("a", "b")] == pytest.approx(list(s.coefficientStandardErrors), rel=1e-6)
    assert [v["terms"][c]["p_value"] for c in ("a", "b")] == pytest.approx(list(s.pValues), rel=1e-4, abs=1e-12)
    e = pdf.y - model.coefficients[0] * pdf.a - model.coefficients[1] * pdf.b
    assert v["model"]["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum(), rel=1e-9)
    assert v["model"]["r2"] == pytest.approx(1 - (e ** 2).sum() / (pdf.y ** 2).sum(), rel=1e-9)


def test_kde_cells_match_full_sum(spark):
    # heavy tail: the bandwidth is small against the range, so a cell meets only the
    # grid points within the cut; sums must equal the full ones to a rounding of one row's kernel
    rng = np.random.default_rng(11)
    x = rng.lognormal(0, 3, 5000)
    h = len(x) ** -0.2 * x.std(ddof=1)
    assert 2 * DG.KDE_CUT * h < x.max() - x.min()
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": x}))
    k = DG.kde_curve(df, "v", by=["g"], grid=200, bins=30).toPandas().sort_values("point")
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(k) == 200
    assert np.allclose(k.density.to_numpy(), dens, rtol=1e-12, atol=1e-15 / h)
    plan = DG.kde_curve(df, "v", by=["g"], grid=200, bins=30)._jdf.queryExecution().optimizedPlan().toString()
    above_cells = plan[: plan.index("__cell")] if "__cell" in plan else plan
    assert plan.count("Generate") == 2 and "Generate" in above_cells  # the grid and the cells, no rows


def test_durbin_watson_groups_spanning_partitions(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, n in (("big", 3000), ("small", 7)):
        e = rng.normal(size=n)
        rows += [(g, int(k), float(v)) for k, v in zip(rng.permutation(n), e)]
    pdf = pd.DataFrame(rows, columns=["g", "k", "e"])
    got = {r.g: r.durbin_watson for r in DG.durbin_watson(spark.createDataFrame(pdf), "e", ["k"], by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        es = part.sort_values("k").e.to_numpy()
        assert got[g] == pytest.approx((np.diff(es) ** 2).sum() / (es ** 2).sum(), rel=1e-10)


def test_bin_counts_2d_match_numpy(spark):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=2000), rng.gamma(2.0, size=2000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    got = DG.bin_counts_2d(df, "x", "y", by=["g"], bins=10).toPandas()
    want, _, _ = np.histogram2d(x, y, bins=10)
    grid = np.zeros((10, 10))
    for r in got.itertuples():
        grid[r.bin_x - 1, r.bin_y - 1] = r.count
    assert np.array_equal(grid, want)


def test_scatter_sample_keeps_the_smallest_of_each_cell(spark):
    from lodestat import config as C
    from lodestat.functions import columns as X

    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "k": np.arange(n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    pdf.loc[::50, "y"] = np.nan
    pdf.loc[pdf.index % 2 == 0, ["x", "y"]] = 0.25           # half of the rows are one point
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(6)
    made = DG.scatter_sample(df, "x", "y", "k", by=["g"], bins=8, k=4).toPandas()
    cells = DG._grid(df, "x", "y", ["g"], 8).withColumn("h", X.key_hash(["k"], C.SPLIT_SEED)).toPandas()
    want = []
    for (g, bx, by_), own in cells.groupby(["g", "bin_x", "bin_y"]):
        want += [(g, bx, by_, len(own), key) for key in own.sort_values(["h", "k"]).k.head(4)]
    assert sorted(made[["g", "bin_x", "bin_y", "count", "key"]].itertuples(index=False, name=None)) == sorted(want)
    assert DG.scatter_sample(df.limit(0), "x", "y", "k", by=["g"]).count() == 0
