"""Least squares from the tall-skinny QR factorisation."""

import numpy as np
import pandas as pd
import pytest

from lodestat.operators import collinearity as CO
from lodestat.operators import qr as QR


def _frame(spark, x, parts=7):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(parts), names


@pytest.mark.parametrize("condition", [1e2, 1e9])
def test_coefficients_agree_with_svd(spark, condition):
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.normal(size=(4000, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = u * np.geomspace(1, 1 / condition, 5) @ v
    y = x @ np.array([1.0, -2.0, 3.0, 0.5, 4.0])
    df, names = _frame(spark, np.column_stack([x, y]))
    coef, ssr, rank = QR.factor(df, names).regress("c5", names[:5])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert rank == 5 and np.allclose(coef, want, rtol=1e-6) and ssr < 1e-20
    if condition == 1e9:  # normal equations lose all of it
        lost = np.linalg.lstsq(x.T @ x, x.T @ y, rcond=1e-10)[0]
        assert not np.allclose(lost, want, rtol=1e-2)


def test_vif_of_nearly_dependent_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    x[:, 3] = x[:, 0] + 1e-6 * rng.normal(size=3000)
    df, names = _frame(spark, x)
    got = CO.vif_values(df, names)
    for i, c in enumerate(names):
        others = np.delete(x, i, axis=1)
        left = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c] == pytest.approx((x[:, i] ** 2).sum() / (left ** 2).sum(), rel=1e-6)
    assert got["c0"] > 1e11


def test_groups_missing_values_and_rank(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [50, 3, 1]), "x": rng.normal(size=54), "y": rng.normal(size=54)})
    pdf["z"] = 2 * pdf.x
    pdf.loc[[0, 10], "y"] = np.nan
    pdf.loc[pdf.g == "c", "x"] = np.nan
    made = QR.factors(spark.createDataFrame(pdf).repartition(5), ["x", "z", "y"], by=["g"])
    assert {g: f.n for g, f in made.items()} == {"a": 48, "b": 3}
    for g, f in made.items():
        own = pdf[(pdf.g == g)].dropna()
        coef, ssr, rank = f.regress("y", ["x", "z"])
        want = np.linalg.lstsq(own[["x", "z"]], own.y, rcond=1e-12)[0]
        assert rank == 1 and ssr == pytest.approx(((own.y - own[["x", "z"]] @ want) ** 2).sum())
        assert coef[0] * 1 + coef[1] * 2 == pytest.approx(want[0] + 2 * want[1])
        assert f.dot("x", "y") == pytest.approx(own.x @ own.y)
    empty = QR.factor(spark.createDataFrame(pdf.iloc[:0], "g string, x double, y double, z double"), ["x", "y"])
    assert empty.n == 0 and np.isnan(CO.vif_values(spark.createDataFrame(pdf.iloc[:0], "g string, x double, y double, z double"), ["x", "y"])["x"])
