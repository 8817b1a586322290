"""Property-based checks and layout invariance."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from lodestat.operators.moments import Moments, merge_all
from lodestat.operators.quantiles import quantiles

from conftest import SF_SMALL

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_quantile_search_matches_pandas(spark, vals, q):
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = quantiles(df, ["x"], [q], bits=16)["x"][q]
    want = pd.Series(vals).quantile(q)
    assert got == pytest.approx(want, rel=1e-12, abs=1e-9)


@settings(max_examples=30, deadline=None)
@given(data=st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=2, max_size=40),
       cut=st.integers(0, 40))
def test_moment_merge_is_exact(data, cut):
    x = np.array(data)
    cut = min(cut, len(x))

    def mom(a):
        if len(a) == 0:
            return Moments.empty(["a", "b"])
        c = a - a.mean(axis=0)
        return Moments(["a", "b"], float(len(a)), a.mean(axis=0), c.T @ c)

    merged = merge_all([mom(x[:cut]), mom(x[cut:])], ["a", "b"])
    whole = mom(x)
    assert merged.n == whole.n
    assert np.allclose(merged.mean, whole.mean, atol=1e-9)
    assert np.allclose(merged.cp, whole.cp, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("name", ["cv_scores", "qq_line", "exact_split", "outlier_fences"])
def test_query_layout_invariance(spark, name):
    """Same result with 3 and 17 shuffle partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = E.queries()[name](spark, SF_SMALL).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = E.queries()[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cols = sorted(a.columns)
    a = a[cols].sort_values(cols).reset_index(drop=True)
    b = b[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
