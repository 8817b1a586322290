"""Exact quantiles (radix selection) and the distributed global rank."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators.quantiles import quantiles
from lodestat.operators.ranking import global_rank
from lodestat.operators.features import exact_split


def _frame(spark, values, parts=7):
    pdf = pd.DataFrame({"k": np.arange(len(values)), "x": values})
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("bits", [5, 11, 16])
def test_quantiles_match_pandas(spark, bits):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.lognormal(0, 2, 3000), np.full(1000, 7.25), [np.nan] * 10])
    df = _frame(spark, vals)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x"], probs, bits=bits)["x"]
    want = pd.Series(vals).quantile(probs)
    for p in probs:
        assert got[p] == pytest.approx(want[p], rel=1e-12)


def test_quantiles_hot_value_and_constant(spark):
    vals = np.array([3.0] * 500 + [1.0, 9.0])
    got = quantiles(_frame(spark, vals), ["x"], [0.25, 0.5, 0.75], bits=4)["x"]
    assert got == {0.25: 3.0, 0.5: 3.0, 0.75: 3.0}
    const = quantiles(_frame(spark, np.full(10, 2.0)), ["x"], [0.5])["x"]
    assert const[0.5] == 2.0


def test_quantiles_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "k bigint, x double")
    assert quantiles(df, ["x"], [0.5])["x"][0.5] is None


def test_global_rank_matches_sort_and_layout(spark):
    rng = np.random.default_rng(2)
    vals = np.round(rng.normal(size=3000), 1)   # many ties, broken by key
    df = _frame(spark, vals)
    want = pd.DataFrame({"k": np.arange(3000), "x": vals}).sort_values(["x", "k"]).k.tolist()
    for parts in (1, 5):
        got = global_rank(df, ["x", "k"], n_partitions=parts).orderBy("rank").collect()
        assert [r.k for r in got] == want
        assert [r["rank"] for r in got] == list(range(1, 3001))


def test_global_rank_within_groups_with_hot_group(spark):
    rows = [("hot", i, float(i % 17)) for i in range(2000)] + [("cold", i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double")
    got = global_rank(df, ["x", "k"], within=["g"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["x", "k"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1))


def test_exact_split_sizes(spark):
    df = spark.range(103).withColumnRenamed("id", "key").withColumn("g", F.lit("a"))
    out = exact_split(df, ["key"], 42, 0.2, within=["g"], k=5).toPandas()
    assert out.is_test.sum() == 21               # ceil(0.2 * 103)
    sizes = out.groupby("fold").size().sort_index().tolist()
    assert sizes == [21, 21, 21, 20, 20]         # first n mod k folds take one more


def test_exact_split_against_a_sort(spark, monkeypatch):
    from lodestat.operators import features as FE

    # a hash of few values, so that bounds fall among keys that share one
    monkeypatch.setattr(FE.X, "key_hash", lambda keys, seed: F.col(keys[0]) % 3)
    rows = [(g, i, str(i % 7)) for g, n in (("a", 50), (None, 9), ("c", 1), ("d", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k bigint, t string").repartition(4)
    made = exact_split(df, ["k", "t"], 1, 0.2, within=["g"], k=5)
    got = {(r["g"], r["k"]): (r["is_test"], r["fold"]) for r in made.collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r[1] % 3, r[1]) for r in rows if r[0] == g)
        n = len(own)
        for rank, (_, key) in enumerate(own):
            fold = next(f for f in range(5) if rank < sum(n // 5 + (j < n % 5) for j in range(f + 1)))
            assert got[g, key] == (rank < math.ceil(0.2 * n), fold)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Aggregate", "Join", "Window"))  # rows are labelled where they are
    assert exact_split(df.limit(0), ["k"], 1).count() == 0


def test_exact_split_ranks_every_row_as_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as E

    # the rank itself is a result; keys repeat and are null
    rows = [(i // 2 if i % 9 else None, 100.0, datetime.datetime(2024, 1 + i % 12, 1), "1-URGENT") for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "l_orderkey long, l_quantity double, l_discount double, l_tax double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM parquet_scan('{tmp_path}/{t}.parquet/*.parquet')")
    made = E.queries()["exact_split"](spark, str(tmp_path))
    assert made.columns == ["atom", "key", "split_rank", "is_test", "fold"]
    want = duck.sql(E.oracle_sql()["exact_split"])
    assert want.columns == made.columns

    def by_rank(rows):
        return sorted(map(tuple, rows), key=lambda r: (r[0], r[2]))

    got = by_rank(made.collect())
    assert got == by_rank(want.fetchall())
    for atom in {r[0] for r in got}:
        ranks = [r[2] for r in got if r[0] == atom]
        assert ranks == list(range(1, len(ranks) + 1))


WIDE = [[1.0, 2.0, 3.0, np.inf], [-1.7e308, 0.0, 1.0, 1.7e308], [-np.inf, -np.inf, 5.0, np.inf, np.inf], [5e-324, -5e-324, 0.0, -0.0, 1e308],
        [np.inf] * 3, [-1.5, np.nan, 2.5, -np.inf]]


@pytest.mark.parametrize("values", WIDE)
def test_quantiles_end_on_every_double(spark, values, monkeypatch):
    import duckdb

    from lodestat.operators import quantiles as Q

    passes, count = [], Q._histograms
    monkeypatch.setattr(Q, "_histograms", lambda *a: passes.append(1) or count(*a))
    probs = [0.0, 0.25, 0.4, 0.5, 0.75, 1.0]
    got = quantiles(_frame(spark, np.array(values)), ["x"], probs)["x"]
    assert len(passes) <= 6
    own = pd.DataFrame({"x": [v for v in values if not np.isnan(v)]})  # noqa: F841 -- read by DuckDB
    for p in probs:
        want = duckdb.sql(f"SELECT quantile_cont(x, {p}) FROM own").fetchall()[0][0]
        assert got[p] == want or got[p] == pytest.approx(want, rel=1e-15) or (np.isnan(got[p]) and np.isnan(want))


def test_keys_keep_the_order_of_doubles():
    from lodestat.operators.quantiles import from_key, sortable

    values = np.sort(np.concatenate([np.random.default_rng(0).normal(0, 1, 500) * 10.0 ** np.arange(-250, 250), [0.0, np.inf, -np.inf, 5e-324, -5e-324]]))
    keys = sortable(values)
    assert (keys[1:] > keys[:-1]).all() and [from_key(int(k)) for k in keys] == values.tolist()
    assert sortable(np.array([-0.0]))[0] == sortable(np.array([0.0]))[0]


def test_ranks_of_many_columns_share_passes(spark):
    from lodestat.operators.quantiles import order_statistics

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 3, 900).astype(float), "c": np.full(900, np.nan)})
    counts, found = order_statistics(spark.createDataFrame(pdf).repartition(5), list(pdf), lambda n: [0, n // 3, n - 1, n])
    assert counts == {"a": 900, "b": 900, "c": 0} and found["c"] == {}
    for c in "ab":
        order = np.sort(pdf[c])
        assert found[c] == {r: order[r] for r in (0, 300, 899)}
