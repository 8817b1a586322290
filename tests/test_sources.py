import pytest
import os
import tempfile

from pyspark.sql import functions as F

from lodestat.functions import columns as X
from lodestat.sources import tables as S
from lodestat.sources import fixtures as FX

from conftest import SF_SMALL


def test_csv_roundtrip_with_and_without_schema(spark):
    df = spark.createDataFrame([(1, "a", 2.5, None), (2, None, -1.0, 3)], "k bigint, s string, x double, n int")
    folder = os.path.join(tempfile.mkdtemp(prefix="lodestat-csv-"), "out")
    S.write_csv(df, folder)
    typed = S.read_csv(spark, folder, df.schema)
    assert sorted(typed.collect()) == sorted(df.collect())
    inferred = S.read_csv(spark, folder)
    assert dict(inferred.dtypes) == {"k": "bigint", "s": "string", "x": "double", "n": "bigint"}
    assert sorted(map(tuple, inferred.collect())) == sorted(map(tuple, df.collect()))


def _text(spark, tmp_path, lines):
    path = str(tmp_path / "t")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
    return path


def test_inferred_types_are_the_narrowest_that_fit(spark, tmp_path):
    path = _text(spark, tmp_path, ["a,b,c,d,e,f", "1,1.5,true,x,,9", "-2,2,FALSE,1,,9223372036854775808", ",NaN,,,,1e3", "7"])
    made = S.infer_csv_types(spark, path)
    assert [f.dataType.simpleString() for f in made] == ["bigint", "double", "boolean", "string", "string", "double"]
    empty = str(tmp_path / "e")
    spark.createDataFrame([], "line string").write.text(empty)
    assert S.infer_csv_types(spark, empty).names == []


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_text_is_named(spark, tmp_path, ansi):
    path = _text(spark, tmp_path, ["k,t", "1,2024-01-01 10:00:00", "two,2024-01-01T10:00:00.5", "3,yesterday", "4", "5,2024-01-02,x", "6,"])
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rejects = {(r["column_name"], r["value"], r["reason"]) for r in S.csv_rejects(spark, path, "k bigint, t timestamp_ntz").collect()}
        assert rejects == {("k", "two", "not a bigint"), ("t", "yesterday", "not a timestamp_ntz"), (None, "4", "wrong number of fields"), (None, "5,2024-01-02,x", "wrong number of fields")}
        for line, column, named in (("two,2024-01-01", "k", "k: not a bigint: two"), ("3,yesterday", "t", "t: not a timestamp_ntz: yesterday"),
                                    ("5,2024-01-02,x", "t", "wrong number of fields: 5,2024-01-02,x")):
            one = tmp_path / named.replace(" ", "").replace(":", "").replace(",", "")
            one.mkdir()
            with pytest.raises(Exception, match=named):
                S.read_csv(spark, _text(spark, one, ["k,t", line]), "k bigint, t timestamp_ntz").select(column).collect()
        times = spark.createDataFrame([("2024-01-01T10:00:00.5",), (None,)], "t string").select(X.parse_timestamp("t").alias("t"))
        assert {str(r["t"]) for r in times.collect()} == {"2024-01-01 10:00:00.500000", "None"}
        with pytest.raises(Exception, match="not a timestamp: yesterday"):
            spark.createDataFrame([("yesterday",)], "t string").select(X.parse_timestamp("t")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "c")], "a int, b string")
    prof = {r.column_name: r for r in S.profile(df).collect()}
    assert prof["a"].non_null == 2 and prof["b"].non_null == 2
    assert prof["a"].n_rows == 3 and prof["a"].dtype == "int" and prof["b"].position == 1


def test_preview_is_ordered(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2).orderBy(F.rand(1))
    got = [r.id for r in S.preview(df, ["id"], 5).collect()]
    assert got == [0, 1, 2, 3, 4]


def test_fixture_shapes():
    import pyarrow.parquet as pq
    assert pq.ParquetFile(f"{SF_SMALL}/events.parquet").metadata.num_rows > 0


def test_fixture_b_has_null_aggregates_for_orders_without_lines(spark):
    ob = FX.order_frame(spark, SF_SMALL)
    assert ob.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert ob.where(F.col("n_lines").isNull()).count() > 0
    assert set(r.atom for r in ob.select("atom").distinct().collect()) == {"winter", "not_winter"}


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from lodestat.session import ensure_checkpoint_dir

    sc = SimpleNamespace(master="spark://somewhere", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
