"""Prepared frames of the two analyses (all lazy unless stated)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as FE
from ..operators.timebucket import bucket_join_counted
from ..session import materialize
from ..sources import fixtures as FX

SEASONS = ("Other", "Spring", "Winter")   # codomain of the season function, sorted
A_SEGMENTS = {"winter": ["winter"], "spring": ["spring"]}   # "spring" is every non-winter row


#: Fixture -> its landings and observations.
INPUTS = {"A": (FX.landings, FX.observations), "D": (FX.order_landings, FX.shipment_observations)}


def joined_a(spark: SparkSession, sf_dir: str, fixture: str = "A") -> DataFrame:
    """JON1 + JON2 on fixture A or D."""
    landings, observations = INPUTS[fixture]
    return bucket_join_counted(landings(spark, sf_dir), observations(spark, sf_dir),
                               "start_time", "time", count_col="bucket_count")


def features_a(spark: SparkSession, sf_dir: str, fixture: str = "A") -> DataFrame:
    return FE.landing_features(joined_a(spark, sf_dir, fixture))


def clean_a(spark: SparkSession, sf_dir: str, fixture: str = "A") -> DataFrame:
    return FE.clean_columns(features_a(spark, sf_dir, fixture))


def encode_a(df: DataFrame) -> DataFrame:
    """FEA3 + PRJ6 + FLT1: season dummies, seasonal interactions, segment atom."""
    enc, _ = FE.onehot(df, "season", categories=SEASONS)
    enc = enc.withColumns({
        "seasonal_arrival_present": F.col("season_Winter") * F.col("arrival_present"),
        "seasonal_food": F.col("season_Winter") * F.col("food_fraction"),
        "atom": F.when(F.col("season_Winter") == 1.0, F.lit("winter")).otherwise(F.lit("spring")),
    })
    return enc


def clean_a_materialized(spark: SparkSession, sf_dir: str, fixture: str = "A", columns=None) -> DataFrame:
    """The cleaned landings (those of ``columns``, if given, and what the encoding needs)
    written once to the checkpoint folder, for queries that run several jobs on them
    (quantile search, fits, scoring)."""
    df = clean_a(spark, sf_dir, fixture)
    if columns is not None:
        needed = {"key", "season", "arrival_present", "food_fraction", C.A_TARGET, *columns}
        df = df.select(*[c for c in df.columns if c in needed])
    return materialize(df, key=["key"])


def repaired_a(spark: SparkSession, sf_dir: str, fixture: str = "A", columns=None, **kw) -> DataFrame:
    """v1: outliers repaired on all rows before the split (one quantile search)."""
    columns = None if columns is None else [*columns, *C.A_REPAIR_COLUMNS]
    return FE.repair_outliers(clean_a_materialized(spark, sf_dir, fixture, columns), C.A_REPAIR_COLUMNS, **kw)


def candidate_features(df: DataFrame) -> list[str]:
    """PRJ2: every numeric column except the exclusion set and helper columns."""
    numeric = {"int", "bigint", "double"}
    types = dict(df.dtypes)
    return [c for c in FE.select_except(df, [*C.A_EXCLUDE, "atom"]) if types[c] in numeric]


def order_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B with the hash split and folds (seed 42)."""
    df = FX.order_frame(spark, sf_dir)
    df = FE.add_split(df, ["key"], C.SPLIT_SEED, C.TEST_SIZE)
    return FE.add_folds(df, ["key"], C.FOLD_SEED, C.N_FOLDS)


def b_features() -> dict[str, list[str]]:
    return {seg: list(C.B_FEATURES) for seg in C.B_SEGMENTS}
