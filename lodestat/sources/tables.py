"""SRC1-3: scans, profile and preview."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns here lets Catalyst prune the read schema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


#: Types of a text column in order of preference, each with its bit; text itself fits any value.
TEXT_TYPES = (("bigint", 1), ("double", 2), ("boolean", 4), ("string", 8))
_CORRUPT = "__corrupt_record"


def _text_scan(spark: SparkSession, path: str, columns: list[str], header: bool) -> DataFrame:
    """All columns as text, and the whole line where it has too few or too many fields (for
    which each line is cut whole, whatever columns are asked for)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    return (spark.read.option("header", str(header).lower()).option("mode", "PERMISSIVE").option("columnPruning", "false")
            .option("columnNameOfCorruptRecord", _CORRUPT).schema(schema).csv(path))


def _typed(c: str, kind: str):
    return F.col(f"`{c}`").try_cast(kind)


def csv_columns(spark: SparkSession, path: str, header: bool = True) -> list[str]:
    """Column names, from the header or as _c0, _c1, ... (reads the first line only)."""
    return spark.read.option("header", str(header).lower()).csv(path).columns


def infer_csv_types(spark: SparkSession, path: str, header: bool = True) -> T.StructType:
    """SRC1: each column's narrowest type among ``TEXT_TYPES`` that every value of every
    row fits, nulls apart, in one aggregation: the types that a value fits are bits, and
    ``bit_and`` merges them.  Lines with a wrong number of fields do not count; a column
    without values is text."""
    columns = csv_columns(spark, path, header)
    if not columns:
        return T.StructType([])

    def fits(c: str):
        bits = F.lit(TEXT_TYPES[-1][1])
        for kind, bit in TEXT_TYPES[:-1]:
            bits = bits + F.when(_typed(c, kind).isNotNull(), bit).otherwise(0)
        return F.bit_and(F.when(F.col(f"`{c}`").isNotNull(), bits))

    rows = _text_scan(spark, path, columns, header).filter(F.col(_CORRUPT).isNull())
    known = rows.agg(*[fits(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    kinds = [next(kind for kind, bit in TEXT_TYPES if (8 if known[i] is None else known[i]) & bit) for i in range(len(columns))]
    return T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in zip(columns, kinds, strict=True)])


def _schema(spark, path, schema, header) -> T.StructType:
    if schema is None:
        return infer_csv_types(spark, path, header)
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """SRC1: CSV with a header row; without a schema the types are inferred (one more pass).

    A value that its column's type does not fit, or a line with too few or too many
    fields, is an error that names it, in any session mode; ``csv_rejects`` lists them all."""
    schema = _schema(spark, path, schema, header)
    rows = _text_scan(spark, path, schema.names, header)

    def checked(f: T.StructField):
        c, value = F.col(f"`{f.name}`"), _typed(f.name, f.dataType.simpleString())
        bad = F.raise_error(F.concat(F.lit(f"{f.name}: not a {f.dataType.simpleString()}: "), c))
        broken = F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col(_CORRUPT)))
        own = F.when(c.isNotNull() & value.isNull(), bad.cast(f.dataType)).otherwise(value)
        return F.when(F.col(_CORRUPT).isNotNull(), broken.cast(f.dataType)).otherwise(own).alias(f.name)

    return rows.select(*[checked(f) for f in schema.fields])


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """SRC1: the reject table of a CSV scan, one row for each bad value (its column, the
    value, the reason and all fields of its line as text) and each line with a wrong
    number of fields (column null, the line as value).  One pass, no shuffle."""
    schema = _schema(spark, path, schema, header)
    rows = _text_scan(spark, path, schema.names, header)
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in schema.names]), F.array(*[F.col(f"`{c}`") for c in schema.names]))
    reject = lambda column, value, reason: F.struct(column.alias("column_name"), value.alias("value"), F.lit(reason).alias("reason"))
    bad = [F.when(F.col(f"`{f.name}`").isNotNull() & _typed(f.name, f.dataType.simpleString()).isNull(),
                  reject(F.lit(f.name), F.col(f"`{f.name}`"), f"not a {f.dataType.simpleString()}")) for f in schema.fields]
    line = F.array(reject(F.lit(None).cast("string"), F.col(_CORRUPT), "wrong number of fields"))
    found = F.when(F.col(_CORRUPT).isNotNull(), line).otherwise(F.array_compact(F.array(*bad)))
    return rows.select(fields.alias("fields"), F.explode(found).alias("r")).select("r.*", "fields")


def write_csv(df: DataFrame, path: str) -> None:
    """Counterpart of ``read_csv`` (header row, timestamps as ISO text)."""
    (df.write.mode("overwrite").option("header", "true")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))


def _present(field: T.StructField):
    """The column, with NaN as null (as in the frames that the profile is modelled on)."""
    c = F.col(f"`{field.name}`")
    return F.when(~F.isnan(c), c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c


def profile(df: DataFrame) -> DataFrame:
    """SRC2: (position, column, dtype, non_null, rows) -- one aggregation pass."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(_present(f)).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    stack_args = ", ".join(
        f"{i}, '{f.name}', '{f.dataType.simpleString()}', c{i}" for i, f in enumerate(fields)
    )
    return counts.selectExpr(
        f"stack({len(fields)}, {stack_args}) as (position, column_name, dtype, non_null)", "__rows as n_rows"
    ).select(
        F.col("position").cast("bigint"), "column_name", "dtype",
        F.col("non_null").cast("bigint"), F.col("n_rows").cast("bigint"),
    )


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """SRC3: first ``n`` rows in key order (an order key makes it deterministic).
    Planned as TakeOrderedAndProject: each task keeps its top n, no full sort."""
    return df.orderBy(*order_by).limit(n)
