"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

#: Bytes of text that a task works on at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

#: Bytes of remembered words that a task holds, and what one takes beside its letters.
MEMO_BYTES, ENTRY_BYTES = 24 << 20, 150

#: ASCII upper case to lower case, for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows of about ``limit`` bytes of ``column`` each."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def map_text(df: DataFrame, keep: dict[str, str], text: str, make, added: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Adds columns that depend on one text column.

    ``keep`` maps output names to columns of ``df`` that pass through; ``make()`` is
    called once in each task and returns a function from a list of texts (None for
    null) to a list of Arrow arrays or Python lists, one for each column of the DDL
    ``added``.  Only the named columns are read."""
    picked = df.select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__llm_text"))
    extra = StructType.fromDDL(added)
    schema = StructType([f for f in picked.schema.fields if f.name != "__llm_text"] + extra.fields)
    names = schema.names

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "__llm_text", limit):
                made = work(part.column("__llm_text").to_pylist())
                kept = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "__llm_text"]
                yield pa.RecordBatch.from_arrays(kept + [_array(v, f) for v, f in zip(made, extra.fields, strict=True)], names=names)

    return picked.mapInArrow(run, schema)


def _array(values, field):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field.dataType)
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, kind)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the session (spark.checkpoint.dir)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: later jobs
    read files, and a lost executor costs no recomputation.  The files belong to the
    session's checkpoint folder, whose owner clears it.  With ``by`` each value of that
    column has a folder of its own, which ``dropped`` may delete."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, by: str, value) -> None:
    """Deletes the rows with this value from a frame ``written`` by that column."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.filter(F.col(by) == value).inputFiles()}:
        if folder.endswith(f"/{by}={value}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache(key, build):
    """An object that stays for the life of a Python worker process, over its tasks."""
    held = sys.__dict__.setdefault("_lodestat_worker_cache", {})
    if key not in held:
        held.clear()
        held[key] = build()
    return held[key]


def sample_by_hash(df: DataFrame, by: str, key: tuple[str, ...], size: int) -> DataFrame:
    """About ``size`` rows of each value of ``by`` (all, if fewer): those whose hash of
    ``key`` is below the value's share.  One count for each value, no sort, no window."""
    counts = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    if not counts:
        return df
    shares = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(1.0, size / n))])
    place = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)
    return df.filter(place < shares[F.col(by)])


@dataclass(frozen=True)
class Bitmap:
    """A set of 64-bit hashes with false positives: bit h mod size of 2^k bits."""

    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each unsigned hash may be in the set."""
        slot = h & np.uint64(64 * len(self.words) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


#: A bitmap's size: bits for each hash, and the bounds of its logarithm (8 kB to 16 MB).
BITS_EACH, LEAST_LOG, MOST_LOG = 16, 16, 27


def bitmap(hashes: DataFrame, column: str = "h") -> Bitmap:
    """The bitmap of a column of hashes (longs), sized by their number up to 16 MB: what
    reaches the driver is bounded, and beyond 8 million hashes only false positives grow."""
    n = hashes.count()
    log = min(MOST_LOG, max(LEAST_LOG, (BITS_EACH * n).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << log) - 1))
    one = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    found = hashes.select(F.shiftright(slot, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (log - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bitmap(words)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
