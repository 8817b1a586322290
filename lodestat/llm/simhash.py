"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ
in at most three bits differ in at most one bit of one of them, so each fingerprint is
put into a table under both segments and looked up under every value of the Hamming ball
of radius one around them; the matches' whole distance is then verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_text
from .components import components

SEGMENT_BITS = 32
SEGMENTS = 64 // SEGMENT_BITS
#: Parts into which the rows of one fingerprint are dealt when its component is joined back.
SALTS = 16


def fingerprint(text: str, shingle: int) -> int:
    """The fingerprint of one text; see ``fingerprints``."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    codes = np.fromiter((h(line[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(codes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """The columns of ``keep`` (doc_id by default) and fp, the 64 bits as a signed long.

    Words are what stands between ASCII white space, ASCII letters lower-cased.  A bit is
    one if it is set in over half of the XXH64 hashes (seed 42) of the space-joined
    shingles, repeats included.  Fewer words than a shingle: their whole sequence; no
    word, or a null text: zero."""

    def make():
        return lambda texts: [pa.array([np.uint64(fingerprint(t or "", shingle)).astype(np.int64) for t in texts], pa.int64())]

    return map_text(docs, keep or {"doc_id": "doc_id"}, text, make, "fp long")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """a < b of all distinct fingerprints of ``fp`` that differ in 1 to ``max_bits`` bits.

    ``max_bits`` is at most three (two segments, balls of radius one).  Keys are 32-bit
    segment values, so a table entry of unrelated fingerprints stays small even for
    billions of them; probes are a fixed number for each fingerprint."""
    if not 0 <= max_bits < 2 * SEGMENTS:
        raise ValueError("max_bits must be 0 to 3")
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)), F.shiftrightunsigned("fp", SEGMENT_BITS)
    table = fps.select("fp").distinct().select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << SEGMENT_BITS)))).alias("key"))
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    probes = table.select(F.col("fp").alias("a"), "key", F.explode(ball).alias("flip")).select("a", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    near = (F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits)
    # Spark sizes exploded rows by what they are exploded from, and would broadcast 33 probes
    # for each entry; a pair within one bit of both segments is found twice
    return probes.join(table.hint("merge"), "key").filter(near).select("a", F.col("fp").alias("b")).distinct()


def groups(fps: DataFrame, doc_id: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """Adds component_id: the smallest id that can be reached over links (null ids take
    part and are passed over; a component of null ids has null).

    Copies share a fingerprint, so links are between distinct fingerprints, and each
    fingerprint's smallest id is aggregated before it is moved.  The root is joined back
    by fingerprint, of which only linked ones have an entry."""
    distinct = fps.groupBy("fp").agg(F.min(doc_id).alias("least"))
    joined = components(links(distinct, max_bits), "a", "b")
    # of rows read from files Spark knows the compressed size only, and would broadcast them all
    of = joined.join(distinct.hint("merge"), joined["node"] == distinct["fp"]).groupBy("root").agg(F.min("least").alias("least"))
    linked = joined.join(of, "root").select(F.col("node").alias("fp"), F.col("least").alias("linked"))
    known = distinct.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    # one fingerprint may be that of a third of all documents: its rows are dealt out by a salt
    # (Spark sizes the copies as one)
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return fps.withColumn("salt", F.pmod(F.xxhash64(*fps.columns), F.lit(SALTS))).join(copies.hint("merge"), ["fp", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (fingerprints written once)."""
    from .common import written

    fps = written(fingerprints(docs, shingle, {"doc_id": doc_id}, text), "fingerprints")
    return groups(fps, "doc_id", max_bits)
