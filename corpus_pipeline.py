"""A corpus pipeline over ``documents``: language ID, toxicity, near-duplicates,
benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each stage's
result as Parquet to the shared folder and reads it again for the next.  Rows are told
apart by a hash of id and text, so null and repeated ids are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import bpe, decontaminate, langid, queries, simhash, toxicity
from lodestat.llm.common import read, written


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter; a text in several languages stays, whatever their shares."""
    columns = {c: c for c in docs.columns}
    made = langid.identify(docs, queries.language_model(docs), {"__" + n: c for n, c in columns.items()})
    return made.filter(F.col("lang_pred") != "und").select(*[F.col("__" + c).alias(c) for c in columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose toxicity score is ``queries.TOXIC_FROM`` or more."""
    columns = {c: c for c in docs.columns}
    made = toxicity.score(docs, queries.toxicity_model(docs, read(spark, sf_dir, "labels")), {"__" + n: c for n, c in columns.items()})
    return made.filter(F.col("score") < queries.TOXIC_FROM).select(*[F.col("__" + c).alias(c) for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id (null last), and of rows
    that are alike one."""
    fps = written(simhash.fingerprints(_keyed(docs), 3, {"doc_id": "doc_id", "__key": "__key"}), "pipeline-fingerprints")
    known = simhash.groups(fps, "doc_id", 3)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    # a component of null ids has no number: its documents are told apart by fingerprint
    group = (F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = known.groupBy(*group).agg(F.min(first).alias("first")).select(F.col("first.__key").alias("__key"))
    repeated = fps.groupBy("__key").count().filter("count > 1").select("__key").withColumn("__again", F.lit(True))
    rows = _keyed(docs).join(kept.join(repeated, "__key", "left"), "__key")
    once = rows.filter(F.col("__again").isNull()).unionByName(rows.filter(F.col("__again")).dropDuplicates(["__key"]))
    return once.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark"), doc_id="__key")
    gone = found.select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and whether decoding gives
    the text again."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode(docs, ranks, public_tokenizers.PATTERN, {"doc_id": "doc_id", "text": "text"}, decoded=True)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return made.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", decontamination), ("byte_bpe", tokens)]

#: Fingerprints, trained models and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
