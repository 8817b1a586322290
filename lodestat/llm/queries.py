"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, covertree, decontaminate, gridcodes, langid, licenses, pst, simhash, token_store, toxicity, warc, wrappers
from .common import read, remainder, shared_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(_vocabulary("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    with open(_vocabulary("byte_bpe_50k.json"), encoding="utf-8") as spec:
        token_store.write(read(spark, sf_dir, "documents"), path, spec.read(), end_id=2)
    made = token_store.read_documents(token_store.open_store(spark, path))
    return made.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


#: The fold that the language model never learns from: (modulus, remainder).
SCORE_FOLD = (7, 2)


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n, out = SCORE_FOLD
    model = pst.train(docs.filter(remainder(F.col("doc_id"), n) != out))
    made = pst.score(docs, model)
    return made.select("doc_id", (remainder(F.col("doc_id"), n) == out).alias("held_out"), "n_tokens", "n_known",
                       F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.documents_with_overlap(found)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(read(spark, sf_dir, "pages"))


#: Folds on which labels and languages are never learned: (modulus, remainder).
TOXIC_FOLD, LANG_FOLD = (4, 2), (5, 0)
TOXIC_FROM = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    n, out = TOXIC_FOLD
    return toxicity.train(toxicity.labelled_sample(docs.filter(remainder(F.col("doc_id"), n) != out), labels, toxicity.SAMPLE_DOCS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    made = toxicity.score(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))
    n, out = TOXIC_FOLD
    return made.select("doc_id", (remainder(F.col("doc_id"), n) == out).alias("held_out"), "score",
                       (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_clauses")


def language_model(docs: DataFrame) -> dict:
    n, out = LANG_FOLD
    return langid.train(docs.filter(remainder(F.col("doc_id"), n) != out))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    made = langid.identify(docs, language_model(docs))
    n, out = LANG_FOLD
    return made.select("doc_id", (remainder(F.col("doc_id"), n) == out).alias("held_out"), "lang_pred", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), top=2000)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridcodes.vector_codes(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_token_store, op3_licenses, op4_suffix_tree, op5_simhash, op6_decontaminate, op7_main_text, op8_toxicity, op9_language_id, op10_top_k, op11_collocations,
    op12_warc, op13_vector_codes)}
ORACLES: dict[str, str] = {
    "op10_top_k": covertree.TOP_K_SQL, "op11_collocations": collocations.COLLOCATIONS_SQL, "op12_warc": warc.WARC_SQL, "op13_vector_codes": gridcodes.CODES_SQL}
