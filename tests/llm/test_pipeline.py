"""The pipeline's stages on a small corpus, each against what it must keep."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestat.llm import decontaminate, queries, simhash
from test_operators import broadcast_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = docs.limit(3).unionByName(docs.filter("doc_id = 7")).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "123", None, "s", 3)], docs.schema))
    docs = docs.unionByName(extra)
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        made = P.written(stage(spark, docs, SF), f"test-{name}")
        assert made.columns == columns
        out.append((name, docs, made))
        docs = made
    return out, P.STAGES[-1][1](spark, docs, SF)


def test_each_stage_drops_what_it_must(spark, stages):
    (_, all_docs, languages), (_, _, clean), (_, before, unique), (_, _, last) = stages[0]
    assert languages.filter("text is null or text = '' or text = '123'").count() == 0
    assert languages.count() > 0.99 * (all_docs.count() - 3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = languages.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 0").count() <= 0.01 * labels.count() and gone.count() > 0
    groups = simhash.near_duplicates(before).select("doc_id", "component_id")
    assert unique.count() == groups.select("component_id").distinct().count()
    assert {r[0] for r in unique.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
    found = decontaminate.contaminated(unique, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r[0] for r in unique.join(last, "doc_id", "left_anti").select("doc_id").collect()} == {r[0] for r in found.select("doc_id").collect()}
    assert found.count() > 0


def test_tokens_come_back(stages):
    out = stages[1]
    assert out.count() == stages[0][-1][2].count()
    assert out.filter(~F.col("round_trip")).count() == 0


def test_names_are_as_dealt():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert len(P.STAGES) == 5 and os.path.basename(P.__file__) == "corpus_pipeline.py"


def test_language_stage_keeps_texts_in_three_languages(spark):
    own = {"en": "the house with that thing ", "fr": "une maison avec des choses ", "de": "das haus mit einem ding "}
    rows = [(100 * k + i, t * 4, g) for k, (g, t) in enumerate(own.items()) for i in range(20)]
    rows += [(900, own["en"] * 5 + own["fr"] * 4 + own["de"] * 3, "en"), (901, "123", "en")]
    kept = {r[0] for r in P.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {901}


def test_near_duplicate_stage_broadcasts_a_row_for_each_document_at_most(spark, monkeypatch):
    seen, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links, *a: seen.append(links) or components(links, *a))
    rows = [(i, " ".join(f"w{i % 120}x{j}" for j in range(30))) for i in range(200)]
    docs = P.written(spark.createDataFrame(rows, "doc_id long, text string"), "test-documents")
    made = P.near_duplicates(spark, docs, SF)
    assert {r["doc_id"] for r in made.collect()} == set(range(120))
    assert seen[0].collect() == []
    for frame in (seen[0], made):
        assert max(broadcast_rows(frame), default=0) <= len(rows)
