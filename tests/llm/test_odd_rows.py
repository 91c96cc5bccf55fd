"""Operators and pipeline stages on nulls, empty tables, very long texts, repeated rows, ties and clashing columns; toxicity in balance."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sieveline.llm import media, mixing, quality, toxicity
from sieveline.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, k int"
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from here"
ROWS = [
    (1, PLAIN, "en", "a", 71, 0.5, "x", 1), (1, PLAIN, "en", "a", 71, 0.5, "x", 1), (2, PLAIN.upper(), "en", None, None, None, None, None), (None, None, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 1.0, "", 0), (5, " \n\t ", None, "b", 4, None, "", 0), (6, "loooong " * 20000, "en", "a", 160000, 0.0, "l", 2), (7, "w" * 100_000, "en", "a", 100_000, 0.0, "l", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (1, 0), (2, None), (None, 1), (4, 0)]])
def test_toxicity_and_quality_of_odd_rows(spark, docs, labelled):
    toxic = spark.createDataFrame(labelled, "doc_id bigint, toxic int")
    good = toxic.withColumnRenamed("toxic", "quality")
    for table in (docs, docs.limit(0)):
        got = toxicity.score(table, toxicity.fit(table, toxic)).collect()
        assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) <= 1
        model, base = quality.fit(table.select("doc_id", "text"), good)
        got = quality.posteriors(table, model, base).collect()
        assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) <= 1


def test_media_of_odd_tables(spark, docs):
    for table in (docs, docs.limit(0)):
        index = media.store(table, tempfile.mkdtemp(prefix="spark-")).cache()
        got = media.features(media.metadata(media.spread(index))).collect()
        assert len(got) == table.count() and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= 576 for r in got)


def test_mixing_of_null_sources_and_sizes_of_nothing(spark, docs):
    for table in (docs, docs.where("text IS NULL OR trim(text) = ''"), docs.limit(0)):
        chosen, _ = mixing.plan(table)
        assert sum(r["copies"] for r in chosen.collect()) == mixing.mix(table).count()
        assert mixing.mix(table).groupBy("doc_id", "text").count().where("count > 6").count() == 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{data}/documents.parquet").withColumns({"row": F.lit("r"), "k": F.lit(1), "score": F.lit(0.5)})
    mixed = real.select(*docs.columns).unionByName(docs)
    for name, stage in corpus_pipeline.STAGES:
        whole = stage(spark, mixed, data)
        assert set(docs.columns) <= set(whole.columns) and (name == "mixing" or whole.columns == docs.columns)
        clean = whole.where(F.lower("text") == PLAIN).count()  # three rows, of which the join keeps one
        assert whole.count() >= 0.7 * real.count() and (name == "mixing" or clean == (1 if name == "jaccard_join" else 3))
        assert stage(spark, mixed.limit(0), data).count() == 0


def test_toxicity_in_balance(spark):
    """As many clean held-out documents as toxic ones would be half right by one answer for all; both sides are asked for."""
    data = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out")
    hit, missed, false, right = (got.where(f"toxic = {t} AND predicted = {p}").count() for t, p in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert hit + missed >= 80 and hit >= 0.9 * (hit + missed) and right >= 0.9 * (right + false)
