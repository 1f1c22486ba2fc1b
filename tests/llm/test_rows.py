"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from rivulet.llm import byte_bpe, chat, jaccard_join, katz, language_id, merkle, mixing, nearest, quality, sharding

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, _row string, id long, bucket int"
ROWS = [
    (1, "the cat sat on the mat and it was a good day. " * 3, "en", "s", 1, 0.0, 0, "r", 1, 1), (1, "the cat sat on the mat and it was a good day. " * 3, "en", "s", 1, 0.0, 0, "r", 1, 1), (2, None, None, None, None, None, None, None, None, None),
    (3, "", "de", "s", 0, 1.0, 1, "", 2, 2), (None, "ohne nummer und ohne namen", "de", None, 3, 2.0, 1, "x", 3, 3), (4, " \n\t ", "", "t", 3, 0.5, 0, "y", 4, 4), (5, "lang wort " * 60_000, "de", "t", 600_000, 0.5, 0, "y", 4, 4), (None, None, None, None, None, None, None, None, None, None),
]
LABELS = [(1, 1), (5, 0), (3, 0), (None, 1), (2, None), (4, 1)]


def _apply(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int")
    return {
        "quality": quality.classify(docs, labels), "katz": katz.score(docs), "language": language_id.detect(docs), "sharding": sharding.shard_rows(docs), "fingerprints": merkle.edited_fingerprints(docs), "tree": merkle.fingerprints(docs),
        "bpe": byte_bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN), "jaccard": jaccard_join.join_components(docs),
    }


def test_every_row_has_a_result(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, df in _apply(spark, docs).items():
        got = df.collect()
        assert len(got) == len(ROWS), name
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS), name
    used = mixing.mix(docs).select("doc_id").collect()
    assert {r.doc_id for r in used} == {r[0] for r in ROWS} and len(used) >= len(ROWS)


def test_empty_tables_have_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, df in _apply(spark, docs).items():
        assert df.count() == 0, name
    assert mixing.mix(docs).count() == 0
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_takes_nulls(spark):
    turns = spark.createDataFrame([(None, 0, None, None), (1, None, "assistant", "x"), (1, None, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert got == {None: (1, 0), 1: (2, 2)}


def test_kept_rows_keep_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "5", "None", "None"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() >= len(ROWS)


def test_the_pipeline_keeps_clean_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    at, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        sizes[name] = at.count()
        if name != "encoding":
            assert at.columns == docs.columns
    good = labels.where("quality = 1").join(docs.select("doc_id"), "doc_id").count()
    kept = spark.read.parquet(str(tmp_path / "language")).join(labels.where("quality = 1"), "doc_id").count()
    assert kept / good > 0.9
    assert docs.count() >= sizes["quality"] >= sizes["language"] > sizes["near_duplicates"] <= sizes["mixing"] == sizes["encoding"]
    single = spark.read.parquet(str(tmp_path / "near_duplicates"))
    again = jaccard_join.join_components(single)
    assert again.where(F.col("doc_id") != F.col("component_id")).count() == 0
    assert {r.doc_id for r in single.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").distinct().collect()}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001").count() == 0
