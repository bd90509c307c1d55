"""The corpus pipeline stage by stage on a small table."""

import pytest

pytest.importorskip("folio.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", None), (9002, "1234 !!", "en", "s", 7), (None, "a text without an id", "en", "s", 20)], docs.schema)
    docs = docs.unionByName(extra)
    names = docs.columns
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes[1] == sizes[0] - 2 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert docs.select("doc_id").distinct().count() == sizes[4]


def test_different_texts_of_one_id_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, words(1), "en", "s", 9), (1, words(2), "en", "s", 9), (1, words(2), "de", "s", 9), (2, words(1), "en", "s", 9), (None, words(3), "en", "s", 9), (None, words(3), "en", "s", 9), (3, None, "en", "s", 0), (3, "", "en", "s", 0), (4, words(4), "en", "s", 9)]
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = [tuple(r)[:3] for r in corpus_pipeline.drop_near_duplicates(spark, table, data).collect()]
    assert sorted((k[1] or str(k[1])) for k in kept) == sorted([words(1), words(2), words(3), words(4), "", "None"])
    assert (1, words(2), "de") in kept


def test_stages_on_an_empty_table_and_extra_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for c in ("id", "part", "matches", "lang_pred", "score", "n_entities", "component_id", "kept"):
        docs = docs.withColumn(c, docs["n_chars"])
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, data)
        assert made.count() == 0 and (name == "packing" or made.columns == docs.columns), name
