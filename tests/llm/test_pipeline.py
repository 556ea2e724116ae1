"""Stages keep the documents' columns, their decisions take effect, and clean documents stay."""

import corpus_pipeline as c
from canopyx.llm import pii

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    extra = [(10**6, "¿ 12 34 !!", "en", "s", 10), (10**6 + 1, None, None, None, None)]
    first = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = first.unionByName(spark.createDataFrame(extra, first.schema))
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in c.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(path := str(tmp_path / name))
        out = spark.read.parquet(path)
        if name != c.STAGES[-1][0]:
            assert out.columns == columns
            now = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(now) <= set(before)
            if name == "language_id":
                assert set(before) - set(now) == {10**6, 10**6 + 1}
            if name == "near_dedup":
                assert len(set(now.values())) == len(now) and set(now.values()) <= set(before.values())
            if name == "personal_data":
                assert not any(pii.patterns(t) for t in now.values())
            before = now
        docs = out
    assert docs.select("doc_id").distinct().count() == len(before)


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 3, [1]), (2, None, None, None, None)], "doc_id long, text string, lang string, `a b.c` int, score array<int>")
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns, name
    assert c.STAGES[-1][1](spark, docs.where("false"), DIR).count() == 0


def test_near_dedup_keeps_clean_rows_whatever_their_ids(spark):
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[4]), (9, texts[5]), (9, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])]
    for n in (1, 3, 7):
        assert sorted(map(str, c.near_dedup(spark, docs.repartition(n), DIR).collect())) == sorted(str(r) for r in spark.createDataFrame(want, docs.schema).collect())


def test_language_id_without_languages(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, "12 + 3", None), (3, None, None), (None, "漢字", None)], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in c.language_id(spark, docs, DIR).collect()) == ["the cat", "漢字"]
