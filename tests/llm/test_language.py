import numpy as np

from worktide.llm import language
from worktide.llm.queries import language_id

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = language_id(spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_are_far_apart():
    for count in (2, 3, 4, 7, 20):
        code = language.codewords(count)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(count) * 1e9
        assert apart.min() >= (1 if count == 2 else code.shape[1] / 4)
        assert all(0 < (code[:, b] > 0).sum() < count for b in range(code.shape[1]))


def test_unknown_and_empty(spark, documents):
    labelled = spark.createDataFrame(
        [(i, t * 20, lang) for i, (t, lang) in enumerate([("der die das und ", "de"), ("the of and to ", "en")] * 5)],
        "doc_id int, text string, lang string",
    )
    model = language.learn(labelled)
    given = [(1, None), (2, ""), (3, "12 34 !"), (4, "the and of"), (5, "und das"), (6, "é" * 100000), (4, "the and of")]
    docs = documents(given).withColumn("language", language.F.lit("old"))
    rows = language.identify(docs, model)
    assert set(rows.columns) == set(docs.columns)
    got = [(r.doc_id, r.language.lang) for r in rows.collect()]
    assert {lang for i, lang in got if i in (1, 2, 3)} == {"und"}
    assert (4, "en") in got and (5, "de") in got and got.count((4, "en")) == 2
    none = language.learn(labelled.where("lang is null"))
    assert none is None
    assert {r.language.lang for r in language.identify(docs, none).collect()} == {"und"}


def test_one_language(spark):
    rows = spark.createDataFrame([(1, "der die das", "de")], "doc_id int, text string, lang string")
    model = language.learn(rows)
    assert language.identify(rows, model).first().language.lang == "de"
