"""The pipeline against its stages said plainly."""

import corpus_pipeline
from worktide.llm import decontaminate, quality, secrets
from tests.llm.texts import prose


def test_stages_take_effect(spark, folder):
    passage = prose(70, 60)
    clean = [(10 + i, prose(200 + i, 150)) for i in range(8)]
    where = folder(
        documents=[
            *clean,
            (1, None), (2, "too short"), (3, "SHOUT!! " * 60), (4, prose(80, 20) + " " + passage),
            (5, prose(81, 120) + " password = s3cr3tvalue99"), (30, clean[0][1]), (31, clean[1][1] + " end"),
            (10, clean[0][1]),
        ],
        benchmark=[(1, passage)],
    )
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, where))
        if name != "packing":
            assert docs.columns == before.columns
            seen[name] = sorted(r.doc_id for r in docs.collect())
        if name == "secrets":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    good = [i for i, _ in clean]
    assert seen["quality"] == sorted([*good, 4, 5, 10, 30, 31])
    assert seen["near_dedup"] == sorted([*good, 4, 5])
    assert seen["decontamination"] == seen["secrets"] == sorted([*good, 5])
    assert texts[5][0].endswith(secrets.MASK) and texts[5][1] == len(texts[5][0])
    assert texts[10][0] == clean[0][1]
    packed = docs.collect()
    assert {r.doc_id for r in packed} == {*good, 5}
    assert [r.asDict() for r in corpus_pipeline.run(spark, where).select("doc_id", "length").sort("doc_id").collect()] == [
        {"doc_id": r.doc_id, "length": r.length} for r in sorted(packed, key=lambda r: r.doc_id)
    ]


def test_row_decisions_on_test_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    for r in rows:
        m = dict(zip(quality.MEASURES, quality.measure_text(r.text.encode()), strict=True))
        if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
            assert r.doc_id not in kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = decontaminate.brute_force([r.text for r in rows[:40]], items)
    got = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect()}
    assert all((r.doc_id in got) != w["contaminated"] for r, w in zip(rows[:40], want, strict=True))
