import random

from worktide.llm import decontaminate as d
from tests.llm.texts import edge_texts, prose


def random_case(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "the", "é"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for k in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    return texts, items


def rows(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = d.find(docs, bench, **how)
    out = found.select(
        "doc_id", "found.n_words", d.hit_words("found").alias("n_hit"), d.F.size("found.items").alias("n_items"),
        d.digest("found").alias("items_sha256"),
    ).collect()
    return [r.asDict() for r in sorted(out, key=lambda r: r.doc_id)]


def check(got, want):
    for g, w in zip(got, want, strict=True):
        assert {k: g[k] for k in ("n_words", "n_hit", "n_items", "items_sha256")} == {
            k: w[k] for k in ("n_words", "n_hit", "n_items", "items_sha256")
        }


def test_against_brute_force(spark):
    for seed in range(3):
        texts, items = random_case(seed)
        for n in (1, 3, 5):
            check(rows(spark, texts, items, n=n), d.brute_force(texts, items, n))


def test_items_in_several_blocks_give_the_same(spark):
    texts, items = random_case(7)
    check(rows(spark, texts, items, n=4, block_bytes=40), d.brute_force(texts, items, 4))


def test_hard_texts(spark):
    texts = edge_texts()
    items = [(1, prose(1, 30000)[5000:5400]), (2, prose(3, 400)[:300]), (3, "same line here"), (4, None)]
    check(rows(spark, texts, items), d.brute_force(texts, items))


def test_clean_keeps_columns(spark, documents):
    passage = prose(5, 60)
    docs = documents([(1, passage), (2, prose(6, 200)), (3, None), (4, prose(8, 5000) + passage), (2, prose(6, 200))])
    items = spark.createDataFrame([(1, passage)], "item_id int, text string")
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 4]
