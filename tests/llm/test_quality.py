import random
from collections import Counter

from worktide.llm import quality as q
from tests.llm.texts import edge_texts, prose


def plain_repeats(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_repeats_against_brute_force():
    rng = random.Random(1)
    for n in (0, 7, 8, 9, 30, 300):
        for kinds in (1, 2, 5, 50):
            words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
            assert q.repeated_words(words) == plain_repeats(words)


def test_ledger_policies_and_ablations(spark, documents):
    given = list(enumerate(edge_texts())) + [(50, "WORD!! " * 40), (51, prose(7, 100)), (51, prose(7, 100))]
    docs = documents(given).withColumn("failed", q.F.lit("old"))
    rows = q.ledger(docs).cache()
    assert set(rows.columns) == {*docs.columns, "measures"}
    names = list(q.RULES)
    for r in rows.collect():
        m = r.measures
        assert bool(r.failed >> names.index("few_words") & 1) == (m.n_words < 20)
    for policy in q.POLICIES.values():
        kept = q.keep(docs, policy=policy)
        assert kept.columns == docs.columns
        want = [r.doc_id for r in rows.collect() if not r.failed & policy.mask]
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
        for a in q.ablations(rows, policy).collect():
            bit = 1 << names.index(a.rule)
            bits = [r.failed & policy.mask for r in rows.collect()]
            assert (a.failing, a.rejected_alone, a.texts) == (sum(b & bit > 0 for b in bits), bits.count(bit), len(bits))
    assert {r.doc_id for r in q.keep(docs).collect()} >= {51}
    assert 50 not in {r.doc_id for r in q.keep(docs).collect()}


def test_kept_follows_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = q.ledger(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    good = rows.where("quality = 1 and measures.n_words >= 20")
    kept = good.where(q.passes(q.F.col("failed"))).count()
    assert kept >= 0.99 * good.count()
