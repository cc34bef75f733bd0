import numpy as np
import pytest

from worktide.plans import pruned
from worktide.plans import retrieval as rt


def frame(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} bigint, vector array<float>")


def clustered(seed, count, groups=12, width=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, count)] + spread * rng.normal(size=(count, width))


def answers(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.distance, 8)) for r in df.collect())


def test_clustered_vectors_visit_few_blocks(spark):
    rows = clustered(1, 3000)
    corpus, queries = frame(spark, rows, "chunk_id"), frame(spark, rows[::60] + 0.01, "query_id")
    index = pruned.Index(corpus, count=16, block_bytes=4096)
    best, visits = pruned.knn(queries, index, 5, query_bytes=512)
    assert answers(best) == answers(rt.knn(queries, corpus, 5))
    seen = visits.first()
    assert seen.all_pairs == 50 * index.blocks.count() and seen.visited < 0.5 * seen.all_pairs


@pytest.mark.parametrize("k", [1, 7])
def test_hard_vectors(spark, k):
    rng = np.random.default_rng(2)
    rows = np.concatenate([
        rng.normal(size=(200, 4)), np.zeros((5, 4)), np.tile([1.0, 2.0, 3.0, 4.0], (60, 1)), -np.tile([1.0, 2.0, 3.0, 4.0], (3, 1)),
    ])
    asked = np.concatenate([rows[:10], np.zeros((1, 4)), [[1, 2, 3, 4], [-5, -10, -15, -20], [2, 4, 6, 8.0001]]])
    corpus, queries = frame(spark, rows, "chunk_id"), frame(spark, asked, "query_id")
    best, _ = pruned.knn(queries, pruned.Index(corpus, count=8, block_bytes=256, sample=100), k)
    assert answers(best) == answers(rt.knn(queries, corpus, k))


def test_small_and_empty_tables(spark):
    corpus, queries = frame(spark, [[1.0, 0.0], [0.0, 1.0]], "chunk_id"), frame(spark, [[1.0, 1.0]], "query_id")
    best, _ = pruned.knn(queries, pruned.Index(corpus), 5)
    assert answers(best) == answers(rt.knn(queries, corpus, 5))
    zeros = frame(spark, [[0.0, 0.0]], "chunk_id")
    assert [r.distance for r in pruned.knn(queries, pruned.Index(zeros), 5)[0].collect()] == [1.0]
    assert pruned.knn(queries, pruned.Index(corpus.limit(0)), 5)[0].count() == 0
    assert pruned.knn(queries.limit(0), pruned.Index(corpus), 5)[0].count() == 0


def test_many_packs_and_repeated_queries(spark):
    """Several packs on both sides; of repeated queries each row counts, as in the flat search."""
    rows = clustered(3, 1500, groups=6, spread=0.5)
    corpus = frame(spark, rows, "chunk_id").repartition(3)
    queries = frame(spark, rows[::40], "query_id")
    queries = queries.unionByName(queries.limit(5))
    index = pruned.Index(corpus, count=8, block_bytes=1024)
    packs = index.packs(4096)
    of = [set(r.block) for r in packs.collect()]
    assert len(of) > 10 and sum(map(len, of)) == index.blocks.count() == len(set().union(*of))
    best, visits = pruned.knn(queries, index, 4, query_bytes=640)
    assert answers(best) == answers(rt.knn(queries, corpus, 4))
    seen = visits.first()
    assert seen.visited <= seen.all_pairs == 43 * index.blocks.count()
