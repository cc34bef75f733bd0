import heapq
import random
import zlib
from collections import Counter, defaultdict

from worktide.llm import sharding
from tests.llm.texts import edge_texts


def plain_schedule(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    return sorted(loads)


def rows_of(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return sharding.assign(docs, **how).collect()


def check(rows, texts):
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    slots, shard_of = defaultdict(list), {}
    for r in rows:
        text = texts[r.doc_id]
        data = (text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert shard_of.setdefault(text, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equals_plain_schedule(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 500) + str(i % 70) for i in range(200)] + edge_texts() + ["hot copy"] * 150
    rows = rows_of(spark, texts)
    check(rows, texts)
    groups = Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert sorted(loads[s] for s in range(16)) == plain_schedule(groups.values(), 16)


def test_parcels_keep_groups_together_and_shards_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 20)
    monkeypatch.setattr(sharding, "PARCELS", 64)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(2)
    texts = [str(rng.random()) * rng.randint(1, 4) for _ in range(2000)] + ["copy"] * 100
    rows = rows_of(spark, texts)
    check(rows, texts)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    mean = sum(loads.values()) / 16
    assert len(loads) == 16 and max(loads.values()) <= 1.1 * mean and min(loads.values()) >= 0.9 * mean
