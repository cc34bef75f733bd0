import itertools
import random

import numpy as np
import pytest
import xxhash

from worktide.llm import simhash as s
from worktide.llm.components import components
from worktide.llm.queries import simhash_near_dedup
from tests.llm.texts import edge_texts, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def cloud(seed, n, centres=5, flips=4):
    rng = random.Random(seed)
    heads = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(heads)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_query_against_brute_force(spark, folder):
    texts = edge_texts()
    base = prose(20, 3000)
    rng = random.Random(5)
    for _ in range(30):
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    where = folder(documents=[(100 + i, t) for i, t in enumerate(texts)] + [(50, base)])
    ids = [*range(100, 100 + len(texts)), 50]
    prints = [plain_fingerprint(t) for t in [*texts, base]]
    roots = plain_classes(prints, 2)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    want = {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_near_dedup(spark, where).collect()}
    assert got == want


@pytest.mark.parametrize(("radius", "n", "tile"), [(2, 300, 10**6), (2, 900, 64), (1, 300, 50), (3, 400, 10**6)])
def test_classes_lose_no_link(spark, monkeypatch, radius, n, tile):
    monkeypatch.setattr(s, "TILE", tile)
    prints = cloud(radius + n, n)
    marked = spark.createDataFrame(
        [(i, [p - (1 << 64) if p >> 63 else p]) for i, p in enumerate(prints)], "doc_id bigint, prints array<bigint>"
    )
    got = {r.doc_id: r.component_id for r in s.classes(marked, "doc_id", radius).collect()}
    assert [got[i] for i in range(n)] == plain_classes(prints, radius)


@pytest.mark.parametrize("lanes", [1, 4])
@pytest.mark.parametrize("radius", [2, 7, 20])
def test_bit_slices_against_popcount(lanes, radius):
    rng = np.random.default_rng(radius)
    flat = rng.integers(0, 2**64, (200, lanes), np.uint64)
    for i in range(1, 200):
        if rng.random() < 0.7:
            flat[i] = flat[i - 1]
            for b in rng.integers(0, 64 * lanes, rng.integers(0, 8)):
                flat[i, b // 64] ^= np.uint64(1 << int(b % 64))
    distance = np.bitwise_count(flat[:, None, :] ^ flat[None, :, :]).sum(axis=2)
    sizes = [1, 2, 60, 64, 3, 70]
    left = np.concatenate([np.arange(z)[::-1] for z in sizes])
    want = {
        (a + i, a + j) for a, z in zip(np.cumsum([0, *sizes]), sizes) for i in range(z) for j in range(i + 1, z)
        if distance[a + i, a + j] <= radius
    }
    got = {(int(x), int(y)) for a, b in s.small_groups(flat, left, radius) for x, y in zip(a, b, strict=True)}
    assert got == want
    label = s.large_group(flat, radius)
    parent = np.arange(200)
    for _ in range(200):
        for i in range(200):
            parent[i] = parent[np.flatnonzero(distance[i] <= radius)].min()
    assert (label == parent).all()


def test_long_text_in_parts():
    text = prose(9, 30000).encode()
    whole = np.concatenate(list(s.shingle_hashes(text, 3)))
    s_size = s.batches.word_blocks.__defaults__
    s.batches.word_blocks.__defaults__ = (1000,)
    try:
        parts = np.concatenate(list(s.shingle_hashes(text, 3)))
    finally:
        s.batches.word_blocks.__defaults__ = s_size
    assert (whole == parts).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    edges += [(7, 7), (3, 2), (None, 4)] + [(300, 300 + i) for i in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(60):
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    assert got == {n: r for n, r in label.items() if n != r}


def test_dedup_keeps_one_of_each_group(spark, documents):
    rng = random.Random(6)
    rows, want = [], set()
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        for c in range(6):
            copy = list(words)
            if c % 2:
                copy[rng.randrange(400)] = "edit"
            rows.append((1000 * (c + 1) + g, " ".join(copy)))
        want.add(1000 + g)
    rows += [(1000, rows[0][1]), (5, None), (6, ""), (7, "one two"), (8, "one two"), (None, "one two")]
    docs = documents(rows)
    kept = s.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted([*want, 5, 7])


def test_forest_of_nearest_links_joins_what_all_links_join():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 120, (2, 900))
    a, b = a[a != b], b[a != b]
    d = rng.integers(0, 40, len(a))
    forest = s.Nearest(hold=100)
    for i in range(0, len(a), 37):
        forest.add(a[i : i + 37], b[i : i + 37], d[i : i + 37])
    x, y, near = forest.links()
    assert len(x) < 120
    for limit in (0, 3, 10, 40):
        want, got = (s._roots(120, p[q <= limit], r[q <= limit]) for p, r, q in ((a, b, d), (x, y, near)))
        assert (want == got).all()


def similar(a: str, b: str, words: int = 5) -> float:
    def shingles(text):
        found = text.split()
        return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("lane_tile", [10**6, 40])
def test_dedup_against_exact_similarity(spark, documents, monkeypatch, lane_tile):
    """Pairs of all similarities around the limit: none below it goes, nine of ten above do."""
    monkeypatch.setattr(s, "TILE", lane_tile)
    rng = random.Random(11)
    rows = []
    for g in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([120, 300, 600]))]
        copy = list(words)
        for _ in range(rng.randrange(1, max(2, len(words) // 24))):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    text = dict(rows)
    share = [similar(text[2 * g], text[2 * g + 1]) for g in range(400)]
    near = {g for g in range(400) if share[g] >= 0.8}
    assert 100 < len(near) < 350
    kept = {r.doc_id for r in s.dedup(documents(rows)).collect()}
    dropped = set(text) - kept
    assert dropped <= {2 * g + 1 for g in near}
    assert len(dropped) >= s.DEDUP_RECALL * len(near)
    surely = {2 * g + 1 for g in near if share[g] >= 0.9}
    assert len(surely & dropped) >= 0.98 * len(surely)


def test_dedup_joins_all_that_true_pairs_join(spark, documents, monkeypatch):
    """Copies on both sides of the limit: a nearer link that proves false stands for no true one."""
    # With 15 keys, groups of 30 go by key and groups of 12 by pairs of tiles.
    monkeypatch.setattr(s, "SET_TILE", 1, raising=False)
    rng = random.Random(5)
    rows, group = [], []
    for size in (30, 30, 12, 12, 12, 12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(2, 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            group.append(words[0])
            rows.append((len(rows), " ".join(copy)))
    label = list(range(len(rows)))
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            if group[i] == group[j] and similar(a, b) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert 6 < len(set(label)) < 100
    kept = s.dedup(documents(rows), key_bits=6, recall=0.999)
    assert {r.doc_id for r in kept.collect()} == set(label)
