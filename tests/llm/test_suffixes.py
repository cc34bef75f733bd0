import hashlib
import random

import numpy as np
import pytest

from worktide.llm import suffixes
from tests.llm.texts import edge_texts, prose


def passages(seed, count=80):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcde ") for _ in range(4000))
    texts = []
    for _ in range(count):
        text = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 4)):
            at, size = rng.randint(0, 3500), rng.choice([99, 100, 101, 130, 400])
            text += base[at : at + size] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
        texts.append(text)
    return [*texts, "a" * 1000, "a" * 99, "a" * 100, "ab" * 300, None, "", texts[3], "x" * 57 + texts[5], "é" * 200,
            "z" + "é" * 70]


def got(docs, **how):
    rows = suffixes.remove(docs, **how).collect()
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_equals_brute_force(spark, partitions, block_bytes):
    texts = passages(1) + edge_texts(2000)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    found = got(docs, block_bytes=block_bytes, range_bytes=5000)
    assert sorted(found) == suffixes.brute_force(rows)


def test_rows_in_order_are_not_moved(spark):
    rows = list(enumerate(passages(2)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(3)
    assert sorted(got(docs, block_bytes=4000)) == suffixes.brute_force(rows)


@pytest.mark.parametrize("length", [64, 73, 150])
def test_other_lengths(spark, length):
    rows = list(enumerate(passages(3, 40)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert sorted(got(docs, length=length, block_bytes=3000)) == suffixes.brute_force(rows, length)


def test_repeated_and_null_ids_and_clashing_columns(spark, documents):
    text, other = prose(4, 100), prose(5, 100)
    rows = documents([(1, text), (1, text), (2, other), (None, other), (None, None), (0, other[:200])])
    found = sorted(got(rows.repartition(3)), key=str)
    size = len(text.encode())
    ones = [r for r in found if r[0] == 1]
    assert sorted(r[2] for r in ones) == [0, size]
    null = sorted(r[1:3] for r in found if r[0] is None)
    assert null == [(0, 0), (len(other.encode()), len(other.encode()))]
    assert [r[2] for r in found if r[0] == 0] == [0]


def test_string_ids_and_kept_texts(spark):
    text = prose(6, 60)
    docs = spark.createDataFrame([("b", "tail " + text), ("a", text)], "name string, body string")
    rows = {r.name: r for r in suffixes.remove(docs, "name", "body").collect()}
    assert bytes(rows["a"].kept) == text.encode() and bytes(rows["b"].kept) == b"tail "[: len(rows["b"].kept)]


def test_hot_text_and_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(400_000))
    rows = [(i, "the very same hot text " * 8 if i % 3 else str(i) * 50) for i in range(900)]
    rows += [(1000, long), (1001, long[5:]), (1002, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert sorted(got(docs, block_bytes=20_000)) == suffixes.brute_force(rows)


def test_cover_brings_any_two_residues_together():
    for a in range(suffixes.MODULUS):
        for b in range(suffixes.MODULUS):
            k = suffixes._SHIFT[a, b]
            assert {(a + k) % suffixes.MODULUS, (b + k) % suffixes.MODULUS} <= set(suffixes.COVER.tolist())


def test_classes_survive_equal_ends():
    # Strings that agree in their first and last bytes are told apart by the samples' names.
    rng = random.Random(8)
    head, tail = "h" * 31, "t" * 30
    middles = ["".join(rng.choice("mn") for _ in range(39)) for _ in range(30)] * 2
    texts = ["." * rng.randint(0, 9) + head + m + tail for m in middles]
    sizes = np.array([len(t) for t in texts], np.int64)
    block = suffixes.Block("".join(texts).encode(), sizes)
    at, first, *_ = suffixes._sorted(block, np.ones(len(block.unique), bool))
    want = {}
    data = "".join(texts)
    for i, place in enumerate(at.tolist()):
        assert first[i] == want.setdefault(data[place : place + 100], i)


def test_messages_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    extra = np.arange(1000, dtype=np.uint16)
    back, more = suffixes._decode(suffixes._encode(values, extra), True)
    assert (back == values).all() and (more == extra).all()
    assert hashlib.sha256(suffixes._decode(suffixes._encode(values), False)[0].tobytes()).digest()
