import random

import numpy as np
import pytest

from worktide.llm import spelling
from tests.llm.texts import edge_texts


def found(docs, **how):
    words = spelling.vocabulary(docs, **how)
    rows = spelling.group(words).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


def variants(seed, count=400):
    rng = random.Random(seed)
    letters = "abcdeéßÿÀ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 30)):
            word = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word))
                kind = rng.randrange(3)
                if kind == 0:
                    word.insert(at, rng.choice(letters))
                elif kind == 1 and len(word) > 2:
                    del word[at]
                else:
                    word[at] = rng.choice(letters)
            words.append("".join(word))
        texts.append(rng.choice([" ", "\n", "-1-"]).join(words))
    return texts


@pytest.mark.parametrize("noise", [97, 5])
def test_equals_brute_force(spark, noise):
    texts = variants(1) + edge_texts(1500) + [None, "", "Wörter ×÷ Straße straße STRASSE", "x×abcde÷abcdeabcde"]
    texts += ["hello world Hello hellos helo hell hellö hellö hellö " * 2] * 3
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, "null ids null ids count counts"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs, noise=noise) == spelling.brute_force(rows, noise=noise)


def test_clashing_columns(spark, documents):
    rows = [(i, t) for i, t in enumerate(variants(2, 60))]
    docs = documents(rows).withColumnRenamed("found", "word").withColumnRenamed("spans", "n")
    assert found(docs) == spelling.brute_force(rows)


@pytest.mark.parametrize("count", [2, 8])
def test_neighbourhoods_are_full_and_without_repeats(count):
    rng = random.Random(3)
    for size in (1, 2, 5, 6):
        chars = np.array([[rng.randint(1, count) for _ in range(size)] for _ in range(20)], np.uint64)
        got: dict[int, list[int]] = {}
        for row, key in spelling.neighbours(chars, count):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                got.setdefault(r, []).append(k)
        for r, word in enumerate(chars.tolist()):
            every = {tuple(word)}
            for i in range(size + 1):
                every |= {tuple(word[:i] + [c] + word[i:]) for c in range(1, count + 1)}
                if i < size:
                    every.add(tuple(word[:i] + word[i + 1 :]))
                    every |= {tuple(word[:i] + [c] + word[i + 1 :]) for c in range(1, count + 1)}
            want = [int(spelling.keys(np.array([w], np.uint64).reshape(1, -1))[0]) for w in every]
            assert sorted(got[r]) == sorted(want)


def test_parts_of_a_long_word(monkeypatch):
    rng = random.Random(4)
    chars = np.array([[rng.randint(1, 3) for _ in range(50)], [5] * 50], np.uint64)
    whole = sorted(k for _, key in spelling.neighbours(chars) for k in key.tolist())
    for part in (1, 7, 50, 51):
        monkeypatch.setattr(spelling, "PART", part)
        assert sorted(k for _, key in spelling.neighbours(chars) for k in key.tolist()) == whole


def test_long_words(spark):
    long = "ab" * 30_000
    rows = [(i, f"{long} {long}x {long[1:]}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: r[4] for r in found(docs, noise=1 << 40)}
    assert got == {long: 2, long + "x": 1, long[1:]: 1}


def test_chains_of_forms(spark):
    counts = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("zzzzz", 5)]
    words = spark.createDataFrame(counts, "word string, n bigint")
    rows = {r.word: r for r in spelling.group(words).collect()}
    assert {rows[w].root for w, _ in counts[:6]} == {"bbbbb"} and rows["zzzzz"].root == "zzzzz"
    assert rows["aaaaa"].form == "aaaab" and rows["bbbbb"].form is None and rows["bbbbb"].n_near == 1


def test_words_with_one_reduced_word(spark):
    # All words of two letters that share a symbol: one reduced word, a hot group.
    same = [c for c in "abcdefghijklmnopqrstuvwxyz" if spelling.symbols(c)[0] == spelling.symbols("a")[0]][:2]
    rng = random.Random(5)
    texts = ["".join(rng.choice(same) for _ in range(6)) for _ in range(50)]
    rows = [(i, " ".join(texts[i % 50 :])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(docs) == spelling.brute_force(rows)
