import random
import zlib

import numpy as np
import pytest

from worktide.llm import packing
from worktide.llm.queries import vocabulary
from tests.llm.texts import edge_texts


def check(rows, size):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by_sequence


@pytest.mark.parametrize("size", [16, 2048])
def test_round_trip(spark, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    texts = [*edge_texts(), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n<|endoftext", "it's 12  three\n\n 'll", "naïve 日本語 текст"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = packing.pack(docs, vocabulary(), size=size, slots=4).collect()
    check(rows, size)
    for i, text in enumerate(texts):
        own = sorted((r.piece, r) for r in rows if r.doc_id == i)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert [t for _, r in own for t in r.ids] == want
        assert [k for k, _ in own] == list(range(len(own)))
        assert all(r.length == size for _, r in own[1:])
        assert [r.start for _, r in own] == np.cumsum([0, *(r.length for _, r in own[:-1])]).tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for _, r in own)


def test_same_ids_as_the_tokenizers_library_on_all_test_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    own = packing.Tokenizer(vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == want.ids


def test_long_white_space():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    own = packing.Tokenizer(vocabulary())
    n = packing.LONG_RUN
    for text in (
        " " * 1_200_000, "a" + "\n" * 1_200_000 + "b", " " * n + "x", "it's" + "\n \t" * n + " 12 " + " " * n + "\n!",
        "é" + "\u3000\xa0" * n + "日", "\x1c" * (n + 5) + " ", "a" + " " * (n - 1) + "b", "\r\n" * n,
    ):
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_against_plain_search():
    rng = random.Random(3)
    bins = packing.BestFit(100, 8)
    room: dict[int, int] = {}
    order: list[int] = []
    for _ in range(3000):
        length = rng.randint(1, 100)
        sequence, offset = bins.place(length)
        fits = [r for r in room.values() if r >= length]
        if fits:
            assert room[sequence] == min(fits) and offset == 100 - room[sequence]
            room[sequence] -= length
        else:
            assert sequence not in order and offset == 0
            if len(room) == 8:
                fullest = min(room.values())
                room.pop(next(s for s in room if room[s] == fullest and s not in bins_open(bins)))
            order.append(sequence)
            room[sequence] = 100 - length
        if not room[sequence]:
            room.pop(sequence)
        assert set(room) == bins_open(bins)


def bins_open(bins):
    return {s for stack in bins.by_room.values() for s in stack}


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, vocabulary(), ids=False).collect()
    sequences = check(rows, packing.SEQUENCE_TOKENS)
    least = -(-sum(r.length for r in rows) // packing.SEQUENCE_TOKENS)
    assert len(sequences) <= 1.03 * least
