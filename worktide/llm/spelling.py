"""Spelling variants by reduced-alphabet generation.

Every letter is hashed to one of a few symbols, so a word becomes a reduced word and many words
share one. If two words differ by one edit, their reduced words are equal or differ by one edit. So
the full neighbourhood of each distinct reduced word, all strings one deletion, replacement or
insertion of a symbol away and the word itself, is generated and joined with the reduced
vocabulary; the words behind each pair of reduced words that meet are verified by their letters.

Strings of symbols are compared as 64-bit keys: a polynomial in the symbols, whose value for each
neighbour follows from sums over the word's two ends. A neighbourhood therefore costs time with the
word's length, not with its square, and is written out in parts; two strings with the same key only
cost a verification. Small alphabets give small neighbourhoods and many verifications, large ones
the reverse.

A word's form is the most frequent near word, if it occurs at least twice as often. Counts double
along a chain of forms, so following forms to the root takes few rounds of pointer doubling.

Defined results: a null or empty text has no words; a null id is written as nothing before the colon
of a run's hash; repeated rows count each; a word without near words has null form and is its own
root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches
from worktide.operators.staging import stage

# Runs of letters (a fixed value).
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
# One run in so many loses a letter.
NOISE = 97
SYMBOLS = 8
# Counts kept in a task before they are passed on.
HELD_WORDS = 200_000
# Positions of a word whose neighbours are written out at once.
PART = 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BY_LENGTH = 0xD6E8FEB86659FD93


def noisy(seed: int, run: str, noise: int = NOISE) -> str:
    """The run, without one of its letters where its hash, which goes on from ``seed``, says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(noise: int, least: int) -> Callable:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in parts:
            keys = batch.column(0).to_pylist()
            done = 0
            for part in batches.slices(batch.column(1)):
                for key, text in zip(keys[done : done + len(part)], batches.raw(part), strict=True):
                    seed = zlib.crc32(f"{key or ''}:".encode())
                    for run, n in Counter(RUN.findall(text.translate(_LOWER).decode())).items():
                        if len(run) >= least and len(word := noisy(seed, run, noise)) >= least:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield _counts(held)
                        held = Counter()
                done += len(part)
        yield _counts(held)

    return count


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
    )


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text",
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               noise: int = NOISE) -> DataFrame:
    """Distinct words with their occurrences ``n`` over all texts; counts are summed in each task
    before they are shuffled."""
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    words = rows.mapInArrow(_counter(noise, least_length), "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols(word: str, count: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to ``count`` of the letters."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (codes * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(count) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _ends(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers, and sums over the letters before and from each place, for words of one length."""
    power = _powers(chars.shape[1] + 1)
    term = chars * power[:-1]
    before = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    np.cumsum(term, axis=1, out=before[:, 1:])
    return power, before, before[:, -1:] - before


def _length_term(size: int) -> np.uint64:
    return np.uint64((_BY_LENGTH * size) & (2**64 - 1))


def keys(chars: np.ndarray) -> np.ndarray:
    """Keys of words of one length, given as rows of symbols."""
    _, before, _ = _ends(chars)
    return before[:, -1] + _length_term(chars.shape[1])


def neighbours(chars: np.ndarray, count: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every string at most one edit from words of one length, each string once."""
    n, size = chars.shape
    power, before, after = _ends(chars)
    length = [_length_term(m) for m in (size - 1, size, size + 1)]
    whole = before[:, -1]
    yield np.arange(n), whole + length[1]
    for low in range(0, size + 1, PART):
        own = chars[:, low : low + PART]
        # The letter before each place; in a run of equal symbols one deletion, and one insertion of
        # that symbol, stands for all.
        previous = np.zeros((n, min(size + 1, low + PART) - low), np.uint64)
        start = 0 if low else 1
        previous[:, start:] = chars[:, low + start - 1 : low + previous.shape[1] - 1]
        if own.shape[1]:
            row, at = np.nonzero(own != previous[:, : own.shape[1]])
            at += low
            yield row, before[row, at] + after[row, at + 1] * np.uint64(_BACK) + length[0]
        for symbol in range(1, count + 1):
            row, at = np.nonzero(own != symbol)
            at += low
            step = (np.uint64(symbol) - chars[row, at]) * power[at]
            yield row, whole[row] + step + length[1]
            row, at = np.nonzero(previous != symbol)
            at += low
            yield row, before[row, at] + np.uint64(symbol) * power[at] + after[row, at] * np.uint64(
                _BASE
            ) + length[2]


def _by_length(words: list[str], count: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows and symbols of words of one length; at most a million symbols together."""
    rows: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        rows.setdefault(len(word), []).append(i)
    for size, members in rows.items():
        step = max(1, (1 << 17) // max(1, size))
        for low in range(0, len(members), step):
            some = members[low : low + step]
            yield some, np.stack([symbols(words[i], count) for i in some])


def _reducer(count: int) -> Callable:
    def reduce(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in parts:
            words = array.to_pylist()
            out = np.zeros(len(words), np.uint64)
            for rows, chars in _by_length(words, count):
                out[rows] = keys(chars)
            yield pa.array(out.view(np.int64))

    reduce.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return reduce


def _generator(count: int) -> Callable:
    def generate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            own = np.asarray(batch.column("reduced"))
            for rows, chars in _by_length(batch.column("word").to_pylist(), count):
                members = own[rows]
                for row, key in neighbours(chars, count):
                    source, reduced = members[row], key.view(np.int64)
                    # Neighbourhoods are mutual: of two that hold each other's word one is enough.
                    half = source <= reduced
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reduced[half]), pa.array(source[half])], ["reduced", "source"]
                    )

    return generate


def pairs(words: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """Directed pairs (word, near, near_n) of all words of ``words`` (word, n) that differ by one
    inserted, deleted or replaced code point."""
    reduced = stage(
        words.withColumn("reduced", F.arrow_udf(_reducer(count), "bigint")(F.col("word")))
    )
    # Words that share a reduced word share its neighbourhood.
    distinct = reduced.groupBy("reduced").agg(F.min("word").alias("word"))
    generated = distinct.mapInArrow(_generator(count), "reduced bigint, source bigint")
    met = generated.join(distinct.select("reduced"), "reduced")
    left = reduced.select(F.col("reduced").alias("source"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = reduced.select("reduced", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (
        met.join(left, "source")
        .join(right, "reduced")
        .where("source < reduced or a < b")
        .where(one_edit(F.col("a"), F.col("b")))
    )
    return near.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
            )
        )
    )


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by exactly one code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def group(words: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n."""
    best = pairs(words, count).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best"),
    )
    often = -F.col("best.rank") >= 2 * F.col("n")
    formed = stage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"),
            F.when(often, -F.col("best.rank")).alias("form_n"),
        )
    )
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form."""
    links = stage(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(
            links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                     F.col("next").isNotNull().alias("more"))
        )
        links = moved.select("word", "root")
        if not moved.where("more").head(1):
            return links


def brute_force(rows: list[tuple[object, str | None]], least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, noise: int = NOISE) -> list[tuple]:
    """The contract said plainly, for tests: (word, form, root, n, n_near, form_n)."""
    counts: Counter[str] = Counter()
    for key, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    mates = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        if mates[w]:
            best = min(mates[w], key=lambda v: (-words[v], v))
            if words[best] >= 2 * n:
                forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, n, len(mates[w]), words[form] if form else None))
    return sorted(out)
