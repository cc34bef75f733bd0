"""Benchmark decontamination by Wu-Manber search for many strings at once.

A window is ``n`` consecutive words of a benchmark item; an item with fewer words is one window. A
text is reduced to its words, each between single spaces, so a window is a string of bytes. Windows
are put into length classes. A class has a table of shifts over blocks of bytes: the shift of the
block that ends the current position tells how far the search may jump, since no window can end
before. Where it is zero, the bucket of that block's hash holds the windows to compare, byte by
byte. Many places of many texts advance together, as lanes of one array.

The windows of a bounded block of items are broadcast; more items take more blocks, one after the
other over the same row, so no row is shuffled and memory follows the block, not the item table.

Defined results: a null or empty text has no words and is never contaminated; rows are judged one
by one, so repeated rows get equal results; items with the same id count once; an item without
words or without id has no windows; without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches

WINDOW_WORDS = 13
# Bytes of item text whose windows are searched at once.
BLOCK_BYTES = 4 << 20

# Word bytes are digits, letters and everything beyond ASCII; capitals are lower-cased.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_CLASSES = (6, 12, 24)
_TABLE_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = 4096

RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)
RESULT_DDL = "struct<n_words:bigint,spans:array<struct<first:int,end:int>>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def windows(text: bytes, n: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    if len(words) <= n:
        return {b" " + b" ".join(words) + b" "}
    return {b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)}


def _block_hash(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Search:
    """Shift table and buckets of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.size = m = min(map(len, patterns))
        self.block = b = min(8, max(2, m // 3))
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << _TABLE_BITS, m - b + 1, np.int32)
        for end in range(b, m + 1):
            block = np.zeros(len(patterns), np.uint64)
            for i in range(b):
                block |= heads[:, end - b + i].astype(np.uint64) << np.uint64(8 * i)
            found = _block_hash(block)
            np.minimum.at(self.shift, found, m - end)
        order = np.argsort(found, kind="stable")
        self.bucket_hash, self.bucket = found[order], order

    def find(self, buffer: bytes, view: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence; ``view`` reads 8 bytes at any place."""
        last = len(buffer) - 8 - self.size
        if last < 0:
            return
        at = np.arange(0, last + 1, _LANE)
        end = np.minimum(at + _LANE, last + 1)
        tail = self.size - self.block
        while len(at):
            found = _block_hash(view[at + tail] & self.mask)
            jump = self.shift[found]
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                yield from self._compare(buffer, at[hit], found[hit])
            at = at + np.maximum(jump, 1)
            alive = at < end
            at, end = at[alive], end[alive]

    def _compare(self, buffer: bytes, at: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int]]:
        low = np.searchsorted(self.bucket_hash, found, "left")
        high = np.searchsorted(self.bucket_hash, found, "right")
        for start, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in self.bucket[a:b].tolist():
                if buffer.startswith(self.patterns[k], start):
                    yield start, k


class Windows:
    """All windows of a block of items, ready to search."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        owners: dict[bytes, set[str]] = {}
        for key, text in items:
            for window in windows(text, n):
                owners.setdefault(window, set()).add(key)
        by_class: dict[int, list[bytes]] = {}
        for window in owners:
            by_class.setdefault(sum(len(window) >= c for c in _CLASSES), []).append(window)
        self.searches = [Search(x) for x in by_class.values()]
        self.owners = owners

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, hit word ranges, ids of the items found."""
        parts, starts, counts, at = [], [], [], 0
        for text in texts:
            words = words_of(text)
            part = b" " + b" ".join(words) + b" \n"
            parts.append(part)
            starts.append(at)
            counts.append(len(words))
            at += len(part)
        buffer = b"".join(parts) + b"\n" * 16
        view = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
        rows: dict[int, list[tuple[int, bytes]]] = {}
        firsts = np.array(starts, np.int64)
        for search in self.searches:
            for start, k in search.find(buffer, view):
                row = int(np.searchsorted(firsts, start, "right")) - 1
                rows.setdefault(row, []).append((start - starts[row], search.patterns[k]))
        out = []
        for row, n_words in enumerate(counts):
            hits = rows.get(row)
            if not hits:
                out.append((n_words, [], set()))
                continue
            gaps = np.flatnonzero(np.frombuffer(parts[row], np.uint8) == 32)
            first = np.searchsorted(gaps, [start for start, _ in hits]).tolist()
            spans = [(a, a + p.count(b" ") - 1) for a, (_, p) in zip(first, hits, strict=True)]
            found = set().union(*(self.owners[p] for _, p in hits))
            out.append((n_words, merged(spans), found))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(shared, n: int) -> Callable:
    def scan(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        search = Windows(shared.value, n)
        for text, before in parts:
            done, out = 0, []
            for part in batches.slices(text):
                old = before.slice(done, len(part)).to_pylist()
                done += len(part)
                rows = []
                for (n_words, spans, items), had in zip(
                    search.scan(batches.raw(part)), old, strict=True
                ):
                    if had and (had["spans"] or had["items"]):
                        spans = merged(spans + [(s["first"], s["end"]) for s in had["spans"]])
                        items = items | set(had["items"])
                    rows.append(
                        {
                            "n_words": n_words,
                            "spans": [{"first": a, "end": b} for a, b in spans],
                            "items": sorted(items),
                        }
                    )
                out.append(pa.array(rows, RESULT))
            yield batches.joined(out, RESULT)

    scan.__annotations__ = {
        "parts": Iterator[tuple[pa.Array, pa.Array]],
        "return": Iterator[pa.Array],
    }
    return scan


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "found",
    n: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, spans (merged ranges of hit words), items (ids).

    A column of ``docs`` named ``out`` is replaced.
    """
    spark = docs.sparkSession
    table = items.select(
        F.col(item_id).cast("string").alias("key"), F.col(item_text).cast("binary").alias("text")
    ).where("key is not null and text is not null")
    total = table.agg(F.sum(F.octet_length("text") + F.octet_length("key"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    result = docs.withColumn(out, F.lit(None).cast(RESULT_DDL))
    for block in range(blocks):
        part = table.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        rows = [(r.key, bytes(r.text)) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(rows)
        scan = F.arrow_udf(_scanner(shared, n), RESULT_DDL)
        result = result.withColumn(out, scan(F.col(text), F.col(out)))
    return result


def hit_words(found: str) -> Column:
    return F.aggregate(
        F.col(f"{found}.spans"), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"]
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: str) -> Column:
    """SHA-256 of the item ids, sorted as strings."""
    return F.sha2(F.concat_ws(",", F.array_sort(f"{found}.items")), 256)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their columns."""
    found = find(docs, items, text, out="__found")
    n_words = F.col("__found.n_words")
    return found.where(~contaminated(hit_words("__found"), n_words)).drop("__found")


def brute_force(
    texts: list[str | None], items: list[tuple[object, str | None]], n: int = WINDOW_WORDS
) -> list[dict]:
    """The contract said plainly, for tests."""
    out = []
    for text in texts:
        words = words_of((text or "").encode())
        hit, keys = set(), set()
        for key, item in items:
            if key is None:
                continue
            own = words_of((item or "").encode())
            size = min(n, len(own))
            for i in range(len(own) - size + 1) if own else ():
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        keys.add(str(key))
        ids = ",".join(sorted(keys))
        out.append(
            {
                "n_words": len(words),
                "n_hit": len(hit),
                "n_items": len(keys),
                "items_sha256": hashlib.sha256(ids.encode()).hexdigest(),
                "contaminated": bool(hit) and 20 * len(hit) >= len(words),
            }
        )
    return out
