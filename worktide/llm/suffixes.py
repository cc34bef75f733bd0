"""Removal of repeated byte strings through blockwise sorted suffixes and a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller id, or further ahead in its own. The documents are cut into blocks of bounded size that
follow the order of their ids. A suffix matters only by its first ``length`` bytes.

* The difference cover modulo 31 has six residues, such that any two residues are brought into it by
  one shift of less than 31. Positions of a document at these residues are its cover sample; a
  sample's name stands for its next ``length - 30`` bytes. Of two equal strings of ``length`` bytes,
  at whatever positions, a pair of samples at the same shift has equal names. So a suffix none of
  whose samples has a name that occurs elsewhere is alone, and only the others are sorted.
* Names are compared between blocks as sorted messages, one per block and range of names, coded by
  their differences; the answer to a message is one bit per name.
* The remaining suffixes of a block are sorted one bucket at a time. A bucket holds suffixes whose
  first word lies between two splitters. Suffixes are told apart by their first 31 and last 30
  bytes; a tied group meets one of its own, by the names of the samples at the shift that the cover
  gives for the two positions, so long ties take one comparison. Only those that differ from it are
  sorted by the bytes between. The order is not the alphabet's, as only equality counts.
* The first suffix of each class of equal strings goes, as a fingerprint of 80 bits, through a
  second exchange of messages, in which a block learns the strings that an earlier block holds.

Memory follows a block or a range, not the table: a hot string occurs once per block in a message.
Names and fingerprints of different strings may agree: a name then only costs sorting; a fingerprint
of 80 bits lets one of n strings pass for another with a chance of n squared in 2 to the 81st.

Defined results: a null text is empty; a text shorter than ``length`` keeps all its bytes; rows with
one id count as documents of their own, in the order of their texts' hashes, and equal ones take any
order; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches
from worktide.operators.staging import stage
from worktide.session import shared_dir

LENGTH = 100
# A perfect difference set: every difference modulo 31 occurs once.
MODULUS = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
# Text bytes of a block, and text bytes per range of names.
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 4 << 20
# Suffixes sorted at once.
BUCKET = 1 << 20
NAME_BITS = 48

_INVERSE = np.full(MODULUS, -1)
_INVERSE[COVER] = np.arange(len(COVER))
# Shift that brings both residues into the cover.
_SHIFT = np.array(
    [
        [next(k for k in range(MODULUS) if _INVERSE[(a + k) % MODULUS] >= 0 <= _INVERSE[(b + k) % MODULUS])
         for b in range(MODULUS)]
        for a in range(MODULUS)
    ]
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def _hash(view: np.ndarray, at: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """64-bit hash of the words at ``offsets`` from each place."""
    out = np.full(len(at), seed, np.uint64)
    # Parts that stay in the processor's cache.
    for low in range(0, len(at), 1 << 14):
        h, here = out[low : low + (1 << 14)], at[low : low + (1 << 14)]
        for offset in offsets:
            h ^= view[here + offset]
            h *= _MULTIPLY
            h ^= h >> np.uint64(32)
        h *= _FINISH
        h ^= h >> np.uint64(29)
    return out


def _words(first: int, end: int) -> tuple[int, ...]:
    """Offsets of words that cover the bytes from ``first`` to ``end``."""
    return (*range(first, end - 8, 8), end - 8)


class Block:
    """Documents of a block, their cover sample and the suffixes that may be repeated."""

    def __init__(self, text: bytes, sizes: np.ndarray, length: int = LENGTH):
        self.length = length
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(text + b"\0" * 8, np.uint8)
        self.view = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        self.long = np.flatnonzero(sizes >= length)
        span = length - MODULUS + 1
        room = sizes[self.long] - span + 1
        counts = room // MODULUS * len(COVER) + np.searchsorted(COVER, room % MODULUS)
        self.base = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(self.long)), counts)
        step = np.arange(len(doc)) - self.base[doc]
        self.sample_doc = doc
        self.sample = self.starts[self.long][doc] + step // len(COVER) * MODULUS + COVER[step % len(COVER)]
        self.names = _hash(self.view, self.sample, _words(0, span))
        self.order = np.argsort(self.names >> np.uint64(64 - NAME_BITS))
        named = (self.names >> np.uint64(64 - NAME_BITS))[self.order]
        self.first = np.flatnonzero(np.diff(named, prepend=named[:1] + np.uint64(1)))
        self.unique = named[self.first]

    def suffixes(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of suffixes with a repeated sample, and their documents among the long ones."""
        counts = np.diff(self.first, append=len(self.order))
        repeated = np.zeros(len(self.order), bool)
        repeated[self.order] = np.repeat(elsewhere | (counts > 1), counts)
        at, doc = self.sample[repeated], self.sample_doc[repeated]
        start = self.starts[self.long][doc]
        low = np.maximum(at - MODULUS + 1, start)
        high = np.minimum(at, start + self.sizes[self.long][doc] - self.length)
        new = np.ones(len(at), bool)
        new[1:] = low[1:] > high[:-1] + 1
        # Runs of two documents may touch; each keeps its own.
        new[1:] |= doc[1:] != doc[:-1]
        runs = np.flatnonzero(new)
        low, high = low[runs], high[np.append(runs[1:], len(at)) - 1] if len(at) else high
        counts = high - low + 1
        skip = np.cumsum(counts) - counts
        return np.arange(counts.sum()) + np.repeat(low - skip, counts), np.repeat(doc[runs], counts)

    def classes(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each suffix the place in ``at`` of the first one with an equal string."""
        first = np.arange(len(at))
        word = self.view[at]
        pick = np.sort(word[:: max(1, len(at) // 4096)])
        cuts = np.unique(pick[:: max(1, -(-len(pick) * BUCKET // max(1, len(at))))])
        bucket = np.searchsorted(cuts, word, "right").astype(np.int32)
        by_bucket = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=len(cuts) + 1))
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if high - low > 1:
                self._sort(first, by_bucket[low:high], at, doc)
        return first

    def _sort(self, first: np.ndarray, rows: np.ndarray, at: np.ndarray, doc: np.ndarray) -> None:
        ends = (*_words(0, MODULUS), *_words(self.length - MODULUS + 1, self.length))
        key = _hash(self.view, at[rows], ends)
        order = np.argsort(key)
        rows = rows[order]
        keep, group = _groups(np.zeros(len(rows), np.int64), key[order])
        rows = rows[keep]
        # Each tied group meets one of its own; the cover says where their samples agree in shift.
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(begin, append=len(rows))
        pivot = np.repeat(rows[begin + size // 2], size)
        start = self.starts[self.long]
        own, other = at[rows] - start[doc[rows]], at[pivot] - start[doc[pivot]]
        shift = _SHIFT[own % MODULUS, other % MODULUS]
        same = self._name(doc[rows], own + shift) == self._name(doc[pivot], other + shift)
        _lowest(first, rows[same], group[same])
        # Strings that differ from it between the ends are sorted by what lies there.
        rows, group = rows[~same], group[~same]
        key = _hash(self.view, at[rows], _words(MODULUS, self.length - MODULUS + 1))
        order = np.lexsort((key, group))
        keep, classes = _groups(group[order], key[order])
        _lowest(first, rows[order][keep], classes)

    def _name(self, doc: np.ndarray, local: np.ndarray) -> np.ndarray:
        step = local // MODULUS * len(COVER) + _INVERSE[local % MODULUS]
        return self.names[self.base[doc] + step]

    def prints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of 64 and 16 further bits."""
        offsets = _words(0, self.length)
        return _hash(self.view, at, offsets, 7), (
            _hash(self.view, at, offsets, 11) >> np.uint64(48)
        ).astype(np.uint16)


def _lowest(first: np.ndarray, members: np.ndarray, group: np.ndarray) -> None:
    """Give all members of a group, which lie together, the smallest of them."""
    if len(members):
        head = np.flatnonzero(np.diff(group, prepend=-1))
        lowest = np.minimum.reduceat(members, head)
        first[members] = np.repeat(lowest, np.diff(head, append=len(members)))


def _groups(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, those that share (group, key) with another; and their new groups."""
    if not len(group):
        return np.zeros(0, bool), group
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(new) - 1
    keep = np.bincount(number)[number] > 1
    return keep, number[keep]


def _encode(values: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Sorted numbers by the bytes of their differences, plane by plane."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    data = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    if extra is not None:
        data += extra.astype("<u2").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(data)


def _decode(data: bytes, extra: bool) -> tuple[np.ndarray, np.ndarray | None]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (10 if extra else 8)
    steps = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T.copy().view("<u8").reshape(n)
    values = np.cumsum(steps, dtype=np.uint64)
    return values, np.frombuffer(raw, "<u2", n, 8 * n) if extra else None


BLOCK_DDL = "block bigint, sizes array<bigint>, text binary, ordered boolean, first {0}, last {0}, ids array<{0}>"


def _packer(block_bytes: int) -> Callable:
    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in parts:
            for part in batches.slices(batch.column(1), block_bytes >> 2):
                size = sum(map(len, batches.raw(part)))
                if kept and held + size > block_bytes:
                    yield _packed(kept, number)
                    kept, held, number = [], 0, number + 1
                done = part.offset - batch.column(1).offset
                kept.append(batch.slice(done, len(part)))
                held += size
        if kept:
            yield _packed(kept, number)

    return pack


def _packed(kept: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([b.column(0) for b in kept])
    texts = [x for b in kept for x in batches.raw(b.column(1))]
    ordered = ids.null_count == 0 and (
        len(ids) < 2 or pc.all(pc.less(ids.slice(0, len(ids) - 1), ids.slice(1))).as_py()
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
            pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
            pa.array([ordered], pa.bool_()),
            ids.slice(0, 1),
            ids.slice(len(ids) - 1),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        ],
        ["block", "sizes", "text", "ordered", "first", "last", "ids"],
    )


class Blocks:
    """Documents as a written table of blocks, bucketed so that answers join without moving it."""

    def __init__(self, docs: DataFrame, key: str, text: str, block_bytes: int):
        spark = docs.sparkSession
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        kind = rows.schema["key"].dataType.simpleString()
        self.name = f"suffix_blocks_{uuid.uuid4().hex}"
        blocks = rows.mapInArrow(_packer(block_bytes), BLOCK_DDL.format(kind))
        self.table = self._write(blocks)
        if not self._in_order():
            spark.sql(f"drop table {self.name}")
            order = [F.col("key").asc_nulls_last(), F.xxhash64("text")]
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = rows.repartitionByRange(parts, *order, F.rand(0)).sortWithinPartitions(*order)
            self.table = self._write(dealt.mapInArrow(_packer(block_bytes), BLOCK_DDL.format(kind)))

    def _write(self, blocks: DataFrame) -> DataFrame:
        spark = blocks.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(spark)}/{self.name}-{uuid.uuid4().hex}"
        blocks.write.option("path", path).bucketBy(buckets, "block").saveAsTable(self.name)
        return spark.table(self.name)

    def _in_order(self) -> bool:
        """Ids rise strictly inside every block, and no two blocks overlap."""
        ends = stage(self.table.select("block", "first", "last", "ordered"))
        if ends.where("not ordered").head(1):
            return False
        # Each block's last id must be below the next block's first.
        both = ends.select(F.col("first").alias("id"), F.lit(1).alias("step")).unionAll(
            ends.select(F.col("last").alias("id"), F.lit(-1).alias("step"))
        )
        order = both.orderBy("id", F.desc("step")).select("step")
        alternating = order.mapInArrow(_alternates, "first int, last int, good boolean").collect()
        edge = [(r.first, r.last) for r in alternating]
        return all(r.good for r in alternating) and all(
            a[1] != b[0] for a, b in zip(edge, edge[1:], strict=False)
        )

    def drop(self) -> None:
        self.table.sparkSession.sql(f"drop table {self.name}")


def _alternates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: the first and last step, and whether opening and closing take turns."""
    steps = np.concatenate([np.zeros(0, np.int32), *(np.asarray(b.column(0)) for b in parts)])
    if len(steps):
        good = bool((steps[1:] != steps[:-1]).all())
        yield pa.RecordBatch.from_pylist(
            [{"first": int(steps[0]), "last": int(steps[-1]), "good": good}],
            pa.schema([("first", pa.int32()), ("last", pa.int32()), ("good", pa.bool_())]),
        )


MESSAGE_DDL = "block bigint, first {}, `range` int, data binary"


def _bounds(ranges: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)


def _opened(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Block]]:
    for i in range(batch.num_rows):
        text = zstandard.ZstdDecompressor().decompress(batch.column("text")[i].as_py())
        yield i, Block(text, np.array(batch.column("sizes")[i].values, np.int64), length)


def _messages(batch: pa.RecordBatch, i: int, values: np.ndarray, extra: np.ndarray | None,
              bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    ends = np.append(np.searchsorted(values, _bounds(ranges, bits)), len(values))
    low, rows = 0, []
    for number, high in enumerate(ends.tolist()):
        if high > low:
            rows.append((number, _encode(values[low:high], None if extra is None else extra[low:high])))
        low = high
    if rows:
        here = pa.array([i] * len(rows))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("block").take(here),
                batch.column("first").take(here),
                pa.array([r for r, _ in rows], pa.int32()),
                pa.array([d for _, d in rows], pa.binary()),
            ],
            ["block", "first", "range", "data"],
        )


def _name_sender(length: int, ranges: int) -> Callable:
    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i, block in _opened(batch, length):
                yield from _messages(batch, i, block.unique, None, NAME_BITS, ranges)

    return send


def _flags(answers: pa.Scalar, count: int) -> np.ndarray:
    """Bits of the answers to a block's messages, in the order of their ranges."""
    got = answers.as_py() or []
    bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(got, key=lambda a: a["range"])]
    flags = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    assert len(flags) == count
    return flags


def _sorted(block: Block, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes of a block, their classes, and the fingerprints of the classes in order."""
    at, doc = block.suffixes(names)
    first = block.classes(at, doc)
    own = np.flatnonzero(first == np.arange(len(at)))
    prints, extra = block.prints(at[own])
    order = np.lexsort((extra, prints))
    return at, first, own[order], prints[order], extra[order]


def _print_sender(length: int, ranges: int) -> Callable:
    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i, block in _opened(batch, length):
                names = _flags(batch.column("names")[i], len(block.unique))
                *_, prints, extra = _sorted(block, names)
                yield from _messages(batch, i, prints, extra, 64, ranges)

    return send


def _answer(earlier: bool) -> Callable:
    """Marks, per message, the values that another block (an earlier one) sent too."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("block", "ascending")])
        got = [_decode(d.as_py(), earlier) for d in table.column("data")]
        counts = [len(v) for v, _ in got]
        values = np.concatenate([v for v, _ in got])
        if earlier:
            extra = np.concatenate([e for _, e in got])
            order = np.lexsort((extra, values))
            equal = (np.diff(values[order]) == 0) & (np.diff(extra[order].astype(np.int32)) == 0)
        else:
            order = np.argsort(values, kind="stable")
            equal = np.diff(values[order]) == 0
        marked = np.zeros(len(values), bool)
        marked[order[1:]] = equal
        if not earlier:
            marked[order[:-1]] |= equal
        bits, at = [], 0
        for n in counts:
            bits.append(np.packbits(marked[at : at + n]).tobytes())
            at += n
        return pa.table(
            {
                "block": table.column("block"),
                "range": table.column("range"),
                "n": pa.array(counts, pa.int32()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return answer


def _answered(messages: DataFrame, earlier: bool, out: str) -> DataFrame:
    """One row per block with the answers to its messages."""
    rows = messages.groupBy("range").applyInArrow(
        _answer(earlier), "block bigint, `range` int, n int, bits binary"
    )
    return rows.groupBy("block").agg(F.collect_list(F.struct("range", "n", "bits")).alias(out))


def removed_spans(block: Block, at: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(document, maximal removed byte ranges) for the removed strings that start at ``at``."""
    if not len(at):
        return
    doc = np.searchsorted(block.starts, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + block.length) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    owner = doc[head]
    low, high = at[head] - block.starts[owner], at[tail] + block.length - block.starts[owner]
    cut = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(owner[a]), list(zip(low[a:b].tolist(), high[a:b].tolist(), strict=True))


RESULT_DDL = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _remover(length: int, kind: pa.DataType | None, texts: bool) -> Callable:
    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i, block in _opened(batch, length):
                names = _flags(batch.column("names")[i], len(block.unique))
                at, first, own, prints, _ = _sorted(block, names)
                gone = first != np.arange(len(at))
                seen = np.zeros(len(at), bool)
                seen[own] = _flags(batch.column("prints")[i], len(prints))
                spans = dict(removed_spans(block, at[gone | seen[first]]))
                rows = [_kept(block, d, spans.get(d, [])) for d in range(len(block.sizes))]
                for low in range(0, len(rows), 1000):
                    part = rows[low : low + 1000]
                    ids = batch.column("ids")[i].values.slice(low, len(part))
                    columns = [
                        ids, *(pa.array([r[k] for r in part], pa.int64()) for k in range(3)),
                        pa.array([hashlib.sha256(r[3]).hexdigest() for r in part], pa.string()),
                    ]
                    names_out = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    if texts:
                        columns.append(pa.array([r[3] for r in part], pa.binary()))
                        names_out.append("kept")
                    yield pa.RecordBatch.from_arrays(columns, names_out)

    return remove


def _kept(block: Block, doc: int, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    start, size = int(block.starts[doc]), int(block.sizes[doc])
    parts, at = [], 0
    for low, high in spans:
        parts.append(block.bytes[start + at : start + low].tobytes())
        at = high
    parts.append(block.bytes[start + at : start + size].tobytes())
    return size, sum(b - a for a, b in spans), len(spans), b"".join(parts)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
           block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
           texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``texts``, the bytes that stay (``kept``). ``length``: at least 64."""
    if length < 2 * MODULUS + 2:
        raise ValueError("length must be at least 64")
    spark = docs.sparkSession
    blocks = Blocks(docs, key, text, block_bytes)
    rows = blocks.table
    kind = rows.schema["first"].dataType.simpleString()
    total = rows.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0]
    ranges = max(1, -(-(total or 0) // range_bytes))
    message = MESSAGE_DDL.format(kind)
    narrow = rows.select("block", "first", "sizes", "text")
    sent = narrow.mapInArrow(_name_sender(length, ranges), message)
    names = stage(_answered(sent, False, "names"))
    told = narrow.join(names, "block", "left")
    sent = told.mapInArrow(_print_sender(length, ranges), message)
    prints = stage(_answered(sent, True, "prints"))
    full = rows.select("block", "ids", "sizes", "text")
    told = full.join(names, "block", "left").join(prints, "block", "left")
    kept = ", kept binary" if texts else ""
    found = stage(told.mapInArrow(_remover(length, None, texts), f"key {kind}, {RESULT_DDL}{kept}"))
    blocks.drop()
    return found.withColumnRenamed("key", key)


def brute_force(rows: list[tuple[object, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract said plainly, for tests: rows in the order of their documents."""
    seen: set[bytes] = set()
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
