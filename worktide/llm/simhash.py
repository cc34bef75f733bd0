"""SimHash near-duplicates, compared in bit slices.

A fingerprint has one vote per bit from the hash of every shingle. Equal fingerprints are one node.
Nodes that may be near are brought together by a key of fingerprint bits:

* ``exact_keys``: the bits are cut into blocks; fingerprints at a distance of at most ``radius``
  differ in at most that many blocks, so they agree in all others. There is one key for each choice
  of agreeing blocks, and no link is lost.
* ``sampled_keys``: for wide radii, where that choice explodes. Each key is a set of bits drawn at
  random; their number follows from the wanted recall.

Nodes with the same key are compared by vertical bit planes: word ``w`` of plane ``b`` holds bit
``b`` of 64 nodes. The exclusive or of a plane with the other side's bit gives 64 differences at
once, carry-save adders add them into bitwise counters, and words in which every distance exceeds
the radius are abandoned between steps. A task returns only the links of a spanning forest, never
all pairs. A key with very many nodes is cut into tiles; each pair of tiles is a group of its own,
so no task holds an unbounded group.

The filter ``dedup`` takes a radius some deviations beyond the distance it looks for, lets tasks
return spanning forests of the nearest links, and confirms every such link by the texts' sets of
shingles before it counts. What the forests join and the confirmed links do not is then compared
pair by pair, so a false link never stands for a true one.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked
like any other; with fewer words than a shingle the whole sequence is the one shingle; repeated
rows have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches
from worktide.llm.components import components
from worktide.operators.staging import stage

SEED = 42
# Nodes with one key that are compared in one task; beyond, tiles of this size are paired.
TILE = 2048
# Up to this size groups are compared together, by their distance in the sorted order.
SMALL = 64
# Nodes with their sets of shingles in one tile.
SET_TILE = 512
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``words`` words, in parts of bounded size."""
    carry: list[bytes] = []
    seen = False
    for block in batches.word_blocks(text.lower()):
        block = carry + block
        carry = block[max(0, len(block) - words + 1) :] if words > 1 else []
        if len(block) < words:
            carry = block
            continue
        seen = True
        shingles = map(b" ".join, zip(*[block[i:] for i in range(words)], strict=False))
        yield np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(block) - words + 1
        )
    if not seen and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits from a hash (the finaliser of splitmix64)."""
    if k == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, words: int, lanes: int = 1) -> np.ndarray:
    """``lanes`` unsigned 64-bit numbers; a bit is 1 if it is set in over half of the hashes."""
    votes = np.zeros(64 * lanes, np.int64)
    total = 0
    for hashes in shingle_hashes(text, words):
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start : start + (1 << 14)]
            total += len(part)
            for k in range(lanes):
                bits = np.unpackbits(
                    _mixed(part, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                    bitorder="little",
                )
                votes[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > total, bitorder="little").view("<u8")


def _fingerprinter(words: int, lanes: int) -> Callable:
    kind = pa.list_(pa.int64())

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in parts:
            rows = [
                fingerprint(x, words, lanes).view(np.int64)
                for part in batches.slices(text)
                for x in batches.raw(part)
            ]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * lanes
            yield pa.ListArray.from_arrays(ends, pa.array(flat)).cast(kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def fingerprints(text: str | Column, words: int, lanes: int = 1) -> Column:
    """Array of ``lanes`` 64-bit numbers per text."""
    return F.arrow_udf(_fingerprinter(words, lanes), "array<bigint>")(text)


# Keys


def exact_keys(radius: int, blocks: int | None = None) -> list[list[int]]:
    """Bit positions of each key over 64 bits; any two fingerprints within ``radius`` share one."""
    blocks = blocks or 2 * radius
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [list(range(a, b)) for a, b in itertools.pairwise(cuts)]
    return [sum(c, []) for c in itertools.combinations(parts, blocks - radius)]


def bit_agreement(similarity: float) -> float:
    """Chance that a bit agrees for two texts of equal length with this share of common shingles
    in the union."""
    shared = 2 * similarity / (1 + similarity)
    return 1 - math.acos(shared) / math.pi


def sampled_keys(size: int, bits: int, similarity: float, recall: float, seed: int = SEED) -> list[list[int]]:
    """Random bit positions of each key, ``size`` of them.

    There are as many keys as give ``recall`` at this similarity, whatever the table's size.
    """
    chance = bit_agreement(similarity) ** size
    count = math.ceil(math.log(1 - recall) / math.log(1 - chance))
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, size, replace=False).tolist()) for _ in range(count)]


def wide_radius(bits: int, similarity: float, deviations: float) -> int:
    """The distance expected at this similarity and some standard deviations more."""
    differs = 1 - bit_agreement(similarity)
    return math.ceil(bits * differs + deviations * math.sqrt(bits * differs * (1 - differs)))


def _keyed(lanes: int, keys: list[list[int]]) -> Callable:
    """Each fingerprint once per key, as a number made of the key's bits and its place."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prints in parts:
            flat = prints.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            out = np.zeros((len(flat), len(keys)), np.uint64)
            for k, places in enumerate(keys):
                value = np.full(len(flat), k + 1, np.uint64)
                # Each bit is folded into a running hash, so a key may be longer than 64 bits.
                for chunk in itertools.batched(places, 32):
                    bits = np.zeros(len(flat), np.uint64)
                    for i, place in enumerate(chunk):
                        lane, bit = divmod(place, 64)
                        bits |= ((flat[:, lane] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
                    value = _mixed(value, 1) ^ bits
                out[:, k] = _mixed(value, 1)
            ends = np.arange(len(flat) + 1, dtype=np.int32) * len(keys)
            yield pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1).view(np.int64)))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


# Bit slices


def planes_of(flat: np.ndarray, spare: int = 1) -> np.ndarray:
    """Planes (bits, words): bit i of word w of plane b is bit b of row 64 w + i; ``spare`` zero
    words follow."""
    n, lanes = flat.shape
    words = (n + 63) // 64
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(n, 8 * lanes), axis=1, bitorder="little")
    out = np.zeros((64 * lanes, (words + spare) * 64), np.uint8)
    out[:, :n] = bits.T
    return np.packbits(out, axis=1, bitorder="little").view("<u8").reshape(64 * lanes, words + spare)


class Counters:
    """Bitwise counters of many distances; ``over`` marks those beyond what the counters hold."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        # Eight planes at a time carry into the fourth counter.
        self.levels = [np.zeros(shape, np.uint64) for _ in range(max(3, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, d: np.ndarray) -> None:
        """Add eight planes of differences by carry-save adders."""
        ones, twos, fours = self.levels[:3]
        ones, a = _csa(ones, d[0], d[1])
        ones, b = _csa(ones, d[2], d[3])
        twos, c = _csa(twos, a, b)
        ones, a = _csa(ones, d[4], d[5])
        ones, b = _csa(ones, d[6], d[7])
        twos, e = _csa(twos, a, b)
        fours, carry = _csa(fours, c, e)
        self.levels[:3] = ones, twos, fours
        for i in range(3, len(self.levels)):
            level = self.levels[i]
            self.levels[i], carry = level ^ carry, level & carry
        self.over |= carry

    def exceeded(self) -> np.ndarray:
        """Bits of the distances beyond the radius."""
        greater, equal = self.over, ~self.over
        for i in reversed(range(len(self.levels))):
            level = self.levels[i]
            if self.radius >> i & 1:
                equal = equal & level
            else:
                greater = greater | (equal & level)
                equal = equal & ~level
        return greater

    def take(self, kept: np.ndarray) -> None:
        self.levels = [x[..., kept] for x in self.levels]
        self.over = self.over[..., kept]


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _set_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def small_groups(flat: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near rows of many small groups at once; ``left``: rows of the same group that follow.

    All rows are compared with the row ``lag`` places on, for each lag that some group reaches.
    """
    planes = planes_of(flat)
    n, words = len(flat), planes.shape[1] - 1
    for lag in range(1, int(left.max(initial=0)) + 1):
        mask = np.zeros(words * 64, np.uint8)
        mask[:n] = left >= lag
        alive = np.packbits(mask, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        alive = alive[at]
        counters = Counters(alive.shape, radius)
        q, r = divmod(lag, 64)
        for b in range(0, len(planes), 8):
            part = planes[b : b + 8]
            other = part[:, at + q]
            if r:
                after = part[:, np.minimum(at + q + 1, words)]
                other = (other >> np.uint64(r)) | (after << np.uint64(64 - r))
            counters.add(part[:, at] ^ other)
            kept = alive & ~counters.exceeded()
            if not kept.any():
                at = at[:0]
                break
            some = kept != 0
            if some.mean() < 0.75:
                at, kept = at[some], kept[some]
                counters.take(some)
            alive = kept
        if len(at):
            near = np.zeros(words, np.uint64)
            near[at] = alive
            rows = _set_bits(near)
            yield rows, rows + lag


def near_rows(flat: np.ndarray, radius: int, step: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of one group with the near rows among itself, its block and those after."""
    planes = planes_of(flat, 0)
    n = len(flat)
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    for start in range(0, n, step):
        asks = bits[start : start + step]
        # Rows before this block were compared when it was their turn.
        at = np.arange(start // 64, planes.shape[1])
        counters = Counters((len(asks), len(at)), radius)
        flips = (asks.T.astype(np.uint64) * _ONES)[:, :, None]
        alive = np.full((len(asks), len(at)), _ONES)
        for b in range(0, len(planes), 8):
            counters.add([planes[b + i, at][None, :] ^ flips[b + i] for i in range(8)])
            alive &= ~counters.exceeded()
            some = alive.any(axis=0)
            if not some.any():
                break
            if some.mean() < 0.75:
                at, alive = at[some], alive[:, some]
                counters.take(some)
        for i in range(len(asks)):
            word = np.flatnonzero(alive[i])
            if not len(word):
                continue
            rows = np.unpackbits(alive[i, word].astype("<u8").view(np.uint8), bitorder="little")
            rows = (at[word][:, None] * 64 + np.arange(64)).reshape(-1)[rows.astype(bool)]
            yield start + i, rows[rows < n]


def large_group(flat: np.ndarray, radius: int, step: int = 64) -> np.ndarray:
    """Labels of the near rows of one group: equal labels are connected."""
    label = np.arange(len(flat))
    for row, near in near_rows(flat, radius, step):
        found = label[near]
        own = label[row]
        if (found != own).any():
            all_found = np.unique(np.append(found, own))
            label[np.isin(label, all_found)] = all_found[0]
    return label


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of the connected nodes, for each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node of each row of a connected set with its least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _roots(len(nodes), flat[: len(a)], flat[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class Nearest:
    """Spanning forest of the nearest links, kept while links come in.

    Of all links across any cut of the nodes the forest holds a nearest one. So the links within
    any distance join the same nodes as those links of the forest do.
    """

    def __init__(self, hold: int = 1 << 20):
        self.hold = hold
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        self.parts.append((np.minimum(a, b), np.maximum(a, b), distance))
        self.n += len(a)
        if self.n > self.hold:
            kept = self.links()
            self.parts, self.n = [kept], len(kept[0])
            self.hold = max(self.hold, 2 * self.n)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, distance = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        # Ties by the nodes, so that keys that bring the same nodes together give the same links.
        order = np.lexsort((b, a, distance))
        a, b, distance = a[order], b[order], distance[order]
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat[: len(a)], flat[len(a) :]
        label, alive, chosen = np.arange(len(nodes)), np.arange(len(a)), np.zeros(len(a), bool)
        while True:
            alive = alive[label[x[alive]] != label[y[alive]]]
            if not len(alive):
                return a[chosen], b[chosen], distance[chosen]
            # Links are in order, so the least place is the nearest link of a set of nodes.
            best = np.full(len(nodes), len(a))
            np.minimum.at(best, label[x[alive]], alive)
            np.minimum.at(best, label[y[alive]], alive)
            chosen[best[best < len(a)]] = True
            label = _roots(len(nodes), x[chosen], y[chosen])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _linker(radius: int, lanes: int, nearest: bool) -> Callable:
    """Rows (key, node, prints), sorted by key, to links (a, b), the ``nearest`` ones if asked."""

    def groups(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of all small groups and their number of followers."""
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        if small.any():
            left = np.repeat(starts + sizes, sizes) - np.arange(len(small)) - 1
            yield np.flatnonzero(small), left[small]

    def nearest_links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, flat, starts, sizes = read(rows)
        forest = Nearest()
        for at, left in groups(starts, sizes):
            own, prints = node[at], flat[at]
            for x, y in small_groups(prints, left, radius):
                forest.add(own[x], own[y], _distance(prints[x], prints[y]))
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own, prints = node[start : start + size], flat[start : start + size]
            for row, near in near_rows(prints, radius):
                near = near[near > row]
                if len(near):
                    forest.add(np.full(len(near), own[row]), own[near], _distance(prints[row], prints[near]))
        if forest.n:
            a, b, _ = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], ["a", "b"])

    def read(rows: pa.Table) -> tuple[np.ndarray, ...]:
        key = rows.column("key").to_numpy()
        node = rows.column("node").to_numpy()
        flat = rows.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return node, flat, starts, np.diff(np.append(starts, len(key)))

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, flat, starts, sizes = read(rows)
        a, b = [], []
        for at, left in groups(starts, sizes):
            own, prints = node[at], flat[at]
            for x, y in small_groups(prints, left, radius):
                a.append(own[x])
                b.append(own[y])
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            group = slice(start, start + size)
            label = large_group(flat[group], radius)
            moved = np.flatnonzero(label != np.arange(size))
            a.append(node[group][moved])
            b.append(node[group][label[moved]])
        if a:
            a, b = _forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    linked = nearest_links if nearest else links

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            if sum(p.num_rows for p in held) < 1 << 17:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            # The last key may go on in the next batch.
            if cut:
                yield from linked(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from linked(pa.Table.from_batches(held))

    return run


def near_links(nodes: DataFrame, radius: int, keys: list[list[int]], lanes: int = 1,
               nearest: bool = False) -> DataFrame:
    """Links (a, b) that connect all nodes whose fingerprints share a key and differ in at most
    ``radius`` bits; with ``nearest`` those of a forest of nearest links. ``nodes``: distinct
    (node bigint, prints array)."""
    keyed = nodes.select("node", "prints", F.explode(key_values("prints", keys, lanes)).alias("key"))
    return _dealt(keyed, TILE).mapInArrow(_linker(radius, lanes, nearest), "a bigint, b bigint")


def key_values(prints: str | Column, keys: list[list[int]], lanes: int) -> Column:
    return F.arrow_udf(_keyed(lanes, keys), "array<bigint>")(prints)


def _dealt(keyed: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, ...) in tasks by key; a key with more than ``size`` rows is cut into tiles,
    and each pair of tiles has a key of its own."""
    rest = [c for c in keyed.columns if c != "key"]
    # Only keys with several tiles are looked up, so fingerprints are shuffled once.
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size)
    tiles = stage(crowded.select("key", F.ceil(F.col("n") / size).cast("bigint").alias("tiles")))
    rows = keyed.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # With several tiles, each pair of them is a group; with one tile the key is the group.
    tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles"))
    pairs = F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda t: t != F.col("tile")),
            lambda t: F.least(t, F.col("tile")) * F.col("tiles") + F.greatest(t, F.col("tile")),
        )
    )
    dealt = (
        rows.withColumn("tile", tile)
        .select("key", *rest, F.explode(pairs).alias("pair"))
        .select(F.xxhash64("key", "pair").alias("key"), *rest)
    )
    return dealt.repartition("key").sortWithinPartitions("key")


def marked(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text", lanes: int = 1) -> DataFrame:
    """Written table of ``key`` and ``prints``."""
    return stage(docs.select(key, fingerprints(F.col(text), words, lanes).alias("prints")))


def node_of(prints: str, lanes: int) -> Column:
    return F.col(prints)[0] if lanes == 1 else F.xxhash64(prints)


def classes(marked: DataFrame, key: str, radius: int, keys: list[list[int]] | None = None,
            prints: str = "prints", lanes: int = 1, out: str = "component_id",
            confirm: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of ``marked`` (a written table) with the least ``key`` of their class.

    Texts are in a class if a chain of fingerprints, each within ``radius`` of the next, joins
    them. ``keys`` defaults to those that lose no link. With ``confirm`` only the links count that
    it returns for the nearest links and the nodes.
    """
    rows = marked.withColumn("__node", node_of(prints, lanes))
    nodes = rows.groupBy(F.col("__node").alias("node")).agg(
        F.min(key).alias("least"), F.first(prints).alias("prints")
    )
    nodes = stage(nodes)
    links = near_links(
        nodes.select("node", "prints"), radius, keys or exact_keys(radius), lanes, confirm is not None
    )
    roots = components(confirm(links, nodes.select("node", "prints")) if confirm else links)
    placed = nodes.select("node", "least").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    # Written apart, so that the join sees a large class as two plain sides and can split it.
    least = stage(placed.groupBy("root").agg(F.min("least").alias(out)))
    named = placed.join(least, "root").select(F.col("node").alias("__node"), out)
    return rows.drop(out).join(named, "__node").drop("__node")


# Confirmation


def _shingle_sets(words: int) -> Callable:
    kind = pa.list_(pa.int32())

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in parts:
            out = []
            for part in batches.slices(text):
                rows = []
                for x in batches.raw(part):
                    hashes = [h.astype(np.uint32) for h in shingle_hashes(x, words)]
                    rows.append(np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint32))
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).view(np.int32))).cast(kind))
            yield batches.joined(out, kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def shingle_set(text: str | Column, words: int) -> Column:
    """Distinct 32-bit hashes of a text's shingles."""
    return F.arrow_udf(_shingle_sets(words), "array<int>")(text)


def _set_linker(radius: int, lanes: int, similarity: float) -> Callable:
    """Rows (key, node, label, prints, shingles), sorted by key, to links (a, b) that join labels.

    Rows of one key with different labels, at most ``radius`` apart, are compared by their shingles;
    labels that a link has joined are one from then on.
    """

    def group(rows: pa.Table) -> tuple[list, list]:
        node = rows.column("node").to_numpy()
        label = np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]
        a, b = [], []
        if not label.any():
            return a, b
        flat = rows.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
        sets = rows.column("shingles").combine_chunks()
        ends = np.append(0, np.cumsum(sets.value_lengths().to_numpy().astype(np.int64)))
        number = np.diff(ends)
        words, place = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        own = np.zeros(len(words), bool)
        for row in range(len(node) - 1):
            others = np.flatnonzero(label[row + 1 :] != label[row]) + row + 1
            n = np.maximum(number[others], number[row])
            others = others[np.minimum(number[others], number[row]) >= similarity * n]
            others = others[_distance(flat[others], flat[row]) <= radius]
            if not len(others):
                continue
            held = place[ends[row] : ends[row + 1]]
            own[held] = True
            hits = own[np.concatenate([place[ends[i] : ends[i + 1]] for i in others])]
            own[held] = False
            upto = np.append(0, np.cumsum(hits))
            stops = np.cumsum(number[others])
            shared = upto[stops] - upto[stops - number[others]]
            others = others[shared >= similarity * (number[others] + number[row] - shared)]
            joined, first = np.unique(label[others], return_index=True)
            a += [node[row]] * len(first)
            b += node[others[first]].tolist()
            label[np.isin(label, joined)] = label[row]
        return a, b

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for start, size in zip(starts, np.diff(np.append(starts, len(key))), strict=True):
            a, b = group(rows.slice(start, size))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            key = part.column("key").to_numpy()
            # Whole keys go as soon as another begins, since sets are long.
            if held and held[-1].column("key")[-1].as_py() != key[0]:
                yield from links(pa.Table.from_batches(held))
                held = []
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from links(pa.Table.from_batches([*held, part.slice(0, cut)]))
                held = []
            held.append(part.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _labelled(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """Nodes with the root of their star, their own where they have none."""
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))


def confirmed(links: DataFrame, texts: DataFrame, words: int, similarity: float, prints: DataFrame,
              radius: int, keys: list[list[int]], lanes: int = 1) -> DataFrame:
    """Links (a, b) that join the nodes whose texts share at least ``similarity`` of the shingles of both.

    ``links`` join all nodes that may be near, of ``prints`` (node, prints). Those that prove true
    are taken. Where they leave apart what ``links`` join, every pair of nodes left apart that
    shares one of ``keys`` and lies within ``radius`` is compared too, so that the result, stars and
    links between them, joins all nodes that true pairs join. ``texts``: a written table (node, row, text); of a node's rows,
    whose fingerprints are equal, the first stands for all. Only texts with a link are read into
    sets.
    """
    links = stage(links.distinct())
    linked = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    first = stage(texts.groupBy("node").agg(F.min("row").alias("row")).join(linked, "node", "left_semi"))
    sets = stage(
        texts.drop("node").join(first, "row").select("node", shingle_set(F.col("text"), words).alias("shingles"))
    )
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    n_a, n_b = F.size("of_a"), F.size("of_b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # Sets of too different sizes need no comparison.
    near = (F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)) & (shared >= similarity * (n_a + n_b - shared))
    true = stage(links.join(of_a, "a").join(of_b, "b").where(near).select("a", "b"))
    # A label is a node that true links join, or a star of them.
    stars = stage(components(true).select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = stage(_labelled(first.select("node"), stars))
    false = links.join(true, ["a", "b"], "left_anti")
    label_a, label_b = (label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    between = false.join(label_a, "a").join(label_b, "b").where("of_a <> of_b")
    roots = components(between.select(F.greatest("of_a", "of_b").alias("a"), F.least("of_a", "of_b").alias("b")))
    # A root has no row of its own.
    root = stage(roots.union(roots.select("root", "root").distinct()).withColumnRenamed("node", "label"))
    placed = stage(label.join(root, "label"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"))
    left = placed.join(sizes, "root").join(prints, "node").join(sets, "node")
    # All pairs of a set of nodes cover those that share a key; only for very large ones are there
    # fewer copies of a node by key than by pairs of tiles.
    by_key = F.transform(key_values("prints", keys, lanes), lambda k: F.xxhash64("root", k))
    columns = ("node", "label", "prints", "shingles")
    large = F.col("n") > len(keys) * SET_TILE
    keyed = left.where(~large).select(F.col("root").alias("key"), *columns).union(
        left.where(large).select(F.explode(by_key).alias("key"), *columns)
    )
    # Written, since it is counted and then dealt.
    more = _dealt(stage(keyed), SET_TILE).mapInArrow(_set_linker(radius, lanes, similarity), "a bigint, b bigint")
    return stars.union(more)


# Production settings of the filter: five-word shingles, texts that share 0.8 of them or more.
DEDUP_WORDS = 5
DEDUP_LANES = 4
DEDUP_SIMILARITY = 0.8
DEDUP_RECALL = 0.9
DEDUP_KEY_BITS = 18
DEDUP_DEVIATIONS = 3.0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
          similarity: float = DEDUP_SIMILARITY, words: int = DEDUP_WORDS,
          lanes: int = DEDUP_LANES, recall: float = DEDUP_RECALL,
          key_bits: int = DEDUP_KEY_BITS, deviations: float = DEDUP_DEVIATIONS) -> DataFrame:
    """Rows of ``docs`` without those that have a near-duplicate with a smaller key.

    Long fingerprints bring texts together that may be near; the radius is the distance expected
    at ``similarity`` and ``deviations`` more. Links count between texts that share ``similarity``
    of their shingles: of each key the forest of the nearest links is looked at, then all pairs
    that the true ones of these leave apart. ``recall`` is the
    chance that a pair just at this similarity meets in one of the keys of ``key_bits`` bits; more
    similar pairs meet almost surely. Keys and radius do not depend on the table. Of repeated rows
    and of rows with equal keys one stays.
    """
    columns = docs.columns
    marked = stage(
        docs.withColumn("__prints", fingerprints(F.col(text), words, lanes)).withColumn(
            "__row", F.monotonically_increasing_id()
        )
    )
    bits = 64 * lanes
    narrow = marked.select(
        F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("__row").alias("row")).alias("__order"),
        F.col("__prints").alias("prints"),
    )
    texts = marked.select(
        node_of("__prints", lanes).alias("node"), F.col("__row").alias("row"), F.col(text).alias("text")
    )
    radius, keys = wide_radius(bits, similarity, deviations), sampled_keys(key_bits, bits, similarity, recall)

    def confirm(links: DataFrame, nodes: DataFrame) -> DataFrame:
        return confirmed(links, texts, words, similarity, nodes, radius, keys, lanes)

    classed = classes(narrow, "__order", radius, keys, lanes=lanes, out="__first", confirm=confirm)
    kept = classed.where("__order = __first").select(F.col("__order.row").alias("__row"))
    return marked.join(kept, "__row", "left_semi").select(*columns)
