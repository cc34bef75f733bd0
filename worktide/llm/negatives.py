"""Hard negatives by Fagin's threshold algorithm.

Vectors have integer components and are dealt into blocks of bounded size. A block keeps, for every
dimension, the list of its rows sorted by that component. For an anchor, each list is read from the
end that the sign of the anchor's component favours; rows met on any list are scored in full by
random access to their integers. After every round the threshold, the score that a row at the depth
reached on all lists would have, bounds every row not met yet. A block is done as soon as the
threshold falls strictly below the k-th best score of each window (below a window's lower end where
that is higher); strictly, since a row with an equal score and a smaller id would still count.

Anchors are a stated query set and meet all blocks, in blocks of their own. The first pass finds each
anchor's best rows of its label (the positives, a window without ends); the second, for each positive,
the best rows of other labels with a score in the window that the positive's score sets. A block
returns at most k rows per window, whose best k over all blocks are the result.

Defined results: rows with a null label, a null vector, or a null, infinite or not-a-number
component take no part; a shorter vector counts as filled with zeros; of rows with one id each counts
for itself, an anchor too, and a row is never its own positive; null ids come last among ties and are
no anchors; an anchor without positives, or a positive without rows in its window, has no rows; an
empty table gives an empty result. Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.operators.ordered import top_k
from worktide.operators.staging import stage

POSITIVES = 5
NEGATIVES = 5
# A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 80, 100
BLOCK_ROWS = 1 << 13
ANCHOR_ROWS = 256
# Blocks of anchors that a task holds while it reads blocks of rows.
HELD = 8
# Depth of the first round on the sorted lists; later rounds go twice as deep.
DEPTH = 16

ROW_DDL = "uid bigint, id bigint, label int, vector array<bigint>"


def prepared(rows: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """Rows that take part: uid, id, label and the integer vector."""
    x = F.col(vector)
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    )
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("bigint"))
    return rows.where(label.isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(key).cast("bigint").alias("id"),
        label.cast("int").alias("label"),
        whole.alias("vector"),
    )


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal width; shorter ones are filled with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


BLOCK_DDL = "block int, width int, uids binary, ids binary, labels binary, vectors binary, lists binary"


def _build(table: pa.Table) -> pa.Table:
    """One row for the rows of a block, with their sorted lists."""
    table = table.combine_chunks()
    # Null ids are the largest, so ties by id need no case of their own.
    ids = np.asarray(table.column("id").fill_null(np.iinfo(np.int64).max), np.int64)
    order = np.argsort(ids, kind="stable")
    vectors = _matrix(table.column("vector").combine_chunks())[order]
    lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32).T
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "width": pa.array([vectors.shape[1]], pa.int32()),
            "uids": pa.array([np.asarray(table.column("uid"), np.int64)[order].tobytes()], pa.binary()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "labels": pa.array([np.asarray(table.column("label"), np.int32)[order].tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "lists": pa.array([np.ascontiguousarray(lists).tobytes()], pa.binary()),
        }
    )


def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows each, whatever their labels; and the numbers in use."""
    numbers = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", _number("uid", numbers))
    return stage(dealt.groupBy("block").applyInArrow(_build, BLOCK_DDL)), numbers


def _number(uid: str, numbers: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(numbers)).cast("int")


class Lists:
    """A block: integer rows in the order of their ids, and one sorted list per dimension."""

    def __init__(self, row: dict, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.uids, self.ids, self.labels = get("uids", np.int64), get("ids", np.int64), get("labels", np.int32)
        width = row[prefix + "width"]
        self.vectors = get("vectors", np.int64).reshape(len(self.uids), width)
        # Products of doubles are whole and exact while sums stay below 2 to the 53rd.
        self.largest = int(max(abs(int(self.vectors.max(initial=0))), abs(int(self.vectors.min(initial=0)))))
        self.doubles = self.vectors.astype(np.float64)
        lists = row.get(prefix + "lists")
        self.lists = None if lists is None else np.frombuffer(lists, np.int32).reshape(width, len(self.uids))

    def search(self, anchor: np.ndarray, open_to: np.ndarray, lowest: np.ndarray, highest: np.ndarray,
               k: int, depth: int = DEPTH) -> tuple[list[np.ndarray], np.ndarray, int]:
        """Best ``k`` rows of every window [lowest, highest] among those that are ``open_to`` it,
        all scores, and the depth at which the threshold ended the search."""
        n = len(self.uids)
        used = np.flatnonzero(anchor[: self.vectors.shape[1]])
        weight = anchor[used]
        turned = weight > 0
        scores = np.zeros(n, np.int64)
        met = np.zeros(n, bool)
        if not len(used):
            # All lists are empty: every row scores zero.
            met[:] = True
            depth = n
        done = 0
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lowest)
        while True:
            depth = min(depth, n)
            # Sorted access: the next rows of each list, from the end that the anchor's sign favours.
            seen = np.where(
                turned[:, None], self.lists[used, n - depth : n - done], self.lists[used, done:depth]
            ) if len(used) else np.zeros((0, 0), np.int32)
            fresh = np.zeros(n, bool)
            fresh[seen.ravel()] = True
            fresh &= ~met
            rows = np.flatnonzero(fresh)
            # Random access: whole scores of the rows that are new.
            scores[rows] = self._score(rows, used, weight)
            met[rows] = True
            done = depth
            if len(used):
                last = np.where(turned, self.lists[used, n - depth], self.lists[used, depth - 1])
                threshold = int((self.vectors[last, used] * weight).sum())
            known = np.flatnonzero(met & open_to)
            ended = True
            for w, (low, high) in enumerate(zip(lowest.tolist(), highest.tolist(), strict=True)):
                inside = known[(scores[known] >= low) & (scores[known] <= high)]
                # Rows are in the order of their ids, so a stable sort settles ties.
                best[w] = inside[np.argsort(-scores[inside], kind="stable")[:k]]
                bound = scores[best[w][-1]] if len(best[w]) == k else low
                ended &= done >= n or threshold < max(int(bound), low)
            if ended or done >= n:
                return best, scores, done
            depth *= 2


    def _score(self, rows: np.ndarray, used: np.ndarray, weight: np.ndarray) -> np.ndarray:
        exact = self.largest * int(np.abs(weight).sum() if len(weight) else 0) < 1 << 53
        some = (self.doubles if exact else self.vectors)[rows]
        if len(used) < some.shape[1]:
            some = some[:, used]
        return (some @ weight.astype(some.dtype)).astype(np.int64)


QUERY = ("width", "uids", "ids", "labels", "vectors")


def _tiles(queries: DataFrame, corpus: DataFrame, homes: int, *more: str) -> DataFrame:
    """Every block of anchors with every block of rows.

    A task reads blocks of rows where they are written and meets them with ``HELD`` of the ``homes``
    blocks of anchors. No pair is shuffled, and none goes through the driver: copies of the anchors per
    block of rows look as small to the planner as the anchors, which it would broadcast.
    """
    wide = queries.select(*[F.col(c).alias(f"q_{c}") for c in (*QUERY, *more)])
    held = wide.repartition(-(-homes // HELD))
    return corpus.crossJoin(held.hint("shuffle_replicate_nl"))


FOUND_DDL = "anchor_uid bigint, anchor_id bigint, slot int, uid bigint, id bigint, score bigint"


def _found(anchors: Lists, block: Lists, hits: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    size = [len(rows) for *_, rows, _ in hits]
    at = np.repeat([a for a, *_ in hits], size).astype(np.int64)
    rows = np.concatenate([np.zeros(0, np.int64), *(r for *_, r, _ in hits)]).astype(np.int64)
    columns = [
        anchors.uids[at], anchors.ids[at], np.repeat([s for _, s, *_ in hits], size).astype(np.int32),
        block.uids[rows], block.ids[rows],
        np.concatenate([np.zeros(0, np.int64), *(s[r] for *_, r, s in hits)]).astype(np.int64),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], ["anchor_uid", "anchor_id", "slot", "uid", "id", "score"]
    )


_ENDS = np.iinfo(np.int64)


def _positives(k: int) -> Callable:
    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                anchors, block = Lists(row, "q_"), Lists(row)
                hits = []
                for a in range(len(anchors.uids)):
                    same = (block.labels == anchors.labels[a]) & (block.uids != anchors.uids[a])
                    ends = np.array([_ENDS.min]), np.array([_ENDS.max])
                    best, scores, _ = block.search(anchors.vectors[a], same, *ends, k)
                    hits.append((a, 0, best[0], scores))
                yield _found(anchors, block, hits)

    return find


def _negatives(k: int, lowest: int, highest: int) -> Callable:
    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                anchors, block = Lists(row, "q_"), Lists(row)
                windows: dict[int, list[tuple[int, int]]] = {}
                for w in row["q_windows"]:
                    windows.setdefault(w["anchor_uid"], []).append((w["slot"], w["score"]))
                hits = []
                for a, uid in enumerate(anchors.uids.tolist()):
                    own = windows.get(uid)
                    if not own:
                        continue
                    # lowest * p <= 100 * score <= highest * p, in whole numbers.
                    low = np.array([-(-lowest * p // 100) for _, p in own])
                    high = np.array([highest * p // 100 for _, p in own])
                    other = block.labels != anchors.labels[a]
                    best, scores, _ = block.search(anchors.vectors[a], other, low, high, k)
                    hits += [(a, slot, rows, scores) for (slot, _), rows in zip(own, best, strict=True)]
                yield _found(anchors, block, hits)

    return find


def _best(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("id"), F.asc("uid")]
    return top_k(found, ["anchor_uid", "slot"], order, k).withColumn("rank", F.col("rank").cast("int"))


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         lowest: int = LOWEST, highest: int = HIGHEST, block_rows: int = BLOCK_ROWS,
         anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the
    ``prepared`` rows; ``anchor`` says of a row whether it is one."""
    rows = stage(rows)
    corpus, _ = blocks(rows, block_rows)
    queries, homes = blocks(rows.where(anchor & F.col("id").isNotNull()), anchor_rows)
    met = _tiles(queries, corpus, homes).mapInArrow(_positives(positives), FOUND_DDL)
    best = _best(met, positives)
    # The rank of a positive, then its window, is a slot of its anchor.
    chosen = stage(best.select("anchor_uid", F.col("rank").alias("slot"), "id", "score"))
    window = F.struct("anchor_uid", "slot", "score")
    # At most so many windows per anchor, so a block's list is bounded.
    windows = chosen.groupBy(_number("anchor_uid", homes).alias("block")).agg(
        F.collect_list(window).alias("windows")
    )
    told = queries.join(windows, "block")
    near = _tiles(told, corpus, homes, "windows").mapInArrow(
        _negatives(negatives, lowest, highest), FOUND_DDL
    )
    positive = chosen.select(
        "anchor_uid", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        _best(near, negatives)
        .join(positive, ["anchor_uid", "slot"])
        .select(
            "anchor_id", _given("positive_id"), "rank", _given("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def _given(name: str) -> Column:
    """The id, null where a row has none."""
    return F.when(F.col(name) != _ENDS.max, F.col(name)).alias(name)


def brute_force(rows: list[tuple], positives: int = POSITIVES, negatives: int = NEGATIVES,
                lowest: int = LOWEST, highest: int = HIGHEST) -> list[tuple]:
    """The contract said plainly, for tests: rows are (id, label, integer vector, is anchor)."""

    def dot(a: list[int], b: list[int]) -> int:
        return sum(x * y for x, y in zip(a, b, strict=False))

    def ranked(anchor: tuple, others: list[tuple]) -> list[tuple]:
        last = float("inf")
        return sorted(
            ((-dot(anchor[2], o[2]), last if o[0] is None else o[0]) for o in others)
        )

    out = []
    for i, one in enumerate(rows):
        if not one[3] or one[0] is None:
            continue
        same = [o for j, o in enumerate(rows) if j != i and o[1] == one[1]]
        rest = ranked(one, [o for o in rows if o[1] != one[1]])
        for score, positive in ranked(one, same)[:positives]:
            inside = [r for r in rest if lowest * -score <= 100 * -r[0] <= highest * -score]
            for k, (found, negative) in enumerate(inside[:negatives]):
                ids = [None if x == float("inf") else x for x in (positive, negative)]
                out.append((one[0], ids[0], k + 1, ids[1], -score, -found))
    return out
