"""Exact nearest neighbours that look only at blocks which may still win.

Unit vectors lie on a sphere, where angles are distances that obey the triangle inequality. Pivots
are the means of groups of a bounded sample. Every vector belongs to the cell of its nearest pivot,
and a cell is cut into rings, blocks of bounded size by the angle to the pivot. A block at angles
from ``low`` to ``high`` around a pivot holds nothing nearer to a query than

    max(low - a, a - high, 0), where a is the angle between the query and the pivot.

The first round searches, for each query, the block with the smallest bound around its nearest
pivot. The k-th angle found there is a limit, and the second round searches only the blocks whose
bound does not exceed it. The limit carries a slack for rounded distances, so results, ties
included, are those of a search of everything.

Vectors of length zero have no angle: as rows they form a cell of their own that every query
searches, as queries they search all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from worktide.operators.ordered import top_k
from worktide.operators.staging import stage
from worktide.plans import retrieval as rt

PIVOTS = 64
# Rows from which pivots are made; any pivots give exact results.
SAMPLE = 4096
BLOCK_BYTES = 1 << 21
QUERY_BYTES = 1 << 19
# Angle that a distance rounded to nine digits may hide: the square root of twice the rounding.
SLACK = 1e-4


def pivots(corpus: DataFrame, count: int = PIVOTS, sample: int = SAMPLE, rounds: int = 4) -> np.ndarray:
    """Means of ``count`` groups of a bounded sample, by the rows' hashes, as unit vectors."""
    some = corpus.select("vector").orderBy(F.xxhash64("chunk_id")).limit(sample).collect()
    rows = np.array([r.vector for r in some], np.float64)
    if not len(rows):
        return np.zeros((0, 0))
    rows = rt.unit(rows[np.abs(rows).sum(axis=1) > 0])
    means = rows[:count].copy()
    for _ in range(rounds if len(rows) > count else 0):
        own = np.argmax(rows @ means.T, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, rows)
        full = np.abs(sums).sum(axis=1) > 0
        means[full] = rt.unit(sums[full])
    return means


def _rows(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return rt.unit(flat.reshape(len(column), width))


def _placed(means: np.ndarray, cells: np.ndarray) -> Callable:
    """The nearest pivot's cell and the angle to it; cell -1 without direction."""

    def place(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = _rows(part, means.shape[1])
            near = rows @ means.T
            best = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), best], -1, 1))
            empty = np.abs(rows).sum(axis=1) == 0
            yield pa.StructArray.from_arrays(
                [pa.array(np.where(empty, -1, cells[best]), pa.int32()), pa.array(np.where(empty, 0.0, angle))],
                ["cell", "angle"],
            )

    place.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return place


def placed(rows: DataFrame, means: np.ndarray, cells: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``angle``."""
    if not len(cells):
        # Nothing has a direction: one cell, which every query searches.
        return rows.select("*", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
    place = F.arrow_udf(_placed(means, cells), "cell int, angle double")
    return rows.select("*", place("vector").alias("__at")).select(*rows.columns, "__at.*")


class Index:
    """Cells and rings of a corpus of (chunk_id, vector), written to the shared folder."""

    def __init__(self, corpus: DataFrame, count: int = PIVOTS, block_bytes: int = BLOCK_BYTES,
                 sample: int = SAMPLE):
        single = F.col("vector").cast("array<float>").alias("vector")
        rows = corpus.select("chunk_id", single)
        self.means = pivots(rows, count, sample)
        self.kind = rows.schema["chunk_id"].dataType
        held = stage(placed(rows, self.means, np.arange(len(self.means))))
        size = F.count("*") * F.max(F.size("vector")) * 4
        number = F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("int")
        cells = held.groupBy("cell").agg(number.alias("rings"))
        # Cuts between the rings of a cell; a cell of equal angles is cut by hash as well.
        steps = cells.select(
            "cell", "rings", F.explode(F.sequence(F.lit(0), F.col("rings") - 1)).alias("ring")
        )
        ends = held.groupBy("cell").agg(
            F.percentile_approx("angle", [i / 256 for i in range(1, 256)], 4096).alias("quantiles")
        )
        cuts = steps.where("ring > 0").join(ends, "cell").groupBy("cell").agg(
            F.array_sort(F.collect_set(F.element_at(
                "quantiles", F.greatest(F.lit(1), F.ceil(256 * F.col("ring") / F.col("rings")).cast("int") - 1)
            ))).alias("cuts")
        )
        dealt = held.join(cells, "cell").join(cuts, "cell", "left")
        ring = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("angle"))), F.lit(0))
        dealt = dealt.withColumn("ring", F.when(F.col("cuts").isNull(), 0).otherwise(ring))
        groups = dealt.groupBy("cell", "ring").agg(number.alias("parts"))
        part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
        # Rings are at most as many as quantiles, 256.
        block = (
            F.shiftleft((F.col("cell") + 1).cast("bigint"), 48) + F.shiftleft(F.col("ring").cast("bigint"), 40)
            + F.col("part")
        )
        self.rows = stage(
            dealt.drop("rings", "cuts").join(groups, ["cell", "ring"]).withColumn("part", part)
            .select(block.alias("block"), "cell", "angle", "chunk_id", "vector")
        )
        self.blocks = stage(
            self.rows.groupBy("block", "cell").agg(
                F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")
            )
        )

        # Cells that hold rows, at most one more than pivots.
        full = np.array(sorted(r.cell for r in self.blocks.select("cell").distinct().collect()), np.int64)
        self.cells = full[full >= 0]

    def packs(self, size: int) -> DataFrame:
        """Written packs of rows, blocks in order."""
        near = self.rows.repartitionByRange("block").sortWithinPartitions("block")
        return rt.packed(near, size, by="block")


def _search(index: Index, pairs: DataFrame, k: int, query_bytes: int) -> DataFrame:
    """Best k rows of each (query_id, vector, block); a block's queries are cut into parts of bounded
    size."""
    counts = pairs.groupBy("block").agg(F.count("*").alias("queries"))
    width = pairs.select(F.max(F.size("vector"))).first()[0] or 1
    parts = F.greatest(F.lit(1), F.ceil(F.col("queries") * width * 4 / query_bytes)).cast("int")
    counts = counts.select("block", parts.alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
    left = pairs.join(counts, "block").select("block", part, "query_id", "vector", F.lit("").alias("__group"))
    right = index.rows.join(counts.withColumnRenamed("block", "of"), F.col("block") == F.col("of")).select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk_id", "vector",
        F.lit("").alias("__group"),
    )
    schema = index.rows.select("chunk_id").schema
    schema = pairs.select("query_id").schema.add(schema["chunk_id"]).add("distance", "double")
    return (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(rt._block_top_k(k, to_arrow_schema(schema)), schema)
    )


def _open_blocks(means: np.ndarray) -> rt.Search:
    """Queries meet the blocks of a pack that may hold a row within their limits."""

    def search(asked: rt.Asked, columns: dict[str, pa.Array], rows: np.ndarray):
        if not hasattr(asked, "angles"):
            asked.start = np.asarray(asked.columns["start"].fill_null(-1))
            asked.empty = np.abs(asked.rows).sum(axis=1) == 0
            if len(means):
                asked.angles = np.arccos(np.clip(asked.rows @ means.T, -1, 1))
            else:
                asked.angles = np.zeros((len(asked.rows), 0))
        block, cell, angle = (np.asarray(columns[c]) for c in ("block", "cell", "angle"))
        reach = np.arccos(np.maximum(-1.0, 1 - np.minimum(asked.limit, 2.0))) + SLACK
        reach[~np.isfinite(asked.limit)] = np.inf
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        found = []
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            open_ = asked.start != block[a]
            # Rows and queries without direction are near everything.
            if cell[a] >= 0:
                own = asked.angles[:, cell[a]]
                bound = np.maximum(angle[a:b].min() - own, own - angle[a:b].max())
                open_ &= (bound <= reach) | asked.empty
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            asked.seen += len(at)
            ids = columns["chunk_id"].slice(a, b - a)
            order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
            near, place, distance = rt.top_places(asked.rows[at], rows[a:b][order], asked.k, asked.limit[at])
            found.append((at[near], a + order[place], distance))
        if not found:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return search


def knn(queries: DataFrame, index: Index, k: int, query_bytes: int = QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Exact k nearest rows per query (query_id, chunk_id, distance, rank), ties to the lower chunk
    id, and one row with the (query, block) pairs ``visited`` and ``all_pairs``.

    Which blocks a query meets is decided where its pack meets theirs, so no table of (query, block)
    pairs is made; shuffled are queries, the first round's block of each and results.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    asked = placed(asked, index.means[index.cells], index.cells)
    # Query ids may repeat; each row is searched for itself.
    asked = stage(asked.withColumn("row", F.monotonically_increasing_id()))
    apart = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high"), F.lit(0.0))
    start = stage(
        asked.select("row", "cell", "angle").join(index.blocks, "cell")
        .groupBy("row").agg(F.min_by("block", F.struct(apart.alias("bound"), "block")).alias("start"))
    )
    pairs = asked.select(F.col("row").alias("query_id"), "row", "vector").join(start, "row")
    pairs = pairs.select("query_id", "vector", F.col("start").alias("block"))
    first = stage(_search(index, pairs, k, query_bytes).withColumnRenamed("query_id", "row"))
    found = first.groupBy("row").agg(F.count("*").alias("n"), F.max("distance").alias("limit"))
    found = found.select("row", F.when(F.col("n") >= k, F.col("limit")).alias("limit"))
    known = asked.join(start, "row", "left").join(found, "row", "left")
    near = known.select("query_id", "vector", "start", "limit", "cell", "angle")
    near = near.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
    packs = rt.packed(near.drop("cell", "angle"), query_bytes)
    second = stage(
        rt.pairs_top_k(packs, index.packs(max(BLOCK_BYTES, query_bytes)), k, _open_blocks(index.means))
    )
    named = first.join(asked.select("row", "query_id"), "row").select("query_id", "chunk_id", "distance")
    later = second.where("distance is not null").select("query_id", "chunk_id", "distance")
    best = top_k(named.unionByName(later), ["query_id"], rt.nearest_order(), k)
    visits = second.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("later")).crossJoin(
        start.agg(F.count("*").alias("first"))
    ).crossJoin(asked.agg(F.count("*").alias("asked"))).crossJoin(index.blocks.agg(F.count("*").alias("blocks")))
    return best, visits.select(
        (F.col("first") + F.col("later")).alias("visited"), (F.col("asked") * F.col("blocks")).alias("all_pairs")
    )
