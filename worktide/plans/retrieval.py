"""Chunks, exact vector search, keyword tiers and their merge."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.functions.splitting import split
from worktide.operators.computed import computed
from worktide.operators.ordered import top_k
from worktide.operators.staging import stage

DIGITS = 9
# Numbers of a product that are held at once (8 MB).
CELLS = 1 << 20


# ---- chunking -----------------------------------------------------------


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of fixed stride over the whole text, numbered from 0."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")
    return (
        docs.where(F.length(text) > 0)
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"), (last + 1).alias("chunk_total"))
        .withColumn(
            "chunk", F.substring(F.col(text), F.col("chunk_index") * stride + 1, F.lit(size))
        )
        .withColumn("chunk_id", chunk_id(F.col(key).cast("string"), F.col("chunk_index")))
        .drop(text)
    )


def recursive_chunks(
    docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200
) -> DataFrame:
    """Chunks cut at paragraph, line, word or character, numbered from 0."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, size, overlap) if t else [])

    return (
        docs.withColumn("__chunks", cut(F.col(text)))
        .select(
            *[c for c in docs.columns if c != text],
            F.size("__chunks").alias("chunk_total"),
            # The plain form would test for empty lists by a second run of the function.
            F.posexplode_outer("__chunks").alias("chunk_index", "chunk"),
        )
        .where("chunk_index is not null")
        .withColumn("chunk_id", chunk_id(F.col(key).cast("string"), F.col("chunk_index")))
    )


def chunk_id(agreement: Column, index: Column) -> Column:
    """``agreement_0001``; numbers beyond four digits stay whole."""
    number = (index + 1).cast("string")
    return F.concat(
        agreement, F.lit("_"), F.when(index < 9999, F.lpad(number, 4, "0")).otherwise(number)
    )


def ingest_totals(chunks: DataFrame, file: str, chunk: str = "chunk") -> DataFrame:
    """Chunks and characters per file, with a total row."""
    per_file = chunks.groupBy(file).agg(
        F.count("*").alias("chunks"), F.sum(F.length(chunk)).alias("chars")
    )
    return per_file.rollup(file).agg(
        F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"), F.count("*").alias("files")
    )


# ---- embedding ----------------------------------------------------------


class RateLimited(Exception):
    """Raised by a batch function that wants to be called again later."""

    def __init__(self, wait: float = 60.0):
        super().__init__(f"retry in {wait} s")
        self.wait = wait


def embed(
    chunks: DataFrame,
    make_model: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
    text: str = "chunk",
    title: str = "title",
    out: str = "vector",
    batch: int = 50,
    retries: int = 5,
) -> DataFrame:
    """Vectors by an injected batch function, with a count check and bounded retries."""

    def make_predict() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = make_model()

        def predict(texts: np.ndarray, titles: np.ndarray) -> np.ndarray:
            for attempt in range(retries + 1):
                try:
                    vectors = np.asarray(model(list(texts), list(titles)), dtype=np.float32)
                    break
                except RateLimited as limited:
                    if attempt == retries:
                        raise
                    time.sleep(limited.wait)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
            return vectors

        return predict

    run = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch
    )
    return chunks.withColumn(out, run(F.col(text), F.col(title)))


def digest_model() -> Callable[[], Callable[[list[str], list[str]], np.ndarray]]:
    """Model for tests whose vectors any engine can recompute: the MD5 bytes of title and text."""

    def make() -> Callable[[list[str], list[str]], np.ndarray]:
        from hashlib import md5

        def run(texts: list[str], titles: list[str]) -> np.ndarray:
            digests = [md5(f"{a}\n{b}".encode()).digest() for a, b in zip(titles, texts, strict=True)]
            return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16) / 255

        return run

    return make


def hashing_model(dims: int = 64) -> Callable[[], Callable[[list[str], list[str]], np.ndarray]]:
    """Deterministic model for tests: unit vectors of hashed words."""

    def make() -> Callable[[list[str], list[str]], np.ndarray]:
        from zlib import crc32

        def run(texts: list[str], titles: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float64)
            for row, (text, title) in enumerate(zip(texts, titles)):
                for word in f"{title} {text}".split():
                    code = crc32(word.encode())
                    out[row, code % dims] += 1.0 if code & 0x10000 else -1.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return run

    return make


# ---- vector search ------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def nearest(corpus: DataFrame, query: Sequence[float], k: int, vector: str = "vector") -> DataFrame:
    """One query: each partition keeps k rows, nothing is shuffled."""
    given = F.array(*[F.lit(float(v)) for v in query])
    return (
        corpus.withColumn("distance", F.round(cosine_distance(F.col(vector), given), DIGITS))
        .orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
        .limit(k)
    )


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a fixed-length list column, scaled to unit length."""
    flat = column.combine_chunks()
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return unit(values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1))


def top_places(
    queries: np.ndarray, corpus: np.ndarray, k: int, limit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, rounded distance) of the k nearest corpus rows of each query, ties to the
    lower place; rows farther than the query's ``limit`` are left out.

    Queries go in slices, so that no more than about ``CELLS`` distances are held at once, however
    large the blocks are and however many rows are equally near.
    """
    keep = min(k, len(corpus))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, CELLS // max(1, len(corpus)))
    for start in range(0, len(queries) if keep else 0, step):
        table = 1.0 - queries[start : start + step] @ corpus.T
        if limit is not None and np.isfinite(own := limit[start : start + step]).all():
            # Limits are rounded; a distance may round down to one.
            rows, cols = np.nonzero(table <= own[:, None] + 10.0**-DIGITS)
            distance = np.round(table[rows, cols], DIGITS)
            near = distance <= own[rows]
            rows, cols, distance = rows[near], cols[near], distance[near]
        else:
            table = np.round(table, DIGITS)
            bound = np.partition(table, keep - 1, axis=1)[:, keep - 1 : keep]
            rows, cols = np.nonzero(table <= bound)
            distance = table[rows, cols]
        order = np.lexsort((cols, distance, rows))
        rows, cols, distance = rows[order], cols[order], distance[order]
        inside = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
        found.append((rows[inside] + start, cols[inside], distance[inside]))
    rows, cols, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, cols, distance


def _by_group(rows: pa.Table) -> dict[str, pa.Table]:
    """Rows of a tile by group; most tiles hold one."""
    rows = rows.sort_by("__group")
    names = rows["__group"].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
    ends = [*starts[1:], len(names)]
    return {names[a]: rows.slice(a, b - a) for a, b in zip(starts, ends, strict=True)}


def _block_top_k(k: int, out: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Top k of one query block against one corpus block by a matrix product per group."""

    def product(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        corpus = corpus.sort_by("chunk_id")
        rows, cols, distance = top_places(_matrix(queries["vector"]), _matrix(corpus["vector"]), k)
        return pa.table(
            [
                queries["query_id"].combine_chunks().take(pa.array(rows)),
                corpus["chunk_id"].combine_chunks().take(pa.array(cols)),
                pa.array(distance, pa.float64()),
            ],
            names=out.names,
        ).cast(out)

    def search(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        known = _by_group(corpus)
        found = [
            product(rows, known[group]) for group, rows in _by_group(queries).items() if group in known
        ]
        return pa.concat_tables([out.empty_table(), *found])

    return search


def _blocks(rows: DataFrame, on: Sequence[str], block_bytes: int, names: tuple[str, str]) -> DataFrame:
    """Number of blocks per group, by the bytes of its vectors, and the bytes; a row per group."""
    size = F.count("*") * F.max(F.size("vector")) * 4
    return rows.groupBy(*on).agg(
        F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("int").alias(names[0]),
        size.alias(names[1]),
    )


def _packer(size: int, out: pa.Schema, by: str | None) -> Callable:
    """Rows to packs of about ``size`` bytes of vectors; equal ``by`` that follow each other stay together
    up to four times that."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        columns = []
        for field in out:
            column = pa.concat_arrays(rows[field.name].chunks)
            if field.name == "vector":
                if column.null_count:
                    raise ValueError("a row has no vector")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                columns.append(pa.array([flat.tobytes()], pa.binary()))
            else:
                ends = pa.array([0, len(column)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, column).cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            width = max(1, len(held[0]["vector"].flatten()) // held[0].num_rows)
            count = max(1, size // (4 * width))
            if sum(p.num_rows for p in held) < count:
                continue
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= count:
                cut = count
                if by:
                    names = rows[by].slice(0, 4 * count).to_numpy()
                    later = np.flatnonzero(names[count:] != names[count - 1 : -1])
                    if not len(later) and len(names) < 4 * count:
                        break
                    cut = count + int(later[0]) if len(later) else count
                yield pack(rows.slice(0, cut))
                rows = rows.slice(cut)
            held = rows.to_batches()
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def packed(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """A written table with a row per pack of rows: a list per column, the vectors as bytes."""
    fields = [
        T.StructField(f.name, T.BinaryType() if f.name == "vector" else T.ArrayType(f.dataType))
        for f in rows.schema
    ]
    schema = T.StructType(fields)
    packs = rows.mapInArrow(_packer(size, to_arrow_schema(schema), by), schema)
    # A pack is large, so a few of them make a task.
    spread = rows.sparkSession.sparkContext.defaultParallelism
    return stage(packs.repartition(spread))


class Asked:
    """A pack of queries with the nearest rows found so far."""

    def __init__(self, columns: dict[str, pa.Array], rows: np.ndarray, k: int):
        self.columns, self.rows, self.k = columns, rows, k
        given = columns.get("limit")
        limit = np.full(len(rows), np.inf)
        if given is not None:
            limit = np.asarray(given.fill_null(np.inf), np.float64).copy()
        # No farther row can be among the nearest.
        self.limit = limit
        self.best: pa.Table | None = None
        self.seen = 0

    def add(self, rows: np.ndarray, ids: pa.Array, distance: np.ndarray) -> None:
        best = pa.table([pa.array(rows), ids, pa.array(distance)], names=["row", "chunk_id", "distance"])
        if self.best is not None:
            best = pa.concat_tables([self.best, best])
        order = pc.sort_indices(
            best, sort_keys=[(c, "ascending") for c in ("row", "distance", "chunk_id")], null_placement="at_start"
        )
        best = best.take(order)
        at, distance = best["row"].to_numpy(), best["distance"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.best = best.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.limit[at[last]] = np.minimum(self.limit[at[last]], distance[last])


Search = Callable[[Asked, dict[str, pa.Array], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def nearest_of_all(asked: Asked, columns: dict[str, pa.Array], rows: np.ndarray):
    """Every query meets every row of the pack."""
    asked.seen += len(asked.rows)
    return top_places(asked.rows, rows, asked.k, asked.limit)


def _pair_top_k(k: int, search: Search, out: pa.Schema) -> Callable:
    """Pairs of packs to the k nearest rows of each query; queries of a few packs are held."""

    def columns(part: pa.RecordBatch, at: int, side: str) -> tuple[dict[str, pa.Array], np.ndarray]:
        own = {n.removeprefix(side): part[n] for n in part.schema.names if n.startswith(side)}
        flat = np.frombuffer(own.pop("vector")[at].as_py(), "<f4").astype(np.float64)
        lists = {n: column[at].values for n, column in own.items() if n != "pack"}
        count = len(next(iter(lists.values())))
        return lists, unit(flat.reshape(count, -1))

    def results(held: dict[int, Asked]) -> Iterator[pa.RecordBatch]:
        for asked in held.values():
            none = [None]
            if asked.best is not None:
                best = asked.best.combine_chunks()
                ids = asked.columns["query_id"].take(pa.concat_arrays(best["row"].chunks or [pa.array([], pa.int64())]))
                yield from pa.table(
                    [ids, best["chunk_id"], best["distance"], pa.nulls(best.num_rows, pa.int64())], names=out.names
                ).cast(out).to_batches()
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, f.type) for f in list(out)[:3]] + [pa.array([asked.seen], pa.int64())], schema=out
            )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Asked] = {}
        for part in parts:
            for at in range(part.num_rows):
                pack = part["q_pack"][at].as_py()
                if pack not in held:
                    if sum(len(x.rows) for x in held.values()) >= 1 << 14:
                        yield from results(held)
                        held = {}
                    held[pack] = Asked(*columns(part, at, "q_"), k)
                asked = held[pack]
                lists, rows = columns(part, at, "c_")
                if "block" not in lists:
                    # Ties go to the lower id.
                    order = pc.array_sort_indices(lists["chunk_id"], null_placement="at_start")
                    lists = {n: x.take(order) for n, x in lists.items()}
                    rows = rows[order.to_numpy()]
                found, places, distance = search(asked, lists, rows)
                if len(found):
                    asked.add(found, lists["chunk_id"].take(pa.array(places)), distance)
        yield from results(held)

    return run


def pairs_top_k(queries: DataFrame, corpus: DataFrame, k: int, search: Search = nearest_of_all) -> DataFrame:
    """k nearest rows (query_id, chunk_id, distance) per query and task, from tables of packs; rows without
    distance hold in ``seen`` how many places the queries of a pack were compared with.

    Every pack of queries meets every pack of the corpus in some task. Packs are read from their
    written tables, so of all pairs nothing is shuffled but results; a task holds a few packs.
    """
    spark = queries.sparkSession
    n = queries.count()
    total = corpus.agg(F.count("*").alias("n"), F.sum(F.length("vector")).alias("bytes")).first()
    # Results are k rows per query and part of the corpus: as few parts as memory and tasks allow.
    parts = max(-(-(total.bytes or 0) // (1 << 26)), -(-2 * spark.sparkContext.defaultParallelism // max(1, n)))
    left = queries.withColumn("pack", F.monotonically_increasing_id())
    left = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns])
    right = corpus.select(*[F.col(c).alias(f"c_{c}") for c in corpus.columns])
    kinds = [queries.schema["query_id"].dataType.elementType, corpus.schema["chunk_id"].dataType.elementType]
    schema = T.StructType(
        [
            T.StructField("query_id", kinds[0]),
            T.StructField("chunk_id", kinds[1]),
            T.StructField("distance", T.DoubleType()),
            T.StructField("seen", T.LongType()),
        ]
    )
    pairs = left.crossJoin(right.coalesce(max(1, min(parts, total.n))))
    return pairs.mapInArrow(_pair_top_k(k, search, to_arrow_schema(schema)), schema)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    on: Sequence[str] = (),
    query_bytes: int = 1 << 19,
    corpus_bytes: int = 1 << 21,
) -> DataFrame:
    """Exact k nearest chunks per query within equal ``on`` values.

    ``queries`` holds query_id, vector and ``on``; ``corpus`` chunk_id, vector
    and ``on``. Both sides are cut into blocks of bounded size, however large a
    group is; a task multiplies one query block with one corpus block and
    returns k rows per query, so pairs never leave a task. Groups of one block
    share a tile with others of their kind. Without ``on`` blocks are read from
    written tables instead of copied through a shuffle. Vectors travel as single
    floats. Ties go to the lower chunk id.
    """
    on = list(on)
    # Fresh columns on one side: both may come from the same table.
    single = F.col("vector").cast("array<float>").alias("vector")
    queries = queries.select("query_id", single, *on)
    corpus = corpus.select(F.col("chunk_id").alias("chunk_id"), single, *[F.col(c).alias(c) for c in on])
    if not on:
        found = pairs_top_k(packed(queries, query_bytes), packed(corpus, corpus_bytes), k)
        found = found.where("distance is not null").drop("seen")
        return top_k(found, ["query_id"], nearest_order(), k)
    sizes = _blocks(queries, on, query_bytes, ("__nq", "__qs")).join(
        _blocks(corpus, on, corpus_bytes, ("__nc", "__cs")), on
    )
    group = F.to_json(F.struct(*[F.col(c) for c in on]))
    sizes = stage(sizes.withColumn("__group", group))
    small = (F.col("__nq") == 1) & (F.col("__nc") == 1)
    total = sizes.where(small).agg(F.sum(F.col("__qs") + F.col("__cs"))).first()[0]
    shared = max(1, -(-(total or 0) // (query_bytes + corpus_bytes)))
    name = F.when(small, F.pmod(F.xxhash64("__group"), F.lit(shared)).cast("string"))
    sizes = sizes.withColumn("__tile", F.coalesce(name, F.col("__group"))).drop("__qs", "__cs")

    def tiles(rows: DataFrame, key: str, own: str, other: str, own_block: str, other_block: str):
        # Fresh columns: the sizes are joined to both sides.
        fresh = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])
        return (
            rows.join(fresh, on)
            .withColumn(own_block, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select(key, "vector", "__group", "__tile", own_block, other_block)
        )

    left = tiles(queries, "query_id", "__nq", "__nc", "__qb", "__cb")
    right = tiles(corpus, "chunk_id", "__nc", "__nq", "__cb", "__qb")
    tile = ["__tile", "__qb", "__cb"]
    id_types = {f.name: f.dataType for f in (*queries.schema.fields, *corpus.schema.fields)}
    schema = T.StructType(
        [
            T.StructField("query_id", id_types["query_id"]),
            T.StructField("chunk_id", id_types["chunk_id"]),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    found = (
        left.groupBy(*tile)
        .cogroup(right.groupBy(*tile))
        .applyInArrow(_block_top_k(k, to_arrow_schema(schema)), schema)
    )
    return top_k(found, ["query_id"], nearest_order(), k)


def nearest_order() -> list[Column]:
    return [F.col("distance").asc_nulls_last(), F.col("chunk_id").asc()]


# ---- keyword tiers ------------------------------------------------------


def tier_hits(
    chunks: DataFrame,
    exact: Sequence[str],
    headers: Sequence[str],
    cap: int,
    weights: dict[str, int] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Best keyword chunks of each file: exact hits, then header hits.

    Inside a tier the higher weight comes first, then the lower index. The hits
    do not depend on the question, so they are found once per file and joined
    to any number of questions later.
    """
    family = {"hits": (exact, headers, cap, weights or {})}
    return tier_families(chunks, family, keep).drop("family")


def tier_families(
    chunks: DataFrame, families: Mapping[str, tuple], keep: Sequence[str] = ()
) -> DataFrame:
    """:func:`tier_hits` for several word families (exact, headers, cap, weights) by name; each
    text is read and folded once."""
    rows = chunks.select("file_name", "chunk_id", "chunk_index", *keep, "text")
    rows = computed(rows, {"__norm": tx.normalize(F.col("text"))}).drop("text")
    found = [
        F.struct(
            F.lit(name).alias("family"),
            F.lit(cap).alias("__cap"),
            rules.tier(F.col("__norm"), exact, headers).alias("tier"),
            rules.weighted_score(F.col("__norm"), weights).alias("score"),
        )
        for name, (exact, headers, cap, weights) in families.items()
    ]
    hits = rows.select(
        "file_name", "chunk_id", "chunk_index", *keep, F.inline(F.array(*found))
    ).where("tier is not null")
    most = max(cap for _, _, cap, _ in families.values())
    best = top_k(hits, ["family", "file_name"], tier_order(), most, "__r")
    return best.where("__r <= __cap").drop("__r", "__cap")


def tier_order() -> list[Column]:
    return [
        F.col("tier").asc(), F.col("score").desc(), F.col("chunk_index").asc_nulls_last(),
        F.col("chunk_id").asc(),
    ]


def keyword_chunks(
    refs: DataFrame, hits: DataFrame, cap: int, by_index: bool = False
) -> DataFrame:
    """Hits of the files each question refers to, best ``cap``, with their place.

    ``refs`` holds (query_id, file_name). ``by_index`` puts the chosen chunks
    back into reading order.
    """
    chosen = top_k(refs.join(hits, "file_name"), ["query_id"], tier_order(), cap, "place")
    if by_index:
        reading = Window.partitionBy("query_id").orderBy(
            F.col("chunk_index").asc_nulls_last(), "chunk_id"
        )
        chosen = chosen.withColumn("place", F.row_number().over(reading))
    return chosen.select("query_id", "chunk_id", "place")


def merge_ranked(lists: Sequence[DataFrame], cap: int) -> DataFrame:
    """Ranked lists one after another; the first occurrence stays, ``cap`` rows at most."""
    tagged = [
        r.select("query_id", "chunk_id", F.struct(F.lit(i).alias("list"), "place").alias("at"))
        for i, r in enumerate(lists)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    once = union.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    return top_k(once, ["query_id"], [F.col("at").asc(), F.col("chunk_id").asc()], cap, "rank")


def names_in_order(ranked: DataFrame, name: str = "file_name") -> DataFrame:
    """Distinct names per question in first-seen order."""
    firsts = ranked.groupBy("query_id", name).agg(F.min("rank").alias("__r"))
    seen = Window.partitionBy("query_id").orderBy("__r")
    return firsts.withColumn("position", F.row_number().over(seen)).drop("__r")


def sources(base: DataFrame, specific: DataFrame, statute: DataFrame) -> DataFrame:
    """Source rows of an answer with a tag telling where they come from."""
    return (
        base.withColumn("source", F.lit("base"))
        .unionByName(specific.withColumn("source", F.lit("especifica")), allowMissingColumns=True)
        .unionByName(statute.withColumn("source", F.lit("base_local")), allowMissingColumns=True)
    )


BASE_LABEL, SPECIFIC_LABEL = "NORMA BASE - ESTATUTO", "NORMA ESPECÍFICA - CONVENIO"


def context(ranked: DataFrame) -> DataFrame:
    """Context text per question from (query_id, source, rank, file_name, text).

    A question has at most twelve chunks here, so the lists are short.
    """
    def chunks(source: str) -> Column:
        return F.array_sort(
            F.collect_list(
                F.when(F.col("source") == source, F.struct("rank", "file_name", "text"))
            )
        )

    lists = ranked.groupBy("query_id").agg(
        chunks("base").alias("base"), chunks("especifica").alias("specific")
    )

    def block(name: str, label: str) -> Column:
        return F.when(F.size(name) > 0, tx.context_block(F.col(name), label))

    return lists.select(
        "query_id",
        F.concat_ws(
            "\n\n===\n\n", block("base", BASE_LABEL), block("specific", SPECIFIC_LABEL)
        ).alias("context"),
    )


def redacted(chunks: Column) -> Column:
    """Diagnostic view of a chunk list: file and distance only."""
    return F.transform(
        chunks, lambda c: F.struct(c["file_name"].alias("file_name"), c["distance"].alias("distance"))
    )


def leave_hits(chunks: DataFrame, cap: int = 5) -> DataFrame:
    return tier_hits(chunks, lx.LEAVE_EXACT, lx.LEAVE_HEADERS, cap)
