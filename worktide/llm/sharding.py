"""Shards of nearly equal size by longest-processing-time scheduling.

Rows that must stay together are a group. Groups, the largest first, go to the least loaded shard,
which a heap yields. So that the heap's work is bounded whatever the table's size, only groups
larger than a fixed share of all bytes are scheduled alone: there can be no more of them than that
share allows. The others are bundled by a hash into a fixed number of parcels, which are scheduled
like groups; no parcel is much larger than its share. Small tables have only groups of their own.

The plan of at most ``GROUPS + PARCELS`` rows is joined back; rows are numbered per shard through
counts of small buckets, so neither a hot group nor a shard is sorted in one task.

Defined results: null texts are one group and empty ones another; both have size 1; rows of equal
text, repeated rows included, share a shard; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.operators.ordered import ordinal
from worktide.operators.staging import stage

SHARDS = 16
# A group with more than one part in so many of all bytes is scheduled alone.
GROUPS = 16384
PARCELS = 4096
# Rows of a shard that are numbered in one task, about.
BUCKET_ROWS = 20000


def schedule(jobs: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each job; ties go by the job's name and the shard's number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(jobs, key=lambda job: (-job[1], str(job[0]))):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _plan(spark: SparkSession, jobs: dict, schema: str) -> DataFrame:
    return spark.createDataFrame(list(jobs.items()), schema)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``key``, size, text_crc32, shard and slot (place in the shard) of every row."""
    spark = docs.sparkSession
    octets = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = stage(
        docs.select(
            F.col(key).alias("key"),
            (octets + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            # Null has a digest of its own.
            F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("null")).alias("group"),
            F.rand(0).alias("salt"),
        )
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = stage(groups.withColumn("parcel", F.pmod(F.xxhash64("group"), F.lit(PARCELS))))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    large = F.col("bytes") * GROUPS > F.lit(total or 0)
    alone = [(("group", r.group), r.bytes) for r in groups.where(large).collect()]
    parcels = groups.where(~large).groupBy("parcel").agg(F.sum("bytes").alias("bytes")).collect()
    shard = schedule([*alone, *((("parcel", r.parcel), r.bytes) for r in parcels)], shards)
    by_group = _plan(spark, {n: s for (k, n), s in shard.items() if k == "group"}, "group string, own int")
    by_parcel = _plan(spark, {n: s for (k, n), s in shard.items() if k == "parcel"}, "parcel bigint, shared int")
    placed = (
        rows.withColumn("parcel", F.pmod(F.xxhash64("group"), F.lit(PARCELS)))
        # Both plans are bounded by GROUPS and PARCELS.
        .join(F.broadcast(by_group), "group", "left")
        .join(F.broadcast(by_parcel), "parcel", "left")
        .select("key", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), "salt")
    )
    buckets = max(1, -(-(count or 0) // BUCKET_ROWS))
    numbered = ordinal(
        placed, ["shard"], ["salt", "key"], F.floor(F.col("salt") * buckets), out="slot"
    )
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot")
    )
