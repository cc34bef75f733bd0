"""Ordered operators over unbounded groups.

A plain window puts a whole group into one task. Here a group is cut into
buckets that follow the order (for instance hours of a time line): rows are
ranked inside (key, bucket), one small row per bucket carries what came before,
and both are joined. No task holds more than one bucket of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(side, list(keys), "left")


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    out: str = "ordinal",
) -> DataFrame:
    """1-based position inside the key; ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    rows = df.withColumn("__b", bucket)
    before = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        rows.groupBy(*keys, "__b")
        .agg(F.count("*").alias("__n"))
        .select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (
        _attach(rows, sizes, [*keys, "__b"])
        .withColumn(out, (F.row_number().over(inside) + F.col("__before")).cast("bigint"))
        .drop("__b", "__before")
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """Last non-null ``value`` up to and including the row (as-of lookup)."""
    keys = list(keys)
    rows = df.withColumn("__b", bucket)
    before = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    changes = (
        rows.groupBy(*keys, "__b")
        .agg(
            F.max_by(
                F.col(value), F.when(F.col(value).isNotNull(), _order(order))
            ).alias("__v")
        )
        .select(*keys, "__b", F.last("__v", ignorenulls=True).over(before).alias("__carry"))
    )
    inside = (
        Window.partitionBy(*keys, "__b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _attach(rows, changes, [*keys, "__b"])
        .withColumn(
            out,
            F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__carry")),
        )
        .drop("__b", "__carry")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """Sum of ``value`` up to and including the row."""
    keys = list(keys)
    rows = df.withColumn("__b", bucket)
    before = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = (
        rows.groupBy(*keys, "__b")
        .agg(F.sum(value).alias("__s"))
        .select(*keys, "__b", F.sum("__s").over(before).alias("__before"))
    )
    inside = (
        Window.partitionBy(*keys, "__b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _attach(rows, sums, [*keys, "__b"])
        .withColumn(
            out, F.sum(value).over(inside) + F.coalesce(F.col("__before"), F.lit(0))
        )
        .drop("__b", "__before")
    )


def latest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """The row with the greatest order per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("__row"))
        .select(*keys, "__row.*")
    )


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    out: str = "rank",
) -> DataFrame:
    """First ``k`` rows per key; Spark prunes each partition to ``k`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= k)
