"""Connected components of a table of links.

Large-star and small-star steps (Kiveris and others, 2014): every node links its greater, then its
smaller neighbours to the least one it knows, until only stars are left. Each step is a grouped
minimum, combined before the shuffle, and a join; each result is a written table, so lineage stays
short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.operators.staging import stage


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join has two plain sides and a node with very many links can be split.
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    wide = both.where("b > a").join(least, "a")
    return wide.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), "m")
    own = least.select("a", "m")
    return others.union(own).select("a", F.col("m").alias("b")).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a smaller node in its component; ``links``: (a, b).

    A node without row is its own root. Links to itself and repeated links are allowed.
    """
    ordered = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = stage(ordered.distinct())
    state = _state(links)
    while state[0]:
        links = stage(_small(_large(links)))
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
