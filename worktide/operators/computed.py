"""Costly columns that are computed once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a generator.

    A later filter on a plain derived column is pushed to the scan as a copy of
    its whole expression, so text work would be done twice and before any join.
    Filters stop at a generator's output.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
