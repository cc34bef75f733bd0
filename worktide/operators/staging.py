"""Written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from worktide.session import shared_dir


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results of costly text work that several branches use: the text is read
    once, later branches prune columns, the size is known to the planner, and a
    lost executor costs no recomputation. Each call has a folder of its own;
    the shared folder's retention removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
