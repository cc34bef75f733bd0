"""Writers: replace by file, upserts, partitioned years, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.operators.ordered import latest
from worktide.sources.store import COMMIT, Store


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, on whichever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _overwrite(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that ``rows`` touch and leave the others.

    The rebalance hint gives each partition few files and splits a large one.
    """
    (
        rows.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_files(new: DataFrame, path: str, key: str, step: int, run: str = "") -> None:
    """Replace all rows of each file in ``new``, as one commit.

    A commit adds its rows and the list of files they belong to; the newest commit of a file counts.
    The cost follows the new rows, not the stored ones. A repeated call with the same run and step
    replaces itself. A run that goes on must have written to this table before.
    """
    store = Store(new.sparkSession, path)
    if step > 0 and run != "" and run not in store.state()["runs"]:
        raise ValueError(f"the checkpoint of run {run} belongs to another table than {path}")
    files = lambda written: written["rows"].select(key).distinct()
    store.commit(run, step, {"rows": new, "files": files}, again=True)
    store.tidy(lambda tables: _newest_files(tables, key))


def _newest_files(tables: Mapping[str, DataFrame], key: str) -> dict[str, DataFrame]:
    names = tables["files"].select(key).distinct()
    return {"rows": _of_newest(tables["rows"], tables["files"], key).drop(COMMIT), "files": names}


def _of_newest(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows of the newest commit of each file. Only files stored more than once need a lookup."""
    versions = files.groupBy(key).agg(F.max(COMMIT).alias("newest"), F.count("*").alias("n"))
    stale = (
        files.join(versions.where("n > 1").drop("n"), key)
        .where(F.col(COMMIT) < F.col("newest"))
        .select(key, COMMIT)
    )
    return rows.join(stale, [key, COMMIT], "left_anti")


def current_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of the newest commit of each file, all from one manifest."""
    store = Store(spark, path)
    state = store.state()
    return _of_newest(store.read("rows", state=state), store.read("files", state=state), key)


def compact_files(spark: SparkSession, path: str, target: str, key: str) -> None:
    """Write the current rows as the first commit of a new table."""
    replace_files(current_files(spark, path, key).drop(COMMIT), target, key, 0)


def append_version(new: DataFrame, path: str, keys: Sequence[str], order: str, step: int, run: str = "") -> None:
    """Add the latest row per key of ``new`` as a commit of its own."""
    store = Store(new.sparkSession, path)
    last = latest(new, list(keys), [order]).select(new.columns)
    store.commit(run, step, {"rows": last}, again=True)
    store.tidy(lambda tables: {"rows": _latest(tables["rows"], keys, order)})


def _latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    columns = [c for c in rows.columns if c != COMMIT]
    return latest(rows, list(keys), [order, COMMIT]).select(columns)


def current_latest(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row per key over all commits; of equal ones the last written."""
    return _latest(Store(spark, path).read("rows"), keys, order)


def compact_latest(
    spark: SparkSession, path: str, target: str, keys: Sequence[str], order: str, by: str
) -> None:
    """Write the latest rows as a table partitioned by ``by``."""
    _overwrite(current_latest(spark, path, keys, order), target, [by])


def write_years(rows: DataFrame, path: str, legacy: Sequence[str] = ()) -> None:
    """Year tables: only the years present are replaced; legacy columns go."""
    _overwrite(rows.drop(*legacy), path, ["year"])


def write_inventory(entries: DataFrame, path: str) -> None:
    """Entries as nested JSON, one document per line."""
    entries.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted text report; sorting is by range, so parts follow each other."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
