"""Stream sources, the micro-batch sink and a runner that drains the input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.session import configure, shared_dir
from worktide.sources.sinks import exists

LATENESS = "10 minutes"


def read_table_stream(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Table as a stream of new files; the checkpoint remembers which were read.

    The pattern matches one file as well as a folder of part files. Bounded
    triggers keep a micro-batch, and with it each user's rows, small.
    """
    configure(spark, streaming=True)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{name}.parque[t]")
    )


def read_events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Event stream with a zoned timestamp, as watermarks need one."""
    rows = read_table_stream(spark, folder, "events", files_per_trigger)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drain(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    mode: str = "append",
    checkpoint: str | None = None,
) -> None:
    """Process all input there is, then stop; a rerun with the checkpoint goes on."""
    checkpoint = checkpoint or new_path(stream.sparkSession, "offsets")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_to_table(
    stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Drain into one folder per micro-batch, so that a retried batch replaces itself."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(stream, write, mode, checkpoint)
    return spark.read.schema(f"{_ddl(stream)}, batch int").option("basePath", path).parquet(path)


def query_id(spark: SparkSession) -> str:
    """Id of the running query, kept in its checkpoint; only known inside a micro-batch."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Rows that earlier micro-batches wrote under ``path/batch=N``; none before the first."""
    rows = spark.createDataFrame([], f"{schema}, batch int")
    if before > 0 and exists(spark, path):
        rows = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path)
    return rows.where(F.col("batch") < before).drop("batch")


def slices_of(rows: DataFrame, slices: int, by: str = "ts") -> Iterator[DataFrame]:
    """Streams over a growing folder that takes ``rows`` slice by slice along ``by``.

    Draining each with one checkpoint gives one micro-batch per slice.
    """
    spark = configure(rows.sparkSession, streaming=True)
    path = new_path(spark, "input")
    at = F.col(by).cast("bigint") if dict(rows.dtypes)[by] != "timestamp" else F.unix_micros(by)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    place = F.floor((at - (low or 0)) * slices / ((high or 0) - (low or 0) + 1))
    for i in range(slices):
        rows.where(place == i).write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


def replayed(
    rows: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "append",
    slices: int = 4, by: str = "ts",
) -> DataFrame:
    """Table of ``make`` over ``rows`` streamed in slices."""
    spark = rows.sparkSession
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "offsets")
    for stream in slices_of(rows, slices, by):
        table = drain_to_table(make(stream), mode, path, checkpoint)
    return table


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
