"""File scans and configuration readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.sources.sinks import exists

# Names ending in .pdf, any case.
PDF_GLOB = "*.[pP][dD][fF]"

OVERRIDE_SCHEMA = (
    "documento string, slug string, sector string, provincia string, vigencia string, "
    "jornada_anual string, vacaciones string, fuente_oficial string, fuente_url string, "
    "verified boolean, notes string, skip boolean, skipStatus string, reason string"
)
TOPIC_SCHEMA = (
    "slug string, label string, contentField string, searchIntent string, titlePattern string, "
    "descriptionPattern string, uniqueAngle string, minimumData array<string>, "
    "fallbackPolicy string"
)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """All PDF files below a folder, without their content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", PDF_GLOB)
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "modificationTime",
            "length",
        )
    )


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of one folder by name."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB).load(folder)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name")).orderBy(
        "file_name"
    )


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual rows from a JSON file; an absent file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], OVERRIDE_SCHEMA)
    return (
        spark.read.option("multiLine", True)
        .schema(f"version int, updatedAt string, entries array<struct<{_fields(OVERRIDE_SCHEMA)}>>")
        .json(path)
        .select(F.inline("entries"))
    )


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic rows of a configuration file with its patterns and switch."""
    return (
        spark.read.option("multiLine", True)
        .schema(
            "generationEnabled boolean, urlPattern string, outputPattern string, "
            f"topics array<struct<{_fields(TOPIC_SCHEMA)}>>"
        )
        .json(path)
        .select("generationEnabled", "urlPattern", F.inline("topics"))
    )


def log_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Structured log lines as text."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "line")


def year_documents(spark: SparkSession, users: str, years: str) -> tuple[DataFrame, DataFrame]:
    """Marks kept in old user rows (a map) and in year rows, both one row per day."""
    def rows(path: str) -> DataFrame:
        stored = spark.read.parquet(path)
        return stored.select(
            "user_id", F.explode("day_marks").alias("day", "kind")
        ).withColumn("day", F.to_date("day"))

    return rows(users), rows(years)


def _fields(ddl: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in ddl.split(", "))
