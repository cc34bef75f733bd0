"""Agreement catalogue: file names, grouping, criteria and resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import extract as ex
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.ordered import ordinal, top_k
from worktide.operators.staging import stage

ORDER_LOCALE = "es"


def file_fields(
    df: DataFrame,
    name: str = "file_name",
    places: lx.Places = lx.PLACES,
    sectors: Sequence[lx.Sector] = lx.SECTORS,
) -> DataFrame:
    """Adds the fields read from a file name, among them the catalogue key."""
    title = tx.strip_extension(tx.base_name(F.col(name)))
    parsed = df.withColumns({"title": title}).withColumn("__norm", tx.normalize(F.col("title")))
    parsed = parsed.withColumns(
        {
            "province": rules.province_of_file(F.col("__norm"), places),
            "sector_keys": rules.sectors_of_file(F.col("__norm"), sectors),
            "__years": ex.years(F.col("title")),
            "part_number": ex.part_number(F.col("__norm")),
        }
    )
    parsed = parsed.withColumns(
        {
            "community": rules.lookup(F.col("province"), places.community_of),
            "year_start": ex.first_year(F.col("__years")),
            "year_end": ex.last_year(F.col("__years")),
        }
    )
    group = F.concat_ws(
        "_",
        F.when(F.size("sector_keys") > 0, F.array_join("sector_keys", "_")).otherwise("sin_sector"),
        F.coalesce("province", F.lit("sin_provincia")),
        F.coalesce(F.col("year_start").cast("string"), F.lit("na")),
        F.coalesce(F.col("year_end").cast("string"), F.lit("na")),
    )
    return parsed.withColumn("catalog_key", tx.identifier(group)).drop("__norm", "__years")


def names_of_chunks(chunks: DataFrame, specific: str = "especifico") -> DataFrame:
    """Distinct file names of specific chunks; the old column fills the new one."""
    return (
        chunks.where(F.col("doc_type") == specific)
        .select(F.coalesce("file_name", "fileName").alias("file_name"))
        .where(F.col("file_name").isNotNull())
        .distinct()
    )


ENTRY = ("title", "province", "community", "sector_keys", "year_start", "year_end")


def build(files: DataFrame, order: str = "ord") -> DataFrame:
    """One entry per catalogue key with the attributes of its first file."""
    return (
        files.groupBy("catalog_key")
        .agg(
            F.min_by(F.struct(*ENTRY), F.col(order)).alias("__first"),
            F.count_distinct("file_name").alias("n_files"),
        )
        .select("catalog_key", "__first.*", "n_files")
    )


def entry_files(files: DataFrame, bucket: Column, order: str = "ord") -> DataFrame:
    """Distinct files of each entry in first-seen order, one row per file."""
    # Numbering reads its input twice; names are parsed once.
    once = stage(files.groupBy("catalog_key", "file_name").agg(F.min(order).alias(order)))
    return ordinal(once, ["catalog_key"], [order], bucket, "position")


def entry_order() -> list[Column]:
    """Later end year first (none counts as 0), then title in Spanish order."""
    return [F.coalesce("year_end", F.lit(0)).desc(), F.collate("title", ORDER_LOCALE).asc()]


def _rank() -> Column:
    return F.struct(
        (-F.coalesce(F.col("year_end"), F.lit(0))).alias("y"),
        F.collate("title", ORDER_LOCALE).alias("t"),
    )


def cells(catalog: DataFrame, shown: int = 3) -> DataFrame:
    """Entries summed up per (province, sector set); bounded by the lexicon, not by the data."""
    usable = catalog.where(F.col("province").isNotNull()).withColumn(
        "set_key", rules.set_key(F.col("sector_keys"))
    )
    keys = ["province", "set_key"]
    best = usable.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.first("sector_keys").alias("sector_keys"),
        F.min_by(
            F.struct("catalog_key", "title", "community", "year_end"), _rank()
        ).alias("best"),
        F.min(_rank()).alias("rank"),
    )
    tops = (
        top_k(usable, keys, [*entry_order(), F.col("catalog_key")], shown)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(_rank().alias("rank"), "title")).alias("tops"))
    )
    return best.join(tops, keys)


def criteria(
    questions: DataFrame,
    question: Column,
    city: Column,
    sector: Column,
    places: lx.Places = lx.PLACES,
    sectors: Sequence[lx.Sector] = lx.SECTORS,
    strong: Sequence[str] = lx.LODGING_CUES,
) -> DataFrame:
    """Provinces and sectors of each question; the profile fills what it leaves open."""
    return questions.withColumns(
        {
            "provinces": rules.question_over_profile(
                rules.provinces_in(question, places), rules.provinces_in(city, places)
            ),
            "sectors": rules.question_over_profile(
                rules.sectors_in(question, sectors, strong),
                rules.sectors_in(sector, sectors, strong),
            ),
        }
    ).withColumn(
        "criteria_key",
        F.concat_ws("/", F.array_join("provinces", "+"), F.array_join("sectors", "+")),
    )


def resolve(asked: DataFrame, catalog: DataFrame, shown: int = 3) -> DataFrame:
    """Resolution per distinct criteria: status, entry, number of options, shown titles.

    Many questions share few criteria, so the catalogue is matched once per
    criteria and never paired with questions.
    """
    distinct = asked.groupBy("criteria_key").agg(
        F.first("provinces").alias("provinces"), F.first("sectors").alias("sectors")
    )
    matches = (
        distinct.select("criteria_key", "sectors", F.explode("provinces").alias("province"))
        .join(cells(catalog, shown), "province")
        .where(F.arrays_overlap("sectors", "sector_keys"))
        .groupBy("criteria_key")
        .agg(
            F.sum("n").alias("n_options"),
            (F.min("set_key") != F.max("set_key")).alias("mixed"),
            F.min_by(
                F.struct("best.*", "province", "sector_keys"), F.struct("rank", "set_key")
            ).alias("entry"),
            F.slice(F.array_sort(F.flatten(F.collect_list("tops"))), 1, shown).alias("tops"),
        )
    )
    none_p, none_s = F.size("provinces") == 0, F.size("sectors") == 0
    status = (
        F.when(none_p & none_s, "missing_all")
        .when(none_s, "missing_sector")
        .when(none_p, "missing_location")
        .when(F.col("entry").isNull(), "not_found")
        .when(F.col("mixed"), "ambiguous")
        .otherwise("resolved")
    )
    resolved = F.col("status") == "resolved"
    return (
        distinct.join(matches, "criteria_key", "left")
        .withColumn("status", status)
        .select(
            "criteria_key",
            "status",
            F.when(resolved, F.col("entry")).alias("entry"),
            F.coalesce("n_options", F.lit(0)).alias("n_options"),
            F.when(
                F.col("status") == "ambiguous", F.transform("tops", lambda t: t["title"])
            ).alias("shown"),
        )
    )


def options(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """All options per distinct criteria as links to (province, sector set) groups."""
    distinct = asked.groupBy("criteria_key").agg(
        F.first("provinces").alias("provinces"), F.first("sectors").alias("sectors")
    )
    return (
        distinct.select("criteria_key", "sectors", F.explode("provinces").alias("province"))
        .join(cells(catalog).select("province", "set_key", "sector_keys", "n"), "province")
        .where(F.arrays_overlap("sectors", "sector_keys"))
        .select("criteria_key", "province", "set_key", F.col("n").alias("n_entries"))
    )


def detected(entry: Column) -> Column:
    """Public view of the agreement found."""
    return F.when(
        entry.isNotNull(),
        F.struct(
            entry["province"].alias("province"),
            entry["community"].alias("community"),
            F.coalesce(entry["sector_keys"], F.array().cast("array<string>")).alias("sector_keys"),
            entry["title"].alias("title"),
        ),
    )


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def rebuild(
    chunks: DataFrame,
    stored: DataFrame,
    places: lx.Places = lx.PLACES,
    sectors: Sequence[lx.Sector] = lx.SECTORS,
) -> DataFrame:
    """Catalogue from the chunk table, merged over the stored one.

    Files are taken in name order; every part of an agreement stays listed.
    """
    names = names_of_chunks(chunks).withColumn("ord", F.col("file_name"))
    fresh = build(file_fields(names, places=places, sectors=sectors))
    return merge_by_key(stored, fresh.select(stored.columns), ["catalog_key"])


def backfill(chunks: DataFrame) -> DataFrame:
    """Fills ``doc_type`` and ``file_name`` and marks changed rows."""
    return chunks.withColumns(
        {
            "changed": F.col("doc_type").isNull()
            | (F.col("file_name").isNull() & F.col("fileName").isNotNull()),
            "doc_type": F.coalesce("doc_type", F.lit("especifico")),
            "file_name": F.coalesce("file_name", "fileName"),
        }
    )
