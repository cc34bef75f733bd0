"""Named queries over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.llm import (
    decontaminate,
    extraction,
    language,
    negatives,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    sql,
    suffixes,
    urls,
    warc,
)
from worktide.operators.staging import stage
from worktide.session import configure
from worktide.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        QUERIES[name] = run
        if twin is not None:
            ORACLES[name] = twin
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    return QUERIES, ORACLES


# Rules of the URL query (fixed values).
HOST_RULES = (
    urls.Rule("||net/", "block"),
    urls.Rule("||example.net/en/", "allow"),
    urls.Rule("||example.com/de/", "block"),
    urls.Rule("||org/fr/", "allow"),
)


@query("op1_url_filters", sql.URL_FILTERS)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.judge(pages, (*HOST_RULES, *urls.DEFAULT_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    rows = extraction.extract(pages)
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op3_decontamination", sql.DECONTAMINATION)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = decontaminate.find(docs, table(spark, folder, "benchmark"))
    measured = rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        decontaminate.hit_words("found").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        decontaminate.digest("found").alias("items_sha256"),
    )
    judged = decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))
    return measured.withColumn("contaminated", judged)


@query("op4_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(rest == 2, F.lit(False))
    model = language.learn(docs.where(rest != 2))
    rows = language.identify(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.ambiguous").alias("ambiguous"),
    )


@query("op5_secret_scans", sql.SECRETS)
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = secrets.scan(docs)
    return rows.select(
        "doc_id",
        *[secrets.count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(), ids=False)


@query("op7_warc", sql.WARC)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc.new_folder(spark)
    index = warc.write(table(spark, folder, "pages"), archive)
    return warc.read(index, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op8_sharding")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.assign(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The contract of the query: shingles of three words, two differing bits.
LINK_WORDS = 3
LINK_BITS = 2


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    marked = simhash.marked(docs.select("doc_id", "text"), LINK_WORDS)
    rows = simhash.classes(marked, "doc_id", LINK_BITS)
    return rows.select(
        "doc_id", F.lpad(F.lower(F.hex(F.col("prints")[0])), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op10_quality_rules", sql.QUALITY)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    failed = F.col("failed")
    return rows.select(
        "doc_id",
        *[
            F.col(f"measures.{m}").alias(m)
            for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        (~quality.passes(failed, quality.BASE)).alias("base_failed"),
        quality.passes(failed).alias("kept"),
    )


@query("op11_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.remove(docs, texts=False)


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = stage(spelling.vocabulary(table(spark, folder, "documents").select("doc_id", "text")))
    return spelling.group(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_hard_negatives", sql.HARD_NEGATIVES)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    # A part of the labels is wrong on purpose.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.prepared(rows, "vec_id", "embedding", label)
    return negatives.mine(vectors, F.col("id") % 100 == 0)
