"""Stored search answers and the routing of questions to an answer source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.computed import computed

PARTS = "array<struct<text string>>"
SOURCES = "array<struct<web struct<uri string, title string>>>"


def read_response(body: Column) -> Column:
    """Text, finish reason, source list and search queries of a stored response."""
    doc = F.try_parse_json(body)

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, "$.candidates[0]." + path, kind)

    parts = at("content.parts", PARTS)
    text = F.array_join(F.transform(parts, lambda p: tx.text_or_empty(p["text"])), "")
    sources = F.transform(
        F.coalesce(at("groundingMetadata.groundingChunks", SOURCES), F.array().cast(SOURCES)),
        lambda c: F.struct(
            tx.text_or_empty(c["web"]["uri"]).alias("uri"),
            tx.text_or_empty(c["web"]["title"]).alias("title"),
        ),
    )
    return F.struct(
        tx.text_or_empty(tx.trim_ws(text)).alias("text"),
        at("finishReason", "string").alias("finish_reason"),
        sources.alias("sources"),
        at("groundingMetadata.webSearchQueries", "array<string>").alias("queries"),
    )


def official_sources(sources: Column, domains: Sequence[str], mode: str = "strict") -> Column:
    """Sources whose host or title is official."""
    return F.filter(
        sources,
        lambda s: (s["uri"] != "")
        & (
            rules.official_domain(tx.host(s["uri"]), domains, mode)
            | rules.official_domain(s["title"], domains, mode)
        ),
    )


def triage(
    rows: DataFrame,
    enabled: Column,
    labour: Column,
    has_key: Column,
    http_status: Column,
    body: Column,
    domains: Sequence[str] = lx.OFFICIAL_DOMAINS,
    official_only: bool = True,
    mode: str = "strict",
) -> DataFrame:
    """Adds ``used``, ``reason``, ``official`` sources and the answer text."""
    read = computed(rows, {"__r": read_response(body)})
    read = computed(read, {"official": official_sources(F.col("__r.sources"), domains, mode)})
    reason = (
        F.when(~enabled, "web_fallback_disabled")
        .when(~labour, "not_labor_question")
        .when(~has_key, "missing_api_key")
        .when(
            ~http_status.between(200, 299),
            F.concat(F.lit("gemini_search_http_"), http_status.cast("string")),
        )
        .when(F.col("__r.finish_reason") == "MAX_TOKENS", "gemini_search_max_tokens")
        .when(F.lit(official_only) & (F.size("official") == 0), "no_allowed_official_sources")
        .when(F.col("__r.text") == "", "empty_response")
        .otherwise("web_grounded")
    )
    return (
        computed(read, {"reason": reason})
        .withColumns(
            {
                "used": F.col("reason") == "web_grounded",
                "answer": F.when(F.col("reason") == "web_grounded", F.col("__r.text")),
                "search_queries": F.col("__r.queries"),
            }
        )
        .drop("__r")
    )


def source_rows(triaged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One numbered row per source of a used answer."""
    return (
        triaged.where("used")
        .select(*keys, F.posexplode("official").alias("pos", "source"))
        .select(
            *keys,
            F.concat(F.lit("web_official_"), (F.col("pos") + 1).cast("string")).alias("id"),
            F.col("source.title").alias("title"),
            F.col("source.uri").alias("url"),
            F.lit("web_official").alias("doc_type"),
        )
    )


def route(rows: DataFrame) -> DataFrame:
    """Adds ``response_source`` and ``event``.

    Expects intent, has_reference, catalog_status, statute_rule, n_base,
    n_specific, not_found, complete, search_used and search_reason.
    """
    statute = F.col("statute_rule").isNotNull()
    by_search = F.when(F.col("search_used"), "web_official").otherwise("unconfirmed")
    searched = F.col("search_reason") != "web_fallback_disabled"
    open_question = ~F.col("has_reference")
    status = F.col("catalog_status")
    clarify = status.isin("missing_all", "missing_sector", "missing_location", "ambiguous")
    empty = (F.col("n_base") == 0) & (F.col("n_specific") == 0)
    source = (
        F.when(F.col("intent").isin("out_of_scope", "mixed_labor"), F.col("intent"))
        .when(F.col("intent") == "needs_clarification", "clarification")
        .when(F.col("intent") == "current_labor", by_search)
        .when(F.col("intent") == "general_labor", "general_labor")
        .when(open_question & clarify, "clarification")
        .when(open_question & (status == "not_found") & statute, "estatuto")
        .when(open_question & (status == "not_found"), by_search)
        .when(empty & statute, "estatuto")
        .when(empty, by_search)
        .when(F.col("not_found") & statute & F.col("complete"), "estatuto")
        .when(F.col("not_found") & ~statute & searched, by_search)
        .when(~F.col("complete"), "unconfirmed")
        .otherwise("convenio")
    )
    event = F.coalesce(
        rules.lookup(F.col("response_source"), lx.ANSWER_EVENTS), F.lit(lx.DEFAULT_ANSWER_EVENT)
    )
    return rows.withColumn("response_source", source).withColumn("event", event)


def log_lines(routed: DataFrame) -> DataFrame:
    """Two log lines per answer: its own event and the common result event."""
    payload = F.struct(
        "response_source", "status", "uid", "quotaPlan", "quotaRemaining", "convenioUsado",
        "requiresClarification", "webFallbackUsed", "webFallbackReason", "finishReason",
        "chunksUsed", "questionLength",
    )
    return routed.select(
        F.explode(F.array(F.col("event"), F.lit("consultarConvenio_result"))).alias("event"),
        payload.alias("p"),
    ).select(F.to_json(F.struct("event", "p.*"), {"ignoreNullFields": "false"}).alias("line"))
