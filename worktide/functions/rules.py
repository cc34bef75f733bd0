"""Predicates and rule classification as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions.text import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    normalize,
    py_normalize,
    strip_extension,
    text_or_empty,
    words,
)


def _alternatives(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ") for t in dict.fromkeys(map(py_normalize, terms)))


def has_any(norm: Column, terms: Sequence[str], whole_word: bool = False) -> Column:
    """Any term inside normalised text; one alternation per list.

    A term matches inside words as well unless ``whole_word`` is set.
    """
    pattern = _alternatives(terms)
    return norm.rlike(f"(?:^| )(?:{pattern})(?: |$)" if whole_word else pattern)


def found(value: Column, missing: str = lx.NOT_FOUND) -> Column:
    return F.coalesce((value != "") & (value != missing), F.lit(False))


def shown(value: Column, prudent: str, missing: str = lx.NOT_FOUND) -> Column:
    return F.when(found(value, missing), value).otherwise(F.lit(prudent))


def data_state(value: Column, missing: str = lx.NOT_FOUND) -> Column:
    return F.when(found(value, missing), "extraido").otherwise("no_localizado")


# ---- places and sectors -------------------------------------------------


def _text_list(flags: Sequence[tuple[Column, str]]) -> Column:
    """Names whose flag holds, in the given order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for flag, name in flags]))


def provinces_in(text: Column, places: lx.Places = lx.PLACES) -> Column:
    """Provinces named in a text; communities count only where no province does."""
    norm = normalize(text)
    direct = _text_list([(has_any(norm, a, True), p) for p, a in places.provinces.items()])
    if not places.communities:
        return direct
    by_community = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.when(
                        has_any(norm, aliases, True),
                        F.array(*[F.lit(p) for p, c in places.community_of.items() if c == name]),
                    ).otherwise(F.array().cast("array<string>"))
                    for name, aliases in places.communities.items()
                ]
            )
        )
    )
    return F.when(F.size(direct) > 0, direct).otherwise(by_community)


def sectors_in(
    text: Column,
    sectors: Sequence[lx.Sector] = lx.SECTORS,
    strong: Sequence[str] = lx.LODGING_CUES,
    first: str = lx.LODGING_SECTOR,
    drops: str = lx.LODGING_DROPS,
) -> Column:
    """Sectors named in a text; a strong cue moves one first and drops another."""
    norm = normalize(text)
    named = _text_list([(has_any(norm, s.labels, True), s.key) for s in sectors])
    rest = F.filter(named, lambda s: ~s.isin(first, drops))
    return F.when(
        has_any(norm, strong, True) & F.array_contains(named, first),
        F.concat(F.array(F.lit(first)), rest),
    ).otherwise(named)


def sectors_of_file(norm_name: Column, sectors: Sequence[lx.Sector] = lx.SECTORS) -> Column:
    return _text_list([(has_any(norm_name, s.file_keywords), s.key) for s in sectors])


def province_of_file(norm_name: Column, places: lx.Places = lx.PLACES) -> Column:
    """First province in declared order."""
    return F.coalesce(
        *[F.when(has_any(norm_name, a, True), F.lit(p)) for p, a in places.provinces.items()]
    )


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def set_key(values: Column) -> Column:
    return F.array_join(F.array_sort(values), "|")


def question_over_profile(question: Column, profile: Column) -> Column:
    return F.when(F.size(question) > 0, question).otherwise(profile)


# ---- intents ------------------------------------------------------------


def intent(
    question: Column,
    provinces: Column,
    sectors: Column,
    terms: lx.IntentTerms = lx.INTENT_TERMS,
    whole_word: bool = False,
) -> Column:
    """Struct(intent, reason): ten ordered rules."""
    norm = normalize(question)

    def hit(names: Sequence[str]) -> Column:
        return has_any(norm, names, whole_word)

    labour, scope = hit(terms.labour), hit(terms.out_of_scope)
    unclear = (F.size(provinces) == 0) | (F.size(sectors) == 0)

    def verdict(name: str, reason: str) -> Column:
        return F.struct(F.lit(name).alias("intent"), F.lit(reason).alias("reason"))

    return (
        F.when(norm == "", verdict("needs_clarification", "empty_question"))
        .when(scope & labour, verdict("mixed_labor", "out_of_scope_with_labor_signal"))
        .when(scope, verdict("out_of_scope", "non_labor_topic"))
        .when(~labour, verdict("out_of_scope", "no_labor_signal"))
        .when(hit(terms.current), verdict("current_labor", "current_or_official_labor_signal"))
        .when(hit(terms.calendar), verdict("current_labor", "labor_calendar_signal"))
        .when(
            hit(terms.definition) & hit(terms.general),
            verdict("general_labor", "labor_definition_signal"),
        )
        .when(
            hit(terms.which_agreement) & unclear,
            verdict("needs_clarification", "missing_convenio_criteria"),
        )
        .when(
            hit(terms.collective),
            verdict("collective_agreement", "collective_agreement_signal"),
        )
        .otherwise(verdict("general_labor", "generic_labor_signal"))
    )


def statute_rule(question: Column, rules: Sequence[lx.StatuteRule] = lx.STATUTE_RULES) -> Column:
    """Id of the first rule whose terms occur, else null."""
    norm = normalize(question)
    return F.coalesce(*[F.when(has_any(norm, r.query_terms), F.lit(r.id)) for r in rules])


def statute_answer(
    rule_id: Column, agreement_file: Column, rules: Sequence[lx.StatuteRule] = lx.STATUTE_RULES
) -> Column:
    prefix = F.when(
        text_or_empty(agreement_file) != "", F.lit(lx.STATUTE_PREFIX_WITH_AGREEMENT)
    ).otherwise(F.lit(lx.STATUTE_PREFIX_WITHOUT_AGREEMENT))
    body = lookup(
        rule_id,
        {r.id: f"{r.answer}\n\nFuente: {lx.STATUTE_NAME}, {r.article}." for r in rules},
    )
    return F.concat(prefix, body)


def statute_source(rule_id: Column) -> Column:
    return F.when(
        rule_id.isNotNull(),
        F.struct(
            rule_id.alias("id"),
            F.lit(lx.STATUTE_NAME).alias("file_name"),
            F.lit("estatuto_trabajadores").alias("agreement_id"),
            F.lit(None).cast("int").alias("chunk_index"),
            F.lit("base_local").alias("doc_type"),
            F.lit("base").alias("source"),
            F.lit(None).cast("double").alias("distance"),
        ),
    )


def language_of_question(
    question: Column,
    cues: Mapping[str, Sequence[str]] | None = None,
    default: str = "castellano",
) -> Column:
    """First language with a whole-word cue, else the default."""
    cues = cues or {"euskera": lx.BASQUE_CUES}
    lower = F.lower(text_or_empty(question))
    return F.coalesce(
        *[F.when(lower.rlike(words("|".join(c))), F.lit(lang)) for lang, c in cues.items()],
        F.lit(default),
    )


def labour_question(
    question: Column,
    terms: Sequence[str] = lx.SEARCH_LABOUR_TERMS,
    off_topic: Sequence[str] = lx.SEARCH_OFF_TOPIC_TERMS,
) -> Column:
    norm = normalize(question)
    return (norm != "") & ~has_any(norm, off_topic) & has_any(norm, terms)


def answer_not_found(answer: Column) -> Column:
    return normalize(answer).contains(lx.NOT_FOUND_ANSWER)


def weighted_score(norm: Column, weights: Mapping[str, int] | None = None) -> Column:
    weights = lx.DISCIPLINE_WEIGHTS if weights is None else weights
    total = F.lit(0)
    for phrase, weight in weights.items():
        total = total + F.when(norm.contains(py_normalize(phrase)), weight).otherwise(0)
    return total


def tier(norm: Column, exact: Sequence[str], headers: Sequence[str]) -> Column:
    """0 exact hit, 1 header hit, null otherwise."""
    return F.when(has_any(norm, exact), 0).when(has_any(norm, headers), 1)


# ---- domains ------------------------------------------------------------


def official_domain(
    value: Column, domains: Sequence[str] = lx.OFFICIAL_DOMAINS, mode: str = "strict"
) -> Column:
    """Equal to or below an allowed domain; ``contains`` accepts it anywhere."""
    lower = F.lower(text_or_empty(value))
    escaped = "|".join(re.escape(d.lower()) for d in dict.fromkeys(domains))
    if mode == "contains":
        return lower.rlike(escaped)
    return lower.rlike(rf"^(?:.*\.)?(?:{escaped})$")


def allowed_origin(origin: Column, allowed: Sequence[str], local_pattern: str) -> Column:
    """No origin, a listed origin, or a local development origin."""
    return (
        (text_or_empty(origin) == "")
        | text_or_empty(origin).isin(*allowed)
        | text_or_empty(origin).rlike(local_pattern)
    )


def recent_login(auth_time: Column, now: Column, limit: int = lx.RECENT_LOGIN_SECONDS) -> Column:
    return F.coalesce((now - auth_time).between(0, limit), F.lit(False))


def allowed_price(
    price: Column, product: Column, prices: Sequence[str], products: Sequence[str]
) -> Column:
    """Listed price or product; nothing is allowed while both lists are empty."""
    ok = F.lit(False)
    if prices:
        ok = ok | text_or_empty(price).isin(*prices)
    if products:
        ok = ok | text_or_empty(product).isin(*products)
    return ok


# ---- clients and buckets ------------------------------------------------


def browser_family(ua: Column) -> Column:
    ua = text_or_empty(ua)
    return (
        F.when(ua.contains("Edg/"), "Edge")
        .when(ua.contains("Firefox/"), "Firefox")
        .when(ua.contains("Chrome/"), "Chrome")
        .when(ua.contains("Safari/"), "Safari")
        .otherwise("Otro")
    )


def os_family(ua: Column, platform: Column) -> Column:
    return (
        F.when(ua.rlike("(?i)Android"), "Android")
        .when(ua.rlike("(?i)iPhone|iPad|iPod"), "iOS")
        .when(platform.rlike("(?i)Win"), "Windows")
        .when(platform.rlike("(?i)Mac"), "macOS")
        .when(platform.rlike("(?i)Linux"), "Linux")
        .otherwise("Otro")
    )


def load_bucket(ms: Column) -> Column:
    return F.when(ms < 1000, "0-1s").when(ms < 3000, "1-3s").when(ms < 5000, "3-5s").otherwise(">5s")


def device_class(width: Column) -> Column:
    return F.when(width <= 767, "movil").when(width <= 1024, "tablet").otherwise("escritorio")


def quality_tier(length: Column, high: int = 50000, medium: int = 15000) -> Column:
    return F.when(length > high, "alta").when(length > medium, "media").otherwise("baja")


def doc_type(file_name: Column) -> Column:
    stem = F.lower(strip_extension(F.regexp_extract(file_name, "([^/]*)$", 1)))
    return F.when(stem == "estatuto_trabajadores", "base").otherwise("especifico")


def part_marker(file_name: Column) -> Column:
    return file_name.rlike(
        rf"(?iu){NOT_AFTER_WORD}parte\s*[0-9]*{NOT_BEFORE_WORD}|parte[0-9]+"
    )


def broken_metadata(file_name: Column, province: Column, sectors: Column) -> Column:
    return (
        province.isNull() | (F.size(sectors) == 0) | file_name.rlike(words("[0-9]{3}-[0-9]{4}"))
    )


# ---- numbers ------------------------------------------------------------


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def signed(value: Column, sign_of: Column) -> Column:
    return F.concat(F.when(sign_of >= 0, "+").otherwise(""), value.cast("string"))


def number_or(c: Column, default: float) -> Column:
    """Zero, NaN, text and null count as missing."""
    number = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), F.nullif(number, F.lit(0.0))), F.lit(default))


def remaining(limit: Column | int, used: Column) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.greatest(F.lit(0), limit - used)
