"""Question, request and visit rules over conversations, events, pages and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.plans import answers as an
from worktide.plans import requests as rq
from worktide.queries import sqltext as sq
from worktide.queries.catalog import ASKED_SQL, asked
from worktide.queries.registry import query
from worktide.sources.tables import events, table

TERMS = lx.IntentTerms(
    labour=("heon", "oue", "enge", "cion", "thre", "and"),
    out_of_scope=("whst", "aux", "ungs"),
    current=("thin", "eau"),
    calendar=("rith", "tiin"),
    definition=("the a", "der "),
    general=("erea", "hein"),
    which_agreement=("of th",),
    collective=("ing", "ent"),
)
RULES = (
    lx.StatuteRule("r1", "art. 1", "one", ("thre the", "und der"), "a"),
    lx.StatuteRule("r2", "art. 2", "two", ("ening", "eaux"), "b"),
    lx.StatuteRule("r3", "art. 3", "three", ("ther", "cion"), "c"),
)


def _hit(terms) -> str:
    # Terms are normalised, so outer blanks go.
    return sq.has_any("nq", [t.strip() for t in terms])


INTENT_SQL = f"""
{ASKED_SQL},
intents as (
  select *, case
    when nq = '' then 'needs_clarification:empty_question'
    when {_hit(TERMS.out_of_scope)} and {_hit(TERMS.labour)} then 'mixed_labor:out_of_scope_with_labor_signal'
    when {_hit(TERMS.out_of_scope)} then 'out_of_scope:non_labor_topic'
    when not {_hit(TERMS.labour)} then 'out_of_scope:no_labor_signal'
    when {_hit(TERMS.current)} then 'current_labor:current_or_official_labor_signal'
    when {_hit(TERMS.calendar)} then 'current_labor:labor_calendar_signal'
    when {_hit(TERMS.definition)} and {_hit(TERMS.general)} then 'general_labor:labor_definition_signal'
    when {_hit(TERMS.which_agreement)} and (len(provinces) = 0 or len(sectors) = 0)
      then 'needs_clarification:missing_convenio_criteria'
    when {_hit(TERMS.collective)} then 'collective_agreement:collective_agreement_signal'
    else 'general_labor:generic_labor_signal' end as verdict
  from asked)
"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    return q.withColumn(
        "verdict",
        rules.intent(F.col("question"), F.col("provinces"), F.col("sectors"), TERMS),
    )


@query(
    "intent_classify",
    f"""
with {INTENT_SQL}
select conv_id, turn, split_part(verdict, ':', 1) as intent, split_part(verdict, ':', 2) as reason
from intents""",
)
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("conv_id", "turn", "verdict.intent", "verdict.reason")


STATUTE_CASE = " ".join(
    f"when {sq.has_any('nq', r.query_terms)} then '{r.id}'" for r in RULES
)


@query(
    "statute_first_rule",
    f"""
with {ASKED_SQL},
r as (select conv_id, turn, case {STATUTE_CASE} end as rule from asked)
select conv_id, turn, coalesce(rule, '-') as rule,
       coalesce(case when turn = 0 then '{lx.STATUTE_PREFIX_WITHOUT_AGREEMENT}'
                     else '{lx.STATUTE_PREFIX_WITH_AGREEMENT}' end
         || case rule when 'r1' then 'a' when 'r2' then 'b' when 'r3' then 'c' end || chr(10) || chr(10)
         || 'Fuente: {lx.STATUTE_NAME}, art. ' || substr(rule, 2) || '.', '-') as answer
from r""",
)
def statute_first_rule(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).withColumn("rule", rules.statute_rule(F.col("question"), RULES))
    agreement = F.when(F.col("turn") > 0, "x.pdf").otherwise("")
    return q.select(
        "conv_id",
        "turn",
        F.coalesce("rule", F.lit("-")).alias("rule"),
        F.coalesce(rules.statute_answer(F.col("rule"), agreement, RULES), F.lit("-")).alias(
            "answer"
        ),
    )


LEAVE, DISCIPLINE, DAYS_OFF = ("thre", "tion the"), ("ered", "eau"), ("ing", "que")


@query(
    "question_kinds",
    f"""
with {ASKED_SQL}
select conv_id, turn, {sq.has_any('nq', LEAVE)} as leave, {sq.has_any('nq', DISCIPLINE)} as discipline,
       {sq.has_any('nq', DAYS_OFF)} as days_off, {sq.has_any('nq', ['in', 'la'], True)} as whole_word,
       nq <> '' and not {sq.has_any('nq', ['whst', 'ungs'])} and {sq.has_any('nq', ['and', 'tion'])}
         as labour
from asked""",
)
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    norm = tx.normalize(F.col("question"))
    return q.select(
        "conv_id",
        "turn",
        rules.has_any(norm, LEAVE).alias("leave"),
        rules.has_any(norm, DISCIPLINE).alias("discipline"),
        rules.has_any(norm, DAYS_OFF).alias("days_off"),
        rules.has_any(norm, ("in", "la"), whole_word=True).alias("whole_word"),
        rules.labour_question(F.col("question"), ("and", "tion"), ("whst", "ungs")).alias(
            "labour"
        ),
    )


@query(
    "request_check",
    f"""
with t as (
  select *, {sq.trim_ws('text')} as q from conversations)
select conv_id, turn, case
    when turn >= 5 then 'not_json'
    when role = 'system' then 'not_an_object'
    when role = 'assistant' and turn = 1 then 'unexpected_field'
    when role = 'assistant' and turn = 3 then 'context_not_text'
    when role = 'assistant' and turn = 2 then 'question_not_text'
    when q = '' then 'question_empty' when length(q) > 1200 then 'question_too_long'
    else 'ok' end as verdict
from t""",
)
def request_check(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    reply = F.col("role") == "assistant"
    body = (
        F.when(F.col("role") == "system", F.to_json(F.array("text")))
        .when(
            reply & (F.col("turn") == 1),
            F.to_json(F.struct(F.col("text").alias("pregunta"), F.lit(1).alias("extra"))),
        )
        .when(
            reply & (F.col("turn") == 3),
            F.to_json(F.struct(F.col("text").alias("pregunta"), F.lit(7).alias("sector"))),
        )
        .when(reply & (F.col("turn") == 2), F.to_json(F.struct(F.lit(5).alias("pregunta"))))
        .otherwise(
            F.to_json(F.struct(F.col("text").alias("pregunta"), F.lit("x").alias("ciudad")))
        )
    )
    content_type = F.when(F.col("turn") >= 5, "text/plain").otherwise(
        "application/json; charset=utf-8"
    )
    return turns.withColumn("doc", rq.fields(body)).select(
        "conv_id",
        "turn",
        F.coalesce(rq.request_verdict(content_type, F.col("doc")), F.lit("ok")).alias("verdict"),
    )


def _visit_body(extra: bool, language, errors):
    fields = {n: F.lit("x") for n in lx.VISIT_TEXT_FIELDS}
    fields["visit_id"] = F.concat(F.lit("v"), F.col("event_id"))
    fields["language"] = language
    fields["timestamp"] = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    fields["acciones"] = F.struct(
        *[(errors if c == "errores" else F.lit(0)).alias(c) for c in lx.VISIT_COUNTERS]
    )
    if extra:
        fields["extra"] = F.lit(1)
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


@query(
    "visit_check",
    """
select event_id, case event_type when 'signup' then 'unexpected_field' when 'view' then 'id_mismatch'
       when 'error' then 'field_not_text' when 'purchase' then 'bad_counters' else 'ok' end as verdict
from events""",
)
def visit_check(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    body = (
        F.when(kind == "signup", _visit_body(True, F.lit("es"), F.lit(0)))
        .when(kind == "error", _visit_body(False, F.lit(3), F.lit(0)))
        .when(kind == "purchase", _visit_body(False, F.lit("es"), F.lit("many")))
        .otherwise(_visit_body(False, F.lit("es"), F.col("value")))
    )
    doc_id = F.concat(F.when(kind == "view", "w").otherwise("v"), F.col("event_id"))
    return (
        events(spark, d)
        .withColumn("doc", rq.fields(body))
        .select(
            "event_id",
            F.coalesce(rq.visit_verdict(doc_id, F.col("doc")), F.lit("ok")).alias("verdict"),
        )
    )


@query(
    "immutable_diff",
    """
select event_id, case event_type when 'signup' then 'immutable_field' when 'error' then 'immutable_field'
       when 'purchase' then 'bad_counters' else 'ok' end as verdict
from events""",
)
def immutable_diff(spark: SparkSession, d: str) -> DataFrame:
    """Stored visit against its update: only counters may move."""
    kind = F.col("event_type")
    old = _visit_body(False, F.lit("es"), F.lit(0))
    new = (
        F.when(kind == "signup", _visit_body(True, F.lit("es"), F.lit(0)))
        .when(kind == "error", _visit_body(False, F.lit("en"), F.lit(0)))
        .when(kind == "purchase", _visit_body(False, F.lit("es"), F.lit("many")))
        .otherwise(_visit_body(False, F.lit("es"), F.col("value")))
    )
    verdict = rq.visit_update_verdict(F.col("old"), F.col("new"))
    return (
        events(spark, d)
        .withColumns({"old": rq.fields(old), "new": rq.fields(new)})
        .select("event_id", F.coalesce(verdict, F.lit("ok")).alias("verdict"))
    )


@query(
    "user_update_check",
    """
select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 'reserved_field'
       when 'BUILDING' then 'unexpected_field' when 'FURNITURE' then 'wrong_type' else 'ok' end as verdict,
       case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'unexpected_field' else 'ok' end
         as create_verdict
from customer""",
)
def user_update_check(spark: SparkSession, d: str) -> DataFrame:
    segment = F.col("c_mktsegment")

    def body(**extra):
        fields = {"email": F.col("c_name"), "ciudadActual": F.lit("Donostia"), **extra}
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    old = body(tipoCuenta=F.lit("free"))
    new = (
        F.when(segment == "AUTOMOBILE", body(tipoCuenta=F.lit("premium")))
        .when(segment == "BUILDING", body(tipoCuenta=F.lit("free"), color=F.lit("red")))
        .when(segment == "FURNITURE", body(tipoCuenta=F.lit("free"), esHosteleria=F.lit("yes")))
        .otherwise(body(tipoCuenta=F.lit("free"), sectorUsuario=F.lit("limpieza")))
    )
    created = (
        F.when(segment == "BUILDING", body(color=F.lit("red")))
        .when(segment == "MACHINERY", body(role=F.lit("admin")))
        .otherwise(body(esHosteleria=F.lit(True)))
    )
    docs = {"old": rq.fields(old), "new": rq.fields(new), "created": rq.fields(created)}
    update = rq.user_update_verdict(F.col("old"), F.col("new"))
    return (
        table(spark, d, "customer")
        .withColumns(docs)
        .select(
            "c_custkey",
            F.coalesce(update, F.lit("ok")).alias("verdict"),
            F.coalesce(rq.user_create_verdict(F.col("created")), F.lit("ok")).alias(
                "create_verdict"
            ),
        )
    )


@query(
    "owner_view",
    "select o_orderkey, o_orderstatus from orders where o_custkey = 7",
)
def owner_view(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one caller; the filter reaches the scan."""
    return rq.owned(table(spark, d, "orders"), "o_custkey", F.lit(7)).select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    "visit_routing",
    """
with e as (
  select *, user_id || '_' || strftime(ts, '%Y%m%d') as load_id,
         row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as rn
  from events)
select load_id, event_id, case when event_type in ('signup', 'purchase') then 'user' else 'anonymous' end
         as target,
       case when event_type in ('signup', 'purchase') then floor(value * 50 + 0.5)::bigint else 0 end as load_ms,
       case when value * 50 < 1000 then '0-1s' when value * 50 < 3000 then '1-3s'
            when value * 50 < 5000 then '3-5s' else '>5s' end as load_bucket,
       case when (props->>'$.k')::int * 20 <= 767 then 'movil'
            when (props->>'$.k')::int * 20 <= 1024 then 'tablet' else 'escritorio' end as device_class,
       strftime(ts, '%Y-%m-%d %H:00') as started_hour,
       strftime(ts, '%Y%m%d_%H%M%S') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') || '_' || user_id
         as visit_id
from e where rn = 1""",
)
def visit_routing(spark: SparkSession, d: str) -> DataFrame:
    """One visit per page load, kept with the account or as an anonymous session."""
    loads = events(spark, d).withColumn(
        "load_id", F.concat_ws("_", F.col("user_id"), F.date_format("ts", "yyyyMMdd"))
    )
    first = loads.groupBy("load_id").agg(
        F.min_by(F.struct(*loads.drop("load_id").columns), F.struct("ts", "event_id")).alias("e")
    )
    v = first.select("load_id", "e.*")
    signed_in = F.col("event_type").isin("signup", "purchase")
    ms = F.col("value") * 50
    width = F.get_json_object("props", "$.k").cast("int") * 20
    return v.select(
        "load_id",
        "event_id",
        F.when(signed_in, "user").otherwise("anonymous").alias("target"),
        F.when(signed_in, rules.round_half_up(ms)).otherwise(0).alias("load_ms"),
        rules.load_bucket(ms).alias("load_bucket"),
        rules.device_class(width).alias("device_class"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00").alias("started_hour"),
        F.concat_ws("_", F.date_format("ts", "yyyyMMdd_HHmmssSSS"), F.col("user_id")).alias(
            "visit_id"
        ),
    )


SEARCH_DOMAINS = ("example.com", "example.org")


def stored_responses(spark: SparkSession, d: str) -> DataFrame:
    """Pages as stored search responses."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    web = [
        F.struct(F.struct(F.col("url").alias("uri"), host.alias("title")).alias("web")),
        F.struct(F.struct(F.lit("").alias("uri"), F.lit("x").alias("title")).alias("web")),
        F.struct(
            F.struct(F.lit("https://www.other.tld/a").alias("uri"), host.alias("title")).alias("web")
        ),
    ]
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.when(F.col("url").contains("#top"), "MAX_TOKENS")
                    .otherwise("STOP")
                    .alias("finishReason"),
                    F.struct(
                        F.array(
                            F.struct(F.lit(" ").alias("text")),
                            F.struct(
                                F.when(F.length(title) < 60, "").otherwise(title).alias("text")
                            ),
                        ).alias("parts")
                    ).alias("content"),
                    F.struct(
                        F.array(*web).alias("groundingChunks"),
                        F.array(title).alias("webSearchQueries"),
                    ).alias("groundingMetadata"),
                )
            ).alias("candidates")
        )
    )
    return table(spark, d, "pages").select("page_id", "url", title.alias("title"), body.alias("body"))


def triaged(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_responses(spark, d)
    return an.triage(
        rows,
        enabled=F.col("url").startswith("https"),
        labour=rules.labour_question(F.col("title"), ("th", "en"), ("whst",)),
        has_key=~F.col("url").contains("utm"),
        http_status=F.when(F.col("url").endswith(".html"), 503).otherwise(200),
        body=F.col("body"),
        domains=SEARCH_DOMAINS,
    )


TRIAGE_SQL = f"""
resp as (
  select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
         regexp_extract(url, '^https?://([^/]+)', 1) as h from pages),
resn as (
  select *, {sq.norm('title')} as nt, regexp_matches(h, '(^|\\.)example\\.(com|org)$') as ok from resp),
triaged as (
  select *, case when not starts_with(url, 'https') then 'web_fallback_disabled'
     when nt = '' or contains(nt, 'whst') or not {sq.has_any('nt', ['th', 'en'])} then 'not_labor_question'
     when contains(url, 'utm') then 'missing_api_key'
     when ends_with(url, '.html') then 'gemini_search_http_503'
     when contains(url, '#top') then 'gemini_search_max_tokens'
     when not ok then 'no_allowed_official_sources'
     when length(title) < 60 then 'empty_response' else 'web_grounded' end as reason
  from resn)
"""


@query(
    "search_triage",
    f"""
with {TRIAGE_SQL}
select page_id, reason, reason = 'web_grounded' as used,
       case when reason = 'web_grounded' then {sq.trim_ws('title')} else '' end as answer,
       case when ok then 2 else 0 end as n_sources
from triaged""",
)
def search_triage(spark: SparkSession, d: str) -> DataFrame:
    return triaged(spark, d).select(
        "page_id", "reason", "used", F.coalesce("answer", F.lit("")).alias("answer"),
        F.size("official").alias("n_sources"),
    )


@query(
    "search_sources",
    f"""
with {TRIAGE_SQL}
select page_id, 'web_official_1' as id, h as title, url, 'web_official' as doc_type
from triaged where reason = 'web_grounded'
union all
select page_id, 'web_official_2', h, 'https://www.other.tld/a', 'web_official'
from triaged where reason = 'web_grounded'""",
)
def search_sources(spark: SparkSession, d: str) -> DataFrame:
    return an.source_rows(triaged(spark, d), ["page_id"])
