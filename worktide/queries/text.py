"""Text queries over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import extract as ex
from worktide.functions import rules, text as tx
from worktide.queries import sqltext as sq
from worktide.queries.registry import query
from worktide.sources.tables import table


@query(
    "text_normalize",
    f"""
select doc_id, md5({sq.norm('text')}) as digest, length({sq.norm('text')})::int as n
from documents""",
)
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    norm = tx.normalize(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(norm).alias("digest"), F.length(norm).alias("n")
    )


@query(
    "text_ids",
    f"""
with n as (select p_partkey, p_name || ' / ' || p_brand || '!' as s, p_type as t,
                  'docs/in/' || p_name || '.v1.pdf' as path from part)
select p_partkey, replace({sq.norm('s')}, ' ', '_') as id, replace({sq.norm('s')}, ' ', '-') as slug,
       upper(t[1]) || lower(t[2:]) as title, split_part(path, '/', 3) as base,
       regexp_replace(split_part(path, '/', 3), '\\.pdf$', '') as stem,
       'convenio' as fallback,
       substr(replace({sq.norm('repeat(s, 12)')}, ' ', '_'), 1, 120) || '_'
         || md5(replace({sq.norm('repeat(s, 12)')}, ' ', '_')) as long_id
from n""",
)
def text_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))
    path = F.concat(F.lit("docs/in/"), "p_name", F.lit(".v1.pdf"))
    return table(spark, d, "part").select(
        "p_partkey",
        tx.identifier(raw).alias("id"),
        tx.slug(raw).alias("slug"),
        tx.title_case(F.col("p_type")).alias("title"),
        tx.base_name(path).alias("base"),
        tx.strip_extension(tx.base_name(path)).alias("stem"),
        tx.identifier(F.lit(None).cast("string")).alias("fallback"),
        tx.identifier(F.repeat(raw, 12)).alias("long_id"),
    )


CRLF = "replace(text, chr(10), chr(13) || chr(10))"


@query(
    "text_clean",
    f"""
with c as (
  select doc_id, {sq.squeeze(f"replace({CRLF}, chr(13) || chr(10), chr(10))")} as a,
         {sq.squeeze(f"replace({CRLF}, chr(13), chr(10))")} as b, {sq.compact(CRLF)} as c
  from documents)
select doc_id, md5(a) as extracted, length(a)::int as n_extracted, md5(b) as published,
       length(b)::int as n_published, md5(c) as one_line, length(c)::int as n_one_line
from c""",
)
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    """The stored text has LF only; CRLF is put back to tell both cleanings apart."""
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    a, b, c = tx.clean_extracted(crlf), tx.clean_published(crlf), tx.compact(crlf)
    return table(spark, d, "documents").select(
        "doc_id",
        F.md5(a).alias("extracted"),
        F.length(a).alias("n_extracted"),
        F.md5(b).alias("published"),
        F.length(b).alias("n_published"),
        F.md5(c).alias("one_line"),
        F.length(c).alias("n_one_line"),
    )


SNIPPET = "Consulta {title} en {place}: {nothing}jornada, vacaciones y permisos. {body}"


@query(
    "meta_snippet",
    f"""
with t as (
  select page_id, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) as title,
         regexp_extract(url, '^https?://([^/]+)', 1) as place,
         {sq.compact("regexp_extract(html, '(?s)<article>(.*?)</h1>', 1)")} as body from pages),
f as (
  select *, 'Consulta ' || title || ' en ' || place || ': jornada, vacaciones y permisos. ' || body as s
  from t),
c as (
  select *, case when length(s) > 230
    then regexp_replace(substr(s, 1, 227), '{sq.WS}+[^\\s]*$', '') || '...' else s end as description
  from f)
select page_id, {sq.escape('title')} as title, {sq.escape('description')} as description,
       length(description)::int as n,
       replace(title, '<', '\\u003c') as json_title
from c""",
)
def meta_snippet(spark: SparkSession, d: str) -> DataFrame:
    title = ex.title_of(F.col("html"))
    body = tx.compact(F.regexp_extract("html", r"(?s)<article>(.*?)</h1>", 1))
    place = F.regexp_extract("url", "^https?://([^/]+)", 1)
    description = tx.ellipsis(
        tx.interpolate(SNIPPET, {"title": title, "place": place, "body": body})
    )
    return table(spark, d, "pages").select(
        "page_id",
        tx.escape_markup(title).alias("title"),
        tx.escape_markup(description).alias("description"),
        F.length(description).alias("n"),
        tx.escape_json_text(title).alias("json_title"),
    )


TEST_DOMAINS = "example.com, example.net ,"
TEST_ORIGINS = ("https://therin.example.com", "https://therin.example.net")
LOCAL_ORIGIN = r"^http://(localhost|127\.0\.0\.1)(:[0-9]+)?$"


@query(
    "url_host",
    """
with h as (
  select page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', '')) as host,
         lower(split_part(regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) || '-ES', '-', 1)) as lang,
         regexp_extract(url, '^(https?://[^/]+)', 1) as origin
  from pages)
select page_id, host, lang,
       host in ('example.com', 'example.net', 'boe.es') or host like '%.example.com'
         or host like '%.example.net' or host like '%.boe.es' as strict_ok,
       contains(host || '.other.tld', 'example.com') or contains(host || '.other.tld', 'example.net')
         as contained_ok,
       origin in ('https://therin.example.com', 'https://therin.example.net') as origin_ok
from h""",
)
def url_host(spark: SparkSession, d: str) -> DataFrame:
    """Hosts, language segment and both domain modes.

    The allow list is the union of a default and a comma-separated setting.
    """
    domains = ["boe.es", *(p.strip() for p in TEST_DOMAINS.split(",") if p.strip())]
    host = tx.host(F.col("url"))
    lang = tx.primary_language(
        F.concat(F.regexp_extract("url", "^https?://[^/]+/([^/]+)/", 1), F.lit("-ES"))
    )
    return table(spark, d, "pages").select(
        "page_id",
        host.alias("host"),
        lang.alias("lang"),
        rules.official_domain(host, domains).alias("strict_ok"),
        rules.official_domain(F.concat(host, F.lit(".other.tld")), domains, "contains").alias(
            "contained_ok"
        ),
        rules.allowed_origin(
            F.regexp_extract("url", "^(https?://[^/]+)", 1), TEST_ORIGINS, LOCAL_ORIGIN
        ).alias("origin_ok"),
    )


@query(
    "allowed_domains",
    """
with c as (select distinct split_part(split_part(url, '/', 3), '?', 1) as h, page_id from pages),
l as (
  select page_id, h || ', ' || upper(h) || ' ,,' || 'boe.es' as setting from c)
select page_id,
       array_to_string(list_sort(list_distinct(
         list_concat(['boe.es', 'bocm.es'],
           list_filter(list_transform(string_split(lower(setting), ','), lambda x: trim(x)),
                       lambda x: x <> '')))), '|') as domains
from l""",
)
def allowed_domains(spark: SparkSession, d: str) -> DataFrame:
    """Defaults united with a configured list, per page host."""
    host = F.regexp_extract("url", "^https?://([^/?]+)", 1)
    setting = F.concat(host, F.lit(", "), F.upper(host), F.lit(" ,,boe.es"))
    configured = tx.split_list(F.lower(setting))
    union = F.array_union(F.array(F.lit("boe.es"), F.lit("bocm.es")), configured)
    return table(spark, d, "pages").select("page_id", rules.set_key(union).alias("domains"))


LANG_CUES = {
    "de": ("und", "der", "nicht"),
    "fr": ("queque", "des", "pour"),
    "es": ("para", "los", "una"),
}


def _cue(words) -> str:
    return f"regexp_matches(lower(text), '\\b({'|'.join(words)})\\b')"


@query(
    "lang_cue",
    f"""
select doc_id, case when {_cue(LANG_CUES['de'])} then 'de' when {_cue(LANG_CUES['fr'])} then 'fr'
       when {_cue(LANG_CUES['es'])} then 'es' else 'en' end as detected, lang,
       {_cue(lx.BASQUE_CUES)} as basque
from documents""",
)
def lang_cue(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        rules.language_of_question(text, LANG_CUES, "en").alias("detected"),
        "lang",
        (rules.language_of_question(text) == "euskera").alias("basque"),
    )


MISSING = lx.NOT_FOUND
LICENCE_STARTS = ("licensed under", "released under", "licen[sc]e")
CODE_KEYWORD = "the|der|les"
CODE_VALUE = "[0-9]{3,}"
SOURCES = ("Apache License", "GNU General Public License", "MIT License")
MAIL_HOSTS = ("mail1.example.com", "mail2.example.com", "mail3.example.com")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Content fields of each document by the test patterns; absent ones stay "not found"."""

    def or_missing(c):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))

    text = F.col("text")
    licence = ex.first_fragment(text, LICENCE_STARTS, 60)
    code = ex.fragment_with(text, CODE_KEYWORD, CODE_VALUE, CODE_VALUE, 80)
    mail = F.when(text.contains("@"), ex.first_match(text, r"[A-Za-z0-9.]+@[a-z0-9.]+"))
    share = F.when(
        text.contains("%%%"),
        F.regexp_replace(ex.first_match(text, r"[A-Za-z,.]+ *%%%"), " ", ""),
    )
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.length(text).alias("n_chars"),
        or_missing(licence).alias("licencia"),
        or_missing(code).alias("codigo"),
        or_missing(mail).alias("correo"),
        or_missing(share).alias("porcentaje"),
        ex.official_source(text, SOURCES).alias("fuente_oficial"),
        ex.official_url(text, MAIL_HOSTS, MAIL_HOSTS).alias("fuente_url"),
    )


FIELDS = ("licencia", "codigo", "correo", "porcentaje", "fuente_oficial", "fuente_url")

_STARTS = " ".join(
    f"when regexp_matches(text, '(?i){p}') then substr(regexp_extract(text, '(?is){p}.{{0,60}}'), 1, 60)"
    for p in LICENCE_STARTS
)
_LINE = sq.compact("text")
_BARE = "|".join(h.replace(".", "\\.") for h in MAIL_HOSTS)
EXTRACT_SQL = f"""
hits as (
  select doc_id, regexp_split_to_array(text, '(?i){CODE_KEYWORD}') as gaps,
         regexp_extract_all(text, '(?i){CODE_KEYWORD}') as kws from documents),
starts as (
  select doc_id, unnest(range(1, len(kws) + 1)) as i, gaps, kws from hits),
frag as (
  select s.doc_id, i, {sq.compact('''substr(text, (1 + list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(kws[1:i - 1], lambda x: length(x))), 0))::bigint, 80)''')} as f
  from starts s join documents d on d.doc_id = s.doc_id),
code as (
  select doc_id, arg_min(f, i) as f from frag where regexp_matches(f, '{CODE_VALUE}') group by 1),
x as (
  select doc_id, lang, source, length(text)::int as n_chars,
         coalesce(nullif({sq.compact(f"case {_STARTS} else '' end")}, ''), '{MISSING}') as licencia,
         coalesce(nullif(code.f, ''), '{MISSING}') as codigo,
         coalesce(nullif(regexp_extract(text, '[A-Za-z0-9.]+@[a-z0-9.]+'), ''), '{MISSING}') as correo,
         coalesce(nullif(replace(regexp_extract(text, '[A-Za-z,.]+ *%%%'), ' ', ''), ''), '{MISSING}')
           as porcentaje,
         case when contains({_LINE}, 'Apache License') then 'Apache License'
              when contains({_LINE}, 'GNU General Public License') then 'Gnu General Public License'
              when contains({_LINE}, 'MIT License') then 'Mit License' end as src,
         nullif(regexp_extract({_LINE}, '(?i)\\b(www\\.)?({_BARE})[^\\s\\x{{00A0}}\\x{{FEFF}})]*'), '') as bare
  from documents left join code using (doc_id)),
extracted as (
  select * exclude (src, bare),
         coalesce('Referencia de publicacion localizada en el PDF: ' || src || '.', '{MISSING}')
           as fuente_oficial,
         coalesce('https://' || regexp_replace(bare, '[.,;]+$', ''), '{MISSING}') as fuente_url
  from x)
"""
SCORE_SQL = " + ".join(f"({f} <> '{MISSING}')::int" for f in FIELDS)


@query(
    "field_extract",
    f"with {EXTRACT_SQL} select *, {SCORE_SQL} as score from extracted",
)
def field_extract(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).withColumn(
        "score", ex.content_score([F.col(f) for f in FIELDS])
    )


@query(
    "year_strip",
    f"""
with t as (select p_partkey, p_name || ' ' || (1990 + p_size) || ' v' || p_size || '_2020' as s from part)
select p_partkey, {sq.trim_ws(f"regexp_replace(regexp_replace(s, '\\b(19|20)[0-9]{{2}}\\b', '', 'g'), '{sq.WS}{{2,}}', ' ', 'g')")} as public_name,
       regexp_matches(s, '\\b(19|20)[0-9]{{2}}\\b') as had_year, false as has_year
from t""",
)
def year_strip(spark: SparkSession, d: str) -> DataFrame:
    """Public names hold no stand-alone year."""
    raw = F.concat(
        "p_name", F.lit(" "), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(" v"),
        F.col("p_size").cast("string"), F.lit("_2020"),
    )
    public = tx.without_years(raw)
    return table(spark, d, "part").select(
        "p_partkey",
        public.alias("public_name"),
        raw.rlike(tx.YEAR).alias("had_year"),
        public.rlike(tx.YEAR).alias("has_year"),
    )
