"""Publication queries over documents, labels, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import extract as ex
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.staging import stage
from worktide.plans import publish as pb
from worktide.queries import sqltext as sq
from worktide.queries.registry import query
from worktide.queries.text import EXTRACT_SQL, FIELDS, MISSING, extracted
from worktide.sources.tables import table

LANG_PLACE = {"en": "GIPUZKOA", "fr": "MADRID", "es": "SEVILLA"}


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Labels as manual rows: quality 1 is verified, toxic 1 means skip."""
    return table(spark, d, "labels").select(
        "doc_id",
        (F.col("quality") == 1).alias("verified"),
        (F.col("toxic") == 1).alias("skip"),
        F.concat(F.lit("Manual "), F.col("doc_id")).alias("licencia"),
        F.when(F.col("toxic") == 0, "Codigo manual").alias("codigo"),
    )


@query(
    "override_merge",
    f"""
with {EXTRACT_SQL}
select doc_id, coalesce(quality = 1, false) as manual_verified,
       case when quality = 1 then 'Manual ' || doc_id else licencia end as licencia,
       case when quality = 1 and toxic = 0 then 'Codigo manual' else codigo end as codigo,
       case when quality = 1 and toxic = 0 then 'licencia|codigo' when quality = 1 then 'licencia'
            else '' end as manual_fields
from extracted left join labels using (doc_id)""",
)
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = extracted(spark, d).select("doc_id", "licencia", "codigo")
    merged = pb.apply_overrides(rows, overrides(spark, d), "doc_id", ["licencia", "codigo"])
    return merged.withColumn("manual_fields", F.array_join("manual_fields", "|"))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a file name that carries sector, place and junk markers."""
    source = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    sector = (
        F.when(source < 6, "hosteleria")
        .when(source < 11, "alojamientos")
        .when(source < 15, "limpieza")
        .when(source < 19, "transporte")
    )
    name = (
        F.when(F.col("source") == "src13", "Estatuto_Trabajadores")
        .otherwise(F.concat(F.lit("Convenio "), F.coalesce(sector, F.lit("x"))))
    )
    manual = table(spark, d, "labels").select(
        "doc_id",
        (F.col("quality") == 1).alias("manual_verified"),
        (F.col("toxic") == 1).alias("skip"),
    )
    return (
        table(spark, d, "documents")
        .join(manual, "doc_id", "left")
        .select(
            "doc_id", "lang", "source", "text",
            F.concat(
                name, F.lit(" "), F.col("doc_id").cast("string"),
                F.when(F.col("text").contains("###"), " parte 2").otherwise(""), F.lit(".pdf"),
            ).alias("file_name"),
            rules.lookup(F.col("lang"), LANG_PLACE).alias("province"),
            F.array_compact(F.array(sector)).alias("sector_keys"),
            F.coalesce("manual_verified", F.lit(False)).alias("manual_verified"),
            F.coalesce("skip", F.lit(False)).alias("skip"),
            F.lit(None).cast("string").alias("skip_status"),
            F.lit(None).cast("string").alias("skip_reason"),
        )
    )


def triaged(spark: SparkSession, d: str) -> DataFrame:
    sector = pb.pick_sector(tx.normalize(F.col("file_name")), F.col("sector_keys"))
    return pb.triage(file_rows(spark, d).withColumn("sector", sector), F.col("sector"), 2000, 500)


TRIAGE_SQL = """
f as (
  select doc_id, lang, source, text, regexp_extract(source, '([0-9]+)$', 1)::int as sn,
         coalesce(quality = 1, false) as verified, coalesce(toxic = 1, false) as skip
  from documents left join labels using (doc_id)),
s as (
  select *, case when sn < 6 then 'hosteleria' when sn < 11 then 'alojamientos'
                 when sn < 15 then 'limpieza' when sn < 19 then 'transporte' end as sector,
         case lang when 'en' then 'GIPUZKOA' when 'fr' then 'MADRID' when 'es' then 'SEVILLA' end
           as province
  from f),
triaged as (
  select *, case when skip then 'no_publicar:Documento marcado manualmente como no publicable.'
     when source = 'src13' then 'no_publicar:No es convenio provincial especifico.'
     when not verified and contains(text, '###') then 'corregir:PDF partido o parte no fusionada.'
     when not verified and (province is null or sector is null)
       then 'corregir:Metadata ambigua o rota en nombre de archivo.'
     when sector is null then 'corregir:Sector no detectado.'
     when length(text) <= 500 then 'no_publicar:Baja calidad de extraccion de texto.'
     else 'candidate:' end as v
  from s)
"""


@query(
    "doc_triage",
    f"""
with {TRIAGE_SQL}
select doc_id, split_part(v, ':', 1) as status, split_part(v, ':', 2) as reason,
       case when length(text) > 2000 then 'alta' when length(text) > 500 then 'media' else 'baja' end
         as quality
from triaged""",
)
def doc_triage(spark: SparkSession, d: str) -> DataFrame:
    return triaged(spark, d).select(
        "doc_id",
        "status",
        F.coalesce("reason", F.lit("")).alias("reason"),
        rules.quality_tier(F.length("text"), 2000, 500).alias("quality"),
    )


CUES = ("the", "and", "que", "der", "tion", "en", "la")


def scored(spark: SparkSession, d: str) -> DataFrame:
    norm = tx.normalize(F.col("text"))
    score = F.lit(0)
    for cue in CUES:
        score = score + F.coalesce(F.contains("__norm", F.lit(cue)).cast("int"), F.lit(0))
    return (
        triaged(spark, d)
        .withColumn("__norm", norm)
        .select(
            "doc_id",
            F.concat_ws("-", "sector", F.lower("province")).alias("slug"),
            F.concat_ws(" ", F.lit("Convenio de"), "sector", F.lit("de"), "province").alias("title"),
            "sector",
            "province",
            "status",
            "reason",
            score.alias("score"),
            F.floor(F.length("text") / 200).cast("int").alias("end_year"),
            F.col("doc_id").alias("ord"),
        )
    )


def selected(spark: SparkSession, d: str) -> DataFrame:
    return pb.select_latest(stage(scored(spark, d)))


_SCORE = " + ".join(f"contains(norm, '{c}')::int" for c in CUES)
SELECT_SQL = f"""
{TRIAGE_SQL},
n as (select *, {sq.norm('text')} as norm from triaged),
sc as (
  select doc_id, concat_ws('-', sector, lower(province)) as slug, sector, province,
         concat_ws(' ', 'Convenio de', sector, 'de', province) as title,
         split_part(v, ':', 1) as st0, split_part(v, ':', 2) as re0, {_SCORE} as score,
         (length(text) // 200)::int as end_year
  from n),
g as (
  select *, case when st0 <> 'candidate' or score >= 4 then st0 when score >= 2 then 'corregir'
                 else 'no_publicar' end as st1,
         case when st0 = 'candidate' and score < 4
              then 'Contenido tematico insuficiente para publicar (' || score || '/11 bloques localizados).'
              else re0 end as re1
  from sc),
c as (
  select doc_id, max(end_year) over (partition by slug order by doc_id
                                rows between unbounded preceding and 1 preceding) as before_,
         row_number() over (partition by slug order by end_year desc, doc_id) as rn
  from g where st1 = 'candidate'),
picked as (
  select g.*, case when st1 <> 'candidate' then st1 when rn = 1 then 'selected' else 'no_publicar' end
           as status,
         case when st1 <> 'candidate' then re1 when rn = 1 then ''
              when before_ is null or g.end_year > before_
                then 'Duplicado para ' || g.slug || '; sustituido por documento mas reciente.'
              else 'Duplicado para ' || g.slug || '; existe documento igual o mas reciente.' end as reason
  from g left join c using (doc_id))
"""


@query(
    "publish_select",
    f"with {SELECT_SQL} select doc_id, slug, score, end_year, status, reason from picked",
)
def publish_select(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).select(
        "doc_id", "slug", "score", "end_year", "status",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query(
    "publish_listing",
    f"""
with {SELECT_SQL},
e as (
  select slug, title, sector, province,
         list_position(['hosteleria', 'alojamientos', 'limpieza', 'transporte'], sector) as group_position
  from picked where status = 'selected' and sector is not null)
select *, row_number() over (order by group_position, province nulls first, slug) as position,
       coalesce(nullif(list_position({list(lx.PRIORITY_SLUGS)}, slug), 0), 0) as priority
from e""",
)
def publish_listing(spark: SparkSession, d: str) -> DataFrame:
    entries = selected(spark, d).where("status = 'selected'").select(
        "slug", "title", "sector", "province"
    )
    listed = pb.listing(entries).withColumn(
        "priority",
        F.array_position(F.array(*[F.lit(p) for p in lx.PRIORITY_SLUGS]), F.col("slug")).cast("int"),
    )
    return listed.orderBy(*pb.publish_order()).withColumn(
        "group_position", F.col("group_position").cast("int")
    )


@query(
    "inventory_summary",
    f"""
with {SELECT_SQL}
select count(*) filter (status = 'selected') as published,
       count(*) filter (status = 'corregir') as needs_corrections,
       count(*) filter (status = 'no_publicar') as do_not_publish,
       count(*) filter (starts_with(reason, 'Duplicado')) as replaced
from picked""",
)
def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).agg(
        F.count_if(F.col("status") == "selected").alias("published"),
        F.count_if(F.col("status") == "corregir").alias("needs_corrections"),
        F.count_if(F.col("status") == "no_publicar").alias("do_not_publish"),
        F.count_if(F.col("reason").startswith("Duplicado")).alias("replaced"),
    )


@query(
    "audit_report",
    f"""
with {SELECT_SQL},
k as (select status, count(*) as n from picked group by 1)
select 1 as section, status as ord, '- ' || status || ': ' || n as line from k
union all
select case status when 'corregir' then 2 else 3 end, doc_id::varchar, '- ' || doc_id || ': ' || reason
from picked where status in ('corregir', 'no_publicar')
union all
select 4, slug, '- ' || slug || ': ' || issue from
  (select slug, 'Falta contenido.' as issue from picked where status = 'selected' and score < 6)""",
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    records = stage(selected(spark, d)).withColumn("name", F.col("doc_id").cast("string"))
    summary = records.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("value"))
    issues = records.where("status = 'selected' and score < 6").select(
        F.col("slug").alias("name"), F.lit("Falta contenido.").alias("issue")
    )
    return pb.audit_lines(summary, records.select("name", "status", "reason"), issues)


# ---- topics and coverage -------------------------------------------------

TOPICS = (
    lx.Topic("licencia", "licencia", "Licencia de {title}", ("fuente_oficial", "licencia"),
             "do_not_generate"),
    lx.Topic("codigo", "codigo", "Codigo de {title}", ("fuente_oficial", "codigo"),
             "generate_prudent"),
    lx.Topic("correo", "correo", "Correo de {title}", ("correo",), "do_not_generate"),
)
VALIDITY = "fuente_oficial"


def _topic_sql(t: lx.Topic) -> str:
    missing = ", ".join(f"case when {f} = '{MISSING}' then '{f}' end" for f in t.minimum_data)
    prudent = f"{VALIDITY} <> '{MISSING}'" if t.fallback_policy == "generate_prudent" else "false"
    return f"""
select doc_id, lang, '{t.slug}' as topic,
       array_to_string(list_filter([{missing}], lambda x: x is not null), '|') as missing,
       {prudent} as prudent, '/convenios/' || doc_id || '/{t.slug}' as url,
       replace('{t.title_pattern}', '{{title}}', source) as page_title
from extracted"""


PLAN_SQL = f"""
{EXTRACT_SQL},
rows_ as ({' union all '.join(_topic_sql(t) for t in TOPICS)}),
plan as (
  select *, case when missing = '' then 'ready' when prudent then 'prudent' else 'blocked' end as status
  from rows_)
"""


def plan(spark: SparkSession, d: str) -> DataFrame:
    return pb.topic_plan(extracted(spark, d), "doc_id", "source", TOPICS, validity=VALIDITY)


@query(
    "topic_plan",
    f"""
with {PLAN_SQL}
select doc_id, topic, status, missing, url, page_title, false as published from plan""",
)
def topic_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan(spark, d).select(
        "doc_id", "topic", "status", F.array_join("missing", "|").alias("missing"), "url",
        "page_title", "published",
    )


@query(
    "topic_histogram",
    f"""
with {PLAN_SQL}
select lang, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'prudent') as prudent,
       count(*) filter (status = 'blocked') as blocked
from plan group by 1""",
)
def topic_histogram(spark: SparkSession, d: str) -> DataFrame:
    return (
        plan(spark, d)
        .groupBy("lang")
        .pivot("status", ["ready", "prudent", "blocked"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


_UNPIVOT = " union all ".join(
    f"select doc_id, lang, '{f}' as field, {f} <> '{MISSING}' as ok from extracted" for f in FIELDS
)


PRUDENT = "Dato no localizado; consulta el documento completo"


@query(
    "field_display",
    f"""
with {EXTRACT_SQL}
select doc_id, case when licencia = '{MISSING}' then '{PRUDENT}' else licencia end as licencia,
       case when correo = '{MISSING}' then 'no_localizado' else 'extraido' end as correo
from extracted""",
)
def field_display(spark: SparkSession, d: str) -> DataFrame:
    """Display text and state label of extracted fields."""
    return extracted(spark, d).select(
        "doc_id",
        rules.shown(F.col("licencia"), PRUDENT).alias("licencia"),
        rules.data_state(F.col("correo")).alias("correo"),
    )


@query(
    "coverage_fields",
    f"""
with {EXTRACT_SQL}, u as ({_UNPIVOT})
select lang, field, count(*) filter (ok) as extracted, count(*) filter (not ok) as missing
from u group by 1, 2""",
)
def coverage_fields(spark: SparkSession, d: str) -> DataFrame:
    return pb.coverage_by_field(extracted(spark, d), FIELDS, ["lang"])


@query(
    "coverage_rollup",
    f"""
with {EXTRACT_SQL}, u as ({_UNPIVOT})
select coalesce(lang, '*') as lang, coalesce(field, '*') as field,
       count(*) filter (ok) as extracted, count(*) filter (not ok) as missing
from u group by rollup(lang, field)""",
)
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    lines = pb.coverage_by_field(extracted(spark, d), FIELDS, ["lang"])
    return (
        lines.rollup("lang", "field")
        .agg(F.sum("extracted").alias("extracted"), F.sum("missing").alias("missing"))
        .select(
            F.coalesce("lang", F.lit("*")).alias("lang"),
            F.coalesce("field", F.lit("*")).alias("field"),
            "extracted",
            "missing",
        )
    )


@query(
    "coverage_missing",
    f"with {EXTRACT_SQL}, u as ({_UNPIVOT}) select doc_id, field from u where not ok",
)
def coverage_missing(spark: SparkSession, d: str) -> DataFrame:
    return pb.missing_fields(extracted(spark, d), "doc_id", FIELDS)


LABELS = {f: f.title() for f in FIELDS}


def _label_list(op: str) -> str:
    items = ", ".join(f"case when {f} {op} '{MISSING}' then '{LABELS[f]}' end" for f in FIELDS)
    return f"list_filter([{items}], lambda x: x is not null)"


PAGES_SQL = f"""
{EXTRACT_SQL},
pages_ as (
  select doc_id, array_to_string({_label_list('<>')}, '|') as extracted,
         array_to_string({_label_list('=')}, '|') as not_located,
         len({_label_list('<>')}) as ne, len({_label_list('=')}) as nm,
         least(count(*) over (partition by source) - 1, 4) as sector_links,
         least(count(*) over (partition by lang) - 1, 4) as province_links
  from extracted)
"""


def coverage_page_rows(spark: SparkSession, d: str) -> DataFrame:
    entries = extracted(spark, d).withColumnsRenamed({"source": "sector", "lang": "province"})
    return pb.coverage_by_page(entries, "doc_id", LABELS)


@query(
    "coverage_pages",
    f"""
with {PAGES_SQL}
select doc_id, extracted, not_located, 3::bigint as app_links, sector_links, province_links,
       2::bigint as index_links
from pages_""",
)
def coverage_pages(spark: SparkSession, d: str) -> DataFrame:
    return coverage_page_rows(spark, d).withColumns(
        {
            "extracted": F.array_join("extracted", "|"),
            "not_located": F.array_join("not_located", "|"),
        }
    )


@query(
    "coverage_totals",
    f"""
with {PAGES_SQL}
select sum(ne)::bigint as extracted, sum(nm)::bigint as missing,
       sum(5 + sector_links + province_links)::bigint as internal_links
from pages_""",
)
def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    return pb.totals(coverage_page_rows(spark, d))


_MISSING_SUM = " + ".join(f"({f} = '{MISSING}')::int" for f in FIELDS)


@query(
    "risk_report",
    f"""
with {EXTRACT_SQL}
select 'group_size' as risk, source as subject, count(*) as n from extracted group by 2 having count(*) >= 50
union all
select 'thin_pages', '', count(*) from extracted where {_MISSING_SUM} >= 5 having count(*) > 0""",
)
def risk_report(spark: SparkSession, d: str) -> DataFrame:
    return pb.risks(extracted(spark, d), FIELDS, "source", few=5, many=50)


# ---- related items, pages, routes ---------------------------------------


@query(
    "related_items",
    """
with b as (
  select p_partkey, p_brand, p_type, p_name from part),
r as (
  select a.p_partkey, 'brand' as kind, o.p_partkey as other,
         row_number() over (partition by a.p_partkey order by o.p_name, o.p_partkey) as rn
  from b a join b o on a.p_brand = o.p_brand and a.p_partkey <> o.p_partkey
  union all
  select a.p_partkey, 'type', o.p_partkey,
         row_number() over (partition by a.p_partkey order by o.p_name, o.p_partkey)
  from b a join b o on a.p_type = o.p_type and a.p_partkey <> o.p_partkey)
select p_partkey, string_agg(other::varchar, '|' order by rn) filter (kind = 'brand') as same_brand,
       string_agg(other::varchar, '|' order by rn) filter (kind = 'type') as same_type
from r where rn <= 4 group by 1""",
)
def related_items(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    both = pb.related(parts, "p_brand", "p_partkey", "p_name", out="same_brand")
    both = pb.related(both, "p_type", "p_partkey", "p_name", out="same_type")
    return both.select(
        "p_partkey",
        F.array_join("same_brand", "|").alias("same_brand"),
        F.array_join("same_type", "|").alias("same_type"),
    )


MARKERS = {**lx.PAGE_MARKERS, "language": '<html lang="en">'}
FAQ_SECTION = "<footer>"


def _marker_sql() -> str:
    lines = [
        f"select page_id, 'Falta {name}.' as issue from pages where not regexp_matches(html, '(?i){p}')"
        for name, p in MARKERS.items()
    ]
    return " union all ".join(lines)


@query(
    "page_issues",
    f"""
with h as (
  select page_id, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) as title,
         regexp_extract(html, '(?i)<meta name="description" content="([^"]+)">', 1) as descr from pages)
{_marker_sql()}
union all
select page_id, 'Falta FAQ pese a existir contenido suficiente.' from pages
where len(regexp_extract_all(html, '<p>')) >= 3 and not contains(html, '<footer>')
union all
select page_id, 'Title duplicado: ' || title from h
qualify row_number() over (partition by title order by page_id) > 1
union all
select page_id, 'Meta description duplicada: ' || descr from h
qualify row_number() over (partition by descr order by page_id) > 1""",
)
def page_issues(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = F.regexp_count("html", F.lit("<p>"))
    return pb.page_issues(
        table(spark, d, "pages"), "page_id", "html", paragraphs, FAQ_SECTION, MARKERS
    )


@query(
    "dup_titles",
    """
with h as (
  select page_id, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) as title from pages)
select page_id, title, min(page_id) over (partition by title) as first_key from h
qualify page_id > min(page_id) over (partition by title)""",
)
def dup_titles(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "pages").select("page_id", ex.title_of(F.col("html")).alias("title"))
    return pb.repeats(heads, "page_id", "title")


SITE = "https://site.example"


def slugs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        "page_id", F.concat(tx.slug(F.col("url")), F.lit("-"), F.col("page_id")).alias("slug")
    )
    return pages


@query(
    "route_table",
    f"""
with s as (
  select replace({sq.norm('url')}, ' ', '-') || '-' || page_id as slug, url from pages),
n as (
  select distinct n_name from nation)
select 0 as place, '/' || lower(n_name) as source, '/index.html' as destination from n
union all select 1, '/convenios', '/seo/convenios.html'
union all select 2, '/convenios/' || slug, '/seo/' || slug || '.html' from s
union all select 3, '**', '/index.html'""",
)
def route_table(spark: SparkSession, d: str) -> DataFrame:
    """Stored routes of an earlier run are replaced; all other stored routes stay."""
    nation = table(spark, d, "nation")
    stored = nation.select(
        F.concat(F.lit("/"), F.lower("n_name")).alias("source"),
        F.lit("/index.html").alias("destination"),
    ).unionByName(
        nation.select(
            F.concat(F.lit("/convenios/"), F.lower("n_name")).alias("source"),
            F.lit("/old.html").alias("destination"),
        )
    )
    return pb.routes(stored, slugs(spark, d))


@query(
    "site_urls",
    f"""
select 0 as place, '{SITE}/convenios' as loc
union all
select 1, '{SITE}/convenios/' || replace({sq.norm('url')}, ' ', '-') || '-' || page_id from pages""",
)
def site_urls(spark: SparkSession, d: str) -> DataFrame:
    return pb.site_urls(slugs(spark, d), SITE)


@query(
    "free_names",
    """
with n as (
  select p_partkey, replace(p_name, ' ', '_') || case when p_partkey % 4 = 0 then '_0' || (p_size % 4 + 1) else '' end
    || '.pdf' as name from part),
old as (select distinct name from n where p_partkey % 7 = 0),
f as (select * from n where p_partkey % 7 <> 0),
o as (
  select *, row_number() over (partition by name order by p_partkey)
    + case when name in (select name from old) then 1 else 0 end as k from f),
t as (
  select regexp_replace(name, '_0([1-9])\\.pdf$', '.pdf') as name,
         list(distinct regexp_extract(name, '_0([1-9])\\.pdf$', 1)::int) as taken
  from n where regexp_matches(name, '_0[1-9]\\.pdf$') group by 1),
g as (
  select o.*, list_filter(range(1, k + len(coalesce(taken, []))), lambda x: not list_contains(coalesce(taken, []), x)) as free
  from o left join t using (name))
select p_partkey, name, case when k = 1 then name else regexp_replace(name, '\\.pdf$', '') || '_'
       || case when free[k - 1] < 100 then lpad(free[k - 1]::varchar, 2, '0') else free[k - 1]::varchar end || '.pdf' end
         as target
from g""",
)
def free_names(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of the parts is stored already; some names look like numbered ones."""
    number = F.concat(F.lit("_0"), (F.col("p_size") % 4 + 1).cast("string"))
    names = table(spark, d, "part").select(
        "p_partkey",
        F.concat(
            F.replace("p_name", F.lit(" "), F.lit("_")),
            F.when(F.col("p_partkey") % 4 == 0, number).otherwise(""), F.lit(".pdf"),
        ).alias("name"),
    )
    files, old = names.where("p_partkey % 7 <> 0"), names.where("p_partkey % 7 = 0")
    return pb.free_names(files, "name", "p_partkey", F.floor(F.col("p_partkey") / 65536), old)


@query(
    "page_graph",
    f"""
with {EXTRACT_SQL},
a as (
  select doc_id, source, list_filter([
    struct_pack(q := 'Que vigencia tiene el convenio de ' || lang || ' de ' || upper(source[1]) || source[2:] || '?', a := licencia),
    struct_pack(q := 'Cuantas horas anuales tiene el convenio de ' || lang || ' de ' || upper(source[1]) || source[2:] || '?', a := codigo),
    struct_pack(q := 'Cuantos dias de vacaciones corresponden?', a := correo),
    struct_pack(q := 'Hay regla de nocturnidad?', a := porcentaje),
    struct_pack(q := 'Que permisos retribuidos hay?', a := fuente_oficial)],
    lambda x: x.a <> '{MISSING}') as items from extracted)
select doc_id, case when len(items) > 0 then 3 else 2 end as n_nodes, len(items)::int as n_items,
       coalesce(items[1].q, '') as first_question, replace(coalesce(items[1].a, ''), '<', '<') as first_answer,
       case when len(items) > 0 then '{SITE}/convenios/' || doc_id || '#faq' else '' end as faq_id,
       '{SITE}/convenios/' || doc_id as last_crumb
from a""",
)
def page_graph(spark: SparkSession, d: str) -> DataFrame:
    """Linked data of each document, read back from its JSON text."""
    missing = F.lit(MISSING)
    content = {
        "vigencia": F.col("licencia"), "jornada_anual": F.col("codigo"),
        "vacaciones": F.col("correo"), "festivos_descansos": missing, "horas_extra": missing,
        "nocturnidad": F.col("porcentaje"), "descansos": missing,
        "permisos": F.col("fuente_oficial"),
    }
    items = pb.faq(F.col("lang"), tx.title_case(F.col("source")), content, "")
    url = F.concat(F.lit(f"{SITE}/convenios/"), F.col("doc_id").cast("string"))
    graph = pb.page_graph(
        url, SITE, F.col("source"), F.col("lang"), F.col("source"), F.col("items"),
        F.array(F.lit("Vigencia"), F.lit("Jornada anual")),
    )
    rows = extracted(spark, d).withColumn("items", items).select("doc_id", graph.alias("graph"))
    doc = F.try_parse_json("graph")

    def at(path: str, kind: str = "string"):
        return F.try_variant_get(F.col("doc"), path, kind)

    return rows.withColumn("doc", doc).select(
        "doc_id",
        F.size(at("$['@graph']", "array<variant>")).alias("n_nodes"),
        F.coalesce(
            F.nullif(F.size(at("$['@graph'][2].mainEntity", "array<variant>")), F.lit(-1)), F.lit(0)
        ).alias("n_items"),
        F.coalesce(at("$['@graph'][2].mainEntity[0].name"), F.lit("")).alias("first_question"),
        F.coalesce(at("$['@graph'][2].mainEntity[0].acceptedAnswer.text"), F.lit("")).alias(
            "first_answer"
        ),
        F.coalesce(at("$['@graph'][0].mainEntity['@id']"), F.lit("")).alias("faq_id"),
        at("$['@graph'][1].itemListElement[2].item").alias("last_crumb"),
    )
