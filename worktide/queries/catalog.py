"""Catalogue queries: parts give the file names, conversations the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.plans import catalog as ct
from worktide.queries import sqltext as sq
from worktide.queries.registry import query
from worktide.sources.tables import table

FILE_SECTORS = (
    lx.Sector("alojamientos", ("on", "le"), ("ring", "bolt")),
    lx.Sector("hosteleria", ("is", "der"), ("widget", "gear")),
    lx.Sector("limpieza", ("are", "para"), ("gizmo", "hot ring")),
    lx.Sector("transporte", ("be", "des"), ("anvil", "rod")),
)
FILE_PLACES = lx.Places(
    provinces={
        "STANDARD": ("standard",),
        "ECONOMY": ("economy",),
        "PROMO": ("promo",),
        "LARGE": ("large",),
        "MEDIUM": ("medium",),
    },
    community_of={"STANDARD": "NORTE", "ECONOMY": "NORTE", "PROMO": "SUR", "LARGE": "SUR",
                  "MEDIUM": "ESTE"},
)
TEXT_PLACES = lx.Places(
    provinces={
        "STANDARD": ("and the", "une"),
        "ECONOMY": ("of the", "und"),
        "PROMO": ("hein", "los"),
        "LARGE": ("with",),
        "MEDIUM": ("for", "avec"),
        "ISLA": ("was", "es"),
    },
    communities={"NORTE": ("this", "que"), "SUR": ("that",), "ESTE": ("haha",)},
    community_of={**FILE_PLACES.community_of, "ISLA": "ESTE"},
)
STRONG = ("on",)


def file_names(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit(1990) + F.col("p_size")
    part = F.when(
        F.col("p_brand").isin("Brand#3", "Brand#7"), F.concat(F.lit(" parte "), F.col("p_size"))
    ).otherwise("")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(
            F.lit("in/Convenio "), "p_name", F.lit(" "), "p_type",
            F.when(F.col("p_brand") == "Brand#5", "").otherwise(
                F.concat(F.lit(" "), start.cast("string"), F.lit("-"),
                         (start + 2).cast("string"))
            ),
            part, F.lit(".pdf"),
        ).alias("file_name"),
    )


def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    return ct.file_fields(
        file_names(spark, d), places=FILE_PLACES, sectors=FILE_SECTORS
    )


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return ct.build(parsed_files(spark, d))


FILES_SQL = f"""
names as (
  select p_partkey as ord,
         'in/Convenio ' || p_name || ' ' || p_type
         || case when p_brand = 'Brand#5' then '' else ' ' || (1990 + p_size) || '-' || (1992 + p_size) end
         || case when p_brand in ('Brand#3', 'Brand#7') then ' parte ' || p_size else '' end
         || '.pdf' as file_name
  from part),
t as (
  select *, regexp_replace(split_part(file_name, '/', 2), '\\.pdf$', '') as title from names),
n as (
  select *, {sq.norm('title')} as norm,
         regexp_extract_all(title, '\\b(?:19|20)[0-9]{{2}}\\b') as ys from t),
p as (
  select ord, file_name, title,
         case when {sq.has_any('norm', ['standard'], True)} then 'STANDARD'
              when {sq.has_any('norm', ['economy'], True)} then 'ECONOMY'
              when {sq.has_any('norm', ['promo'], True)} then 'PROMO'
              when {sq.has_any('norm', ['large'], True)} then 'LARGE'
              when {sq.has_any('norm', ['medium'], True)} then 'MEDIUM' end as province,
         list_filter([case when {sq.has_any('norm', ['ring', 'bolt'])} then 'alojamientos' end,
                      case when {sq.has_any('norm', ['widget', 'gear'])} then 'hosteleria' end,
                      case when {sq.has_any('norm', ['gizmo', 'hot ring'])} then 'limpieza' end,
                      case when {sq.has_any('norm', ['anvil', 'rod'])} then 'transporte' end],
                     lambda x: x is not null) as sector_keys,
         ys[1]::int as year_start, ys[-1]::int as year_end,
         try_cast(regexp_extract(norm, '\\bparte ?([0-9]+)\\b', 1) as int) as part_number
  from n),
files as (
  select *, case when province in ('STANDARD', 'ECONOMY') then 'NORTE'
                 when province in ('PROMO', 'LARGE') then 'SUR'
                 when province = 'MEDIUM' then 'ESTE' end as community,
         lower(coalesce(nullif(array_to_string(sector_keys, '_'), ''), 'sin_sector') || '_'
               || coalesce(province, 'sin_provincia') || '_' || coalesce(year_start::varchar, 'na')
               || '_' || coalesce(year_end::varchar, 'na')) as catalog_key
  from p),
catalog as (
  select catalog_key, count(distinct file_name) as n_files, arg_min(title, ord) as title,
         any_value(province) as province, any_value(community) as community,
         any_value(sector_keys) as sector_keys, any_value(year_start) as year_start,
         any_value(year_end) as year_end
  from files group by 1)
"""
MAIN = "ord, title, coalesce(province, '-') as province, coalesce(community, '-') as community"


@query(
    "file_name_parse",
    f"""
with {FILES_SQL}
select {MAIN}, array_to_string(sector_keys, '|') as sector_keys, coalesce(year_start, 0) as year_start,
       coalesce(year_end, 0) as year_end, coalesce(part_number, 0) as part_number, catalog_key,
       province is null or len(sector_keys) = 0 as broken,
       regexp_matches(file_name, '(?i)\\bparte\\s*[0-9]*\\b') as is_part, 'especifico' as doc_type
from files""",
)
def file_name_parse(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("file_name")
    return parsed_files(spark, d).select(
        "ord",
        "title",
        F.coalesce("province", F.lit("-")).alias("province"),
        F.coalesce("community", F.lit("-")).alias("community"),
        F.array_join("sector_keys", "|").alias("sector_keys"),
        F.coalesce("year_start", F.lit(0)).alias("year_start"),
        F.coalesce("year_end", F.lit(0)).alias("year_end"),
        F.coalesce("part_number", F.lit(0)).alias("part_number"),
        "catalog_key",
        rules.broken_metadata(name, F.col("province"), F.col("sector_keys")).alias("broken"),
        rules.part_marker(name).alias("is_part"),
        rules.doc_type(name).alias("doc_type"),
    )


@query(
    "catalog_build",
    f"""
with {FILES_SQL}
select catalog_key, title, coalesce(province, '-') as province, coalesce(community, '-') as community,
       array_to_string(list_sort(sector_keys), '|') as set_key, coalesce(year_start, 0) as year_start,
       coalesce(year_end, 0) as year_end, n_files
from catalog""",
)
def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    return (
        catalog(spark, d)
        .orderBy(*ct.entry_order())
        .select(
            "catalog_key",
            "title",
            F.coalesce("province", F.lit("-")).alias("province"),
            F.coalesce("community", F.lit("-")).alias("community"),
            rules.set_key(F.col("sector_keys")).alias("set_key"),
            F.coalesce("year_start", F.lit(0)).alias("year_start"),
            F.coalesce("year_end", F.lit(0)).alias("year_end"),
            "n_files",
        )
    )


@query(
    "catalog_files",
    f"""
with {FILES_SQL},
o as (select catalog_key, file_name, min(ord) as ord from files group by 1, 2)
select catalog_key, file_name, ord,
       row_number() over (partition by catalog_key order by ord) as position
from o""",
)
def catalog_files(spark: SparkSession, d: str) -> DataFrame:
    return ct.entry_files(parsed_files(spark, d), F.floor(F.col("ord") / 65536))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """User turns, each with the text of its conversation's first turn as profile."""
    turns = table(spark, d, "conversations")
    profile = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("profile"))
    return (
        turns.where("role = 'user'")
        .join(profile, "conv_id")
        .select("conv_id", "turn", F.col("text").alias("question"), "profile")
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    return ct.criteria(
        questions(spark, d), F.col("question"), F.col("profile"), F.col("profile"),
        TEXT_PLACES, FILE_SECTORS, STRONG,
    )


def _provinces_sql(x: str) -> str:
    hits = ", ".join(
        f"case when {sq.has_any(x, a, True)} then '{p}' end"
        for p, a in TEXT_PLACES.provinces.items()
    )
    direct = f"list_filter([{hits}], lambda v: v is not null)"
    by_community = ", ".join(
        f"case when {sq.has_any(x, TEXT_PLACES.communities[c], True)} then '{p}' end"
        for p, c in TEXT_PLACES.community_of.items()
    )
    return (
        f"case when len({direct}) > 0 then {direct} "
        f"else list_filter([{by_community}], lambda v: v is not null) end"
    )


def _sectors_sql(x: str) -> str:
    hits = ", ".join(
        f"case when {sq.has_any(x, s.labels, True)} then '{s.key}' end" for s in FILE_SECTORS
    )
    named = f"list_filter([{hits}], lambda v: v is not null)"
    return (
        f"case when {sq.has_any(x, STRONG, True)} and list_contains({named}, 'alojamientos') "
        f"then list_concat(['alojamientos'], list_filter({named}, "
        f"lambda v: v not in ('alojamientos', 'hosteleria'))) else {named} end"
    )


ASKED_SQL = f"""
prof as (select conv_id, arg_min(text, turn) as profile from conversations group by 1),
q0 as (
  select c.conv_id, turn, text as question, profile, {sq.norm('text')} as nq, {sq.norm('profile')} as np
  from conversations c join prof using (conv_id) where role = 'user'),
q1 as (
  select *, {_provinces_sql('nq')} as pq, {_provinces_sql('np')} as pp,
         {_sectors_sql('nq')} as sq, {_sectors_sql('np')} as sp from q0),
asked as (
  select conv_id, turn, question, nq, case when len(pq) > 0 then pq else pp end as provinces,
         case when len(sq) > 0 then sq else sp end as sectors
  from q1)
"""
RESOLVE_SQL = f"""
{FILES_SQL}, {ASKED_SQL},
cand as (
  select conv_id, turn, c.*, array_to_string(list_sort(c.sector_keys), '|') as set_key,
         row_number() over (partition by conv_id, turn
                            order by coalesce(c.year_end, 0) desc, c.title, c.catalog_key) as rn
  from asked a join catalog c on list_contains(a.provinces, c.province)
       and list_has_any(a.sectors, c.sector_keys)),
agg as (
  select conv_id, turn, count(*) as n, count(distinct set_key) as sets,
         min(title) filter (rn = 1) as title, min(province) filter (rn = 1) as province,
         string_agg(title, ' ; ' order by rn) filter (rn <= 3) as shown
  from cand group by 1, 2),
resolved as (
  select a.*, case when len(provinces) = 0 and len(sectors) = 0 then 'missing_all'
                   when len(sectors) = 0 then 'missing_sector'
                   when len(provinces) = 0 then 'missing_location'
                   when n is null then 'not_found' when sets > 1 then 'ambiguous'
                   else 'resolved' end as status,
         coalesce(n, 0) as n, title, province, shown
  from asked a left join agg using (conv_id, turn))
"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    return q.join(ct.resolve(q, catalog(spark, d)), "criteria_key")


@query(
    "catalog_resolve",
    f"""
with {RESOLVE_SQL}
select conv_id, turn, array_to_string(provinces, '+') as provinces,
       array_to_string(sectors, '+') as sectors, status, n::bigint as n_options,
       case when status = 'resolved' then title else '-' end as title,
       case when status = 'resolved' then province else '-' end as province,
       case when status = 'ambiguous' then shown else '-' end as shown
from resolved""",
)
def catalog_resolve(spark: SparkSession, d: str) -> DataFrame:
    entry = ct.detected(F.col("entry"))
    return resolved(spark, d).select(
        "conv_id",
        "turn",
        F.array_join("provinces", "+").alias("provinces"),
        F.array_join("sectors", "+").alias("sectors"),
        "status",
        "n_options",
        F.coalesce(entry["title"], F.lit("-")).alias("title"),
        F.coalesce(entry["province"], F.lit("-")).alias("province"),
        F.coalesce(F.array_join("shown", " ; "), F.lit("-")).alias("shown"),
    )


@query(
    "catalog_options",
    f"""
with {FILES_SQL}, {ASKED_SQL},
k as (select distinct provinces, sectors from asked),
c as (select *, array_to_string(list_sort(sector_keys), '|') as set_key from catalog)
select array_to_string(provinces, '+') || '/' || array_to_string(sectors, '+') as criteria_key,
       c.province, set_key, count(*) as n_entries
from k join c on list_contains(provinces, c.province) and list_has_any(sectors, c.sector_keys)
group by 1, 2, 3""",
)
def catalog_options(spark: SparkSession, d: str) -> DataFrame:
    return ct.options(asked(spark, d), catalog(spark, d))


@query(
    "resolve_histogram",
    f"with {RESOLVE_SQL} select status, count(*) as n from resolved group by 1",
)
def resolve_histogram(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def old_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks written before ``doc_type`` and ``file_name`` existed."""
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "de", "base")
        .when(F.col("lang") == "fr", None)
        .otherwise("especifico")
        .alias("doc_type"),
        F.when(F.col("lang") != "es", F.concat("source", F.lit(".pdf"))).alias("file_name"),
        F.concat("source", F.lit(".pdf")).alias("fileName"),
    )


@query(
    "ingest_backfill",
    """
select doc_id, case when lang = 'de' then 'base' else 'especifico' end as doc_type,
       source || '.pdf' as file_name, lang in ('fr', 'es') as changed
from documents""",
)
def ingest_backfill(spark: SparkSession, d: str) -> DataFrame:
    return ct.backfill(old_chunks(spark, d)).drop("fileName")


@query(
    "backfill_counts",
    """
select case when lang = 'de' then 'base' else 'especifico' end as doc_type, count(*) as n,
       count(*) filter (lang in ('fr', 'es')) as changed
from documents group by 1""",
)
def backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    return (
        ct.backfill(old_chunks(spark, d))
        .groupBy("doc_type")
        .agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))
    )


@query(
    "chunk_file_names",
    "select distinct source || '.pdf' as file_name from documents where lang in ('en', 'es')",
)
def chunk_file_names(spark: SparkSession, d: str) -> DataFrame:
    return ct.names_of_chunks(old_chunks(spark, d))


@query(
    "catalog_rebuild",
    f"""
with {FILES_SQL},
c as (
  select catalog_key, file_name from files join documents on doc_id = ord where lang <> 'de'),
r as (
  select catalog_key, count(distinct file_name) as n_files,
         regexp_replace(split_part(min(file_name), '/', 2), '[.]pdf$', '') as title from c group by 1)
select * from r
union all
select catalog_key, 0, 'stored' from catalog where catalog_key not in (select catalog_key from r)""",
)
def catalog_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Chunk table to catalogue, merged by key over the stored entries."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang")
    chunks = file_names(spark, d).join(docs, "ord").select(
        F.when(F.col("lang") == "de", "base").otherwise("especifico").alias("doc_type"),
        F.when(F.col("lang") == "fr", F.col("file_name")).alias("file_name"),
        F.col("file_name").alias("fileName"),
    )
    stored = catalog(spark, d).select(
        "catalog_key", F.lit(0).cast("bigint").alias("n_files"), F.lit("stored").alias("title")
    )
    return ct.rebuild(chunks, stored, FILE_PLACES, FILE_SECTORS)


@query(
    "catalog_merge",
    f"""
with {FILES_SQL}
select catalog_key, case when year_end >= 2010 then 'new' else 'old' end as version, n_files
from catalog""",
)
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by key: rebuilt entries replace the stored ones, the others stay."""
    stored = catalog(spark, d).select("catalog_key", F.lit("old").alias("version"), "n_files")
    rebuilt = (
        catalog(spark, d)
        .where("year_end >= 2010")
        .select("catalog_key", F.lit("new").alias("version"), "n_files")
    )
    return ct.merge_by_key(stored, rebuilt, ["catalog_key"])
