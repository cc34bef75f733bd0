"""Queries over values and files that the other queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import extract as ex
from worktide.functions import rules
from worktide.operators.computed import computed
from worktide.plans import requests as rq
from worktide.plans import worktime as wt
from worktide.queries import intents as it
from worktide.queries import publish as qp
from worktide.queries import registry
from worktide.queries import sqltext as sq
from worktide.queries import worktime as qw
from worktide.queries.registry import query
from worktide.sources import files, sinks
from worktide.sources.tables import table
from worktide.streaming.runner import new_path


@query(
    "content_fields",
    f"""
select doc_id,
  case when doc_id % 2 = 1 then 'Vigencia detectada en el documento: 2020-2024.' else '{lx.NOT_FOUND}' end as vigencia,
  case when doc_id % 3 = 0 then 'Jornada anual localizada en el texto: 1.' || (700 + doc_id % 90) || ' horas.'
       else '{lx.NOT_FOUND}' end as jornada_anual,
  case when doc_id % 4 <> 0 then 'Vacaciones localizadas en el texto: ' || (22 + doc_id % 10) || ' días naturales.'
       else '{lx.NOT_FOUND}' end as vacaciones,
  case when doc_id % 5 = 0 then 'Regla de nocturnidad localizada en el texto, con referencia a un incremento del '
       || (20 + doc_id % 7) || '%.' else '{lx.NOT_FOUND}' end as nocturnidad
from documents""",
)
def content_fields(spark: SparkSession, d: str) -> DataFrame:
    """Published fields of documents that end in agreement clauses, in any depth of the text."""
    key = F.col("doc_id")

    def clause(when, head: str, number, tail: str):
        return F.when(when, F.concat(F.lit("\n" + head), number.cast("string"), F.lit(tail))).otherwise("")

    text = F.concat(
        "text",
        clause(key % 3 == 0, "Jornada anual de 1.", 700 + key % 90, " horas al año."),
        clause(key % 4 != 0, "Vacaciones: ", 22 + key % 10, "  días naturales."),
        clause(key % 5 == 0, "Nocturnidad con un ", 20 + key % 7, " %más."),
    )
    year = F.when(key % 2 == 1, 2020), F.when(key % 2 == 1, 2024)
    found = ex.content(F.col("full"), F.lit("Limpieza"), F.lit("malaga"), *year, F.col("low"))
    fields = ("vigencia", "jornada_anual", "vacaciones", "nocturnidad")
    texts = table(spark, d, "documents").select("doc_id", text.alias("full"))
    # Each field looks at the folded text; it is made once.
    rows = computed(texts, {"low": ex.folded(F.col("full"))}).select("doc_id", found.alias("c"))
    return rows.select("doc_id", *[F.col(f"c.{f}").alias(f) for f in fields])


@query(
    "answer_flags",
    f"""
select conv_id, turn, turn % 4 = 3 as not_found,
  case when {sq.has_any('n', [t.strip() for t in it.RULES[0].query_terms])} then 'r1'
       when {sq.has_any('n', [t.strip() for t in it.RULES[1].query_terms])} then 'r2'
       when {sq.has_any('n', [t.strip() for t in it.RULES[2].query_terms])} then 'r3' end as rule_id,
  case when {sq.has_any('n', [t.strip() for r in it.RULES for t in r.query_terms])}
       then '{lx.STATUTE_NAME}' end as file_name
from (select *, {sq.norm('text')} as n from conversations where role = 'assistant')""",
)
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Answers that say nothing was found, and the statute source of a text."""
    said = F.when(F.col("turn") % 4 == 3, " Lo siento: NO he encontrado el dato exacto.").otherwise("")
    source = rules.statute_source(rules.statute_rule(F.col("text"), it.RULES))
    return table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id",
        "turn",
        rules.answer_not_found(F.concat("text", said)).alias("not_found"),
        source["id"].alias("rule_id"),
        source["file_name"].alias("file_name"),
    )


@query(
    "year_marks",
    """
with o as (
  select o_custkey as user_id, cast(o_orderdate as date) as day,
    arg_max(case o_orderstatus when 'F' then 'trabajado' when 'P' then 'baja' when 'O' then 'otro' end, o_orderkey) as kind
  from orders group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as day, kind from o where year(day) = 1996""",
)
def year_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of one year, written as a map per user and year and read back."""
    path = new_path(spark, "years")
    marks = qw.marks(spark, d).withColumn("year", F.year("day"))
    # A user has at most 366 marks a year.
    days = F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd"), "kind")))
    stored = marks.groupBy("user_id", "year").agg(days.alias("day_marks"))
    sinks.write_years(stored, path)
    _, rows = files.year_documents(spark, path, path)
    return wt.year_only(rows, 1996).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "kind"
    )


@query(
    "sector_default",
    """
select c_custkey, case when sector <> '' then sector when flag then 'hosteleria' else 'general' end as sector
from (select c_custkey, c_acctbal > 0 as flag, case when c_nationkey < 5 then c_mktsegment else '' end as sector
      from customer)""",
)
def sector_default(spark: SparkSession, d: str) -> DataFrame:
    """Sector of a user, else what the old flag says."""
    sector = F.when(F.col("c_nationkey") < 5, F.col("c_mktsegment")).otherwise("")
    return table(spark, d, "customer").select(
        "c_custkey", wt.sector_or_legacy(sector, F.col("c_acctbal") > 0).alias("sector")
    )


@query(
    "inventory_file",
    "select p_partkey as key, p_name as name, p_brand as brand, p_size as size from part",
)
def inventory_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries as nested JSON, read back."""
    path = new_path(spark, "inventory")
    entries = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"),
        F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).alias("title"),
        F.col("p_size").alias("size"),
    )
    sinks.write_inventory(entries, path)
    return spark.read.schema(entries.schema).json(path).select("key", "title.*", "size")


@query("report_file", f"select line from ({registry.ORACLES['audit_report']})")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The audit report as a sorted text file, read back."""
    path = new_path(spark, "report")
    sinks.write_lines(qp.audit_report(spark, d), path, ["section", "ord"])
    return files.log_lines(spark, path)


@query(
    "client_families",
    """
select event_id, case event_type when 'click' then 'Edge' when 'view' then 'Firefox' when 'purchase' then 'Chrome'
  when 'signup' then 'Safari' else 'Otro' end as browser from events""",
)
def client_families(spark: SparkSession, d: str) -> DataFrame:
    """Browser family of a client string."""
    agents = {"click": "x Edg/1 Chrome/1 Safari/1", "view": "Firefox/2", "purchase": "Chrome/1 Safari/1", "signup": "Safari/1"}
    agent = F.coalesce(rules.lookup(F.col("event_type"), agents), F.lit("curl"))
    return table(spark, d, "events").select("event_id", rules.browser_family(agent).alias("browser"))


@query(
    "quarantine",
    """
select o_orderkey, case when o_totalprice < 50000 then 'too_small' end as reject_reason from orders""",
)
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Accepted rows, and rejected rows with their reason."""
    verdict = F.when(F.col("o_totalprice") < 50000, "too_small")
    good, bad = rq.split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), verdict)
    columns = ("o_orderkey", "reject_reason")
    return good.withColumn("reject_reason", F.lit(None).cast("string")).select(*columns).unionByName(
        bad.select(*columns)
    )
