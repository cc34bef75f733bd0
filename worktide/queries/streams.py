"""Streaming queries: each drains its input and returns the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.plans import accounts as ac
from worktide.plans import monitoring as mo
from worktide.plans import retrieval as rt
from worktide.queries import accounts as qa
from worktide.queries import monitoring as qm
from worktide.queries import registry
from worktide.queries.registry import query
from worktide.sources import files
from worktide.sources.tables import events, table
from worktide.streaming import jobs
from worktide.streaming.runner import (
    drain_to_table,
    new_path,
    read_events_stream,
    read_table_stream,
    replayed,
    slices_of,
)

# Micro-batches of the replayed tables.
SLICES = 4

@query("stream_billing", f"with {qa.DECIDE_SQL}, {qa.STATE_SQL}")
def stream_billing(spark: SparkSession, d: str) -> DataFrame:
    """Account state from billing events in slices of time, each a micro-batch."""
    path, checkpoint = new_path(spark, "billing"), new_path(spark, "offsets")
    users, provider = qa.accounts_table(spark, d), qa.provider_tables(spark, d)
    for stream in slices_of(qa.billing_events(events(spark, d)), SLICES):
        decided = jobs.billing(stream, path, users, *provider, qa.PRICES, qa.PRODUCTS, checkpoint)
    # What changes no account stays in the decision log alone.
    changes = ac.applied(decided)
    changes.write.parquet(f"{path}/current")
    stream = spark.readStream.schema(changes.schema).parquet(f"{path}/current")
    return qa.shown_accounts(jobs.final_accounts(drain_to_table(jobs.account_updates(stream), "update")))


@query(
    "stream_unknown",
    "select event_id, 'customer.created' as type from events where event_type = 'view'",
)
def stream_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Billing events of unknown type, kept aside."""
    stream = qa.billing_events(read_events_stream(spark, d))
    unknown = stream.where(~F.col("type").isin(*ac.HANDLED)).select("event_id", "type")
    return drain_to_table(unknown).drop("batch")


@query("stream_quota", f"with {qa.QUOTA_SQL} select * from ledger")
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    """The quota ledger over slices of time."""
    path, checkpoint = new_path(spark, "quota"), new_path(spark, "offsets")
    known = qa.profiles(spark, d)
    for stream in slices_of(qa.quota_activity(events(spark, d)), SLICES):
        out = jobs.quota(stream, path, known, qa.FREE_LIMIT, qa.DAY_LIMIT, checkpoint)
    return out.drop("ts")


@query("stream_quota_late", f"with {qa.QUOTA_SQL} select * from ledger")
def stream_quota_late(spark: SparkSession, d: str) -> DataFrame:
    """The quota ledger over slices by id, so that many rows come days late and still count."""
    path, checkpoint = new_path(spark, "quota"), new_path(spark, "offsets")
    known = qa.profiles(spark, d)
    for stream in slices_of(qa.quota_activity(events(spark, d)), SLICES, "event_id"):
        out = jobs.quota(stream, path, known, qa.FREE_LIMIT, qa.DAY_LIMIT, checkpoint)
    return out.drop("ts")


@query(
    "stream_late",
    f"""
with b as (select min(event_id) as lo, max(event_id) as hi from events),
s as (select event_id, ts, (event_id - lo) * {SLICES} // (hi - lo + 1) as slice from events, b),
m as (select slice, max(ts) as until from s group by 1)
select event_id, coalesce(ts < (select max(until) from m where m.slice < s.slice) - interval 10 minutes, false) as late
from s""",
)
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Events by id, so many come late: rows in time and rows beside them."""
    path, checkpoint = new_path(spark, "late"), new_path(spark, "offsets")
    rows = events(spark, d).select("event_id", "ts")
    for stream in slices_of(rows, SLICES, "event_id"):
        good, late = jobs.route_late(stream, path, checkpoint=checkpoint)
    return good.select("event_id", F.lit(False).alias("late")).unionByName(
        late.select("event_id", F.lit(True).alias("late"))
    )


@query("stream_sessions", registry.ORACLES["session_counters"])
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    actions = qm.session_actions(events(spark, d))
    updates = replayed(actions, lambda s: jobs.session_updates(s, qm.ACTIONS), "update", SLICES)
    return jobs.final_sessions(updates, qm.ACTIONS)


@query("stream_alerts", registry.ORACLES["alerts_window"])
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = qm.as_requests(events(spark, d))
    updates = replayed(rows, lambda s: jobs.alert_updates(s, qm.RULES), "update", SLICES)
    return jobs.latest(updates, ["rule", "bucket"], ["batch", "n"]).drop("batch", "closed_at")


CLOCK = mo.Rule("clock", "service_name = 'clock'", 600, 1 << 30)


def with_clock(rows: DataFrame) -> DataFrame:
    """Requests and, a day after the last, one tick that closes all windows."""
    spark = rows.sparkSession
    end = rows.agg(F.max("ts") + F.expr("interval 1 day")).first()[0]
    tick = spark.createDataFrame([(end, "clock", "2xx", 0.0)] if end else [],
                                 "ts timestamp, service_name string, response_code_class string, latency_ms double")
    return rows.select(*tick.columns).unionByName(tick)


@query("stream_incidents", registry.ORACLES["incidents"])
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    """From events to incidents as one stream."""
    rows = with_clock(qm.requests(spark, d))
    rules = (*qm.RULES[:-1], mo.Rule("spike", "service_name <> 'clock'", *_rest(qm.RULES[-1])), CLOCK)
    updates = replayed(rows, lambda s: jobs.incident_updates(s, rules), "append", SLICES)
    return jobs.final_incidents(updates)


def _rest(rule: mo.Rule) -> tuple[int, int]:
    return rule.period, rule.threshold


@query("stream_latency", registry.ORACLES["alerts_sustained"])
def stream_latency(spark: SparkSession, d: str) -> DataFrame:
    """Sustained latency runs from requests as one stream."""
    rows = with_clock(qm.requests(spark, d))
    updates = replayed(
        rows, lambda s: jobs.sustained_updates(s, qm.HOUR, qm.P95_LIMIT), "append", SLICES
    )
    return jobs.final_sustained(updates, qm.P95_POINTS)


@query("stream_answers", registry.ORACLES["kpi_answers"])
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by source and plan from a stream of log lines."""
    path = new_path(spark, "log")
    qm.answer_log(spark, d).write.text(path)
    updates = drain_to_table(
        jobs.log_updates(files.log_lines(spark, path, streaming=True)), "update"
    )
    return jobs.latest(updates, ["response_source", "quotaPlan"], ["batch"]).drop("batch")


@query("stream_dedup", "select event_type, count(*) as n from events group by 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, counted once."""
    twice = read_events_stream(spark, d).unionByName(read_events_stream(spark, d))
    kept = drain_to_table(jobs.deduplicated(twice).select("event_id", "event_type"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "stream_ingest",
    """
select 'doc' || doc_id as file_name, case when doc_id % 5 = 0 then 2 else 1 end as run, true as complete
from documents where text <> ''""",
)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with checkpoints of their own on one table: some files are replaced, some come
    back empty, the others are untouched."""
    path = new_path(spark, "chunks")
    docs = read_table_stream(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id")).alias("file_name")
    jobs.ingest(docs.select(name, "text"), path, rt.hashing_model(64))
    again = docs.where("doc_id % 5 < 2").select(
        name, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("@2@ "), F.col("text"))).otherwise(" \n").alias("text")
    )
    out = jobs.ingest(again, path, rt.hashing_model(64))
    return out.groupBy("file_name").agg(
        F.max(F.when(F.col("chunk").startswith("@2@ "), 2).otherwise(1)).alias("run"),
        (
            (F.count("*") == F.max("chunk_total")) & (F.count_distinct("chunk_index") == F.count("*"))
        ).alias("complete"),
    )


@query(
    "stream_years",
    """
select o_custkey as user_id, year(o_orderdate)::int as year,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) as goal,
       strftime(max(o_orderdate), '%Y-%m-%d') as updated
from orders group by 1, 2""",
)
def stream_years(spark: SparkSession, d: str) -> DataFrame:
    """Year documents, last writer wins."""
    docs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order"),
        F.col("o_custkey").alias("user_id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("goal"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"),
        F.struct("o_orderdate", "o_orderkey").alias("version"),
    )
    path, checkpoint = new_path(spark, "years"), new_path(spark, "offsets")
    for stream in slices_of(docs, SLICES, "order"):
        kept = jobs.keep_latest(stream, path, ["user_id", "year"], "version", checkpoint)
    return kept.drop("version", "order")
