"""Monitoring queries: events play requests, ``value`` the latency, ``k`` the status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.functions import rules
from worktide.operators.staging import stage
from worktide.plans import answers as an
from worktide.plans import monitoring as mo
from worktide.queries.registry import query
from worktide.queries.retrieval import answer_route
from worktide.queries import registry
from worktide.sources.tables import events, table

# Test rules: name, condition, period, threshold.
RULES = (
    mo.Rule("errors", "service_name = 'error'", 600, 1),
    mo.Rule("purchase_5xx", "service_name = 'purchase' and response_code_class = '5xx'", 600, 0),
    mo.Rule("all_5xx", "response_code_class = '5xx'", 3600, 3),
    mo.Rule("spike", "true", 3600, 20),
)
P95_LIMIT, P95_POINTS, HOUR, DAY = 60.0, 3, 3600, 86400


def requests(spark: SparkSession, d: str) -> DataFrame:
    return as_requests(events(spark, d))


def as_requests(rows: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 70, 200 + k).when(k < 90, 400 + k - 70).otherwise(500 + k - 90)
    return rows.select(
        "ts",
        "user_id",
        F.col("event_type").alias("service_name"),
        mo.code_class(status).alias("response_code_class"),
        status.alias("status"),
        # Whole milliseconds: a busy series shrinks to few distinct values.
        F.round("value").alias("latency_ms"),
    )


REQ_SQL = """
rq as (
  select ts, user_id, event_type as service_name, round(value) as latency_ms, (props->>'$.k')::int as k,
         case when (props->>'$.k')::int < 70 then '2xx' when (props->>'$.k')::int < 90 then '4xx'
              else '5xx' end as cls
  from events)
"""


def _bucket(seconds: int) -> str:
    return f"(epoch_us(ts) // 1000000 // {seconds} * {seconds})::bigint"


def _series_sql(seconds: int) -> str:
    return f"""
al as (
  select {_bucket(seconds)} as bucket, service_name, cls, count(*) as n, avg(latency_ms) as m,
         sum(latency_ms) as s, quantile_cont(latency_ms, 0.95) as p
  from rq group by 1, 2, 3),
series as (
  select bucket, service_name, sum(n)::bigint as requests,
         coalesce(sum(n) filter (cls = '5xx'), 0)::bigint as errors_5xx, round(avg(m), 6) as mean_of_means,
         round(sum(s) / sum(n), 6) as weighted_mean, round(max(p), 6) as p95_max
  from al group by 1, 2)
"""


def _rounded(df: DataFrame) -> DataFrame:
    names = ("mean_of_means", "weighted_mean", "p95_max")
    return df.withColumns({c: F.round(c, 6) for c in names})


def latency(spark: SparkSession, d: str, seconds: int) -> DataFrame:
    return mo.latency_series(
        requests(spark, d), seconds, ["service_name"], ["response_code_class"], "latency_ms"
    )


@query("service_series", f"with {REQ_SQL}, {_series_sql(60)} select * from series")
def service_series(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(latency(spark, d, 60))


@query(
    "store_series",
    f"""
with {REQ_SQL}
select {_bucket(60)} as bucket, service_name, count(*) as n from rq
where cls <> '2xx' group by 1, 2""",
)
def store_series(spark: SparkSession, d: str) -> DataFrame:
    """Failed calls per minute by operation."""
    rows = requests(spark, d).where("response_code_class <> '2xx'")
    return mo.count_series(rows, 60, ["service_name"])


@query(
    "volume_series",
    f"""
with {REQ_SQL},
b as (select {_bucket(60)} as bucket, sum(cast(latency_ms as decimal(18, 2)))::double as sent from rq group by 1),
m as (select {_bucket(HOUR)} as bucket, service_name, avg(latency_ms) as m from rq group by 1, 2),
l as (select bucket, round(sum(m), 6) as level from m group by 1),
s as (
  select {_bucket(DAY)} as bucket, k < 50 as is_anon, count(*) as n from rq where service_name = 'signup'
  group by 1, 2)
select 'sent' as series, '' as label, bucket, sent as value from b
union all select 'stored', '', bucket, level from l
union all select 'sign_ins', case when is_anon then 'anon' else 'user' end, bucket, n::double from s""",
)
def volume_series(spark: SparkSession, d: str) -> DataFrame:
    """Bytes per minute, stored level per hour, sign-ins per day."""
    rows = requests(spark, d)
    sent = mo.sum_series(
        rows.withColumn("bytes", F.col("latency_ms").cast("decimal(18,2)")), 60, [], "bytes"
    ).select(
        F.lit("sent").alias("series"), F.lit("").alias("label"), "bucket",
        F.col("total").cast("double").alias("value"),
    )
    stored = mo.mean_level(rows, HOUR, ["service_name"], "latency_ms").select(
        F.lit("stored").alias("series"), F.lit("").alias("label"), "bucket",
        F.round("level", 6).alias("value"),
    )
    anon = F.get_json_object("props", "$.k").cast("int") < 50
    sign_ins = mo.count_series(
        events(spark, d)
        .where("event_type = 'signup'")
        .withColumn("label", F.when(anon, "anon").otherwise("user")),
        DAY,
        ["label"],
    ).select(
        F.lit("sign_ins").alias("series"), "label", "bucket", F.col("n").cast("double").alias("value")
    )
    return sent.unionByName(stored).unionByName(sign_ins)


@query(
    "status_classes",
    f"""
with {REQ_SQL}
select {_bucket(HOUR)} as bucket, count(*) as requests, count(*) filter (cls = '4xx') as c4xx,
       count(*) filter (cls = '5xx') as c5xx
from rq group by 1""",
)
def status_classes(spark: SparkSession, d: str) -> DataFrame:
    """Hosting requests by status class."""
    status = F.col("status")
    return (
        requests(spark, d)
        .groupBy(mo.bucket_start("ts", HOUR).alias("bucket"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if((status >= 400) & (status < 500)).alias("c4xx"),
            F.count_if(status >= 500).alias("c5xx"),
        )
    )


def _fired(name: str, condition: str, period: int, threshold: int) -> str:
    return (
        f"select '{name}' as rule, {period} as period, {threshold} as threshold, "
        f"{_bucket(period)} as bucket, count(*) as n from rq where {condition} "
        f"group by 4 having count(*) > {threshold}"
    )


FIRED_SQL = "fired as (" + " union all ".join(
    _fired(r.name, r.condition.replace("response_code_class", "cls"), r.period, r.threshold)
    for r in RULES
) + ")"


@query("alerts_window", f"with {REQ_SQL}, {FIRED_SQL} select * from fired")
def alerts_window(spark: SparkSession, d: str) -> DataFrame:
    return mo.fired(requests(spark, d), RULES)


@query(
    "alerts_sustained",
    f"""
with {REQ_SQL}, {_series_sql(HOUR)},
t as (
  select *, bucket - row_number() over (partition by service_name order by bucket) * {HOUR} as island
  from series where p95_max > {P95_LIMIT})
select service_name, min(bucket) as run_start, (max(bucket) + {HOUR})::bigint as run_end, count(*) as points
from t group by service_name, island having count(*) >= {P95_POINTS}""",
)
def alerts_sustained(spark: SparkSession, d: str) -> DataFrame:
    return mo.sustained(
        latency(spark, d, HOUR), ["service_name"], "p95_max", HOUR, P95_LIMIT, P95_POINTS
    )


@query(
    "incidents",
    f"""
with {REQ_SQL}, {FIRED_SQL},
g as (
  select *, case when bucket - lag(bucket + period) over (partition by rule order by bucket) <= 3600 then 0
                 else 1 end as new_ from fired),
i as (select *, sum(new_) over (partition by rule order by bucket)::bigint as incident from g)
select rule, incident, min(bucket) as opened, (max(bucket + period) + 3600)::bigint as closed,
       count(*) as periods, sum(n)::bigint as hits
from i group by 1, 2""",
)
def incidents(spark: SparkSession, d: str) -> DataFrame:
    return mo.incidents(mo.fired(requests(spark, d), RULES))


@query(
    "session_counters",
    """
select user_id || '_' || strftime(ts, '%Y%m%d') as session_id,
       count(*) filter (event_type = 'click') as calendario_clicks,
       count(*) filter (event_type = 'view') as cambios_mes,
       coalesce(sum((props->>'$.k')::int) filter (event_type = 'purchase'), 0)::bigint as aperturas_premium,
       count(*) filter (event_type = 'error') as errores
from events group by 1""",
)
def session_counters(spark: SparkSession, d: str) -> DataFrame:
    actions = session_actions(events(spark, d))
    return mo.session_counters(actions, ACTIONS)


ACTIONS = ("calendario_clicks", "cambios_mes", "aperturas_premium", "errores")


def session_actions(rows: DataFrame) -> DataFrame:
    names = {"click": ACTIONS[0], "view": ACTIONS[1], "purchase": ACTIONS[2], "error": ACTIONS[3]}
    step = F.when(
        F.col("event_type") == "purchase", F.get_json_object("props", "$.k").cast("int")
    ).otherwise(1)
    return rows.select(
        F.concat_ws("_", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        rules.lookup(F.col("event_type"), names).alias("action"),
        step.alias("n"),
        "ts",
    )


@query(
    "kpi_daily",
    """
select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*) as events,
       count(distinct user_id) as users
from events group by 1, 2""",
)
def kpi_daily(spark: SparkSession, d: str) -> DataFrame:
    figures = mo.daily_figures(events(spark, d).withColumnRenamed("event_type", "kind"))
    return figures.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "kpi_weekly",
    """
with a as (select distinct cast(ts as date) as day, user_id from events),
w as (select user_id, unnest(generate_series(day, day + interval 6 day, interval 1 day))::date as last_day from a)
select strftime(last_day, '%Y-%m-%d') as last_day, count(distinct user_id) as users from w group by 1""",
)
def kpi_weekly(spark: SparkSession, d: str) -> DataFrame:
    out = mo.sliding_users(events(spark, d))
    return out.withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query(
    "kpi_periods",
    """
with u as (select unnest(['week', 'month']) as unit)
select unit, strftime(date_trunc(unit, ts), '%Y-%m-%d') as period, event_type as kind,
       count(distinct user_id) as users
from events, u group by all""",
)
def kpi_periods(spark: SparkSession, d: str) -> DataFrame:
    """Users per week and per month from the table of days alone."""
    days = stage(mo.daily_users(events(spark, d).withColumnRenamed("event_type", "kind")))
    parts = [mo.period_users(days, unit).withColumn("unit", F.lit(unit)) for unit in ("week", "month")]
    out = parts[0].unionByName(parts[1]).drop("exact")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "kpi_answers",
    f"""
with r as ({registry.ORACLES['answer_route']}),
t as (
  select response_source, case when c.turn > 0 then 'premium' else 'free' end as plan, c.turn
  from r join conversations c using (conv_id, turn))
select response_source, plan as "quotaPlan", count(*) as answers,
       count(*) filter (response_source = 'unconfirmed') as errors, count(*) filter (turn = 2) as exhausted
from t group by 1, 2""",
)
def kpi_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by source and plan, read back from the structured log lines."""
    return mo.answers_by_source(mo.read_log(answer_log(spark, d)))


def answer_log(spark: SparkSession, d: str) -> DataFrame:
    routed = answer_route(spark, d)
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    empty = F.lit(None).cast("string")
    rows = routed.join(turns, ["conv_id", "turn"]).select(
        "event",
        "response_source",
        F.when(F.col("response_source") == "unconfirmed", 500).otherwise(200).alias("status"),
        F.col("conv_id").cast("string").alias("uid"),
        F.when(F.col("turn") > 0, "premium").otherwise("free").alias("quotaPlan"),
        F.abs(F.lit(2) - F.col("turn")).cast("int").alias("quotaRemaining"),
        empty.alias("convenioUsado"),
        (F.col("response_source") == "clarification").alias("requiresClarification"),
        (F.col("response_source") == "web_official").alias("webFallbackUsed"),
        empty.alias("webFallbackReason"),
        empty.alias("finishReason"),
        F.lit(0).alias("chunksUsed"),
        F.col("n").alias("questionLength"),
    )
    return an.log_lines(rows)
