"""Service series, alerts, incidents, session counters and product figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide import lexicon as lx

P95 = 0.95


@dataclass(frozen=True)
class Rule:
    """Fires when more than ``threshold`` matching rows fall into one aligned period."""

    name: str
    condition: str
    period: int
    threshold: int


# Alert rules over request metrics (service, code class, period, threshold).
ALERT_RULES = (
    Rule("query_5xx", "service_name = 'consultarconvenio' and response_code_class = '5xx'", 600, 3),
    Rule("webhook_5xx", "service_name = 'stripewebhook' and response_code_class = '5xx'", 600, 0),
    Rule("store_non_ok", "service_name = 'firestore' and response_code <> 'OK'", 600, 5),
    Rule("model_5xx", "service_name = 'generativelanguage' and response_code_class = '5xx'", 600, 3),
    Rule("request_spike", "service_name = 'consultarconvenio'", 3600, 100),
)
# Sustained latency (60 s points above 10 s for 600 s), incident closing time.
LATENCY_PERIOD, LATENCY_LIMIT_MS, LATENCY_POINTS = 60, 10000, 10
AUTO_CLOSE_SECONDS = 3600


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Start of the aligned period holding ``ts``, in epoch seconds."""
    return F.floor(F.unix_timestamp(ts) / seconds) * seconds


def code_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def count_series(rows: DataFrame, seconds: int, labels: Sequence[str]) -> DataFrame:
    """Rows per aligned period and label."""
    return rows.groupBy(bucket_start("ts", seconds).alias("bucket"), *labels).agg(
        F.count("*").alias("n")
    )


def sum_series(rows: DataFrame, seconds: int, labels: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(bucket_start("ts", seconds).alias("bucket"), *labels).agg(
        F.sum(value).alias("total")
    )


def latency_series(
    rows: DataFrame, seconds: int, group: Sequence[str], series: Sequence[str], value: str
) -> DataFrame:
    """Requests, errors, mean and p95 per group: aligned per series, then reduced.

    Equal values are counted first. Latencies are bounded by the request limit,
    so a busy series shrinks to its distinct values before the exact percentile.
    """
    keys = ["bucket", *group, *series]
    counted = (
        rows.withColumn("bucket", bucket_start("ts", seconds))
        .groupBy(*keys, value)
        .agg(F.count("*").alias("__f"))
    )
    aligned = counted.groupBy(*keys).agg(
        F.sum("__f").alias("n"),
        F.sum(F.col(value) * F.col("__f")).alias("__total"),
        F.percentile(F.col(value), F.lit(P95), F.col("__f")).alias("p95"),
    )
    return aligned.groupBy("bucket", *group).agg(
        F.sum("n").alias("requests"),
        F.sum(F.when(F.col("response_code_class") == "5xx", F.col("n")).otherwise(0)).alias(
            "errors_5xx"
        ),
        F.avg(F.col("__total") / F.col("n")).alias("mean_of_means"),
        (F.sum("__total") / F.sum("n")).alias("weighted_mean"),
        F.max("p95").alias("p95_max"),
    )


def mean_level(rows: DataFrame, seconds: int, series: Sequence[str], value: str) -> DataFrame:
    """Level per period: mean inside each series, summed over series."""
    aligned = rows.groupBy(bucket_start("ts", seconds).alias("bucket"), *series).agg(
        F.avg(value).alias("__m")
    )
    return aligned.groupBy("bucket").agg(F.sum("__m").alias("level"))


def fired(rows: DataFrame, rules: Sequence[Rule] = ALERT_RULES) -> DataFrame:
    """Periods in which a rule fired; all rules share one pass and one shuffle."""
    hits = [
        F.when(
            F.expr(r.condition),
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.period).alias("period"),
                F.lit(r.threshold).alias("threshold"),
                bucket_start("ts", r.period).alias("bucket"),
            ),
        )
        for r in rules
    ]
    return (
        rows.select(F.inline(F.array_compact(F.array(*hits))))
        .groupBy("rule", "period", "threshold", "bucket")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > F.col("threshold"))
    )


def runs(points: DataFrame, keys: Sequence[str], seconds: int, condition: Column) -> DataFrame:
    """Runs of consecutive periods in which the condition holds; an absent period ends a run."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    true = points.where(condition).withColumn(
        "__island", F.col("bucket") - F.row_number().over(order) * seconds
    )
    return true.groupBy(*keys, "__island").agg(
        F.min("bucket").alias("run_start"),
        (F.max("bucket") + seconds).alias("run_end"),
        F.count("*").alias("points"),
    ).drop("__island")


def sustained(
    series: DataFrame,
    keys: Sequence[str],
    value: str = "p95_max",
    seconds: int = LATENCY_PERIOD,
    limit: float = LATENCY_LIMIT_MS,
    points: int = LATENCY_POINTS,
) -> DataFrame:
    """Runs long enough to raise the alert."""
    return runs(series, keys, seconds, F.col(value) > limit).where(F.col("points") >= points)


def incidents(
    alerts: DataFrame, close_after: int = AUTO_CLOSE_SECONDS
) -> DataFrame:
    """Incidents per rule: fired periods no further apart than the closing time."""
    by_rule = Window.partitionBy("rule").orderBy("bucket")
    ends = F.col("bucket") + F.col("period")
    gap = F.col("bucket") - F.lag(ends).over(by_rule)
    opened = alerts.withColumn(
        "__new", F.when(gap.isNull() | (gap > close_after), 1).otherwise(0)
    )
    numbered = opened.withColumn("incident", F.sum("__new").over(by_rule))
    return numbered.groupBy("rule", "incident").agg(
        F.min("bucket").alias("opened"),
        (F.max(ends) + close_after).alias("closed"),
        F.count("*").alias("periods"),
        F.sum("n").alias("hits"),
    )


def counter_columns(counters: Sequence[str]) -> list[Column]:
    return [
        F.sum(F.when(F.col("action") == c, F.col("n")).otherwise(0)).cast("bigint").alias(c)
        for c in counters
    ]


def session_counters(
    actions: DataFrame, counters: Sequence[str] = lx.VISIT_COUNTERS
) -> DataFrame:
    """Action counts per session, one column per known action."""
    return actions.groupBy("session_id").agg(*counter_columns(counters))


def daily_figures(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Events and distinct users per day and kind.

    Users are made distinct by a first aggregate, so no task holds a user set.
    """
    pairs = rows.groupBy(F.to_date("ts").alias("day"), kind, "user_id").agg(
        F.count("*").alias("__n")
    )
    return pairs.groupBy("day", kind).agg(
        F.sum("__n").alias("events"), F.count("*").alias("users")
    )


def sliding_users(rows: DataFrame, days: int = 7) -> DataFrame:
    """Distinct users per window of ``days`` days, moved day by day."""
    active = rows.select(F.to_date("ts").alias("day"), "user_id").distinct()
    windows = active.select(
        "user_id", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("last_day")
    ).distinct()
    return windows.groupBy("last_day").agg(F.count("*").alias("users"))


# Days with at most so many users keep their ids; others keep a sketch of 2 ** SKETCH_BITS registers,
# whose estimate is within 2 % with a probability of 99 %.
FEW_USERS = 256
SKETCH_BITS = 14


def daily_users(rows: DataFrame, kind: str = "kind", few: int = FEW_USERS, bits: int = SKETCH_BITS) -> DataFrame:
    """What a day leaves for longer periods: its number of users, their ids where they are few, and
    a mergeable sketch. A table of days is kept; the events are not needed again.

    Users are made distinct by a first aggregate; a day's list is cut to ``few`` and one in each task.
    """
    pairs = rows.where("user_id is not null").select(F.to_date("ts").alias("day"), kind, "user_id").distinct()
    order = Window.partitionBy("day", kind).orderBy("user_id")
    # Spark keeps few + 1 rows of a group before the shuffle.
    short = pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= few + 1)
    ids = short.groupBy("day", kind).agg(F.collect_list("user_id").alias("few"))
    counted = pairs.groupBy("day", kind).agg(
        F.count("*").alias("users"), F.hll_sketch_agg("user_id", bits).alias("sketch")
    )
    return counted.join(ids, ["day", kind]).withColumn(
        "few", F.when(F.size("few") <= few, F.col("few"))
    )


def period_users(days: DataFrame, unit: str, kind: str = "kind") -> DataFrame:
    """Distinct users per week, month or other calendar ``unit`` from the table of days: exact where
    every day has few users, else the estimate of the merged sketches; ``exact`` tells which."""
    merged = days.groupBy(F.date_trunc(unit, "day").cast("date").alias("period"), kind).agg(
        F.bool_and(F.col("few").isNotNull()).alias("exact"),
        # Days without a list add nothing, so the lists are bounded by the days of a period.
        F.array_distinct(F.flatten(F.collect_list("few"))).alias("ids"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
    )
    users = F.when(F.col("exact"), F.size("ids").cast("bigint")).otherwise(F.col("estimate"))
    return merged.select("period", kind, users.alias("users"), "exact")


QUERY_LOG = (
    "event string, response_source string, status int, uid string, quotaPlan string, "
    "quotaRemaining int, convenioUsado string, requiresClarification boolean, "
    "webFallbackUsed boolean, webFallbackReason string, finishReason string, chunksUsed int, "
    "questionLength int"
)


def read_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Result events of the structured log; other lines are left out."""
    return lines.select(F.from_json(column, QUERY_LOG).alias("e"), *[
        c for c in lines.columns if c != column
    ]).select("e.*", *[c for c in lines.columns if c != column]).where(
        "event = 'consultarConvenio_result'"
    )


def answers_by_source(log: DataFrame) -> DataFrame:
    return log.groupBy("response_source", "quotaPlan").agg(
        F.count("*").alias("answers"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.count_if(F.col("quotaRemaining") == 0).alias("exhausted"),
    )
