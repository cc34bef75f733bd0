"""Streaming jobs over events, logs and documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import text as tx
from worktide.operators.ordered import latest
from worktide.plans import accounts as ac
from worktide.plans import monitoring as mo
from worktide.plans import retrieval as rt
from worktide.operators.staging import stage
from worktide.sources.sinks import append_version, current_files, current_latest, replace_files
from worktide.sources.store import COMMIT, Rows, Store, all_rows
from worktide.streaming import processors as pr
from worktide.streaming.runner import LATENESS, drain, query_id, stored


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drops redelivered events by id within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def account_updates(changes: DataFrame) -> DataFrame:
    """Account rows as they change; ``changes`` are applied billing decisions."""
    return ac.account_state(changes)


def final_accounts(updates: DataFrame) -> DataFrame:
    """Last written row per user."""
    return latest(updates, ["user_id"], ["batch"]).drop("batch")


def session_updates(
    actions: DataFrame, counters: Sequence[str] = lx.VISIT_COUNTERS, lateness: str = "1 day"
) -> DataFrame:
    """Counters per session and day, rewritten whenever they grow; state goes after the day."""
    return (
        actions.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "session_id")
        .agg(*mo.counter_columns(counters))
        .select(F.col("window.start").alias("day"), "session_id", *counters)
    )


def final_sessions(updates: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Last counters of each session over its days."""
    days = latest(updates, ["session_id", "day"], ["batch"])
    return days.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in counters])


def alert_updates(
    rows: DataFrame, rules: Sequence[mo.Rule], lateness_seconds: int = 600
) -> DataFrame:
    """Counts of fired periods: growing ones in update mode, each closed one once in append mode.

    State goes once a period is closed and late rows are over.
    """
    hits = [
        F.when(
            F.expr(r.condition),
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.period).alias("period"),
                F.lit(r.threshold).alias("threshold"),
                mo.bucket_start("ts", r.period).alias("bucket"),
            ),
        )
        for r in rules
    ]
    matched = rows.select(F.inline(F.array_compact(F.array(*hits))))
    slack = lateness_seconds + max(r.period for r in rules)
    return (
        matched.withColumn("closed_at", F.timestamp_seconds(F.col("bucket") + F.col("period")))
        .withWatermark("closed_at", f"{slack} seconds")
        .groupBy("rule", "period", "threshold", "bucket", "closed_at")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > F.col("threshold"))
    )


def latency_updates(rows: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Windowed p95 per service, exact: the greatest over its classes; each window once.

    State is a sparse histogram: a count per window, service, class and latency. Latencies are whole
    milliseconds below the request limit, so a busy window holds a bounded number of counts, however
    many requests it has. A closed window's histogram gives the interpolated percentile.
    """
    label = ["service_name", "response_code_class"]

    same_window = F.window(F.window_time("window"), f"{seconds} seconds")
    counts = (
        rows.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds"), *label, "latency_ms")
        .agg(F.count("*").alias("n"))
    )
    by_class = counts.groupBy(same_window, *label).agg(
        F.percentile("latency_ms", mo.P95, F.col("n")).alias("p95")
    )
    return (
        by_class.groupBy(same_window, "service_name")
        .agg(F.max("p95").alias("p95_max"))
        .select(
            F.window_time("window").alias("closed_at"),
            F.unix_timestamp("window.start").alias("bucket"), "service_name", "p95_max",
        )
    )


def interval_updates(periods: DataFrame, key: str, gap: int, length: int) -> DataFrame:
    """Intervals of periods at most ``gap`` seconds apart and ``length`` long, as they change.

    ``periods``: key, bucket, period, n and the event time ``closed_at``, each period once.
    """
    rows = periods.select(
        F.col(key).alias("key"), F.col("bucket").cast("bigint").alias("bucket"),
        F.col("period").cast("bigint").alias("period"), F.col("n").cast("bigint").alias("n"),
        "closed_at",
    )
    return rows.groupBy("key").transformWithState(
        statefulProcessor=pr.IntervalProcessor(gap, length),
        outputStructType=pr.INTERVAL_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def final_intervals(updates: DataFrame) -> DataFrame:
    """Last state of each interval; those merged into an earlier one are left out."""
    last = latest(updates, ["key", "opened"], ["batch", ~F.col("is_open")])
    return last.where("periods > 0").drop("batch", "is_open")


def incident_updates(
    rows: DataFrame, rules: Sequence[mo.Rule], close_after: int = mo.AUTO_CLOSE_SECONDS
) -> DataFrame:
    """From events to incidents in one stream: closed fired periods, joined into intervals."""
    longest = max(r.period for r in rules)
    return interval_updates(alert_updates(rows, rules), "rule", close_after, longest)


def final_incidents(updates: DataFrame, close_after: int = mo.AUTO_CLOSE_SECONDS) -> DataFrame:
    """Last state of each incident, numbered per rule."""
    by_rule = Window.partitionBy("key").orderBy("opened")
    return final_intervals(updates).select(
        F.col("key").alias("rule"),
        F.row_number().over(by_rule).cast("bigint").alias("incident"),
        "opened",
        (F.col("last_end") + close_after).alias("closed"),
        "periods",
        "hits",
    )


def sustained_updates(rows: DataFrame, seconds: int, limit: float) -> DataFrame:
    """From requests to runs of windows above the limit in one stream."""
    high = latency_updates(rows, seconds).where(F.col("p95_max") > limit)
    points = high.withColumns({"period": F.lit(seconds), "n": F.lit(1)})
    return interval_updates(points, "service_name", 0, seconds)


def final_sustained(updates: DataFrame, points: int) -> DataFrame:
    """Runs long enough to raise the alert."""
    return final_intervals(updates).where(F.col("periods") >= points).select(
        F.col("key").alias("service_name"), F.col("opened").alias("run_start"),
        F.col("last_end").alias("run_end"), F.col("periods").alias("points"),
    )


def split_late(
    batch: DataFrame, seen_until: str | None, lateness: str = LATENESS
) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows older than the lateness allows before ``seen_until``."""
    if seen_until is None:
        return batch, batch.limit(0)
    bound = F.lit(seen_until).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
    return batch.where(F.col("ts") >= bound), batch.where(F.col("ts") < bound)


MARK = "until string"


def aside(batch: DataFrame, batch_id: int, path: str, lateness: str = LATENESS) -> DataFrame:
    """Rows in time; late ones go to ``path/late``, by the largest time of earlier batches, which
    is kept beside them, one value per batch."""
    marks = stored(batch.sparkSession, f"{path}/seen", MARK, batch_id)
    good, late = split_late(batch, marks.agg(F.max("until")).first()[0], lateness)
    late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
    batch.agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("until")
    ).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
    return good


def late_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(f"{path}/late")


def route_late(
    stream: DataFrame, path: str, lateness: str = LATENESS, checkpoint: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows as two tables below ``path``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        good = aside(batch.persist(), batch_id, path, lateness)
        good.write.mode("overwrite").parquet(f"{path}/in-time/batch={batch_id}")
        batch.unpersist()

    drain(stream, each, checkpoint=checkpoint)
    spark = stream.sparkSession
    good = spark.read.schema(stream.schema).option("recursiveFileLookup", True)
    return good.parquet(f"{path}/in-time"), late_rows(spark, path, stream)


USERS = (
    "user_id bigint, ts timestamp, event_id bigint, "
    "planned struct<ts:timestamp,event_id:bigint,new_plan:string>"
)
USED = "user_id bigint, plan string, period_key string, n bigint"
PERIOD = ["user_id", "plan", "period_key"]


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest(rows, list(keys), [COMMIT]).drop(COMMIT)


def _merged_quota(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Counters and users keep their newest rows, and of daily counters only the user's last day."""
    out = all_rows(tables)
    out["users"] = _newest(tables["users"], ["user_id"])
    used = _newest(tables["used"], PERIOD)
    day = F.when(F.col("period_key") != "total", F.col("period_key"))
    last = used.groupBy("user_id").agg(F.max(day).alias("last_day"))
    out["used"] = used.join(last, "user_id").where(
        "period_key = 'total' or period_key = last_day"
    ).drop("last_day")
    if "corrected" in tables:
        out["corrected"] = _newest(tables["corrected"], ["event_id"])
    return out


def quota(
    activity: DataFrame, path: str, profiles: DataFrame,
    free_limit: int = lx.FREE_TOTAL_LIMIT, daily_limit: int = lx.PAID_DAILY_LIMIT,
    checkpoint: str | None = None,
) -> DataFrame:
    """Decision per request, as the batch ledger over all rows that ever came gives it.

    Carried are, per user, the last row seen, the plan and the counters of its periods; levelled
    merges keep them at one row per user and period, so a micro-batch costs what it and the users
    cost, not what came before. A row that comes after a later one of its user, however late, takes
    back that user's decisions: they are made again from all its activity and replace the old ones.
    Each micro-batch is one commit.
    """
    spark = activity.sparkSession
    store = Store(spark, path)

    def decide(rows: DataFrame, **known: DataFrame) -> DataFrame:
        return stage(ac.quota_ledger(rows, profiles, free_limit, daily_limit, **known))

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = query_id(session)
        own = Store(session, path)
        if own.done(run, batch_id):
            return
        own.tidy(_merged_quota)
        state = own.state()
        rows = batch.select("user_id", "ts", "event_id", "is_request", "new_plan").persist()
        here = rows.select("user_id").distinct()
        users = _newest(
            own.read("users", USERS, state=state).join(here, "user_id", "left_semi"), ["user_id"]
        ).persist()
        counted = _newest(
            own.read("used", USED, state=state).join(here, "user_id", "left_semi"), PERIOD
        ).persist()
        last = users.select("user_id", F.struct("ts", "event_id").alias("last"))
        behind = (
            rows.join(last, "user_id").where(F.struct("ts", "event_id") < F.col("last"))
            .select("user_id").distinct().persist()
        )
        late = bool(behind.head(1))
        plans = users.where("planned is not null").select("user_id", "planned.*")
        before = counted.withColumnRenamed("n", "before")
        ahead = rows.join(behind, "user_id", "left_anti") if late else rows
        ledger = decide(ahead, plans=plans, counted=before)
        tables = {"activity": rows, "ledger": ledger}
        used = (
            ledger.groupBy(*PERIOD).agg(F.count("*").alias("more")).join(before, PERIOD, "left")
            .select(*PERIOD, (F.col("more") + F.coalesce("before", F.lit(0))).alias("n"))
        )
        if late:
            stored = own.read("activity", rows.schema, state=state).drop(COMMIT)
            again = decide(stored.unionByName(rows).join(behind, "user_id", "left_semi"))
            tables["corrected"] = again
            # Periods that the user no longer has anything in count nothing.
            old = counted.join(behind, "user_id", "left_semi").select(*PERIOD, F.lit(0).cast("bigint").alias("n"))
            new = again.groupBy(*PERIOD).agg(F.count("*").alias("n"))
            used = used.unionByName(old.unionByName(new).groupBy(*PERIOD).agg(F.sum("n").alias("n")))
        at = F.struct("ts", "event_id")
        seen = rows.select(
            "user_id", at.alias("at"),
            F.when(F.col("new_plan").isNotNull(), F.struct("ts", "event_id", "new_plan")).alias("planned"),
        ).unionByName(users.select("user_id", at.alias("at"), "planned"))
        tables["used"] = used
        tables["users"] = seen.groupBy("user_id").agg(
            F.max("at").alias("at"), F.max("planned").alias("planned")
        ).select("user_id", "at.*", "planned")
        own.commit(run, batch_id, tables)
        for held in (rows, users, counted, behind):
            held.unpersist()

    drain(activity, each, checkpoint=checkpoint)
    return current_ledger(store)


def current_ledger(store: Store) -> DataFrame:
    """Every request's decision as it stands after the corrections."""
    state = store.state()
    ledger = store.read("ledger", state=state).drop(COMMIT)
    if "corrected" in state["schemas"]:
        corrected = _newest(store.read("corrected", state=state), ["event_id"]).select(ledger.columns)
        ledger = ledger.join(corrected.select("event_id"), "event_id", "left_anti").unionByName(corrected)
    return ledger.drop("period_key")


def _merged_billing(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out = all_rows(tables)
    if "corrected" in tables:
        out["corrected"] = _newest(tables["corrected"], ["event_id"])
    return out


def billing(
    events: DataFrame, path: str, users: DataFrame, subscriptions: DataFrame,
    line_items: DataFrame, prices: Sequence[str], products: Sequence[str],
    checkpoint: str | None = None,
) -> DataFrame:
    """Decisions with resolved users; each micro-batch is one commit.

    Ids that activations store are kept below ``path`` and looked up, as of the event, by later
    events of the same and of later batches; only ids that a batch asks for are looked at. An
    activation that comes late, however late, finds users for earlier decisions too: those that
    named its ids are resolved again and replace the old ones. Ignored and unresolved events stay in
    the decisions.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = query_id(session)
        store = Store(session, path)
        if store.done(run, batch_id):
            return
        store.tidy(_merged_billing)
        state = store.state()
        decided = ac.decide(ac.read_billing(batch), subscriptions, line_items, prices, products)
        direct = stage(ac.direct_users(decided, users))
        learned = stage(ac.learned_links(direct))
        links = ac.stored_links(users).unionByName(
            store.read("links", ac.LINK, state=state).drop(COMMIT)
        ).unionByName(learned)

        def resolved(rows: DataFrame) -> DataFrame:
            asked = ac.asked_keys(rows).distinct()
            return ac.resolve_by_links(rows, links.join(asked, ["kind", "key"], "left_semi"))

        unnamed = direct.where("user_id is null")
        tables: dict[str, Rows] = {"decisions": resolved(direct), "links": learned, "unnamed": unnamed}
        # Earlier decisions after a new link's time that named its id.
        until = store.remembered(run).get("until")
        late = learned.where(F.col("ts") < F.lit(until).cast("timestamp")) if until else learned.limit(0)
        if until and late.head(1):
            first = late.groupBy("kind", "key").agg(F.min("ts").alias("since"))
            stored = store.read("unnamed", direct.schema, state=state).drop(COMMIT)
            named = stored.select("event_id", "ts", F.inline(ac.keys_of()))
            touched = named.join(first, ["kind", "key"]).where("ts >= since").select("event_id").distinct()
            tables["corrected"] = resolved(stage(stored.join(touched, "event_id", "left_semi")))
        newest = direct.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        store.commit(run, batch_id, tables, {"until": max(filter(None, (newest, until)), default=None)})

    drain(events, each, checkpoint=checkpoint)
    return current_decisions(Store(events.sparkSession, path))


def current_decisions(store: Store) -> DataFrame:
    """Every billing event's decision as it stands after the corrections."""
    state = store.state()
    rows = store.read("decisions", state=state).drop(COMMIT)
    if "corrected" in state["schemas"]:
        corrected = _newest(store.read("corrected", state=state), ["event_id"]).select(rows.columns)
        rows = rows.join(corrected.select("event_id"), "event_id", "left_anti").unionByName(corrected)
    return rows


def ingest(
    documents: DataFrame,
    path: str,
    make_model: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
    checkpoint: str | None = None,
    size: int = 1000,
    overlap: int = 200,
) -> DataFrame:
    """New documents: clean, chunk, embed, replace by file.

    ``documents`` streams (file_name, text). Files without readable text give
    no chunks and replace nothing. A run with a new checkpoint adds to what
    earlier runs stored; a checkpoint of another table is refused.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        clean = batch.select("file_name", tx.clean_extracted(F.col("text")).alias("text")).where(
            "text <> ''"
        )
        parts = rt.recursive_chunks(clean, "file_name", "text", size, overlap)
        embedded = rt.embed(parts, make_model, "chunk", "file_name")
        replace_files(embedded, path, "file_name", batch_id, query_id(batch.sparkSession))

    drain(documents, each, checkpoint=checkpoint)
    return current_files(documents.sparkSession, path, "file_name")


def keep_latest(
    stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str | None = None
) -> DataFrame:
    """Last writer wins per key; each micro-batch appends a version."""
    def each(batch: DataFrame, batch_id: int) -> None:
        append_version(batch, path, keys, order, batch_id, query_id(batch.sparkSession))

    drain(stream, each, checkpoint=checkpoint)
    return current_latest(stream.sparkSession, path, keys, order)


def log_updates(lines: DataFrame) -> DataFrame:
    """Answers by source and plan from streamed log lines."""
    return mo.answers_by_source(mo.read_log(lines))
