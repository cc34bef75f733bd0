from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktide.plans import accounts as ac
from worktide.plans import monitoring as mo
from worktide.plans import retrieval as rt
from worktide.session import configure
from worktide.streaming import jobs
from worktide.streaming.runner import drain_to_table

START = datetime(2024, 1, 1)


@pytest.fixture
def batches(spark, tmp_path):
    """Write frames one by one and stream them back, one file per micro-batch."""
    configure(spark, streaming=True)

    def run(frames):
        import time

        path = str(tmp_path / "in")
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)

    return run


def test_quota_stream_equals_ledger(spark, batches, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        plan = rng.choice([None, None, None, "premium", "free"])
        rows.append((1 if i % 3 else int(rng.integers(2, 5)), START + timedelta(hours=i), i, plan is None, plan))
    schema = "user_id bigint, ts timestamp, event_id bigint, is_request boolean, new_plan string"
    frames = [spark.createDataFrame(rows[a : a + 50], schema) for a in (0, 50, 100)]
    profiles = spark.createDataFrame([(i,) for i in range(1, 5)], "user_id bigint")
    # User 4 has no profile.
    profiles = profiles.where("user_id < 4")
    batch = ac.quota_ledger(spark.createDataFrame(rows, schema), profiles, 3, 4).drop("period_key")
    stream = jobs.quota(batches(frames), str(tmp_path / "quota"), profiles, 3, 4)
    key = lambda r: r.event_id
    columns = sorted(batch.columns)
    want = sorted(batch.select(columns).collect(), key=key)
    assert sorted(stream.select(columns).collect(), key=key) == want
    assert {r.code for r in want} == {
        "ok", "premium_daily_quota_exceeded", "free_total_quota_exceeded", "user_profile_not_found"
    }
    assert all(r.used == r.remaining == 0 for r in want if r.code == "user_profile_not_found")


def test_account_stream_ignores_older_events(spark, batches):
    schema = ("event_id bigint, ts timestamp, action string, reason string, user_id string, customer_id string, "
              "subscription_id string, price_id string, product_id string, subscription_status string, "
              "period_end bigint, cancel_at_period_end boolean")

    def row(i, hour, action, sub):
        return (i, START + timedelta(hours=hour), action, "r", "u", "c", sub, "p", "", "st%d" % i, i, i % 2 == 0)

    rows = [row(1, 1, "activate", "s1"), row(2, 5, "activate", "s2"), row(3, 3, "deactivate", ""), row(4, 6, "deactivate", "")]
    frames = [spark.createDataFrame([r], schema) for r in rows]
    got = jobs.final_accounts(drain_to_table(jobs.account_updates(batches(frames)), "update")).first()
    want = ac.account_state(spark.createDataFrame(rows, schema)).first()
    assert {c: got[c] for c in want.asDict()} == want.asDict()
    assert (got.account_kind, got.subscription_id, got.subscription_status) == ("free", "s2", "st4")


def intervals(spark, batches, rows, close_after):
    schema = "rule string, period int, bucket bigint, n bigint"
    frames = [spark.createDataFrame([r], schema) for r in rows]
    stream = batches(frames).withColumn("closed_at", F.timestamp_seconds(F.col("bucket") + F.col("period")))
    periods = stream.withWatermark("closed_at", "20 days")
    return drain_to_table(jobs.interval_updates(periods, "rule", close_after, 600), "append"), schema


@pytest.mark.parametrize("buckets", [
    (0, 600, 4800, 10000, 30000), (11 * 86400, 0), (9000, 0, 4200), (30000, 10000, 4800, 600, 0),
])
def test_incidents_in_any_order_equal_batch(spark, batches, buckets):
    rows = [("r", 600, b, 5) for b in buckets]
    updates, schema = intervals(spark, batches, rows, 3600)
    final = {(r.incident, r.opened, r.closed, r.periods, r.hits) for r in jobs.final_incidents(updates).collect()}
    want = mo.incidents(spark.createDataFrame(rows, schema))
    assert final == {(r.incident, r.opened, r.closed, r.periods, r.hits) for r in want.collect()}


def test_a_period_counts_once_over_many_batches(spark, batches):
    """Four hits of one period in each of three batches: one period, twelve hits."""
    rules = (mo.Rule("r", "service_name = 's'", 600, 3), mo.Rule("clock", "service_name = 'clock'", 600, 1 << 30))
    schema = "ts timestamp, service_name string"
    frames = [
        spark.createDataFrame([(START + timedelta(seconds=60 * b + i), "s") for i in range(4)], schema) for b in range(3)
    ] + [spark.createDataFrame([(START + timedelta(days=1), "clock")], schema)]
    updates = drain_to_table(jobs.incident_updates(batches(frames), rules), "append")
    assert [(r.periods, r.hits) for r in jobs.final_incidents(updates).collect()] == [(1, 12)]


def test_late_rows_go_aside(spark, batches, tmp_path):
    schema = "event_id bigint, ts timestamp"
    frames = [spark.createDataFrame([(i, START + timedelta(minutes=m))], schema) for i, m in ((1, 60), (2, 49), (3, 55), (4, 90), (5, 81))]
    good, late = jobs.route_late(batches(frames), str(tmp_path / "late"))
    assert {r.event_id for r in late.collect()} == {2}
    assert {r.event_id for r in good.collect()} == {1, 3, 4, 5}


def test_ingest_replaces_and_skips_empty(spark, batches, tmp_path):
    schema = "file_name string, text string"
    frames = [
        spark.createDataFrame([("a", "uno  dos " * 200), ("b", "tres")], schema),
        spark.createDataFrame([("a", "nuevo"), ("b", "  \n ")], schema),
    ]
    out = jobs.ingest(batches(frames), str(tmp_path / "out"), rt.hashing_model(8))
    assert {(r.file_name, r.chunk) for r in out.collect()} == {("a", "nuevo"), ("b", "tres")}


def test_ingest_runs_add_to_one_table(spark, tmp_path):
    """A run with a new checkpoint loses nothing that an earlier run stored."""
    configure(spark, streaming=True)
    schema, table = "file_name string, text string", str(tmp_path / "table")

    def run(name, rows, checkpoint=None):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        out = jobs.ingest(stream, table, rt.hashing_model(8), checkpoint)
        return {(r.file_name, r.chunk) for r in out.collect()}

    run("one", [("a.pdf", "uno"), ("b.pdf", "dos")])
    check = str(tmp_path / "check")
    assert run("two", [("c.pdf", "tres")], check) == {("a.pdf", "uno"), ("b.pdf", "dos"), ("c.pdf", "tres")}
    assert ("a.pdf", "nuevo") in run("three", [("a.pdf", "nuevo")])
    # The second run goes on after the third: its versions are newer still.
    assert run("two", [("a.pdf", "final")], check) == {("a.pdf", "final"), ("b.pdf", "dos"), ("c.pdf", "tres")}
    other = spark.readStream.schema(schema).parquet(str(tmp_path / "two"))
    spark.createDataFrame([("d.pdf", "x")], schema).write.mode("append").parquet(str(tmp_path / "two"))
    with pytest.raises(Exception, match="belongs to another table"):
        jobs.ingest(other, str(tmp_path / "other"), rt.hashing_model(8), check)


def test_billing_learns_ids_across_batches(spark, tmp_path):
    from worktide.queries import accounts as qa
    from worktide.sources.tables import events
    from worktide.streaming.runner import slices_of

    folder, path, check = "/root/testdata/sf0.001", str(tmp_path / "b"), str(tmp_path / "c")
    users, provider = qa.accounts_table(spark, folder), qa.provider_tables(spark, folder)
    for stream in slices_of(qa.billing_events(events(spark, folder)), 3):
        out = jobs.billing(stream, path, users, *provider, qa.PRICES, qa.PRODUCTS, check)
    columns = ["event_id", "action", "reason", "user_id"]
    want = qa.resolved_changes(spark, folder).select(columns).collect()
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, want))
    assert spark.read.parquet(f"{path}/links").select("batch").distinct().count() > 1


def test_stream_continues_from_its_checkpoint(spark, tmp_path):
    configure(spark, streaming=True)
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema("v int").parquet(path)
    for v in (1, 2):
        spark.createDataFrame([(v,)], "v int").write.mode("append").parquet(path)
        out = drain_to_table(stream(), path=str(tmp_path / "out"), checkpoint=check)
    assert sorted((r.v, r.batch) for r in out.collect()) == [(1, 0), (2, 1)]


def test_dedup_within_watermark(spark, batches):
    schema = "event_id bigint, ts timestamp"
    frames = [spark.createDataFrame([(i, START)], schema) for i in (1, 1, 2)]
    assert drain_to_table(jobs.deduplicated(batches(frames))).count() == 2


def test_log_lines_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    line = '{"event":"consultarConvenio_result","response_source":"convenio","status":200,"quotaPlan":"free","quotaRemaining":0}'
    spark.createDataFrame([(line,), ("garbage",), ('{"event":"other"}',)], "value string").write.text(path)
    from worktide.sources.files import log_lines

    updates = drain_to_table(jobs.log_updates(log_lines(spark, path, True)), "update")
    assert [(r.response_source, r.answers, r.exhausted) for r in updates.collect()] == [("convenio", 1, 1)]


def test_unused_columns_are_pruned(spark):
    """The yearly balance reads three order columns and pushes nothing needless."""
    from worktide.queries import registry

    plan = registry.load()[0]["work_year_balance"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in text.splitlines() if "orders.parquet" in line]
    assert reads and "o_totalprice" not in reads[0].split("ReadSchema")[1]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


QUOTA = "user_id bigint, ts timestamp, event_id bigint, is_request boolean, new_plan string"


def quota_rows(seed, count, users=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        plan = rng.choice([None, None, None, "premium", "free"])
        at = START + timedelta(hours=int(rng.integers(0, 80)))
        rows.append((int(rng.integers(1, users + 1)), at, i, plan is None, plan))
    return rows


def as_rows(df):
    columns = sorted(c for c in df.columns if c != "period_key")
    return sorted(map(str, df.select(columns).collect()))


def test_late_rows_change_earlier_decisions(spark, batches, tmp_path):
    """Rows in any order, days late: the ledger is that of all rows at once."""
    rows = quota_rows(5, 160)
    frames = [spark.createDataFrame(rows[a : a + 20], QUOTA) for a in range(0, 160, 20)]
    profiles = spark.createDataFrame([(i,) for i in range(1, 4)], "user_id bigint")
    stream = jobs.quota(batches(frames), str(tmp_path / "quota"), profiles, 3, 2)
    assert as_rows(stream) == as_rows(ac.quota_ledger(spark.createDataFrame(rows, QUOTA), profiles, 3, 2))


def test_quota_state_is_bounded_and_batches_count_once(spark, tmp_path):
    from worktide.sources.store import FAN, Store

    path = str(tmp_path / "quota")
    rows = sorted(quota_rows(6, 120), key=lambda r: (r[1], r[2]))
    profiles = spark.createDataFrame([(i,) for i in range(1, 5)], "user_id bigint")
    given = spark.createDataFrame(rows, QUOTA)

    class Source:
        """Micro-batches by hand, some of them delivered again."""

        sparkSession = spark

    made = []
    drain, query_id = jobs.drain, jobs.query_id
    jobs.drain, jobs.query_id = lambda stream, each, checkpoint=None: made.append(each), lambda s: "run"
    try:
        store = Store(spark, path)
        store.commit("start", 0, {"ledger": ac.quota_ledger(given.limit(0), profiles)})
        jobs.quota(Source(), path, profiles, 3, 2)
        for step in range(12):
            made[0](given.where(f"event_id is not null").join(
                spark.createDataFrame([(r[2],) for r in rows[step * 10 : step * 10 + 10]], "event_id bigint"), "event_id"
            ).select("user_id", "ts", "event_id", "is_request", "new_plan"), step)
            if step in (3, 7):
                made[0](given, step)
    finally:
        jobs.drain, jobs.query_id = drain, query_id
    state = store.state()
    assert len(state["entries"]) <= FAN + 2 and max(e["level"] for e in state["entries"]) == 1
    assert as_rows(jobs.current_ledger(store)) == as_rows(ac.quota_ledger(given, profiles, 3, 2))
    merged = next(e["id"] for e in state["entries"] if e["level"] == 1)
    users = spark.read.parquet(f"{path}/users/batch={merged}")
    assert users.count() == users.select("user_id").distinct().count()


def test_late_activation_resolves_earlier_events(spark, tmp_path):
    from worktide.queries import accounts as qa
    from worktide.sources.tables import events
    from worktide.streaming.runner import slices_of

    folder, path, check = "/root/testdata/sf0.001", str(tmp_path / "b"), str(tmp_path / "c")
    users, provider = qa.accounts_table(spark, folder), qa.provider_tables(spark, folder)
    rows = qa.billing_events(events(spark, folder)).withColumn("turn", F.pmod(F.xxhash64("event_id"), F.lit(1000)))
    for stream in slices_of(rows, 2, "turn"):
        out = jobs.billing(stream.drop("turn"), path, users, *provider, qa.PRICES, qa.PRODUCTS, check)
    columns = ["event_id", "action", "reason", "user_id"]
    want = qa.resolved_changes(spark, folder).select(columns).collect()
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, want))


def test_streamed_percentile_is_exact_over_many_rows(spark, batches):
    """More rows a window than any sketch holds exactly, in pieces; equal to the batch series."""
    rng = np.random.default_rng(8)
    rows = [
        (START + timedelta(seconds=int(s)), f"s{s % 2}", "5xx" if s % 7 == 0 else "2xx", float(ms))
        for s, ms in zip(rng.integers(0, 240, 24000), rng.integers(1, 90000, 24000), strict=True)
    ]
    rows.append((START + timedelta(days=2), "clock", "2xx", 1.0))
    schema = "ts timestamp, service_name string, response_code_class string, latency_ms double"
    frames = [spark.createDataFrame(rows[a : a + 8001], schema) for a in (0, 8001, 16002)]
    got = drain_to_table(jobs.latency_updates(batches(frames), 120))
    want = mo.latency_series(spark.createDataFrame(rows, schema), 120, ["service_name"], ["response_code_class"], "latency_ms")
    key = lambda df: sorted((r.bucket, r.service_name, r.p95_max) for r in df.where("service_name <> 'clock'").collect())
    assert key(got) == key(want) and len(key(got)) == 4
