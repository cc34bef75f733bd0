from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worktide.plans import accounts as ac
from worktide.plans import requests as rq
from worktide.plans import worktime as wt

NOW = 10_000
ERASURES = [
    # token, auth_time, sub, status, lookup, provider, cancel_ok, customer, customer_delete, want
    (False, NOW, None, None, "ok", None, True, None, "ok", ("unauthenticated", "none", "none")),
    (True, NOW - 60, None, None, "ok", None, True, None, "ok", ("ok", "not_linked", "not_linked")),
    (True, NOW - 301, None, None, "ok", None, True, None, "ok", ("requires_recent_login", "none", "none")),
    (True, None, None, None, "ok", None, True, None, "ok", ("requires_recent_login", "none", "none")),
    (True, NOW, "s", "active", "ok", "active", False, "c", "ok", ("stripe_subscription_cancel_failed", "none", "none")),
    (True, NOW, "s", "active", "ok", "active", True, "c", "ok", ("ok", "cancelled", "deleted")),
    (True, NOW, "s", "canceled", "ok", "Canceled", False, "c", "ok", ("ok", "already_inactive", "deleted")),
    (True, NOW, None, None, "ok", None, True, "c", "error", ("ok", "not_linked", "retained")),
    (True, NOW, "s", "active", "missing", None, False, "c", "missing", ("ok", "not_found", "not_found")),
    (True, NOW, "s", None, "error", None, True, "c", "ok", ("stripe_subscription_lookup_failed", "none", "none")),
    (True, NOW, None, "Trialing", "ok", None, True, None, "ok", ("stripe_subscription_reference_missing", "none", "none")),
]


def _requests(spark, cases):
    return spark.createDataFrame(
        [(i, "u%d" % i, NOW, *c[:9]) for i, c in enumerate(cases)],
        "i int, uid string, now bigint, token_present boolean, auth_time bigint, subscription_id string, "
        "subscription_status string, lookup string, provider_status string, cancel_ok boolean, "
        "customer_id string, customer_delete string",
    )


def test_erasure_outcomes(spark):
    got = ac.erasure_plan(_requests(spark, ERASURES), F.lit(True)).orderBy("i").collect()
    for row, case in zip(got, ERASURES):
        assert (row.code, row.subscription_outcome, row.customer_outcome) == case[9], case
        assert row.ends_immediately == (row.subscription_outcome == "cancelled")
    off = ac.erasure_plan(_requests(spark, [ERASURES[1], ERASURES[5]]), F.lit(False)).orderBy("i").collect()
    assert [(r.code, r.subscription_outcome) for r in off] == [
        ("ok", "not_checked"), ("stripe_cleanup_unavailable", "none"),
    ]


def test_erased_users_leave_no_row(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(50)], "owner int, v int")
    gone = spark.createDataFrame([(1,), (3,)], "user_id int")
    left = {r.owner for r in ac.without_users(rows, gone, "owner").collect()}
    assert left == {0, 2, 4}


def test_partial_merge_and_clear(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    new = spark.createDataFrame([(1, "z", ["q"]), (3, "n", None)], "id int, p string, cleared array<string>")
    got = {r.id: (r.p, r.q) for r in ac.merge_partial(old, new, "id").collect()}
    assert got == {1: ("z", None), 2: ("b", "y"), 3: ("n", None)}


def test_redelivered_events_count_once(spark):
    rows = [(1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 2), "a"), (2, datetime(2024, 1, 1), "b")]
    assert ac.once(spark.createDataFrame(rows, "event_id int, ts timestamp, v string")).count() == 2


def test_learned_ids_resolve_later_events(spark):
    rows = [
        (1, datetime(2024, 1, 1, 1), "activate", "u1", "", "s9"),
        (2, datetime(2024, 1, 1, 5), "deactivate", "", "", "s9"),
        (3, datetime(2024, 1, 1, 0), "deactivate", "", "", "s9"),
        (4, datetime(2024, 1, 2), "deactivate", "missing", "c2", ""),
        (5, datetime(2024, 1, 2), "deactivate", "", "", ""),
    ]
    decided = spark.createDataFrame(
        rows, "event_id bigint, ts timestamp, action string, uid string, customer_id string, subscription_id string"
    )
    users = spark.createDataFrame(
        [("u1", "c1", None), ("u2", "c2", "")], "user_id string, customer_id string, subscription_id string"
    )
    got = {r.event_id: r.user_id for r in ac.resolve_users(decided, users).collect()}
    assert got == {1: "u1", 2: "u1", 3: None, 4: "u2", 5: None}


def test_trialing_update_deactivates(spark):
    payloads = [
        ("customer.subscription.updated", '{"id":"s","status":"trialing","items":{"data":[{"price":{"id":"p"}}]}}'),
        ("customer.subscription.updated", '{"id":"s","status":"active","items":{"data":[{"price":"q"},{"price":"p"}]}}'),
        ("customer.subscription.updated", '{"id":"s","status":"active","items":{"data":[]}}'),
        ("customer.subscription.deleted", '{"id":"s"}'),
        ("invoice.payment_failed", '{"customer":{"id":"c"},"subscription":"s"}'),
        ("other", "{}"),
    ]
    events = spark.createDataFrame(
        [(i, datetime(2024, 1, 1), t, p) for i, (t, p) in enumerate(payloads)],
        "event_id bigint, ts timestamp, type string, payload string",
    )
    price = "array<struct<price_id string, product_id string>>"
    subs = spark.createDataFrame([], f"subscription_id string, sub_status string, sub_prices {price}, sub_period_end bigint, sub_cancel boolean")
    lines = spark.createDataFrame([], f"object_id string, item_prices {price}")
    got = ac.decide(ac.read_billing(events), subs, lines, ("p",), ()).orderBy("event_id").collect()
    assert [(r.action, r.reason) for r in got] == [
        ("deactivate", "subscription_not_active"), ("activate", "subscription_active"),
        ("deactivate", "subscription_price_not_allowed"), ("deactivate", "subscription_deleted"),
        ("deactivate", "invoice_payment_failed"), ("ignore", "unhandled_type"),
    ]
    assert [r.subscription_status for r in got[3:5]] == ["canceled", "past_due"]
    assert got[4].customer_id == "c" and got[1].subscription_id == "s"


def test_balance_rules(spark):
    """Ratio missing counts as 1, goal 0 falls back, any mark opens a year, halves round up."""
    rows = [("u", "2024-01-0%d" % i, k, h) for i, k, h in
            [(1, "trabajado", True), (2, "baja", False), (3, "otro", True)]] + [("u", "2023-05-01", "otro", False)]
    marks = spark.createDataFrame(rows, "user_id string, day string, kind string, is_holiday boolean").withColumn(
        "day", F.to_date("day")
    )
    year = marks.withColumns({"ratio": F.lit(0.625), "annual_hours": F.lit(0)})
    got = {r.year: r for r in wt.year_balance(year, 20).collect()}
    row = got[2024]
    # 2 days x 5 h = 10; required 20 x .625 - 4 x .625 = 10
    assert (row.days_worked, row.holidays_worked, row.balance_hours, row.state) == (2, 1, 0, "even")
    assert got[2023].hours_label == "-12" and got[2023].days_label == "-2"
    summary = {r.year: r.balance_label for r in wt.year_summary(year).collect()}
    assert summary == {2024: "+13h", 2023: "+0h"}


def test_overtime_cap_is_strict(spark):
    rows = [("a", "2024-01-01", 80), ("b", "2024-01-01", 80), ("b", "2024-03-02", 1)]
    df = spark.createDataFrame(rows, "user_id string, day string, hours int").withColumn("day", F.to_date("day"))
    got = {r.user_id: (r.over_limit, str(r.crossed_on)) for r in wt.overtime_cap(df).collect()}
    assert got == {"a": (False, "None"), "b": (True, "2024-03-02")}


def test_clear_month_keeps_other_data(spark):
    df = spark.createDataFrame([("2024-02-01",), ("2024-03-01",)], "day string").withColumn("day", F.to_date("day"))
    assert [str(r.day) for r in wt.clear_month(df, 2024, 2).collect()] == ["2024-03-01"]
    make = wt.sector_or_legacy(F.col("s"), F.col("f"))
    got = spark.createDataFrame([("", True), (None, False), ("x", True)], "s string, f boolean").select(make).collect()
    assert [r[0] for r in got] == ["hosteleria", "general", "x"]


def test_owned_rows_are_filtered_at_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "owner string, v int").write.parquet(str(tmp_path / "t"))
    rows = rq.owned(spark.read.parquet(str(tmp_path / "t")), "owner", "a")
    assert [r.v for r in rows.collect()] == [1]
    assert "EqualTo(owner,a)" in rows._jdf.queryExecution().executedPlan().toString()


def lookup_rows(spark):
    """Events by (ts, event_id); some name no id, one came twice, one has no time."""
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [
        (at(1), 1, "s1", "c1", None), (at(3), 2, "s1", "c1", None), (at(3), 2, "s1", "c1", None),
        (at(4), 3, "", "c1", None), (at(4), 4, "", "", None), (at(5), 5, None, None, None),
        (None, 6, "s1", "c1", None), (at(6), 7, "s9", "c1", None), (at(7), 8, "s1", "c1", "own"),
    ]
    schema = "ts timestamp, event_id bigint, subscription_id string, customer_id string, user_id string"
    links = [(0, "s1", at(2), 0, "by-sub"), (1, "c1", at(0), 0, "by-customer")]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(links, ac.LINK)


def test_users_by_links_as_of_the_event(spark):
    got = ac.resolve_by_links(*lookup_rows(spark)).collect()
    assert {(r.event_id, r.user_id) for r in got} == {
        (1, "by-customer"), (2, "by-sub"), (3, "by-customer"), (4, None), (5, None), (6, None),
        (7, "by-customer"), (8, "own"),
    }
    assert len(got) == 8


def test_events_stay_out_of_the_lookup(spark):
    """Ids and times alone are sorted and carried; whole events are shuffled once."""
    plan = ac.resolve_by_links(*lookup_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [
        inner for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Window")
        for inner in lines[i + 1 :] if depth(inner) > depth(line)
    ]
    assert below and not [line for line in below if " event#" in line or "AS event#" in line]
