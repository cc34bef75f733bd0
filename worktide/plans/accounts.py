"""Account state: billing events, quota ledger, erasure, default profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.computed import computed
from worktide.operators.ordered import carry_last, ordinal
from worktide.operators.staging import stage

ITEMS = "array<struct<price variant>>"


# ---- billing events -------------------------------------------------------


def _id(value: Column) -> Column:
    """Id given as text or as an object holding ``id``; empty when absent."""
    as_text = F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )
    # The object form first: a schema is read only where there is no id.
    return F.coalesce(F.try_variant_get(value, "$.id", "string"), as_text, F.lit(""))


def _prices(items: Column) -> Column:
    return F.transform(
        F.coalesce(items, F.array().cast(ITEMS)),
        lambda i: F.struct(
            _id(i["price"]).alias("price_id"),
            _id(F.try_variant_get(i["price"], "$.product", "variant")).alias("product_id"),
        ),
    )


def read_billing(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Fields of the event object; ``payload`` is its JSON text."""
    doc = F.col("__doc")

    def text(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    def node(path: str) -> Column:
        return F.try_variant_get(doc, path, "variant")

    is_subscription = F.col("type").startswith("customer.subscription.")
    return (
        computed(events, {"__doc": F.try_parse_json(payload)})
        .select(
            "event_id",
            "ts",
            "type",
            text("$.status").alias("status"),
            tx.text_or_empty(text("$.mode")).alias("mode"),
            text("$.payment_status").alias("payment_status"),
            _id(doc).alias("object_id"),
            tx.first_present(
                F.when(~is_subscription, text("$.client_reference_id")),
                text("$.metadata.uid"),
                text("$.metadata.userId"),
            ).alias("uid"),
            _id(node("$.customer")).alias("customer_id"),
            F.when(is_subscription, _id(doc))
            .otherwise(_id(node("$.subscription")))
            .alias("subscription_id"),
            _prices(F.try_variant_get(doc, "$.items.data", ITEMS)).alias("prices"),
            F.try_variant_get(doc, "$.current_period_end", "bigint").alias("period_end"),
            F.coalesce(
                F.try_variant_get(doc, "$.cancel_at_period_end", "boolean"), F.lit(False)
            ).alias("cancel_at_period_end"),
        )
    )


def _first_allowed(prices_: Column, prices: Sequence[str], products: Sequence[str]) -> Column:
    return F.try_element_at(
        F.filter(
            prices_, lambda p: rules.allowed_price(p["price_id"], p["product_id"], prices, products)
        ),
        F.lit(1),
    )


# Handled event types.
CHECKOUT = "checkout.session.completed"
UPDATED = "customer.subscription.updated"
DELETED = "customer.subscription.deleted"
PAYMENT_FAILED = "invoice.payment_failed"
HANDLED = (CHECKOUT, UPDATED, DELETED, PAYMENT_FAILED)


def decide(
    billing: DataFrame,
    subscriptions: DataFrame,
    line_items: DataFrame,
    prices: Sequence[str],
    products: Sequence[str],
) -> DataFrame:
    """Action and reason of each event.

    ``subscriptions`` holds subscription_id, sub_status, sub_prices,
    sub_period_end and sub_cancel; ``line_items`` object_id and item_prices.
    """
    joined = billing.join(subscriptions, "subscription_id", "left").join(
        line_items, "object_id", "left"
    )
    by_sub = F.col("mode") == "subscription"
    checkout = F.col("type") == CHECKOUT
    match = _first_allowed(
        F.when(checkout & by_sub, F.col("sub_prices"))
        .when(checkout, F.col("item_prices"))
        .otherwise(F.col("prices")),
        prices,
        products,
    )

    def verdict(action: str, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))

    configured = F.lit(bool(prices or products))
    active_sub = F.coalesce(F.col("sub_status") == "active", F.lit(False))
    allowed = F.col("match").isNotNull()
    checkout_rule = (
        F.when(~configured, verdict("ignore", "premium_config_missing"))
        .when(~F.col("status").eqNullSafe("complete"), verdict("ignore", "incomplete_status"))
        .when(F.col("uid") == "", verdict("ignore", "missing_uid"))
        .when(by_sub & ~active_sub, verdict("ignore", "subscription_not_active"))
        .when(by_sub & ~allowed, verdict("ignore", "price_not_allowed"))
        .when(by_sub, verdict("activate", "checkout_subscription"))
        .when(F.col("mode") != "payment", verdict("ignore", "mode_not_supported"))
        .when(
            ~F.col("payment_status").eqNullSafe("paid"), verdict("ignore", "payment_not_paid")
        )
        .when(~allowed, verdict("ignore", "price_not_allowed"))
        .otherwise(verdict("activate", "checkout_payment"))
    )
    rule = (
        F.when(checkout, checkout_rule)
        .when(
            (F.col("type") == UPDATED) & ~allowed,
            verdict("deactivate", "subscription_price_not_allowed"),
        )
        .when(
            (F.col("type") == UPDATED) & (F.col("status") == "active"),
            verdict("activate", "subscription_active"),
        )
        .when(F.col("type") == UPDATED, verdict("deactivate", "subscription_not_active"))
        .when(F.col("type") == DELETED, verdict("deactivate", "subscription_deleted"))
        .when(F.col("type") == PAYMENT_FAILED, verdict("deactivate", "invoice_payment_failed"))
        .otherwise(verdict("ignore", "unhandled_type"))
    )
    paid = checkout & (F.col("mode") == "payment")
    status = (
        F.when(paid, "paid")
        .when(checkout, F.col("sub_status"))
        .when(F.col("type") == PAYMENT_FAILED, "past_due")
        .when(F.col("type") == DELETED, F.coalesce(F.nullif("status", F.lit("")), F.lit("canceled")))
        .otherwise(F.col("status"))
    )
    return (
        computed(computed(joined, {"match": match}), {"verdict": rule})
        .select(
            "event_id", "ts", "type", "verdict.*", "uid", "customer_id",
            F.when(paid, "").otherwise(F.col("subscription_id")).alias("subscription_id"),
            "match.price_id",
            "match.product_id",
            F.coalesce(F.nullif(status, F.lit("")), F.col("verdict.reason")).alias(
                "subscription_status"
            ),
            F.when(paid, None)
            .when(checkout, F.col("sub_period_end"))
            .otherwise(F.col("period_end"))
            .alias("period_end"),
            F.when(paid, False)
            .when(checkout, F.coalesce("sub_cancel", F.lit(False)))
            .otherwise(F.col("cancel_at_period_end"))
            .alias("cancel_at_period_end"),
        )
    )


LINK = "kind int, key string, ts timestamp, event_id bigint, linked string"


def keys_of() -> Column:
    """Ids an event names, by kind."""
    pairs = [(0, "subscription_id"), (1, "customer_id")]
    return F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in pairs]),
        lambda p: p["key"] != "",
    )


def direct_users(decided: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the user whose id the event itself names."""
    ids = users.select(F.col("user_id").alias("uid"), F.col("user_id"))
    return decided.join(ids, "uid", "left")


def learned_links(direct: DataFrame) -> DataFrame:
    """Ids that activations of known users store, as of the event."""
    return (
        direct.where((F.col("action") == "activate") & F.col("user_id").isNotNull())
        .select("ts", "event_id", F.col("user_id").alias("linked"), F.inline_outer(keys_of()))
        .where("key is not null")
        .select("kind", "key", "ts", "event_id", "linked")
    )


def stored_links(users: DataFrame) -> DataFrame:
    """Ids of the user table, valid from the start; the lowest user id wins."""
    return (
        users.select("user_id", F.inline_outer(keys_of()))
        .where("key is not null")
        .groupBy("kind", "key")
        .agg(F.min("user_id").alias("linked"))
        .select(
            "kind", "key", F.lit("1970-01-01").cast("timestamp").alias("ts"),
            F.lit(-1).cast("bigint").alias("event_id"), "linked",
        )
    )


def asked_keys(direct: DataFrame) -> DataFrame:
    """Ids by which the user of an event has to be found."""
    return direct.where("user_id is null").select(F.inline(keys_of())).select("kind", "key")


def resolve_by_links(direct: DataFrame, links: DataFrame, bucket: str = "hour") -> DataFrame:
    """Finds the user of the other events: by subscription, else by customer, as of the event.

    Only ids and times go through the lookup; the events are shuffled once, to meet their hits.
    """
    at = ["ts", "event_id"]
    rest = [c for c in direct.columns if c not in ("user_id", *at)]
    open_ = direct.where("user_id is null")
    asked = open_.select(*at, F.inline(keys_of())).withColumn("linked", F.lit(None).cast("string"))
    timeline = asked.withColumn("asks", F.lit(True)).unionByName(links.withColumn("asks", F.lit(False)))
    hits = (
        carry_last(timeline, ["kind", "key"], at, F.date_trunc(bucket, "ts"), "linked", "hit")
        .where(F.col("asks") & F.col("hit").isNotNull())
        .select(*at, "kind", "hit")
    )
    found = (
        open_.select(*at, F.struct(*rest).alias("event"))
        .unionByName(hits, allowMissingColumns=True)
        .groupBy(*at)
        .agg(
            F.any_value("event", True).alias("event"),
            F.min_by("hit", "kind").alias("user_id"),
        )
        .select(*at, "event.*", "user_id")
    )
    return direct.where("user_id is not null").unionByName(found.select(direct.columns))


def resolve_users(decided: DataFrame, users: DataFrame, bucket: str = "hour") -> DataFrame:
    """Adds ``user_id``: by uid, else by subscription, else by customer.

    ``users`` holds user_id, customer_id and subscription_id. A user found by
    uid takes the ids of an activation, and later events without a uid find the
    user through them: one as-of lookup over both kinds of id.
    """
    # Two branches follow; payloads are parsed once.
    direct = stage(direct_users(decided, users))
    links = stored_links(users).unionByName(learned_links(direct))
    return resolve_by_links(direct, links, bucket)


def applied(resolved: DataFrame) -> DataFrame:
    """Events that change an account; the others stay in the decision log."""
    return resolved.where(
        F.col("action").isin("activate", "deactivate") & F.col("user_id").isNotNull()
    )


def account_state(changes: DataFrame) -> DataFrame:
    """State per user after all changes, by (ts, event_id).

    The last change sets kind, status, cancel flag and time; ids, price and
    period end stay as the last activation set them.
    """
    at = F.struct("ts", "event_id")
    activated = F.col("action") == "activate"

    def nullable(c: str) -> Column:
        return F.nullif(F.col(c), F.lit("")).alias(c)

    state = changes.groupBy("user_id").agg(
        F.max_by(
            F.struct(
                F.when(activated, "premium").otherwise("free").alias("account_kind"),
                F.when(activated, F.coalesce("subscription_status", F.lit("active")))
                .otherwise(F.coalesce("subscription_status", "reason", F.lit("inactive")))
                .alias("subscription_status"),
                F.when(activated, F.col("cancel_at_period_end")).alias("cancel_at_period_end"),
                F.col("ts").alias("updated_billing_at"),
            ),
            at,
        ).alias("last"),
        F.max_by(
            F.struct(
                nullable("customer_id"), nullable("subscription_id"), nullable("price_id"),
                nullable("product_id"), "period_end",
            ),
            F.when(activated, at),
        ).alias("paid"),
    )
    return state.select("user_id", "last.*", "paid.*")


def once(events: DataFrame, key: str = "event_id", order: str = "ts") -> DataFrame:
    """One row per event id; redelivered copies are dropped by an aggregate."""
    rest = [c for c in events.columns if c != key]
    return (
        events.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
        .select(key, "__row.*")
    )


# ---- quota ------------------------------------------------------------------


def quota_ledger(
    activity: DataFrame,
    profiles: DataFrame,
    free_limit: int = lx.FREE_TOTAL_LIMIT,
    daily_limit: int = lx.PAID_DAILY_LIMIT,
    bucket: str = "hour",
    plans: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Decision and counters of every request.

    ``plans`` (user_id, ts, event_id, new_plan) are changes known before, ``counted`` (user_id,
    plan, period_key, before) the requests counted before. A user without profile has no quota:
    ``used`` and ``remaining`` are zero.

    ``activity`` holds user_id, ts, event_id, is_request and new_plan (null for
    requests). The plan is the one valid at the request; a free request counts
    against the total, a paid one against its UTC day. Rejected requests come
    after the limit is reached, so the rank alone decides.
    """
    slot = F.date_trunc(bucket, "ts")
    order = ["ts", "event_id"]
    if plans is not None:
        known = plans.join(activity.select("user_id").distinct(), "user_id", "left_semi")
        activity = activity.unionByName(known.withColumn("is_request", F.lit(False)))
    planned = carry_last(activity, ["user_id"], order, slot, "new_plan", "plan").where("is_request")
    planned = planned.withColumns(
        {
            "plan": F.coalesce("plan", F.lit("free")),
            "day": F.to_date("ts"),
        }
    ).withColumn(
        "period_key",
        F.when(F.col("plan") == "premium", F.date_format("day", "yyyy-MM-dd")).otherwise("total"),
    )
    # Requests of users without a profile consume nothing.
    known = planned.join(
        profiles.select("user_id", F.lit(True).alias("__known")), "user_id", "left"
    )
    # Ranking reads its input twice; the plan lookup and the join are done once.
    known = stage(known.drop("is_request", "new_plan"))
    ranked = ordinal(
        known, ["user_id", "plan", "period_key"], order, slot, "rank"
    )
    if counted is not None:
        ranked = ranked.join(counted, ["user_id", "plan", "period_key"], "left").withColumn(
            "rank", F.col("rank") + F.coalesce("before", F.lit(0))
        )
    limit = F.when(F.col("plan") == "premium", daily_limit).otherwise(free_limit)
    accepted = F.col("__known").isNotNull() & (F.col("rank") <= limit)
    return ranked.select(
        "event_id",
        "user_id",
        "ts",
        "plan",
        F.when(F.col("plan") == "premium", "day").otherwise("total").alias("period"),
        accepted.alias("accepted"),
        F.when(F.col("__known").isNull(), "user_profile_not_found")
        .when(accepted, "ok")
        .when(F.col("plan") == "premium", "premium_daily_quota_exceeded")
        .otherwise("free_total_quota_exceeded")
        .alias("code"),
        F.when(F.col("__known").isNotNull(), F.least("rank", limit))
        .otherwise(0)
        .cast("bigint")
        .alias("used"),
        F.when(F.col("__known").isNotNull(), rules.remaining(limit, F.least("rank", limit)))
        .otherwise(0)
        .cast("bigint")
        .alias("remaining"),
        "period_key",
    )


# ---- erasure ----------------------------------------------------------------


def erasure_plan(requests: DataFrame, configured: Column) -> DataFrame:
    """Outcome of each deletion request.

    Expects uid, token_present, auth_time, now, subscription_id, customer_id,
    subscription_status and the provider's answers: lookup and
    customer_delete (ok, missing, error), provider_status, cancel_ok.
    """
    sub = tx.text_or_empty(F.col("subscription_id"))
    customer = tx.text_or_empty(F.col("customer_id"))
    active = (sub != "") | F.lower(tx.text_or_empty(F.col("subscription_status"))).isin(
        *lx.LIVE_SUBSCRIPTIONS
    )
    ended = F.lower(tx.text_or_empty(F.col("provider_status"))).isin(*lx.TERMINAL_SUBSCRIPTIONS)
    looked_up = configured & (sub != "")
    code = (
        F.when(
            ~F.coalesce(F.col("token_present"), F.lit(False))
            | (tx.text_or_empty(F.col("uid")) == ""),
            "unauthenticated",
        )
        .when(~rules.recent_login(F.col("auth_time"), F.col("now")), "requires_recent_login")
        .when(active & ~configured, "stripe_cleanup_unavailable")
        .when(active & (sub == ""), "stripe_subscription_reference_missing")
        .when(looked_up & (F.col("lookup") == "error"), "stripe_subscription_lookup_failed")
        .when(
            looked_up & (F.col("lookup") == "ok") & ~ended & ~F.col("cancel_ok"),
            "stripe_subscription_cancel_failed",
        )
        .otherwise("ok")
    )
    subscription = (
        F.when(~configured, "not_checked")
        .when(sub == "", "not_linked")
        .when(F.col("lookup") == "missing", "not_found")
        .when(ended, "already_inactive")
        .otherwise("cancelled")
    )
    outcome = (
        F.when(~configured, "not_checked")
        .when(customer == "", "not_linked")
        .when(F.col("customer_delete") == "ok", "deleted")
        .when(F.col("customer_delete") == "missing", "not_found")
        .otherwise("retained")
    )
    ok = F.col("code") == "ok"
    return requests.withColumn("code", code).withColumns(
        {
            "erase": ok,
            "subscription_outcome": F.when(ok, subscription).otherwise("none"),
            "customer_outcome": F.when(ok, outcome).otherwise("none"),
            "ends_immediately": ok & (subscription == "cancelled"),
        }
    )


def without_users(rows: DataFrame, erased: DataFrame, key: str) -> DataFrame:
    """Rows that stay after the erasure of ``erased`` users."""
    return rows.join(erased.select(F.col("user_id").alias(key)), key, "left_anti")


# ---- profiles ---------------------------------------------------------------


def default_profiles(
    seen: DataFrame, profiles: DataFrame, defaults: Mapping[str, Column]
) -> DataFrame:
    """Existing profiles and a default row for every user seen without one."""
    new = (
        seen.groupBy("user_id")
        .agg(F.min("ts").alias("registered_at"))
        .join(profiles.select("user_id"), "user_id", "left_anti")
        .select("user_id", "registered_at", *[v.alias(k) for k, v in defaults.items()])
    )
    return profiles.select(new.columns).unionByName(new)


def merge_partial(
    old: DataFrame, new: DataFrame, key: str, cleared: str = "cleared"
) -> DataFrame:
    """Only supplied fields change; names listed in ``cleared`` become null.

    ``new`` may lack columns of ``old``.
    """
    fields = [c for c in old.columns if c != key]
    given = [c for c in fields if c in new.columns]
    theirs = new.select(
        key, *[F.col(c).alias(f"__n_{c}") for c in given], F.col(cleared).alias("__cleared")
    )

    def value(c: str) -> Column:
        kept = F.coalesce(F.col(f"__n_{c}"), F.col(c)) if c in given else F.col(c)
        gone = F.coalesce(F.array_contains("__cleared", c), F.lit(False))
        return F.when(~gone, kept).alias(c)

    return old.join(theirs, key, "full_outer").select(key, *[value(c) for c in fields])
