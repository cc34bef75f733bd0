"""Account queries: events play billing, requests and visits; customers play users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.plans import accounts as ac
from worktide.queries.registry import query
from worktide.sources.tables import events, table

PRICES, PRODUCTS = ("price_ok",), ("prod_ok",)
TYPES = {
    "signup": ac.CHECKOUT,
    "purchase": ac.UPDATED,
    "click": ac.DELETED,
    "error": ac.PAYMENT_FAILED,
    "view": "customer.created",
}


def _text(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def billing_events(rows: DataFrame) -> DataFrame:
    """Events with a provider payload as JSON text."""
    k, kind = F.col("k"), F.col("event_type")
    customer_id, sub_id, user = _text("cus_", "user_id"), _text("sub_", "user_id"), F.col("user_id").cast("string")
    as_object = F.to_json(F.struct(customer_id.alias("id")))
    quoted = F.concat(F.lit('"'), customer_id, F.lit('"'))
    # The customer arrives as text or as an object.
    customer = F.when(k < 50, as_object).otherwise(quoted)

    def body(**fields) -> Column:
        inner = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
        head = F.regexp_replace(inner, r"\}$", "")
        return F.concat(head, F.lit(',"customer":'), customer, F.lit("}"))

    def items(price, product) -> Column:
        def item(p, q):
            return F.struct(F.struct(p.alias("id"), F.struct(q.alias("id")).alias("product")).alias("price"))

        return F.struct(F.array(item(F.lit("p0"), F.lit("q0")), item(price, product)).alias("data"))

    payload = (
        F.when(
            kind == "signup",
            body(
                id=_text("cs_", "event_id"),
                status=F.when(k < 80, "complete").otherwise("open"),
                mode=F.when(k < 40, "subscription").when(k < 70, "payment").otherwise("setup"),
                payment_status=F.when(F.col("value") > 20, "paid").otherwise("unpaid"),
                client_reference_id=F.when(F.col("value") < 60, user),
                metadata=F.struct(F.when(k >= 10, user).alias("uid")),
                subscription=sub_id,
            ),
        )
        .when(
            kind == "purchase",
            body(
                id=sub_id,
                status=F.when(k < 60, "active").when(k < 80, "past_due").otherwise("trialing"),
                metadata=F.struct(F.when(F.col("value") < 30, user).alias("userId")),
                items=items(
                    F.when(k < 50, "price_ok").otherwise("price_no"),
                    F.when(k > 90, "prod_ok").otherwise("prod_no"),
                ),
                current_period_end=F.lit(1700000000) + k,
                cancel_at_period_end=k < 30,
            ),
        )
        .when(
            kind == "click",
            body(id=sub_id, status=F.when(k < 50, "canceled")),
        )
        .when(kind == "error", body(id=_text("in_", "event_id"), subscription=F.when(k < 50, sub_id)))
        .otherwise(body(id=customer_id))
    )
    type_ = F.lit(None).cast("string")
    for name, value in TYPES.items():
        type_ = F.when(kind == name, value).otherwise(type_)
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        "event_id", "ts", type_.alias("type"), payload.alias("payload")
    )


def accounts_table(spark: SparkSession, d: str) -> DataFrame:
    """Users; some are missing and some hold another customer's id."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").where("c_nationkey >= 2").select(
        key.cast("string").alias("user_id"),
        F.concat(
            F.lit("cus_"),
            F.when(F.col("c_mktsegment") == "MACHINERY", key + 1).otherwise(key).cast("string"),
        ).alias("customer_id"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("sub_"), key.cast("string"))).alias(
            "subscription_id"
        ),
    )


def provider_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Subscriptions and checkout lines as the provider would return them."""
    price = F.when(F.col("c_mktsegment") == "BUILDING", "price_no").otherwise("price_ok")
    subs = table(spark, d, "customer").select(
        _text("sub_", "c_custkey").alias("subscription_id"),
        F.when(
            F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE"), "active"
        ).otherwise("canceled").alias("sub_status"),
        F.array(F.struct(price.alias("price_id"), F.lit("prod_x").alias("product_id"))).alias(
            "sub_prices"
        ),
        (F.lit(1800000000) + F.col("c_custkey")).alias("sub_period_end"),
        (F.col("c_acctbal") < 0).alias("sub_cancel"),
    )
    lines = (
        events(spark, d)
        .where("event_type = 'signup'")
        .select(
            _text("cs_", "event_id").alias("object_id"),
            F.array(
                F.struct(
                    F.when(F.get_json_object("props", "$.k").cast("int") < 60, "price_ok")
                    .otherwise("price_no")
                    .alias("price_id"),
                    F.lit("").alias("product_id"),
                )
            ).alias("item_prices"),
        )
    )
    return subs, lines


def decisions(spark: SparkSession, d: str) -> DataFrame:
    billing = ac.read_billing(billing_events(events(spark, d)))
    return ac.decide(billing, *provider_tables(spark, d), PRICES, PRODUCTS)


def resolved_changes(spark: SparkSession, d: str) -> DataFrame:
    return ac.resolve_users(decisions(spark, d), accounts_table(spark, d))


DECIDE_SQL = """
ev as (
  select event_id, ts, event_type, user_id, value, (props->>'$.k')::int as k from events),
dec as (
  select e.*, c.c_mktsegment as seg, c.c_acctbal as bal,
    case event_type
      when 'signup' then case when k >= 80 then 'ignore:incomplete_status'
        when value >= 60 and k < 10 then 'ignore:missing_uid'
        when k < 40 then case when seg is null or seg not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE')
                                then 'ignore:subscription_not_active'
                              when seg = 'BUILDING' then 'ignore:price_not_allowed'
                              else 'activate:checkout_subscription' end
        when k >= 70 then 'ignore:mode_not_supported'
        when value <= 20 then 'ignore:payment_not_paid'
        when k >= 60 then 'ignore:price_not_allowed'
        else 'activate:checkout_payment' end
      when 'purchase' then case when k >= 50 and k <= 90 then 'deactivate:subscription_price_not_allowed'
        when k < 60 then 'activate:subscription_active' else 'deactivate:subscription_not_active' end
      when 'click' then 'deactivate:subscription_deleted'
      when 'error' then 'deactivate:invoice_payment_failed'
      else 'ignore:unhandled_type' end as v,
    case when event_type = 'signup' and (value < 60 or k >= 10) then user_id::varchar
         when event_type = 'purchase' and value < 30 then user_id::varchar else '' end as uid,
    'cus_' || user_id as customer_id,
    case when event_type in ('purchase', 'click') then 'sub_' || user_id
         when event_type = 'signup' and k between 40 and 69 then ''
         when event_type = 'signup' then 'sub_' || user_id
         when event_type = 'error' and k < 50 then 'sub_' || user_id else '' end as subscription_id
  from ev e left join customer c on c.c_custkey = e.user_id),
de as (
  select *, split_part(v, ':', 1) as action, split_part(v, ':', 2) as reason from dec),
us as (
  select c_custkey::varchar as user_id, 'cus_' || (case when c_mktsegment = 'MACHINERY' then c_custkey + 1
           else c_custkey end) as customer_id,
         case when c_acctbal > 5000 then 'sub_' || c_custkey end as subscription_id
  from customer where c_nationkey >= 2),
d1 as (select de.* exclude (user_id), us.user_id as u1 from de left join us on us.user_id = de.uid),
ls as (
  select subscription_id as key, timestamp '1970-01-01' as ts, min(user_id) as linked from us
  where subscription_id is not null group by 1
  union all
  select subscription_id, ts, u1 from d1 where action = 'activate' and u1 is not null and subscription_id <> ''),
lc as (
  select customer_id as key, timestamp '1970-01-01' as ts, min(user_id) as linked from us group by 1
  union all
  select customer_id, ts, u1 from d1 where action = 'activate' and u1 is not null),
d2 as (
  select d1.*, ls.linked as u2 from d1 asof left join ls on d1.subscription_id = ls.key and d1.ts >= ls.ts),
d3 as (
  select d2.*, lc.linked as u3 from d2 asof left join lc on d2.customer_id = lc.key and d2.ts >= lc.ts),
res as (
  select *, coalesce(u1, case when subscription_id <> '' then u2 end, u3) as user_id from d3)
"""


@query(
    "billing_decisions",
    f"""
with {DECIDE_SQL}
select event_id, action, reason, coalesce(user_id, '-') as user_id from res""",
)
def billing_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Action, reason and resolved user of every billing event."""
    return resolved_changes(spark, d).select(
        "event_id", "action", "reason", F.coalesce("user_id", F.lit("-")).alias("user_id")
    )


STATE_SQL = """
ch as (
  select *, case when action <> 'activate' then null when event_type = 'signup' and k >= 40 then false
                 when event_type = 'signup' then bal < 0 else k < 30 end as cancel_,
         case event_type when 'signup' then case when k >= 40 then 'paid' else 'active' end
              when 'purchase' then case when k < 60 then 'active' when k < 80 then 'past_due' else 'trialing' end
              when 'click' then 'canceled' else 'past_due' end as st,
         case when event_type = 'signup' and k >= 40 then null
              when event_type = 'signup' then 1800000000 + replace(customer_id, 'cus_', '')::bigint
              else 1700000000 + k end as pe,
         case when event_type = 'purchase' and k >= 50 then 'price_no' else 'price_ok' end as pr
  from res where action in ('activate', 'deactivate') and user_id is not null),
la as (select user_id, arg_max(action, ts) as a, arg_max(st, ts) as st, max(ts) as ts from ch group by 1),
lc2 as (
  select user_id, cancel_ from ch qualify row_number() over (partition by user_id order by ts desc) = 1),
pa as (
  select user_id, customer_id, subscription_id, pr, pe from ch where action = 'activate'
  qualify row_number() over (partition by user_id order by ts desc) = 1)
select la.user_id, case when a = 'activate' then 'premium' else 'free' end as account_kind,
       st as subscription_status, coalesce(cancel_::varchar, '-') as cancel_at_period_end,
       coalesce(nullif(pa.customer_id, ''), '-') as customer_id,
       coalesce(nullif(pa.subscription_id, ''), '-') as subscription_id, coalesce(pr, '-') as price_id,
       coalesce(pe, 0)::bigint as period_end, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at
from la left join lc2 using (user_id) left join pa using (user_id)
"""


@query("billing_state", f"with {DECIDE_SQL}, {STATE_SQL}")
def billing_state(spark: SparkSession, d: str) -> DataFrame:
    return shown_accounts(ac.account_state(ac.applied(resolved_changes(spark, d))))


def shown_accounts(state: DataFrame) -> DataFrame:
    dash = F.lit("-")
    return state.select(
        "user_id",
        "account_kind",
        "subscription_status",
        F.coalesce(F.col("cancel_at_period_end").cast("string"), dash).alias("cancel_at_period_end"),
        F.coalesce("customer_id", dash).alias("customer_id"),
        F.coalesce("subscription_id", dash).alias("subscription_id"),
        F.coalesce("price_id", dash).alias("price_id"),
        F.coalesce("period_end", F.lit(0)).alias("period_end"),
        F.date_format("updated_billing_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


FREE_LIMIT, DAY_LIMIT = 3, 2


def quota_activity(rows: DataFrame) -> DataFrame:
    """Views are requests, purchases start the paid plan, errors end it."""
    kind = F.col("event_type")
    return rows.where(kind.isin("view", "purchase", "error")).select(
        "user_id",
        "ts",
        "event_id",
        (kind == "view").alias("is_request"),
        F.when(kind == "purchase", "premium").when(kind == "error", "free").alias("new_plan"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_nationkey >= 2").select(
        F.col("c_custkey").alias("user_id")
    )


QUOTA_SQL = f"""
pl as (
  select *, coalesce(last_value(case event_type when 'purchase' then 'premium' when 'error' then 'free' end
                       ignore nulls) over (partition by user_id order by ts, event_id
                       rows between unbounded preceding and current row), 'free') as plan
  from events where event_type in ('view', 'purchase', 'error')),
rk as (
  select *, row_number() over (partition by user_id, plan,
              case when plan = 'premium' then cast(ts as date) end order by ts, event_id) as rank,
         case when plan = 'premium' then {DAY_LIMIT} else {FREE_LIMIT} end as lim,
         user_id in (select c_custkey from customer where c_nationkey >= 2) as known
  from pl where event_type = 'view'),
ledger as (
  select event_id, user_id, plan, case when plan = 'premium' then 'day' else 'total' end as period,
         known and rank <= lim as accepted,
         case when not known then 'user_profile_not_found' when rank <= lim then 'ok'
              when plan = 'premium' then 'premium_daily_quota_exceeded'
              else 'free_total_quota_exceeded' end as code,
         case when known then least(rank, lim) else 0 end::bigint as used,
         case when known then lim - least(rank, lim) else 0 end::bigint as remaining
  from rk)
"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return ac.quota_ledger(
        quota_activity(events(spark, d)), profiles(spark, d), FREE_LIMIT, DAY_LIMIT
    ).drop("ts", "period_key")


@query("quota_ledger", f"with {QUOTA_SQL} select * from ledger")
def quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d)


# ---- erasure ----------------------------------------------------------------

NOW = 1700000000


def erasure_requests(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt ask for deletion; their columns give the provider's answers."""
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, d, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_custkey").cast("string").alias("uid"),
        (seg != "HOUSEHOLD").alias("token_present"),
        (F.lit(NOW) - nation * 14).cast("bigint").alias("auth_time"),
        F.lit(NOW).cast("bigint").alias("now"),
        F.when(seg.isin("AUTOMOBILE", "FURNITURE"), F.col("c_name")).alias("subscription_id"),
        F.when(nation < 18, F.col("c_name")).alias("customer_id"),
        F.when((seg == "BUILDING") & (nation < 4), "active").alias("subscription_status"),
        F.when(nation < 3, "error").when(nation < 6, "missing").otherwise("ok").alias("lookup"),
        F.when(seg == "FURNITURE", "Canceled").otherwise("active").alias("provider_status"),
        (nation > 8).alias("cancel_ok"),
        F.when(nation < 8, "ok").when(nation < 12, "missing").otherwise("error").alias(
            "customer_delete"
        ),
    )


ERASURE_SQL = f"""
rq as (
  select c_custkey as user_id, c_mktsegment as seg, c_nationkey as n from customer where c_acctbal < 0),
cd as (
  select *, case when seg = 'HOUSEHOLD' then 'unauthenticated' when n * 14 > 300 then 'requires_recent_login'
     when seg = 'BUILDING' and n < 4 then 'stripe_subscription_reference_missing'
     when seg in ('AUTOMOBILE', 'FURNITURE') and n < 3 then 'stripe_subscription_lookup_failed'
     when seg = 'AUTOMOBILE' and n >= 6 and n <= 8 then 'stripe_subscription_cancel_failed'
     else 'ok' end as code
  from rq),
plan as (
  select user_id, code, code = 'ok' as erase,
    case when code <> 'ok' then 'none' when seg not in ('AUTOMOBILE', 'FURNITURE') then 'not_linked'
         when n between 3 and 5 then 'not_found' when seg = 'FURNITURE' then 'already_inactive'
         else 'cancelled' end as subscription_outcome,
    case when code <> 'ok' then 'none' when n >= 18 then 'not_linked' when n < 8 then 'deleted'
         when n < 12 then 'not_found' else 'retained' end as customer_outcome
  from cd)
"""


def erasures(spark: SparkSession, d: str) -> DataFrame:
    return ac.erasure_plan(erasure_requests(spark, d), F.lit(True))


@query(
    "erasure_plan",
    f"""
with {ERASURE_SQL}
select *, subscription_outcome = 'cancelled' as ends_immediately from plan""",
)
def erasure_plan(spark: SparkSession, d: str) -> DataFrame:
    return erasures(spark, d).select(
        "user_id", "code", "erase", "subscription_outcome", "customer_outcome", "ends_immediately"
    )


@query(
    "erasure",
    f"""
with {ERASURE_SQL},
gone as (select user_id from plan where erase),
o as (select o_orderkey, o_custkey in (select user_id from gone) as out_ from orders)
select 'customer' as table_name, c_custkey as key, 0 as part from customer
where c_custkey not in (select user_id from gone)
union all select 'orders', o_orderkey, 0 from o where not out_
union all select 'lineitem', l_orderkey, l_linenumber from lineitem join o on o_orderkey = l_orderkey where not out_
union all select 'events', event_id, 0 from events""",
)
def erasure(spark: SparkSession, d: str) -> DataFrame:
    """Keys that remain after the cascade; billing rows are kept."""
    gone = erasures(spark, d).where("erase").select("user_id")
    customer, orders, lines, billing = (
        table(spark, d, t) for t in ("customer", "orders", "lineitem", "events")
    )
    owned = gone.withColumnRenamed("user_id", "o_custkey")
    erased_orders = orders.join(owned, "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("l_orderkey")
    )

    def keys(name: str, rows: DataFrame, key: str, part: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), part.alias("part"))

    none = F.lit(0)
    return (
        keys("customer", ac.without_users(customer, gone, "c_custkey"), "c_custkey", none)
        .unionByName(keys("orders", ac.without_users(orders, gone, "o_custkey"), "o_orderkey", none))
        .unionByName(
            keys("lineitem", lines.join(erased_orders, "l_orderkey", "left_anti"), "l_orderkey",
                 F.col("l_linenumber"))
        )
        .unionByName(keys("events", billing, "event_id", none))
    )


@query(
    "profile_defaults",
    """
with f as (
  select user_id + case when event_type = 'view' then 1000000000 else 0 end as user_id, min(ts) as t
  from events group by 1),
p as (select c_custkey as user_id, c_mktsegment as sector, 'N' || c_nationkey as city from customer)
select user_id, '-' as registered_at, city, sector, sector in ('FURNITURE', 'MACHINERY') as is_hospitality
from p
union all
select user_id, strftime(t, '%Y-%m-%d'), 'Donostia', 'general', false from f
where user_id not in (select user_id from p)""",
)
def profile_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A default profile for each user seen first in the events; views come from guests."""
    stored = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lit(None).cast("timestamp").alias("registered_at"),
        _text("N", "c_nationkey").alias("city"),
        F.col("c_mktsegment").alias("sector"),
        F.col("c_mktsegment").isin("FURNITURE", "MACHINERY").alias("is_hospitality"),
    )
    defaults = {
        "city": F.lit(lx.DEFAULT_CITY),
        "sector": F.lit(lx.DEFAULT_SECTOR),
        "is_hospitality": F.lit(False),
    }
    guest = F.when(F.col("event_type") == "view", 1000000000).otherwise(0)
    seen = events(spark, d).select((F.col("user_id") + guest).alias("user_id"), "ts")
    out = ac.default_profiles(seen, stored, defaults)
    return out.withColumn(
        "registered_at", F.coalesce(F.date_format("registered_at", "yyyy-MM-dd"), F.lit("-"))
    )


@query(
    "profile_merge",
    """
with n as (
  select user_id, arg_max(event_type, ts) as sector, max(value) as hours from events group by 1)
select coalesce(c_custkey, user_id) as user_id,
       case when n.hours > 300 then '-' when n.hours > 150 then n.sector else coalesce(c_mktsegment, '-') end
         as sector,
       coalesce('N' || c_nationkey, '-') as city
from customer full join n on c_custkey = user_id""",
)
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Partial update: given fields replace, listed fields are cleared, the rest stays."""
    stored = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("sector"),
        _text("N", "c_nationkey").alias("city"),
    )
    changes = (
        events(spark, d)
        .groupBy("user_id")
        .agg(F.max_by("event_type", "ts").alias("kind"), F.max("value").alias("hours"))
        .select(
            "user_id",
            F.when(F.col("hours") > 150, F.col("kind")).alias("sector"),
            F.when(F.col("hours") > 300, F.array(F.lit("sector"))).alias("cleared"),
        )
    )
    merged = ac.merge_partial(stored, changes, "user_id")
    return merged.select(
        "user_id",
        F.coalesce("sector", F.lit("-")).alias("sector"),
        F.coalesce("city", F.lit("-")).alias("city"),
    )
