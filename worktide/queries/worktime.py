"""Work-time queries: orders play day marks, customers play workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions.rules import lookup
from worktide.functions.text import verification_id
from worktide.plans import worktime as wt
from worktide.queries.registry import query
from worktide.sources.tables import events, table

SEGMENT_SECTOR = {
    "AUTOMOBILE": "transporte",
    "BUILDING": "limpieza",
    "FURNITURE": "hosteleria",
    "HOUSEHOLD": "general",
    "MACHINERY": "alojamientos",
}
SEGMENT_RATIO = {"AUTOMOBILE": 1.0, "BUILDING": 0.875, "FURNITURE": 0.75, "HOUSEHOLD": 0.0,
                 "MACHINERY": 0.5}
DEFAULT_GOAL = 1780
KIND = {"F": "trabajado", "P": "baja", "O": "otro"}


def marks(spark: SparkSession, d: str) -> DataFrame:
    """One mark per (user, day); the highest order key wins."""
    return (
        table(spark, d, "orders")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("day"),
            lookup(F.col("o_orderstatus"), KIND).alias("kind"),
            "o_orderkey",
        )
        .groupBy("user_id", "day")
        .agg(F.max_by("kind", "o_orderkey").alias("kind"))
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.lit(None).cast("double")
    for segment, value in SEGMENT_RATIO.items():
        ratio = F.when(F.col("c_mktsegment") == segment, value).otherwise(ratio)
    nation = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city")
    )
    return (
        table(spark, d, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("email"),
            "city",
            lookup(F.col("c_mktsegment"), SEGMENT_SECTOR).alias("sector"),
            ratio.alias("ratio"),
            F.when(F.col("c_mktsegment") == "BUILDING", 0)
            .otherwise(1700 + F.col("c_nationkey"))
            .alias("annual_hours"),
        )
    )


def holidays(spark: SparkSession, d: str) -> DataFrame:
    """New Year, Labour Day, Christmas and one local day per city."""
    span = table(spark, d, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    first, last = (F.lit(v).cast("date") for v in span)
    days = table(spark, d, "nation").select(
        F.col("n_name").alias("city"),
        "n_nationkey",
        F.explode(F.sequence(first, last)).alias("day"),
    )
    month_day = F.date_format("day", "MM-dd")
    local = (F.month("day") == F.col("n_nationkey") % 12 + 1) & (F.day("day") == 15)
    return days.where(month_day.isin("01-01", "05-01", "12-25") | local).select("city", "day")


def sector_holidays(spark: SparkSession, d: str) -> DataFrame:
    """The fixed sector rules, for the cities of region 0."""
    rules = F.array(
        *[
            F.struct(F.lit(s).alias("sector"), F.lit(m).alias("month"), F.lit(n).alias("dom"))
            for _, s, m, n in lx.SECTOR_HOLIDAYS
        ]
    )
    return (
        table(spark, d, "nation")
        .where("n_regionkey = 0")
        .select(F.col("n_name").alias("city"), F.inline(rules))
    )


def holiday_marks(spark: SparkSession, d: str) -> DataFrame:
    return wt.with_holidays(
        marks(spark, d), users(spark, d), holidays(spark, d), sector_holidays(spark, d)
    )


def overtime(spark: SparkSession, d: str) -> DataFrame:
    """Hours per order day: a tenth of the ordered quantity, summed per order first."""
    per_order = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg((F.sum(F.col("l_quantity").cast("decimal(8,1)")) / 10).alias("hours"))
    )
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(per_order, "o_orderkey")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("day"),
            F.col("hours").cast("decimal(18,1)").alias("hours"),
        )
    )


MARKS_SQL = """
marks as (
  select o_custkey as user_id, cast(o_orderdate as date) as day,
         arg_max(case o_orderstatus when 'F' then 'trabajado' when 'P' then 'baja' else 'otro' end,
                 o_orderkey) as kind
  from orders group by 1, 2),
users as (
  select c_custkey as user_id, c_name as email, n_name as city, n_regionkey, n_nationkey,
         case c_mktsegment when 'AUTOMOBILE' then 'transporte' when 'BUILDING' then 'limpieza'
              when 'FURNITURE' then 'hosteleria' when 'HOUSEHOLD' then 'general'
              else 'alojamientos' end as sector,
         case c_mktsegment when 'AUTOMOBILE' then 1.0 when 'BUILDING' then 0.875
              when 'FURNITURE' then 0.75 when 'HOUSEHOLD' then 1.0 else 0.5 end::double as ratio,
         case when c_mktsegment = 'BUILDING' then 0 else 1700 + c_nationkey end as annual_hours
  from customer join nation on c_nationkey = n_nationkey),
hm as (
  select m.*, u.* exclude (user_id), year(day)::int as year, month(day)::int as month,
         (strftime(day, '%m-%d') in ('01-01', '05-01', '12-25')
          or (month(day) = n_nationkey % 12 + 1 and day(day) = 15)
          or (n_regionkey = 0 and sector = 'transporte' and strftime(day, '%m-%d') = '07-10')
          or (n_regionkey = 0 and sector in ('alojamientos', 'hosteleria', 'limpieza')
              and strftime(day, '%m-%d') = '07-29')) as is_holiday
  from marks m join users u using (user_id))
"""
OVERTIME_SQL = """
overtime as (
  select o_custkey as user_id, cast(o_orderdate as date) as day,
         sum(cast(l_quantity / 10 as decimal(18, 1))) as hours
  from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)
"""


@query(
    "work_year_balance",
    f"""
with {MARKS_SQL},
c as (
  select user_id, year, max(ratio) as r,
         max(case when annual_hours = 0 then {DEFAULT_GOAL} else annual_hours end) as goal,
         count(*) filter (kind in ('trabajado', 'baja')) as d,
         count(*) filter (kind in ('trabajado', 'baja') and is_holiday) as h
  from hm group by 1, 2),
b as (
  select *, 8 * r * d as worked, goal * r - 4 * r * h as required,
         floor(8 * r * d - (goal * r - 4 * r * h) + 0.5)::bigint as bal from c),
e as (select *, floor(bal / (8 * r) + 0.5)::bigint as bd from b)
select user_id, year, d as days_worked, h as holidays_worked,
       floor(worked + 0.5)::bigint as hours_worked,
       floor(required + 0.5)::bigint as hours_required,
       bal as balance_hours, bd as balance_days,
       case when bal >= 0 then '+' else '' end || bal as hours_label,
       case when bal >= 0 then '+' else '' end || bd as days_label,
       case when bal > 0 then 'over' when bal < 0 then 'under' else 'even' end as state
from e""",
)
def work_year_balance(spark: SparkSession, d: str) -> DataFrame:
    return wt.year_balance(holiday_marks(spark, d), DEFAULT_GOAL)


@query(
    "work_summary",
    f"""
with {MARKS_SQL},
c as (
  select user_id, year, max(ratio) as r, max(annual_hours) as goal,
         count(*) filter (kind in ('trabajado', 'baja')) as d,
         count(*) filter (kind in ('trabajado', 'baja') and is_holiday) as h
  from hm group by 1, 2),
b as (select *, 8 * r * d as worked, goal * r - 4 * r * h as required from c)
select user_id, year, goal::bigint as goal_hours, h as holidays_worked,
       floor(required + 0.5)::bigint as hours_required,
       floor(worked + 0.5)::bigint as hours_worked,
       case when worked - required >= 0 then '+' else '' end
         || floor(worked - required + 0.5)::bigint || 'h' as balance_label
from b""",
)
def work_summary(spark: SparkSession, d: str) -> DataFrame:
    return wt.year_summary(holiday_marks(spark, d)).orderBy("user_id", F.desc("year"))


@query(
    "overtime_month",
    f"""
with {OVERTIME_SQL},
comp as (
  select o_custkey as user_id, year(o_orderdate) as y, month(o_orderdate) as m,
         bool_or(o_orderpriority = '1-URGENT') as c
  from orders group by 1, 2, 3)
select o.user_id, year(day)::int as year, month(day)::int as month,
       sum(hours)::double as hours, coalesce(bool_or(c), false) as compensated
from overtime o left join comp on comp.user_id = o.user_id and y = year(day) and m = month(day)
group by 1, 2, 3 having sum(hours) <> 0""",
)
def overtime_month(spark: SparkSession, d: str) -> DataFrame:
    compensated = (
        table(spark, d, "orders")
        .groupBy(
            F.col("o_custkey").alias("user_id"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
        )
        .agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("compensated"))
    )
    months = wt.overtime_by_month(overtime(spark, d), compensated)
    return months.withColumn("hours", F.col("hours").cast("double"))


@query(
    "overtime_cap",
    f"""
with {OVERTIME_SQL},
r as (
  select *, year(day)::int as year,
         sum(hours) over (partition by user_id, year(day) order by day) as so_far
  from overtime)
select user_id, year, sum(hours)::double as total,
       greatest(sum(hours) - 80, 0)::double as excess, sum(hours) > 80 as over_limit,
       strftime(min(day) filter (so_far > 80), '%Y-%m-%d') as crossed_on
from r group by 1, 2""",
)
def overtime_cap(spark: SparkSession, d: str) -> DataFrame:
    out = wt.overtime_cap(overtime(spark, d))
    return out.withColumns(
        {
            "total": F.col("total").cast("double"),
            "excess": F.col("excess").cast("double"),
            "crossed_on": F.date_format("crossed_on", "yyyy-MM-dd"),
        }
    )


MONTH_DAYS_SQL = f"""
{MARKS_SQL}, {OVERTIME_SQL},
active as (
  select distinct user_id, date_trunc('month', day)::date as ms from
    (select user_id, day from marks union all select user_id, day from overtime)),
spine as (
  select user_id, unnest(generate_series(ms, last_day(ms), interval 1 day))::date as day
  from active),
lines as (
  select s.user_id, year(s.day)::int as year, month(s.day)::int as month, s.day,
         coalesce(upper(kind), 'NO REGISTRADO') as status, coalesce(hours, 0) as overtime,
         coalesce(kind in ('trabajado', 'baja'), false) as worked,
         coalesce(is_holiday, false) as is_holiday
  from spine s left join hm on hm.user_id = s.user_id and hm.day = s.day
  left join overtime o on o.user_id = s.user_id and o.day = s.day)
"""


@query(
    "month_report_days",
    f"""
with {MONTH_DAYS_SQL}
select user_id, year, month, strftime(day, '%Y-%m-%d') as day, status,
       case when overtime > 0 then overtime || 'h' else '-' end as overtime_label, worked,
       is_holiday
from lines""",
)
def month_report_days(spark: SparkSession, d: str) -> DataFrame:
    days = wt.month_days(wt.day_entries(holiday_marks(spark, d), overtime(spark, d)))
    label = F.when(
        F.col("overtime") > 0, F.concat(F.col("overtime").cast("string"), F.lit("h"))
    ).otherwise("-")
    return days.select(
        "user_id", "year", "month", F.date_format("day", "yyyy-MM-dd").alias("day"), "status",
        label.alias("overtime_label"), "worked", "is_holiday",
    )


@query(
    "month_report_totals",
    f"""
with {MONTH_DAYS_SQL},
m as (
  select user_id, year, month, count(*) filter (worked) as d, sum(overtime) as om,
         count(*) filter (worked and is_holiday) as holidays_worked
  from lines group by 1, 2, 3),
y as (select *, sum(om) over (partition by user_id, year) as oy from m)
select user_id, year, month, floor(d * 8 * ratio + 0.5)::bigint as ordinary_hours,
       om::double as overtime_month, holidays_worked, oy::double as overtime_year,
       oy > 80 as over_limit,
       'RLC-' || upper(substr(to_base64(encode(user_id || '' || year || (month - 1))), 1, 24))
         || '-' || year as report_id,
       'RLC-' || upper(md5(lpad(user_id::varchar, 28, 'u') || year || (month - 1))) || '-' || year
         as long_report_id
from y join users using (user_id)""",
)
def month_report_totals(spark: SparkSession, d: str) -> DataFrame:
    entries = wt.day_entries(holiday_marks(spark, d), overtime(spark, d))
    out = wt.month_totals(entries, users(spark, d).select("user_id", "ratio"))
    return out.withColumns(
        {
            "overtime_month": F.col("overtime_month").cast("double"),
            "overtime_year": F.col("overtime_year").cast("double"),
            "long_report_id": verification_id(
                F.lpad(F.col("user_id").cast("string"), 28, "u"), F.col("year"), F.col("month")
            ),
        }
    )


@query(
    "month_rollup",
    f"""
with {MONTH_DAYS_SQL}
select user_id, year, coalesce(month, 0)::int as month, count(*) filter (worked) as days_worked,
       sum(overtime)::double as overtime, grouping(month)::int as is_year_row
from lines group by grouping sets ((user_id, year, month), (user_id, year))""",
)
def month_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Month and year rows in one pass; month 0 marks the year row."""
    sums = wt.month_sums(wt.day_entries(holiday_marks(spark, d), overtime(spark, d)))
    return (
        sums.groupingSets(
            [("user_id", "year", "month"), ("user_id", "year")], "user_id", "year", "month"
        )
        .agg(
            F.sum("days_worked").alias("days_worked"),
            F.sum("overtime_month").cast("double").alias("overtime"),
            F.grouping("month").cast("int").alias("is_year_row"),
        )
        .withColumn("month", F.coalesce("month", F.lit(0)))
    )


@query(
    "month_grid",
    """
with m as (select distinct date_trunc('month', o_orderdate)::date as ms from orders)
select strftime(ms, '%Y-%m-%d') as month_start, day(last_day(ms))::int as days_in_month,
       (isodow(ms) - 1)::int as monday_offset,
       strftime(ms + interval 1 month, '%Y-%m-%d') as next_month,
       strftime(ms - interval 1 month, '%Y-%m-%d') as previous_month
from m""",
)
def month_grid(spark: SparkSession, d: str) -> DataFrame:
    months = (
        table(spark, d, "orders")
        .select(F.trunc("o_orderdate", "MM").alias("month_start"))
        .distinct()
    )
    grid = wt.month_grid(months)
    text = {c: F.date_format(c, "yyyy-MM-dd") for c in ("month_start", "next_month", "previous_month")}
    return grid.withColumns(text)


@query(
    "mark_toggle",
    """
with c as (
  select user_id, cast(ts as date) as day, event_type as kind, ts, event_id,
         row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as rn,
         first_value(event_type) over (partition by user_id, cast(ts as date)
                                       order by ts desc, event_id desc) as last_kind
  from events),
r as (
  select user_id, day, any_value(last_kind) as kind,
         coalesce(min(rn) filter (kind <> last_kind) - 1, count(*)) as run
  from c group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as day, kind, run::bigint as clicks_in_run
from r where run % 2 = 1""",
)
def mark_toggle(spark: SparkSession, d: str) -> DataFrame:
    clicks = events(spark, d).select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "ts", "event_id"
    )
    out = wt.toggled_marks(clicks, ["ts", "event_id"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "year_overlay",
    """
with src as (
  select o_custkey as user_id, cast(o_orderdate as date) as day,
         case o_orderstatus when 'F' then 'trabajado' when 'P' then 'baja' else 'otro' end as kind,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end as prio, o_orderkey
  from orders
  where not (year(o_orderdate) = 1996 and month(o_orderdate) = 2)),
one as (
  select user_id, day, prio, arg_max(kind, o_orderkey) as kind from src group by 1, 2, 3),
pick as (
  select user_id, day, arg_max(kind, prio) as kind, max(prio) as prio from one group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as day, kind,
       case when prio = 1 then 'year' else 'legacy' end as origin,
       c_mktsegment in ('FURNITURE', 'MACHINERY') as is_hospitality
from pick join customer on c_custkey = user_id""",
)
def year_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Old marks kept in the user row, overlaid by year rows; one month cleared."""
    src = table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("day"),
        lookup(F.col("o_orderstatus"), KIND).alias("kind"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("old"),
        "o_orderkey",
    )

    def side(flag: bool, origin: str) -> DataFrame:
        return (
            src.where(F.col("old") == flag)
            .groupBy("user_id", "day")
            .agg(F.max_by("kind", "o_orderkey").alias("kind"))
            .withColumn("origin", F.lit(origin))
        )

    marks_ = wt.overlay([side(True, "legacy"), side(False, "year")], ["user_id", "day"])
    people = users(spark, d).select(
        "user_id", wt.hospitality(F.col("sector")).alias("is_hospitality")
    )
    return (
        wt.clear_month(marks_, 1996, 2)
        .join(people, "user_id")
        .withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    )


@query(
    "user_export",
    f"""
with {MARKS_SQL}, {OVERTIME_SQL},
m as (
  select user_id, count(*) as n, string_agg('"' || strftime(day, '%Y-%m-%d') || '":"' || kind || '"', ','
                                order by day) as s
  from marks group by 1),
o as (
  select user_id, count(*) as n, string_agg('"' || strftime(day, '%Y-%m-%d') || '":' || hours, ','
                                order by day) as s
  from overtime group by 1)
select user_id, coalesce(m.n, 0) as n_marks, coalesce(o.n, 0) as n_overtime,
       '{{"usuario":"' || email || '","registros":{{' || coalesce(m.s, '') || '}},"horasExtra":{{'
       || coalesce(o.s, '') || '}},"configuracion":{{"ciudad":"' || city || '","sector":"' || sector
       || '","objetivos":' || annual_hours || '}}}}' as document
from m full join o using (user_id) join users using (user_id)""",
)
def user_export(spark: SparkSession, d: str) -> DataFrame:
    return wt.user_export(marks(spark, d), overtime(spark, d), users(spark, d))
