"""Work-time ledger: marks, balances, overtime and month reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions.rules import number_or, round_half_up, signed
from worktide.functions.text import verification_id


def overlay(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources in rising precedence; the last one wins per key."""
    tagged = [s.withColumn("__prio", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for other in tagged[1:]:
        out = out.unionByName(other)
    rest = [c for c in sources[0].columns if c not in keys]
    return (
        out.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("__prio")).alias("__row"))
        .select(*keys, "__row.*")
    )


def year_only(marks: DataFrame, year: int) -> DataFrame:
    return marks.where(F.year("day") == year)


def clear_month(marks: DataFrame, year: int, month: int) -> DataFrame:
    return marks.where(~((F.year("day") == year) & (F.month("day") == month)))


def hospitality(sector: Column) -> Column:
    return sector.isin(*lx.HOSPITALITY_SECTORS)


def sector_or_legacy(sector: Column, legacy_flag: Column) -> Column:
    return F.coalesce(
        F.nullif(sector, F.lit("")),
        F.when(legacy_flag, F.lit("hosteleria")).otherwise(F.lit(lx.DEFAULT_SECTOR)),
    )


def toggled_marks(clicks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fold of clicks per (user, day): the same kind again removes the mark.

    Only the last run of equal kinds matters, and its parity decides. Two
    aggregates find where that run starts, so no group is sorted in one task.
    """
    keys = ["user_id", "day"]
    rank = F.struct(*order)
    per_kind = clicks.groupBy(*keys, "kind").agg(F.max(rank).alias("last_at"))
    runs = (
        per_kind.groupBy(*keys)
        .agg(
            F.max(F.struct("last_at", "kind")).alias("top"),
            # A key has few kinds, so this list is short.
            F.sort_array(F.collect_list("last_at"), asc=False).alias("lasts"),
        )
        .select(
            *keys,
            F.col("top.kind").alias("kind"),
            F.try_element_at("lasts", F.lit(2)).alias("other_at"),
        )
    )
    trailing = clicks.withColumn("at", rank).join(runs, [*keys, "kind"]).where(
        F.col("other_at").isNull() | (F.col("at") > F.col("other_at"))
    )
    return (
        trailing.groupBy(*keys, "kind")
        .agg(F.count("*").alias("clicks_in_run"))
        .where(F.col("clicks_in_run") % 2 == 1)
    )


def with_holidays(
    marks: DataFrame, users: DataFrame, holidays: DataFrame, sector_holidays: DataFrame
) -> DataFrame:
    """Adds user columns and ``is_holiday`` (city calendar or sector rule).

    The calendars are plain joins: Spark broadcasts them while they are below
    its own size limit and shuffles otherwise.
    """
    city_days = holidays.select("city", "day", F.lit(True).alias("__city"))
    rules = sector_holidays.select("city", "sector", "month", "dom", F.lit(True).alias("__rule"))
    return (
        marks.join(users, "user_id")
        .withColumns({"month": F.month("day"), "dom": F.day("day")})
        .join(city_days, ["city", "day"], "left")
        .join(rules, ["city", "sector", "month", "dom"], "left")
        .withColumn("is_holiday", F.col("__city").isNotNull() | F.col("__rule").isNotNull())
        .drop("__city", "__rule", "month", "dom")
    )


def _worked(kind: Column) -> Column:
    return kind.isin(*lx.WORK_KINDS)


def year_balance(
    marks: DataFrame, default_goal: int = 0, holiday_credit: int = lx.HOLIDAY_CREDIT
) -> DataFrame:
    """Hour balance per (user, year) of marks with user and holiday columns."""
    counted = (
        marks.groupBy("user_id", F.year("day").alias("year"))
        .agg(
            F.count_if(_worked(F.col("kind"))).alias("days_worked"),
            F.count_if(_worked(F.col("kind")) & F.col("is_holiday")).alias("holidays_worked"),
            F.max("ratio").alias("ratio"),
            F.max("annual_hours").alias("annual_hours"),
        )
        .withColumn("ratio", number_or(F.col("ratio"), 1.0))
    )
    goal = F.coalesce(F.nullif("annual_hours", F.lit(0)), F.lit(default_goal))
    day_hours = F.col("ratio") * lx.HOURS_PER_DAY
    worked = F.col("days_worked") * day_hours
    required = goal * F.col("ratio") - F.col("holidays_worked") * holiday_credit * F.col("ratio")
    balance = round_half_up(worked - required)
    return (
        counted.withColumns({"balance_hours": balance})
        .select(
            "user_id",
            "year",
            "days_worked",
            "holidays_worked",
            round_half_up(worked).alias("hours_worked"),
            round_half_up(required).alias("hours_required"),
            "balance_hours",
            round_half_up(F.col("balance_hours") / day_hours).alias("balance_days"),
        )
        .withColumns(
            {
                "hours_label": signed(F.col("balance_hours"), F.col("balance_hours")),
                "days_label": signed(F.col("balance_days"), F.col("balance_hours")),
                "state": F.when(F.col("balance_hours") > 0, "over")
                .when(F.col("balance_hours") < 0, "under")
                .otherwise("even"),
            }
        )
    )


def year_summary(marks: DataFrame, holiday_credit: int = lx.HOLIDAY_CREDIT) -> DataFrame:
    """Multi-year table: every year with a mark of any kind; rounded only for display."""
    counted = marks.groupBy("user_id", F.year("day").alias("year")).agg(
        F.count_if(_worked(F.col("kind"))).alias("days"),
        F.count_if(_worked(F.col("kind")) & F.col("is_holiday")).alias("holidays_worked"),
        F.max(number_or(F.col("ratio"), 1.0)).alias("ratio"),
        F.coalesce(F.max("annual_hours"), F.lit(0)).alias("goal_hours"),
    )
    worked = F.col("days") * lx.HOURS_PER_DAY * F.col("ratio")
    required = F.col("goal_hours") * F.col("ratio") - (
        F.col("holidays_worked") * holiday_credit * F.col("ratio")
    )
    balance = worked - required
    return counted.select(
        "user_id",
        "year",
        F.col("goal_hours").cast("bigint").alias("goal_hours"),
        "holidays_worked",
        round_half_up(required).alias("hours_required"),
        round_half_up(worked).alias("hours_worked"),
        F.concat(signed(round_half_up(balance), balance), F.lit("h")).alias("balance_label"),
    )


def overtime_by_month(overtime: DataFrame, compensated: DataFrame) -> DataFrame:
    """Overtime per month with its flag; months without hours are left out."""
    months = (
        overtime.groupBy("user_id", F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(F.sum("hours").alias("hours"))
        .where(F.col("hours") != 0)
    )
    return months.join(compensated, ["user_id", "year", "month"], "left").withColumn(
        "compensated", F.coalesce("compensated", F.lit(False))
    )


def overtime_cap(overtime: DataFrame, limit: int = lx.OVERTIME_LIMIT) -> DataFrame:
    """Year total against the legal limit and the day that crosses it.

    The running sum goes over daily totals, at most 366 rows per (user, year).
    """
    days = overtime.groupBy("user_id", "day").agg(F.sum("hours").alias("hours"))
    days = days.withColumn("year", F.year("day"))
    so_far = Window.partitionBy("user_id", "year").orderBy("day")
    run = days.withColumn("so_far", F.sum("hours").over(so_far))
    return run.groupBy("user_id", "year").agg(
        F.sum("hours").alias("total"),
        F.greatest(F.sum("hours") - limit, F.lit(0)).alias("excess"),
        (F.sum("hours") > limit).alias("over_limit"),
        F.min(F.when(F.col("so_far") > limit, F.col("day"))).alias("crossed_on"),
    )


def day_entries(marks: DataFrame, overtime: DataFrame) -> DataFrame:
    """One row per (user, day) with a mark, overtime or both."""
    entries = marks.select(
        "user_id", "day", "kind", "is_holiday", F.lit(None).cast("decimal(18,1)").alias("hours")
    ).unionByName(
        overtime.select(
            "user_id",
            "day",
            F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("boolean").alias("is_holiday"),
            F.col("hours").cast("decimal(18,1)").alias("hours"),
        )
    )
    return entries.groupBy("user_id", "day").agg(
        F.max("kind").alias("kind"),
        F.coalesce(F.max("is_holiday"), F.lit(False)).alias("is_holiday"),
        F.coalesce(F.sum("hours"), F.lit(0)).cast("decimal(18,1)").alias("hours"),
    )


def month_days(entries: DataFrame) -> DataFrame:
    """One line per calendar day of each month that has any entry.

    The day spine is generated per (user, month) and filled from a map of at
    most 31 entries, so the spine itself is never shuffled or joined.
    """
    months = entries.groupBy("user_id", F.trunc("day", "MM").alias("month_start")).agg(
        F.map_from_entries(
            F.collect_list(F.struct("day", F.struct("kind", "is_holiday", "hours")))
        ).alias("filled")
    )
    spine = months.select(
        "user_id",
        "month_start",
        F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("day"),
        "filled",
    )
    entry = F.try_element_at("filled", F.col("day"))
    return spine.select(
        "user_id",
        F.year("day").alias("year"),
        F.month("day").alias("month"),
        "day",
        F.coalesce(F.upper(entry["kind"]), F.lit("NO REGISTRADO")).alias("status"),
        F.coalesce(entry["hours"], F.lit(0).cast("decimal(18,1)")).alias("overtime"),
        F.coalesce(_worked(entry["kind"]), F.lit(False)).alias("worked"),
        F.coalesce(entry["is_holiday"], F.lit(False)).alias("is_holiday"),
    )


def month_sums(entries: DataFrame) -> DataFrame:
    """Sums per month straight from the entries; days without one add nothing."""
    worked = F.coalesce(_worked(F.col("kind")), F.lit(False))
    return entries.groupBy(
        "user_id", F.year("day").alias("year"), F.month("day").alias("month")
    ).agg(
        F.count_if(worked).alias("days_worked"),
        F.sum("hours").alias("overtime_month"),
        F.count_if(worked & F.col("is_holiday")).alias("holidays_worked"),
    )


def month_totals(entries: DataFrame, ratios: DataFrame, prefix: str = "RLC") -> DataFrame:
    """Month totals with the year's overtime and the report id."""
    months = month_sums(entries)
    # A (user, year) has at most twelve rows here.
    year = Window.partitionBy("user_id", "year")
    return (
        months.withColumn("overtime_year", F.sum("overtime_month").over(year))
        .join(ratios, "user_id")
        .select(
            "user_id",
            "year",
            "month",
            round_half_up(
                F.col("days_worked") * lx.HOURS_PER_DAY * number_or(F.col("ratio"), 1.0)
            ).alias("ordinary_hours"),
            "overtime_month",
            "holidays_worked",
            "overtime_year",
            (F.col("overtime_year") > lx.OVERTIME_LIMIT).alias("over_limit"),
            verification_id(F.col("user_id"), F.col("year"), F.col("month"), prefix).alias(
                "report_id"
            ),
        )
    )


def month_grid(months: DataFrame) -> DataFrame:
    """Calendar geometry of each month: length, offset of day 1, neighbours."""
    return months.select(
        "month_start",
        F.day(F.last_day("month_start")).alias("days_in_month"),
        F.weekday("month_start").alias("monday_offset"),
        F.add_months("month_start", 1).alias("next_month"),
        F.add_months("month_start", -1).alias("previous_month"),
    )


def user_export(
    marks: DataFrame, overtime: DataFrame, users: DataFrame
) -> DataFrame:
    """One JSON document per user; a user has at most one entry per day."""
    entries = marks.select(
        "user_id", "day", "kind", F.lit(None).cast("decimal(18,1)").alias("hours")
    ).unionByName(
        overtime.select(
            "user_id",
            "day",
            F.lit(None).cast("string").alias("kind"),
            F.col("hours").cast("decimal(18,1)").alias("hours"),
        )
    )
    per_day = entries.groupBy("user_id", "day").agg(
        F.max("kind").alias("kind"), F.sum("hours").alias("hours")
    )
    key = F.date_format("day", "yyyy-MM-dd")

    def as_map(value: str) -> Column:
        pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(key, F.col(value))))
        return F.map_from_entries(F.array_sort(pairs))

    docs = per_day.groupBy("user_id").agg(
        as_map("kind").alias("registros"), as_map("hours").alias("horasExtra")
    )
    return docs.join(users, "user_id").select(
        "user_id",
        F.size("registros").cast("bigint").alias("n_marks"),
        F.size("horasExtra").cast("bigint").alias("n_overtime"),
        F.to_json(
            F.struct(
                F.col("email").alias("usuario"),
                "registros",
                "horasExtra",
                F.struct(
                    F.col("city").alias("ciudad"),
                    F.col("sector").alias("sector"),
                    F.col("annual_hours").alias("objetivos"),
                ).alias("configuracion"),
            )
        ).alias("document"),
    )
