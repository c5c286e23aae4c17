"""Schedules: dates times slots, logs, reminders, week grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.dates import day_period, due, soon


def active_on(plans: DataFrame, day: Column, start: str = "start_date", end: str = "end_date", include_inactive: bool = True, active: str = "is_active") -> DataFrame:
    """Plans whose range holds the day; a missing end is open. The toggle leaves out inactive plans."""
    inside = plans.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))
    return inside if include_inactive else inside.where(F.col(active))


def expand(plans: DataFrame, slots: Column, first: Column, last: Column) -> DataFrame:
    """One row per day of [first, last] and slot; empty ranges give none."""
    days = plans.where(first <= last).withColumn("day", F.explode(F.sequence(first, last)))
    return days.withColumn("slot", F.explode(slots))


def with_status(doses: DataFrame, log: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Doses with their logged status, 'pending' where none is."""
    return doses.join(log.select(key, status), key, "left").withColumn(status, F.coalesce(status, F.lit("pending")))


def status_summary(doses: DataFrame, *by: str, status: str = "status") -> DataFrame:
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("taken", "pending", "skipped", "missed")]
    return doses.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def reminders(doses: DataFrame, at: Column, now: Column, stages: tuple[int, ...] = (-30, 0, 15, 30, 45)) -> DataFrame:
    """The stages of each dose, in minutes around its time, that still lie ahead."""
    staged = doses.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return staged.withColumn("remind_at", at + F.make_interval(mins=F.col("stage"))).where(F.col("remind_at") > now)


def week_grid(doses: DataFrame, by: list[str], at: Column, status: str = "status") -> DataFrame:
    """Per day and period the counts and the dominant label: missed, pending, taken, skipped, mixed."""
    grid = doses.groupBy(*by, F.to_date(at).alias("day"), day_period(at).alias("period")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(status) == s).alias(s) for s in ("missed", "pending", "taken", "skipped")]
    )
    label = (
        F.when(F.col("missed") > 0, F.format_string("missed %d/%d", "missed", "n"))
        .when(F.col("pending") > 0, F.format_string("pending %d/%d", "pending", "n"))
        .when(F.col("taken") == F.col("n"), "taken")
        .when(F.col("skipped") == F.col("n"), "skipped")
        .otherwise("mixed")
    )
    return grid.withColumn("label", label)


def slot_rows(assignments: DataFrame, slot: str, item: Column) -> DataFrame:
    """Slots with their sorted items; slots without an item are left out."""
    held = assignments.where("pills > 0").groupBy(slot).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"), F.sum("pills").alias("pills"))
    return held.where("pills > 0")


def dose_priority(status: Column, at: Column, now: Column) -> Column:
    """Due doses before those that come soon, then other pending, missed and done ones: 0 to 4."""
    pending = status == "pending"
    return F.when(pending & due(at, now), 0).when(pending & soon(at, now), 1).when(pending, 2).when(status == "missed", 3).otherwise(4)


def plan_title(title: Column, first: Column, second: Column, n: Column) -> Column:
    """A plan's own title, else made of the names of its first two of ``n`` drugs."""
    # The words that make a title.
    none, more = "Kế hoạch thuốc", " và {} thuốc khác"
    lead, tail = more.split("{}")
    rest = F.when(n > 2, F.concat(F.lit(lead), (n - 2).cast("string"), F.lit(tail))).otherwise("")
    made = F.when(n == 0, none).when(n == 1, first).otherwise(F.concat(F.concat_ws(", ", first, second), rest))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", title).otherwise(made)


def has_ended(active: Column, end: Column, today: Column) -> Column:
    """Inactive plans have ended, and those whose last day has passed."""
    return ~active | F.coalesce(end < today, F.lit(False))


def last_day(start: Column, end: Column, days: Column) -> Column:
    """The end of a plan, where none is given that of its ``days``."""
    return F.coalesce(end, F.date_add(start, (days - 1).cast("int")))


def varies(pills: Column) -> Column:
    """An aggregate: whether slots differ in their pills."""
    return F.count_distinct(pills) > 1
