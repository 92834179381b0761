"""Dates of regular composite periods, as DataFrames and as plain lists."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.validate import choice, positive_integer

CYCLES = ("annual", "monthly", "semimonthly", "10-day", "16-day", "8-day", "weekly", "daily")
ANCHORS = ("start", "centre", "end")
WEEKS = 52


def _month_end(day: date) -> date:
    return (day.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)


def period_of(day: date, cycle: str) -> tuple[date, date] | None:
    """First and last day of the period that holds a day; None for days in no period (the end of a year of weeks)."""
    jan1, dec31 = date(day.year, 1, 1), date(day.year, 12, 31)
    if cycle == "daily":
        return day, day
    if cycle == "annual":
        return jan1, dec31
    if cycle == "monthly":
        return day.replace(day=1), _month_end(day)
    if cycle == "semimonthly":
        return (day.replace(day=1), day.replace(day=15)) if day.day <= 15 else (day.replace(day=16), _month_end(day))
    if cycle == "10-day":
        third = min((day.day - 1) // 10, 2)
        return day.replace(day=10 * third + 1), _month_end(day) if third == 2 else day.replace(day=10 * third + 10)
    length = {"16-day": 16, "8-day": 8, "weekly": 7}[cycle]
    k = (day - jan1).days // length
    if cycle == "weekly":
        return None if k >= WEEKS else (jan1 + timedelta(days=7 * k), jan1 + timedelta(days=7 * k + 6))
    return jan1 + timedelta(days=length * k), min(jan1 + timedelta(days=length * (k + 1) - 1), dec31)


def periods(cycle: str, start: date, n: int) -> list[tuple[date, date]]:
    """The n periods from the one that begins on ``start``."""
    choice(cycle, CYCLES, "cycle_type")
    if period_of(start, cycle) is None or period_of(start, cycle)[0] != start:
        raise ValueError(f"{start} does not begin a {cycle} period")
    out: list[tuple[date, date]] = []
    day = start
    while len(out) < positive_integer(n, "n"):
        p = period_of(day, cycle)
        if p is None:
            day += timedelta(days=1)
            continue
        out.append(p)
        day = p[1] + timedelta(days=1)
    return out


def anchored(p: tuple[date, date], anchor: str = "centre") -> date:
    """The period's first, last or central day (the earlier of two central days)."""
    choice(anchor, ANCHORS, "time_anchor")
    return {"start": p[0], "end": p[1], "centre": p[0] + timedelta(days=(p[1] - p[0]).days // 2)}[anchor]


def calendar_dates(cycle: str, start: date, n: int, end: date | None = None, anchor: str = "centre") -> list[date]:
    """The anchored dates of n periods; ``end``, where given, must be the last day of the last one."""
    found = periods(cycle, start, n)
    if end is not None and found[-1][1] != end:
        raise ValueError(f"{n} {cycle} periods from {start} end on {found[-1][1]}, not {end}")
    return [anchored(p, anchor) for p in found]


def period_start_sql(day: str, cycle: str) -> str:
    """SQL for the first day of the period of a date; null in no period."""
    year = f"date_trunc('year', {day})"
    k = f"(dayofyear({day}) - 1)"
    step = {"16-day": 16, "8-day": 8, "weekly": 7}.get(cycle)
    if step:
        at = f"cast(date_add({year}, cast(floor({k} / {step}.0) as int) * {step}) as date)"
        return f"case when {k} >= {7 * WEEKS} then null else {at} end" if cycle == "weekly" else at
    month = f"cast(date_trunc('month', {day}) as date)"
    return {
        "annual": f"cast({year} as date)", "monthly": month, "daily": f"cast({day} as date)",
        "semimonthly": f"case when day({day}) <= 15 then {month} else date_add({month}, 15) end",
        "10-day": f"case when day({day}) <= 10 then {month} when day({day}) <= 20 then date_add({month}, 10) else date_add({month}, 20) end",
    }[cycle]


def calendar_frame(spark: SparkSession, cycle: str, first: date, last: date) -> DataFrame:
    """start, end, centre of every period that lies wholly in [first, last], from one row per day."""
    choice(cycle, CYCLES, "cycle_type")
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day").withColumn("start", F.expr(period_start_sql("day", cycle)).cast("date"))
    spans = days.where("start is not null").groupBy("start").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    nxt = F.date_add("high", 1)
    whole = spans.withColumn("after", F.expr(period_start_sql("date_add(high, 1)", cycle)).cast("date")).where((F.col("low") == F.col("start")) & (F.col("after").isNull() | (F.col("after") == nxt)))
    return whole.select("start", F.col("high").alias("end"), F.expr("date_add(start, cast(floor(datediff(high, start) / 2) as int))").alias("centre"))
