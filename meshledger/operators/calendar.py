"""Calendars, densifying and filters on the study period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshledger.functions.timebins import day, moment, month_end, plus_seconds, week_ending
from meshledger.study import StudyWindow


def calendar(spark: SparkSession, window: StudyWindow, step: str = "day", out: str = "day") -> DataFrame:
    """Days, week-closing Mondays or month ends of the study, the closing date included."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(day(moment(window.lo)), day(moment(window.hi)), F.expr("interval 1 day"))
        ).alias(out)
    )
    if step == "day":
        return days
    if step == "week":
        return days.where(F.col(out) == week_ending(out))
    if step == "month":
        return days.where(F.col(out) == month_end(out))
    raise ValueError(f"unknown step {step!r}")


def densify(
    df: DataFrame, dates: DataFrame, date: str, kind: str, kinds: Sequence[str], fill: dict
) -> DataFrame:
    """One row per date and kind; facts that are missing take the values of ``fill``."""
    grid = dates.withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds])))
    return grid.join(df, [date, kind], "left").fillna(fill)


def densify_with_observed(
    df: DataFrame, dates: DataFrame, date: str, kind: str, fill: dict
) -> DataFrame:
    """As ``densify`` with the kinds that occur in ``df``; meant for a few dozen kinds."""
    observed = df.agg(F.array_sort(F.collect_set(kind)).alias("k")).scalar()
    grid = dates.withColumn(kind, F.explode(observed))
    return grid.join(df, [date, kind], "left").fillna(fill)


def trim(df: DataFrame, ts: str, window: StudyWindow) -> DataFrame:
    return df.where((F.col(ts) >= moment(window.lo)) & (F.col(ts) < moment(window.hi)))


def shift_local_time(df: DataFrame, columns: Sequence[str], hours: int = 9) -> DataFrame:
    return df.withColumns({c: plus_seconds(c, hours * 3600) for c in columns})


def in_outage(date: Column | str, window: StudyWindow) -> Column:
    return (day(date) >= day(moment(window.outage_lo))) & (day(date) < day(moment(window.outage_hi)))


def label_outage(df: DataFrame, date: str, window: StudyWindow, out: str = "outage") -> DataFrame:
    return df.withColumn(out, F.when(in_outage(date, window), "Outage").otherwise("Normal"))


def normal_days(df: DataFrame, date: str, window: StudyWindow) -> DataFrame:
    return df.where(~in_outage(date, window))


def low_traffic_days(daily: DataFrame, total_bytes: str, below_gb: float = 0.9) -> DataFrame:
    return daily.where(F.col(total_bytes) / F.lit(1e9) < F.lit(below_gb))
