"""Purchase sessions and the gaps between all flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions.timebins import seconds_between
from meshledger.operators.scans import (
    ROWS_PER_BUCKET,
    by_time,
    ordered_scan,
    previous,
    previous_time,
    running_max,
    sessionize,
)
from meshledger.operators.stats import cdf, quantiles
from meshledger.study import SECONDS_PER_DAY


def consolidate_purchases(
    transactions: DataFrame,
    gap_s: int = 60,
    tie: Sequence[str] = ("amount_bytes", "amount_idr"),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Purchases of one user less than ``gap_s`` after the one before become one session.

    A session has the time of its first purchase and the sums of all; the time since the last
    session's start is null for a user's first.
    """

    def apart(last: Column, ts: Column) -> Column:
        return seconds_between(last, ts) >= F.lit(float(gap_s))

    purchases = transactions.where(F.col("kind") == "purchase")
    purchases = purchases.select(*dict.fromkeys(["user_id", "ts", *tie, "amount_bytes", "amount_idr"]))
    rows = sessionize(purchases, ["user_id"], ["ts", *tie], "ts", apart, rows_per_bucket, bucket="bucket")
    sessions = rows.groupBy("user_id", "session").agg(
        F.sum("amount_bytes").alias("amount_bytes"), F.sum("amount_idr").alias("amount_idr"),
        F.min("bucket").alias("bucket"),
    )
    sessions = sessions.select(
        F.col("session.ts").alias("ts"), F.lit("purchase").alias("kind"), "user_id",
        "amount_bytes", "amount_idr", "bucket",
    )
    # A session lies in the bucket of its first purchase, so its cut is known already.
    return ordered_scan(
        sessions, ["user_id"], ["ts"], F.col("bucket"), {"_last": previous_time("ts")}
    ).select(
        "ts", "kind", "user_id", "amount_bytes", "amount_idr",
        seconds_between("_last", "ts").alias("time_since_last_purchase"),
    )


def purchase_timing(sessions: DataFrame) -> DataFrame:
    """Mean, 90 % and 99 % quantile of the time between sessions per user, in seconds."""
    timed = sessions.where(F.col("time_since_last_purchase").isNotNull())
    means = timed.groupBy("user_id").agg(F.avg("time_since_last_purchase").alias("mean"))
    spread = quantiles(timed, "time_since_last_purchase", {"q90": 0.9, "q99": 0.99}, ["user_id"])
    return means.join(spread, "user_id")


def purchase_timing_cdf(sessions: DataFrame) -> DataFrame:
    """Distribution over users of the three statistics, in days."""
    labels = {"mean": "User's Mean", "q90": "User's 90% Quantile", "q99": "User's 99% Quantile"}
    long = purchase_timing(sessions).unpivot(["user_id"], list(labels), "statistic", "seconds")
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    spread = cdf(long.withColumn("type", names[F.col("statistic")]), "seconds", ["type"])
    return spread.select(
        "type", (F.col("value") / F.lit(float(SECONDS_PER_DAY))).alias("days"), "base_count",
        "pdf", "cdf",
    )


def log_gaps(
    flows: DataFrame,
    mode: str = "previous",
    tie: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Stretches with no flow: a flow that starts after the end of the one before.

    ``previous`` compares with the row before only, ``running_max`` with the latest end so far,
    which leaves out false gaps under a long flow.
    """
    before = {
        "previous": previous("end_ts"),
        "running_max": running_max("end_ts", strict=True),
    }[mode]
    scanned = ordered_scan(
        flows.select("start_ts", "end_ts", *tie),
        [],
        ["start_ts", "end_ts", *tie],
        by_time("start_ts", rows_per_bucket),
        {"_before": before},
    )
    return scanned.where(F.col("start_ts") > F.col("_before")).select(
        F.col("_before").alias("gap_start"), F.col("start_ts").alias("gap_end")
    )


def full_gap_days(gaps: DataFrame, min_days: int = 1) -> DataFrame:
    """Days after a gap's first day that begin inside a gap longer than ``min_days``.

    The candidates are one, two, ... whole days after the gap's start, up to its end.
    """
    seconds = seconds_between("gap_start", "gap_end")
    long = gaps.where(seconds > F.lit(float(min_days * SECONDS_PER_DAY)))
    count = F.floor(seconds / F.lit(float(SECONDS_PER_DAY))).cast("int")
    return long.select(
        F.explode(F.sequence(F.lit(1), count)).alias("n"), "gap_start"
    ).select(F.date_add(F.to_date("gap_start"), F.col("n")).alias("day"))


def outage_cdf(gaps: DataFrame, min_s: int = 10) -> DataFrame:
    """Distribution of gap length in hours; shorter gaps are normal pauses."""
    seconds = seconds_between("gap_start", "gap_end")
    hours = gaps.where(seconds >= F.lit(float(min_s))).select(
        (seconds / F.lit(3600.0)).alias("duration_hours")
    )
    return cdf(hours, "duration_hours")


def uptime(gaps: DataFrame, window) -> DataFrame:
    total = window.days * SECONDS_PER_DAY
    down = F.sum(seconds_between("gap_start", "gap_end"))
    return gaps.agg(
        down.alias("downtime_s"),
        F.lit(total).alias("period_s"),
        (down / F.lit(total) * F.lit(100.0)).alias("downtime_pct"),
    )
