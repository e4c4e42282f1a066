"""Reports on users: what they use, how much per day, how many there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshledger.functions import rules as R
from meshledger.functions.timebins import day, month_end, week_ending
from meshledger.operators.activity import eligible_users, online_ratio
from meshledger.operators.calendar import calendar, normal_days
from meshledger.operators.classify import k_anonymize
from meshledger.operators.sketches import merged_distinct
from meshledger.operators.stats import rank_bins, rolling_mean_rows, with_rank, with_ranks
from meshledger.plans.traffic import (
    GB,
    MB,
    UP_DOWN,
    hour_statistics,
    label_order,
    summed,
    total_bytes,
    value_cdf_by_type,
)
from meshledger.session import cut_lineage
from meshledger.study import StudyWindow


def user_category_org_bytes(flows: DataFrame) -> DataFrame:
    return summed(flows, ["user_id", "category", "org"])


def with_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(total_bytes()).alias("bytes_total"))


def sort_order(grouped: DataFrame, dimension: str) -> DataFrame:
    """Values of a dimension ranked by their bytes, most first."""
    totals = with_total(grouped, [dimension])
    return with_rank(totals, "bytes_total", "rank", descending=True)


def user_share_of_category(
    grouped: DataFrame, activity: DataFrame, dimension: str = "category"
) -> DataFrame:
    """Bytes per online day and share of the user's bytes, with both ranks."""
    users = eligible_users(activity, strict=True).select("user_id", "days_online")
    parts = with_total(grouped, ["user_id", dimension])
    totals = parts.groupBy("user_id").agg(F.sum("bytes_total").alias("user_total"))
    totals = totals.join(users, "user_id").withColumn(
        "user_daily", F.col("user_total") / F.col("days_online")
    )
    ranked = with_rank(totals, "user_daily", "user_rank")
    order = sort_order(grouped, dimension).select(dimension, F.col("rank").alias("dimension_rank"))
    per_day = F.col("bytes_total") / F.col("days_online")
    return (
        parts.join(ranked, "user_id")
        .join(order, dimension)
        .select(
            "user_id", dimension, "bytes_total", "user_rank", "dimension_rank",
            per_day.alias("bytes_avg_online_day"),
            (F.col("bytes_total") / F.nullif(F.col("user_total"), F.lit(0))).alias("share"),
        )
    )


def quantile_shares(
    grouped: DataFrame, activity: DataFrame, dimension: str = "category", bins: int = 10,
    include_zero: bool = False,
) -> DataFrame:
    """Mean daily bytes and mean share per category and bin of users by daily use.

    ``include_zero`` counts users without bytes in a category as zero; by default only
    observed pairs take part in a mean.
    """
    users = eligible_users(activity, strict=True).select("user_id", "days_online")
    parts = with_total(grouped, ["user_id", dimension])
    totals = parts.groupBy("user_id").agg(F.sum("bytes_total").alias("user_total"))
    totals = totals.join(users, "user_id").withColumn(
        "daily", F.col("user_total") / F.col("days_online")
    )
    # One row per user, read for the bins' ends and for the bins.
    ranked = cut_lineage(with_rank(totals, "daily", "rank_daily"), "ranks")
    binned = rank_bins(ranked, "rank_daily", "quantile", bins)
    joined = parts.join(binned, "user_id")
    order = sort_order(grouped, dimension).select(dimension, "rank")
    # A user without any bytes has no shares; such pairs do not count in the mean of shares.
    share = F.col("bytes_total") / F.nullif(F.col("user_total"), F.lit(0))
    means = joined.groupBy("quantile", dimension).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.col("bytes_total") / F.col("days_online")).alias("sum_daily"),
        F.sum(share).alias("sum_share"),
        F.count(share).alias("shares"),
    )
    if include_zero:
        sizes = binned.groupBy("quantile").agg(F.count(F.lit(1)).alias("n"))
        means = means.join(F.broadcast(sizes), "quantile").withColumn("shares", F.col("n"))
    else:
        means = means.withColumn("n", F.col("pairs"))
    return means.join(order, dimension).select(
        "quantile", dimension, "rank",
        (F.col("sum_daily") / F.col("n")).alias("normalized_bytes_total"),
        (F.col("sum_share") / F.nullif(F.col("shares"), F.lit(0))).alias("category_share"),
    )


def _log10(value: Column) -> Column:
    """Logarithm with minus infinity for zero."""
    return F.when(value == 0, F.lit(float("-inf"))).otherwise(F.log10(value))


def heat_map(grouped: DataFrame, activity: DataFrame, dimension: str = "category") -> DataFrame:
    """GB, share and MB per day of every user and category, with logarithms."""
    users = eligible_users(activity, min_active_days=None).select("user_id", "days_active")
    parts = with_total(grouped, ["user_id", dimension])
    totals = parts.groupBy("user_id").agg(F.sum("bytes_total").alias("user_total"))
    gb = F.col("bytes_total") / GB
    per_day = gb * F.lit(1000.0) / F.nullif(F.col("days_active"), F.lit(0.0))
    return (
        parts.join(totals, "user_id")
        .join(users, "user_id")
        .select(
            "user_id", dimension, gb.alias("gb"), _log10(gb).alias("log_gb"),
            (F.col("bytes_total") / F.nullif(F.col("user_total"), F.lit(0))).alias("normalized"),
            per_day.alias("mb_per_day"), _log10(per_day).alias("log_mb_per_day"),
        )
    )


def org_heat_map(grouped: DataFrame, activity: DataFrame, k: int = 5) -> DataFrame:
    """The heat map by organisation, organisations with few users merged."""
    sized = grouped.withColumn("_t", total_bytes())
    merged = k_anonymize(sized, "org", "user_id", k, R.AGGREGATED_ORG, ignore_zero="_t")
    return heat_map(merged.drop("_t"), activity, "org")


def split_outliers(grouped: DataFrame, n: int = 20) -> DataFrame:
    """GB per user and category, users labelled as the top n or the rest."""
    parts = with_total(grouped, ["user_id", "category"])
    totals = parts.groupBy("user_id").agg(F.sum("bytes_total").alias("user_total"))
    top = totals.orderBy(F.desc("user_total"), "user_id").limit(n)
    rest = totals.agg((F.count(F.lit(1)) - n).alias("m")).scalar()
    labels = F.broadcast(top.select("user_id", F.lit(f"Top {n}").alias("label")))
    return parts.join(labels, "user_id", "left").select(
        "user_id", "category", (F.col("bytes_total") / GB).alias("gb"),
        F.coalesce("label", F.concat(F.lit("Bottom "), rest.cast("string"))).alias("top_n"),
    )


# --- use per day ------------------------------------------------------------------------------


def user_day_bytes(flows: DataFrame) -> DataFrame:
    daily = flows.groupBy(day("start_ts").alias("date"), "user_id").agg(
        F.sum(total_bytes()).alias("bytes_total")
    )
    return daily.where(F.col("user_id").isNotNull())


def mb_per_day(user_days: DataFrame, activity: DataFrame) -> DataFrame:
    """MB per online and per active day of every user."""
    totals = user_days.groupBy("user_id").agg(F.sum("bytes_total").alias("b"))
    mb = F.col("b") / MB
    return totals.join(activity, "user_id").select(
        "user_id",
        (mb / F.col("days_online")).alias("mb_per_online_day"),
        (mb / F.nullif(F.col("days_active"), F.lit(0.0))).alias("mb_per_active_day"),
    )


def mb_per_day_cdf(rates: DataFrame) -> DataFrame:
    return value_cdf_by_type(
        rates, {"Online Ratio": "mb_per_online_day", "Active Ratio": "mb_per_active_day"}
    )


def median_of_values(distribution: DataFrame) -> DataFrame:
    """Median of the distinct values of a distribution, per type (not weighted by users)."""
    from meshledger.operators.stats import quantiles

    return quantiles(distribution, "value", {"median": 0.5}, ["type"])


def top_category(flows: DataFrame) -> DataFrame:
    """The category in which each user has most bytes; ties take the last name."""
    parts = with_total(summed(flows, ["user_id", "category"]), ["user_id", "category"])
    best = F.max_by("category", F.struct("bytes_total", "category"))
    return parts.groupBy("user_id").agg(best.alias("top_category"))


def uplink_ratio(flows: DataFrame, activity: DataFrame) -> DataFrame:
    """Up and down shares, daily rates and ranks of every eligible user."""
    users = activity.select("user_id")
    parts = summed(flows, ["user_id", "category"])
    owned = users.join(parts, "user_id", "left")
    totals = owned.groupBy("user_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in UP_DOWN],
        F.max_by("category", F.struct(total_bytes().alias("b"), "category")).alias("top_category"),
    )
    totals = totals.withColumn("bytes_total", total_bytes())
    eligible = eligible_users(activity, strict=True).select("user_id", "days_active", "days_online")
    joined = totals.join(eligible, "user_id").withColumns(
        {
            "bytes_avg_per_online_day": F.col("bytes_total") / F.col("days_online"),
            "bytes_up_avg_per_online_day": F.col("bytes_up") / F.col("days_online"),
            "bytes_down_avg_per_online_day": F.col("bytes_down") / F.col("days_online"),
            "normalized_days_online": F.least("days_online", "days_active") / F.col("days_active"),
            "ul_ratio": F.col("bytes_up") / F.nullif(F.col("bytes_total"), F.lit(0)),
            "dl_ratio": F.col("bytes_down") / F.nullif(F.col("bytes_total"), F.lit(0)),
        }
    ).withColumn("mb_avg_per_online_day", F.col("bytes_avg_per_online_day") / MB)
    # One row per user, read for the ranks and for the rows.
    joined = cut_lineage(joined, "totals")
    return with_ranks(joined, {"rank_total": "bytes_total", "rank_daily": "bytes_avg_per_online_day"})


def online_rate(user_days: DataFrame, activity: DataFrame) -> DataFrame:
    """Online ratio (capped) against MB per online day of every eligible user."""
    users = online_ratio(eligible_users(activity), "capped")
    totals = user_days.groupBy("user_id").agg(F.sum("bytes_total").alias("b"))
    return totals.join(users, "user_id").select(
        "user_id", "online_ratio", "days_online",
        (F.col("b") / MB / F.col("days_online")).alias("mb_per_online_day"),
    )


def online_ratio_cdf(activity: DataFrame) -> DataFrame:
    users = eligible_users(activity)
    both = online_ratio(online_ratio(users, "optimistic", "optimistic"), "observed", "observed")
    return value_cdf_by_type(
        both, {"Optimistic (ignore outages)": "optimistic", "Observed": "observed"}
    )


# --- numbers of users -------------------------------------------------------------------------


def hourly_active_users(flows: DataFrame) -> DataFrame:
    """Distinct users per day and hour, by grouping twice."""
    seen = flows.groupBy(
        day("start_ts").alias("date"), F.hour("start_ts").alias("hour"), "user_id"
    ).agg(F.lit(1).alias("one"))
    return seen.groupBy("date", "hour").agg(F.count("user_id").alias("users"))


def hourly_user_stats(hourly_users: DataFrame, window: StudyWindow) -> DataFrame:
    names = ["Max", "99th Percentile", "90th Percentile", "Mean"]
    return hour_statistics(normal_days(hourly_users, "date", window), ["hour"], "users", names)


def active_users(user_days: DataFrame, bin_end: Column, out: str) -> DataFrame:
    """Distinct users per time bin."""
    bins = user_days.select(bin_end.alias("date"), "user_id").distinct()
    return bins.groupBy("date").agg(F.count("user_id").alias(out))


def daily_active(user_days: DataFrame) -> DataFrame:
    return active_users(user_days, F.col("date"), "users")


def weekly_active(user_days: DataFrame) -> DataFrame:
    return active_users(user_days, week_ending("date", "MON"), "users")


def monthly_active(user_days: DataFrame) -> DataFrame:
    return active_users(user_days, month_end("date"), "users")


def active_from_days(day_sketches: DataFrame) -> DataFrame:
    """(period, date, users): about how many users were active per day, week and month.

    From one stored summary per day (``sketches.distinct_sketches``); flows are not read again.
    """
    ends = {"day": F.col("date"), "week": week_ending("date", "MON"), "month": month_end("date")}
    parts = [
        merged_distinct(day_sketches, end, "users").select(F.lit(name).alias("period"), "date", "users")
        for name, end in ends.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


USER_TYPES = ("Registered", "Unique Monthly Online", "Unique Weekly Online", "Unique Daily Online")


def user_counts_wide(
    user_days: DataFrame, registered: DataFrame, window: StudyWindow
) -> DataFrame:
    """Registered, daily, weekly and monthly users on every day of the study.

    Registrations fill forward, weekly and monthly counts backward from their closing day. All
    windows here run over one row per day of the calendar.
    """
    spark = user_days.sparkSession
    days = calendar(spark, window, "day", "date")
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)

    known = days.join(registered.withColumnRenamed("day", "date"), "date", "left").withColumn(
        "registered", F.last("registered", ignorenulls=True).over(upto)
    )
    known = known.where(F.col("registered").isNotNull())
    weekly = calendar(spark, window, "week", "date").join(
        active_users(user_days, week_ending("date", "MON"), "weekly"), "date", "full"
    )
    monthly = (
        calendar(spark, window, "month", "date")
        .join(active_users(user_days, month_end("date"), "monthly"), "date", "full")
        .fillna({"monthly": 0})
    )
    joined = (
        known.join(active_users(user_days, F.col("date"), "daily"), "date", "left")
        .join(weekly, "date", "full")
        .join(monthly, "date", "full")
        .fillna({"daily": 0})
    )
    filled = joined.select(
        "date",
        F.last("registered", ignorenulls=True).over(upto).alias("Registered"),
        F.first("monthly", ignorenulls=True).over(ahead).alias("Unique Monthly Online"),
        F.first("weekly", ignorenulls=True).over(ahead).alias("Unique Weekly Online"),
        F.col("daily").alias("Unique Daily Online"),
    )
    return filled.where(F.col("date") < F.lit(window.hi.date()))


def user_counts(user_days: DataFrame, registered: DataFrame, window: StudyWindow) -> DataFrame:
    wide = user_counts_wide(user_days, registered, window)
    long = wide.unpivot(["date"], list(USER_TYPES), "user_type", "num_users").dropna()
    return long.withColumn("place", label_order("user_type", USER_TYPES).cast("int"))


def user_counts_rolling(
    user_days: DataFrame, registered: DataFrame, window: StudyWindow
) -> DataFrame:
    """Seven-row mean of the daily online users, once seven rows are there."""
    wide = user_counts_wide(user_days, registered, window)
    return rolling_mean_rows(
        wide.select("date", F.col("Unique Daily Online").alias("daily")), [], "date", "daily",
        "mean_7",
    )
