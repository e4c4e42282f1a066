"""Reports on purchases, transfers, revenue and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshledger.functions.timebins import day, moment, weekday_name
from meshledger.operators.activity import eligible_users
from meshledger.operators.calendar import calendar
from meshledger.operators.stats import cdf, coefficient_of_variation, quantiles, with_rank
from meshledger.plans.traffic import GB, MB, label_order
from meshledger.study import IDR_PER_USD, StudyWindow


def usd(column: str, rate: float = IDR_PER_USD):
    return F.col(column) / F.lit(float(rate))


def purchases(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("kind") == "purchase")


def package_sales(transactions: DataFrame) -> DataFrame:
    """Number and volume of purchases per package size."""
    sizes = purchases(transactions).groupBy("amount_bytes").agg(F.count(F.lit(1)).alias("count"))
    return sizes.where(F.col("amount_bytes").isNotNull()).select(
        "amount_bytes", "count", (F.col("amount_bytes") / MB).alias("amount_mb"),
        (F.col("amount_bytes") * F.col("count") / GB).alias("total_gb"),
    )


def purchase_totals(transactions: DataFrame) -> DataFrame:
    totals = purchases(transactions).groupBy("user_id").agg(
        F.sum("amount_idr").alias("amount_idr"), F.sum("amount_bytes").alias("amount_bytes")
    )
    return totals.where(F.col("user_id").isNotNull()).withColumns(
        {"amount_gb": F.col("amount_bytes") / GB, "amount_usd": usd("amount_idr")}
    )


def purchase_totals_of_active(transactions: DataFrame, activity: DataFrame) -> DataFrame:
    users = eligible_users(activity).select("user_id", "days_active")
    return purchase_totals(transactions).join(users, "user_id")


def purchase_total_cdf(transactions: DataFrame, activity: DataFrame) -> DataFrame:
    return cdf(purchase_totals_of_active(transactions, activity), "amount_usd")


def spend_rate(transactions: DataFrame, activity: DataFrame) -> DataFrame:
    """USD per active day of every eligible user."""
    return purchase_totals_of_active(transactions, activity).withColumn(
        "usd_per_day", F.col("amount_usd") / F.col("days_active")
    )


def spend_rate_cdf(transactions: DataFrame, activity: DataFrame) -> DataFrame:
    return cdf(spend_rate(transactions, activity), "usd_per_day")


def spend_inequality(transactions: DataFrame, activity: DataFrame) -> DataFrame:
    """Extremes, mean and median of the spend rate, and the maximum relative to both."""
    rates = spend_rate(transactions, activity)
    middle = quantiles(rates, "usd_per_day", {"median": 0.5}).scalar()
    stats = rates.agg(
        F.min("usd_per_day").alias("min"), F.max("usd_per_day").alias("max"),
        F.avg("usd_per_day").alias("mean"),
    ).withColumn("median", middle)
    return stats.withColumns(
        {"max_over_mean": F.col("max") / F.nullif(F.col("mean"), F.lit(0.0)),
         "max_over_median": F.col("max") / F.nullif(F.col("median"), F.lit(0.0))}
    )


def expenses(spark: SparkSession, window: StudyWindow) -> DataFrame:
    """Dated costs in USD: set-up, repair after the outage, monthly satellite and power."""
    # Amounts of the study.
    power_idr, satellite_usd, initial_usd, repair_usd = 1_300_000, 300.0, 9334.0, 1000.0
    monthly = calendar(spark, window, "month", "date").select(
        "date", F.explode(F.array(F.lit(satellite_usd), F.lit(power_idr) / F.lit(float(IDR_PER_USD)))).alias("amount_usd")
    )
    single = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(day(moment(window.lo)).alias("date"), F.lit(initial_usd).alias("amount_usd")),
                F.struct(day(moment(window.outage_hi)).alias("date"), F.lit(repair_usd).alias("amount_usd")),
            )
        )
    )
    return monthly.unionByName(single)


def revenue_series(
    transactions: DataFrame, window: StudyWindow, drop: Sequence[int] = (5, 10, 15, 20)
) -> DataFrame:
    """Cumulative costs and revenue per day, also without the users who spend most."""
    daily = purchases(transactions).groupBy(day("ts").alias("date"), "user_id").agg(
        F.sum("amount_idr").alias("amount_idr")
    )
    daily = daily.where(F.col("user_id").isNotNull())
    totals = daily.groupBy("user_id").agg(F.sum("amount_idr").alias("t"))
    ranked = daily.join(with_rank(totals, "t", "rank", descending=True), "user_id")
    limits = {"Total Revenue": 0, **{f"Revenue Sans Top {n}": n for n in drop}}
    sums = ranked.groupBy("date").agg(
        *[F.sum(F.when(F.col("rank") > n, F.col("amount_idr"))).alias(k) for k, n in limits.items()]
    )
    revenue = (
        sums.unpivot(["date"], list(limits), "kind", "idr").where(F.col("idr").isNotNull())
        .select("date", "kind", usd("idr").alias("amount_usd"))
    )
    costs = (
        expenses(transactions.sparkSession, window).groupBy("date")
        .agg(F.sum("amount_usd").alias("amount_usd"))
        .select("date", F.lit("Costs").alias("kind"), "amount_usd")
    )
    # One row per day and kind.
    upto = Window.partitionBy("kind").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = revenue.unionByName(costs)
    return both.withColumns(
        {
            "amount_cum": F.sum("amount_usd").over(upto),
            "place": label_order("kind", ["Costs", *limits]).cast("int"),
        }
    )


def arpu(transactions: DataFrame, window: StudyWindow) -> DataFrame:
    """Revenue per paying user: in all, per twelfth of it and per day of the study (IDR)."""
    sums = purchases(transactions).agg(
        F.count_distinct("user_id").alias("users"), F.sum("amount_idr").alias("revenue_idr")
    )
    whole = F.col("revenue_idr") / F.nullif(F.col("users"), F.lit(0))
    return sums.select(
        "users", "revenue_idr", whole.alias("arpu_idr"),
        (whole / F.lit(12.0)).alias("arpu_twelfth_idr"),
        (whole / F.lit(window.days)).alias("arpu_day_idr"),
    )


def purchases_per_user(transactions: DataFrame) -> DataFrame:
    counts = purchases(transactions).groupBy("user_id").agg(F.count(F.lit(1)).alias("purchase_count"))
    return counts.where(F.col("user_id").isNotNull())


def transfers_per_user(transactions: DataFrame, rate: float = IDR_PER_USD) -> DataFrame:
    """Transfers sent and received per user: number and amount, in long form."""
    sent_kind = transactions.where(F.col("kind") == "user_transfer")

    def side(user: str, name: str) -> DataFrame:
        return sent_kind.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user_id")).agg(
            F.count(F.lit(1)).alias(f"{name}_count"), F.sum("amount_idr").alias(f"{name}_sum")
        )

    both = side("user_id", "src").join(side("dest_user_id", "dst"), "user_id", "full")
    directions = F.array(
        F.struct(F.lit("transfer_src").alias("direction"), F.col("src_count").alias("count"),
                 F.col("src_sum").alias("idr")),
        F.struct(F.lit("transfer_dst").alias("direction"), F.col("dst_count").alias("count"),
                 F.col("dst_sum").alias("idr")),
    )
    return both.select("user_id", F.inline(directions)).withColumn("usd", usd("idr", rate))


def cumulative_topups(transactions: DataFrame, rate: float = IDR_PER_USD) -> DataFrame:
    daily = (
        transactions.where(F.col("kind") == "admin_topup")
        .groupBy(day("ts").alias("date"))
        .agg(F.sum("amount_idr").alias("idr"))
    )
    # One row per day.
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("idr_cumulative", F.sum("idr").over(upto)).withColumn(
        "usd_cumulative", usd("idr_cumulative", rate)
    )


def daily_purchase_mb(transactions: DataFrame) -> DataFrame:
    daily = purchases(transactions).groupBy(day("ts").alias("date")).agg(
        F.sum("amount_bytes").alias("amount_bytes")
    )
    return daily.select("date", weekday_name("date").alias("weekday"), (F.col("amount_bytes") / MB).alias("mb"))


def purchase_variation(transactions: DataFrame) -> DataFrame:
    """Spread of a user's daily purchases over the days with a purchase."""
    daily = purchases(transactions).groupBy("user_id", day("ts").alias("date")).agg(
        (F.sum("amount_bytes") / MB).alias("mb")
    )
    users = daily.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.avg("mb").alias("mean"), F.stddev_samp("mb").alias("std"),
        F.count(F.lit(1)).alias("days"), coefficient_of_variation(F.col("mb")).alias("c_of_v"),
    )
    return users.where(F.col("days") > 1)


def packages_per_user(transactions: DataFrame) -> DataFrame:
    counts = purchases(transactions).groupBy("user_id", "amount_bytes").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.dropna().withColumns(
        {"amount_mb": F.col("amount_bytes") / MB,
         "bytes_per_package": F.col("count") * F.col("amount_bytes")}
    )


def transfer_histogram(transactions: DataFrame, exclude_dest=None) -> DataFrame:
    """Number of user transfers per amount, without those to one partner."""
    moved = transactions.where(F.col("kind") == "user_transfer")
    if exclude_dest is not None:
        moved = moved.where(F.col("dest_user_id") != F.lit(exclude_dest))
    return moved.groupBy("amount_idr").agg(F.count(F.lit(1)).alias("count"))


def transactions_per_user(transactions: DataFrame) -> DataFrame:
    """Log records per first-named user: the buyer or sender, the receiver of a top-up."""
    named = F.coalesce("user_id", "dest_user_id").alias("user_id")
    return transactions.select(named).groupBy("user_id").agg(F.count(F.lit(1)).alias("transactions"))


def purchases_per_price(transactions: DataFrame) -> DataFrame:
    return purchases(transactions).groupBy("amount_idr").agg(F.count(F.lit(1)).alias("transactions"))


def session_amounts(sessions: DataFrame) -> DataFrame:
    """How often each consolidated amount was bought."""
    sizes = sessions.groupBy("amount_bytes").agg(F.count(F.lit(1)).alias("count"))
    return sizes.withColumn("amount_mb", F.col("amount_bytes") / MB)
