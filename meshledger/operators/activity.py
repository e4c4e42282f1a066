"""When each user was active, and which users have been around long enough to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshledger.functions.timebins import day, days_between, moment
from meshledger.study import StudyWindow


def flow_ranges(flows: DataFrame) -> DataFrame:
    """First start, end of the last-started flow and number of days with flows, per user.

    Reduced to one row per user and day before it is reduced per user.
    """
    daily = flows.groupBy("user_id", day("start_ts").alias("day")).agg(
        F.min("start_ts").alias("first"),
        F.max(F.struct("start_ts", "end_ts")).alias("last"),
    )
    return daily.groupBy("user_id").agg(
        F.min("first").alias("first_flow"),
        F.max("last").getField("end_ts").alias("last_flow_end"),
        F.count(F.lit(1)).alias("days_online"),
    )


def purchase_ranges(transactions: DataFrame) -> DataFrame:
    return (
        transactions.where((F.col("kind") == "purchase") & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min("ts").alias("first_purchase"), F.max("ts").alias("last_purchase"))
    )


def count_days_inside(
    df: DataFrame, days: DataFrame, lo: str, hi: str, out: str, column: str = "day"
) -> DataFrame:
    """Add how many of the distinct ``days`` begin inside [lo, hi].

    The count is that of the days up to hi less that of the days before lo, both looked up in one
    running count over the calendar from the first to the last of ``days``; dates outside it take the
    count at its ends.
    """
    ends = days.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    calendar = ends.select(F.explode(F.sequence(F.date_sub("first", 1), F.col("last"))).alias("_day"))
    listed = days.select(F.col(column).alias("_day")).distinct().withColumn("_is", F.lit(1))
    # One row per day of the calendar bounds this window.
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    running = calendar.join(listed, "_day", "left").select("_day", F.sum(F.coalesce("_is", F.lit(0))).over(upto).alias("_n"))
    first, last = ends.select("first").scalar(), ends.select("last").scalar()

    def at(date: Column) -> Column:
        return F.least(F.greatest(date, F.date_sub(first, 1)), last)

    # a day that begins at lo counts, one that began before does not
    before = F.date_sub(F.to_date(lo), F.when(F.col(lo) == F.to_date(lo).cast("timestamp_ntz"), 1).otherwise(0))
    ranged = df.withColumns({"_lo": at(before), "_hi": at(F.to_date(hi))})
    for side in ("_lo", "_hi"):
        ranged = ranged.join(running.select(F.col("_day").alias(side), F.col("_n").alias(f"{side}_n")), side, "left")
    number = F.greatest(F.col("_hi_n") - F.col("_lo_n"), F.lit(0)).cast("int")
    return ranged.select(*df.columns, F.when(F.col(lo).isNull() | F.col(hi).isNull(), None).otherwise(F.coalesce(number, F.lit(0))).alias(out))


def user_activity(
    flows: DataFrame, transactions: DataFrame, gap_days: DataFrame, window: StudyWindow
) -> DataFrame:
    """Activity span of every user with both flows and purchases."""
    ranges = flow_ranges(flows).join(purchase_ranges(transactions), "user_id")
    flow_first = F.col("first_flow") < F.col("first_purchase")
    flow_last = F.col("last_flow_end") > F.col("last_purchase")
    spans = ranges.select(
        "user_id",
        "days_online",
        F.least("first_flow", "first_purchase").alias("earliest"),
        F.when(flow_first, "Flow").otherwise("Purchase").alias("earliest_kind"),
        F.greatest("last_flow_end", "last_purchase").alias("latest"),
        F.when(flow_last, "Flow").otherwise("Purchase").alias("latest_kind"),
    )
    spans = spans.withColumns(
        {
            "days_since_first_active": days_between("earliest", moment(window.hi)),
            "days_active": days_between("earliest", "latest"),
        }
    )
    spans = count_days_inside(spans, gap_days, "earliest", "latest", "outage_impact_days")
    return spans.withColumn(
        "optimistic_days_online", F.col("days_online") + F.col("outage_impact_days")
    )


def eligible_users(
    activity: DataFrame,
    min_age_days: float = 7,
    min_active_days: float | None = 1,
    strict: bool = False,
) -> DataFrame:
    """Users known for long enough; ``strict`` takes > for >=, None drops the second test."""

    def enough(column: str, least: float) -> Column:
        return F.col(column) > least if strict else F.col(column) >= least

    kept = activity.where(enough("days_since_first_active", min_age_days))
    if min_active_days is None:
        return kept
    return kept.where(enough("days_active", min_active_days))


def online_ratio(activity: DataFrame, kind: str = "observed", out: str = "online_ratio") -> DataFrame:
    """Share of active days on which a user was online.

    ``observed`` of all active days; ``optimistic`` of active days without outage days (may
    exceed 1); ``capped`` limits the online days to those as well. Null where nothing is left
    to divide by.
    """
    online, active = F.col("days_online"), F.col("days_active")
    served = active - F.col("outage_impact_days")
    top, bottom = {
        "observed": (F.least(online, active), active),
        "optimistic": (F.least(online, active), served),
        "capped": (F.least(online, served), served),
    }[kind]
    return activity.withColumn(out, top / F.nullif(bottom, F.lit(0.0)))


def members(df: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    return df.join(users.select(F.col("user_id").alias(user)).distinct(), user, "left_semi")


def exclude_user_after(df: DataFrame, user, after, ts: str = "ts") -> DataFrame:
    """Leave out the rows of one user after a moment (a known mistake in the records)."""
    return df.where(~(F.col("user_id").eqNullSafe(F.lit(user)) & (F.col(ts) > moment(after))))


def first_purchases(transactions: DataFrame, tie: str | None = None) -> DataFrame:
    """Each user's first purchase."""
    order = F.struct("ts", *([tie] if tie else []))
    whole = F.struct("ts", "kind", "amount_bytes", "amount_idr")
    return (
        transactions.where((F.col("kind") == "purchase") & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min_by(whole, order).alias("p"))
        .select(
            F.col("p.ts").alias("start"), F.col("p.kind").alias("action"), "user_id",
            F.col("p.amount_bytes").alias("amount"), F.col("p.amount_idr").alias("price"),
        )
    )


def registered_users(
    transactions: DataFrame, early_users: DataFrame, window: StudyWindow
) -> DataFrame:
    """Number of users registered by the end of each day on which someone registered.

    Early users count from the first day of the study, others from their first purchase.
    """
    start = moment(window.lo)
    starts = (
        first_purchases(transactions).select("user_id", "start")
        .unionByName(early_users.select("user_id", start.alias("start")))
        .groupBy("user_id")
        .agg(F.min("start").alias("start"))
    )
    daily = starts.groupBy(day("start").alias("day")).agg(
        F.count(F.lit(1)).alias("new_users")
    )
    # One row per day: the calendar bounds this window.
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", F.sum("new_users").over(upto).alias("registered"))
