"""Currency and data-balance ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions.timebins import hour_start, moment, plus_seconds, seconds_between
from meshledger.operators.activity import eligible_users, members
from meshledger.operators.calendar import trim
from meshledger.operators.scans import (
    ROWS_PER_BUCKET,
    by_time,
    by_value,
    following_time,
    min_ahead,
    ordered_scan,
    running_max,
    running_sum,
    with_bucket,
)
from meshledger.session import cut_lineage
from meshledger.study import StudyWindow


def ledger_entries(transactions: DataFrame, tie: str) -> DataFrame:
    """Every credit movement: transfers and top-ups add to the receiver, transfers and
    purchases take from the sender or buyer."""
    amount, kind = F.col("amount_idr"), F.col("kind")
    receives = kind.isin("user_transfer", "admin_transfer", "admin_topup")
    spends = kind.isin("user_transfer", "admin_transfer", "purchase")
    entries = F.array(
        F.struct(F.lit(0).alias("side"), F.col("dest_user_id").alias("user_id"),
                 F.when(receives, amount).alias("amount_idr")),
        F.struct(F.lit(1).alias("side"), F.col("user_id").alias("user_id"),
                 F.when(spends, -amount).alias("amount_idr")),
    )
    return (
        transactions.select("ts", "kind", F.col(tie).alias("entry_id"), F.inline(entries))
        .where(F.col("amount_idr").isNotNull() & F.col("user_id").isNotNull())
    )


def currency_ledger(
    transactions: DataFrame, tie: str = "event_id", rows_per_bucket: int = ROWS_PER_BUCKET,
    with_next: bool = False,
) -> DataFrame:
    """Ledger entries with each user's running balance; ``with_next`` adds the time of the next entry."""
    following = {"next_ts": following_time("ts")} if with_next else {}
    return ordered_scan(
        ledger_entries(transactions, tie),
        ["user_id"],
        ["ts", "entry_id", "side"],
        by_time("ts", rows_per_bucket),
        {"balance": running_sum("amount_idr"), **following},
    )


def negative_offsets(ledger: DataFrame) -> DataFrame:
    """How far below zero each user's balance falls; these users were there before the log."""
    return (
        ledger.where(F.col("balance") < 0)
        .groupBy("user_id")
        .agg((-F.min("balance")).alias("offset"))
    )


def correct_negative(ledger: DataFrame, window: StudyWindow | None = None) -> tuple[DataFrame, DataFrame]:
    """Lift negative histories to zero; returns (ledger with ``corrected``, early users).

    Both results read the exchange of the ledger's scan. With a window, entries outside it go, also
    as next entries.
    """
    offsets = negative_offsets(ledger)
    lifted = (
        ledger.join(offsets, "user_id", "left")
        .withColumn("balance", F.col("balance") + F.coalesce("offset", F.lit(0)))
        .withColumn("corrected", F.col("offset").isNotNull())
        .drop("offset")
    )
    if window is not None:
        lifted = trim(lifted, "ts", window)
        if "next_ts" in lifted.columns:
            inside = F.col("next_ts") < moment(window.hi)
            lifted = lifted.withColumn("next_ts", F.when(inside, F.col("next_ts")))
    return lifted, offsets.select("user_id")


def credit_time_share(ledger: DataFrame, activity: DataFrame) -> DataFrame:
    """Days with and without credit per eligible user, as a share of the active days.

    ``ledger`` has ``next_ts`` (``currency_ledger(with_next=True)``) and ``corrected``.
    """
    users = eligible_users(activity)
    timed = ledger.withColumn(
        "seconds", F.coalesce(seconds_between("ts", "next_ts"), F.lit(0.0)).cast("decimal(28,6)")
    )
    shares = timed.groupBy("user_id").agg(
        F.sum(F.when(F.col("balance") <= 0, F.col("seconds"))).alias("at_zero"),
        F.sum(F.when(F.col("balance") > 0, F.col("seconds"))).alias("nonzero"),
        F.bool_or("corrected").alias("corrected"),
    )
    zero_days = F.coalesce(F.col("at_zero").cast("double"), F.lit(0.0)) / F.lit(86400.0)
    return shares.join(users, "user_id").select(
        "user_id",
        zero_days.alias("days_at_zero"),
        "days_active",
        "corrected",
        "days_since_first_active",
        (zero_days / F.col("days_active")).alias("fraction_at_zero"),
        (F.lit(1.0) - zero_days / F.col("days_active")).alias("fraction_nonzero"),
    )


def credit_summary(shares: DataFrame) -> DataFrame:
    """How many users nearly always have credit, overall and among long-time users."""
    mostly, long = F.col("fraction_nonzero") > 0.95, F.col("days_active") > 30
    return shares.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("days_at_zero") == 0).alias("never_zero"),
        F.count_if(mostly).alias("mostly_credit"),
        F.count_if(long).alias("active_over_30_days"),
        F.count_if(mostly & long).alias("mostly_credit_over_30_days"),
    )


def usage_events(
    flows: DataFrame, sessions: DataFrame, activity: DataFrame, tie: str = "event_id"
) -> DataFrame:
    """External flows and purchase sessions of eligible users in one event table."""
    users = eligible_users(activity)
    external = members(flows.where(~F.col("local")), users).select(
        F.col("start_ts").alias("ts"), F.col("end_ts").alias("end_ts"), "user_id",
        F.lit("ext").alias("type"), "bytes_up", "bytes_down",
        F.lit(0).cast("bigint").alias("bytes_purchased"), F.col(tie).alias("row_id"),
    )
    bought = members(sessions, users).select(
        "ts", F.col("ts").alias("end_ts"), "user_id", F.lit("purchase").alias("type"),
        F.lit(0).cast("bigint").alias("bytes_up"), F.lit(0).cast("bigint").alias("bytes_down"),
        F.col("amount_bytes").alias("bytes_purchased"), F.lit(0).cast("bigint").alias("row_id"),
    )
    return external.unionByName(bought)


def possible_zero_ranges(events: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """For each purchase: from the end of the user's last successful flow to the purchase."""
    good = events.where((F.col("type") == "ext") & (F.col("bytes_down") > 0)).select(
        "user_id", F.col("end_ts").alias("at"), F.lit(0).alias("turn"),
        F.col("end_ts").alias("good_end"),
    )
    bought = events.where(F.col("type") == "purchase").select(
        "user_id", F.col("ts").alias("at"), F.lit(1).alias("turn")
    )
    stream = good.unionByName(bought, allowMissingColumns=True)
    return (
        ordered_scan(
            stream,
            ["user_id"],
            ["at", "turn"],
            by_time("at", rows_per_bucket),
            {"range_start": running_max("good_end")},
        )
        .where((F.col("turn") == 1) & (F.col("range_start") < F.col("at")))
        .select("user_id", "range_start", F.col("at").alias("range_end"))
    )


def overlap_counts(
    ranges: DataFrame, intervals: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``overlaps``: how many of the user's intervals touch each closed range.

    An interval touches [lo, hi] unless it starts after hi or ends before lo, so the count is
    the number started up to hi less the number ended before lo: two running counts over one
    stream of events, and no range join.
    """
    def both(first: str, turn: int, second: str, other: int) -> Column:
        """Two events of one row, so that neither input is read twice."""
        return F.inline(F.array(*[
            F.struct(F.col(at).alias("at"), F.lit(t).alias("turn")) for at, t in ((first, turn), (second, other))]))

    # At equal times: begins, then questions at range ends, then at range starts, then ends.
    edges = intervals.select("user_id", both("start_ts", 0, "end_ts", 3))
    questions = ranges.select("user_id", "range_start", "range_end", both("range_end", 1, "range_start", 2))
    stream = edges.unionByName(questions, allowMissingColumns=True).withColumns(
        {"began": (F.col("turn") == 0).cast("int"), "ended": (F.col("turn") == 3).cast("int")}
    )
    counted = ordered_scan(
        stream,
        ["user_id"],
        ["at", "turn"],
        by_time("at", rows_per_bucket),
        {"n_began": running_sum("began"), "n_ended": running_sum("ended")},
    )
    probes = counted.where(F.col("turn").isin(1, 2)).groupBy(
        "user_id", "range_start", "range_end"
    )
    return probes.agg(
        (
            F.max(F.when(F.col("turn") == 1, F.col("n_began")))
            - F.max(F.when(F.col("turn") == 2, F.col("n_ended")))
        ).alias("overlaps")
    )


def likely_zero_ranges(
    events: DataFrame, min_failed: int = 50, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Ranges in which at least ``min_failed`` external flows got nothing back."""
    failed = events.where((F.col("type") == "ext") & (F.col("bytes_down") <= 0)).select(
        "user_id", F.col("ts").alias("start_ts"), "end_ts"
    )
    counted = overlap_counts(possible_zero_ranges(events, rows_per_bucket), failed, rows_per_bucket)
    return counted.where(F.col("overlaps") >= min_failed)


def data_balance(
    events: DataFrame, min_failed: int = 50, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Each user's data balance, set to zero where it must have been zero.

    Rows are ordered by time, type (init, tare, purchase, ext), end and row id. The running
    balance of a hot user is scanned in time buckets; the corrections are then found on a
    table of (user, bucket, stretch between tares), and joined back on all three. ``events`` is
    read several times: pass a written table.
    """
    tares = cut_lineage(likely_zero_ranges(events, min_failed, rows_per_bucket), "tares").select(
        F.col("range_start").alias("ts"), F.col("range_end").alias("end_ts"), "user_id",
        F.lit("tare").alias("type"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("bytes_up", "bytes_down", "bytes_purchased", "row_id")],
    )
    inits = events.groupBy("user_id").agg(F.min("ts").alias("first_ts")).select(
        plus_seconds("first_ts", -1).alias("ts"),
        F.lit(None).cast("timestamp_ntz").alias("end_ts"), "user_id", F.lit("init").alias("type"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("bytes_up", "bytes_down", "bytes_purchased", "row_id")],
    )
    turn = F.create_map(F.lit("init"), F.lit(0), F.lit("tare"), F.lit(1), F.lit("purchase"),
                        F.lit(2), F.lit("ext"), F.lit(3))
    rows = (
        events.unionByName(tares)
        .unionByName(inits)
        .withColumn("turn", turn[F.col("type")])
        .withColumn("net_bytes", F.col("bytes_purchased") - F.col("bytes_up") - F.col("bytes_down"))
        .withColumn("sort_end", F.coalesce("end_ts", "ts"))
        .withColumn("tare_flag", (F.col("type") == "tare").cast("int"))
    )
    rows = with_bucket(rows, by_time("ts", rows_per_bucket), "bucket")
    scanned = ordered_scan(
        rows,
        ["user_id"],
        ["ts", "turn", "sort_end", "row_id"],
        F.col("bucket"),
        {
            "raw_balance": running_sum("net_bytes"),
            "user_hist_i": running_sum(F.lit(1)),
            "stretch": running_sum("tare_flag"),
        },
    )
    scanned = cut_lineage(scanned, "balance")

    is_low_point = (F.col("type") == "tare") | ((F.col("type") == "ext") & (F.col("bytes_down") > 0))
    per_bucket = scanned.groupBy("user_id", "stretch", "bucket").agg(
        F.min(F.when(is_low_point, F.col("raw_balance"))).alias("low"),
        F.min(F.when(F.col("type") != "init", F.col("raw_balance"))).alias("lowest"),
    )
    per_stretch = per_bucket.groupBy("user_id", "stretch").agg(
        F.min("low").alias("low"), F.min("lowest").alias("lowest")
    )
    stretches = ordered_scan(
        per_stretch,
        ["user_id"],
        ["stretch"],
        by_value("stretch", rows_per_bucket),
        {"low_ahead": min_ahead("low")},
    )
    starts = per_stretch.groupBy("user_id").agg(
        F.greatest(F.lit(0), -F.min("lowest")).alias("offset")
    )
    # What is taken off from a stretch on: its lowest point ahead; nothing before the first tare.
    corrections = stretches.join(starts, "user_id").select(
        "user_id", "stretch", "offset",
        F.when(F.col("stretch") > 0, F.col("low_ahead") + F.col("offset")).alias("taken_off"),
    )
    earlier = corrections.select(
        "user_id", (F.col("stretch") + 1).alias("stretch"), F.col("taken_off").alias("taken_before")
    )
    corrections = corrections.join(earlier, ["user_id", "stretch"], "left")
    by_bucket = per_bucket.select("user_id", "stretch", "bucket").join(
        corrections, ["user_id", "stretch"]
    )
    placed = scanned.join(by_bucket, ["user_id", "bucket", "stretch"])
    taken = F.coalesce("taken_off", F.lit(0))
    before = F.coalesce("taken_before", F.lit(0))
    return placed.select(
        "ts",
        "end_ts",
        "user_id",
        "type",
        "bytes_up",
        "bytes_down",
        "bytes_purchased",
        F.when(F.col("type") == "init", F.col("offset"))
        .when(F.col("type") == "tare", before - taken)
        .otherwise(F.col("net_bytes"))
        .alias("net_bytes"),
        F.greatest(F.lit(0), F.col("raw_balance") + F.col("offset") - taken).alias("balance"),
        (F.col("user_hist_i") - 1).alias("user_hist_i"),
    )


def hourly_ledger(
    flows: DataFrame,
    transactions: DataFrame,
    tie: str = "event_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Bytes used per hour and bytes bought, with each user's running balance."""
    spends = (
        flows.groupBy("user_id", hour_start("start_ts").alias("ts"))
        .agg((-F.sum(F.col("bytes_up") + F.col("bytes_down"))).alias("bytes"))
        .select("user_id", "ts", "bytes", F.lit("spend").alias("type"),
                F.lit(0).cast("bigint").alias("entry_id"))
    )
    topups = transactions.where(F.col("kind") == "purchase").select(
        "user_id", "ts", F.col("amount_bytes").alias("bytes"), F.lit("topup").alias("type"),
        F.col(tie).alias("entry_id"),
    )
    return ordered_scan(
        spends.unionByName(topups),
        ["user_id"],
        ["ts", "type", "entry_id"],
        by_time("ts", rows_per_bucket),
        {"balance": running_sum("bytes")},
    ).drop("entry_id")
