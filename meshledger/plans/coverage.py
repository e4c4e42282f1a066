"""Headline numbers of the study: counts, shares and how much of the traffic is explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions import rules as R
from meshledger.operators.activity import eligible_users, members, online_ratio
from meshledger.operators.sketches import heavy_candidates
from meshledger.operators.stats import quantiles, with_rank
from meshledger.plans.traffic import GB, MB, summed, total_bytes

# Categories that do not say what a flow was.
UNMAPPED_CATEGORIES = (R.NO_DNS, R.NOT_MAPPED, R.GOOGLE_NO_DNS)
UNMAPPED_ORGS = (R.NO_DNS, R.NOT_MAPPED)


def _sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def heavy_unmapped(
    flows: DataFrame, by: str = "bytes_down", n: int = 50, summary: bool = False
) -> DataFrame:
    """The domains with most bytes among those without a mapping.

    ``summary``: domains that a summary of sums rules out are not shuffled; the rows are the same.
    """
    unmapped = flows.where((F.col("org") == R.NOT_MAPPED) | (F.col("category") == R.NOT_MAPPED))
    if summary:
        unmapped = heavy_candidates(unmapped.select("fqdn", "bytes_up", "bytes_down"), "fqdn", F.col(by), n)
    return summed(unmapped, ["fqdn"]).orderBy(F.desc(by), "fqdn").limit(n)


def heavy_unknown_addresses(flows: DataFrame, n: int = 40, summary: bool = False) -> DataFrame:
    """The addresses with most bytes among flows without any name; ``summary`` as above."""
    unknown = flows.where((F.col("category") == R.NO_DNS) | (F.col("org") == R.NO_DNS))
    if summary:
        unknown = heavy_candidates(unknown.select("dest_ip", "bytes_up", "bytes_down"), "dest_ip", total_bytes(), n)
    totals = unknown.groupBy("dest_ip").agg((F.sum(total_bytes()) / MB).alias("mbytes_total"))
    return totals.orderBy(F.desc("mbytes_total"), "dest_ip").limit(n)


def flow_counts(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Flows and GB outside and inside the network, and the shares of each."""
    outside = ~F.col("local")
    typical = flows.agg(
        F.count_if(outside).alias("internet_flows"),
        F.count_if(F.col("local")).alias("local_flows"),
        _sum_where(outside, F.col("bytes_down")).alias("internet_down"),
        _sum_where(outside, F.col("bytes_up")).alias("internet_up"),
        _sum_where(F.col("local"), total_bytes()).alias("local_bytes"),
    )
    peers = p2p.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(total_bytes("bytes_a_to_b", "bytes_b_to_a")), F.lit(0)).alias("b"),
        ).alias("p")
    ).scalar()
    both = typical.withColumn("p", peers)
    inner_flows = F.col("local_flows") + F.col("p.n")
    inner_bytes = F.col("local_bytes") + F.col("p.b")
    outer_bytes = F.col("internet_down") + F.col("internet_up")
    all_flows = F.col("internet_flows") + inner_flows
    return both.select(
        "internet_flows",
        inner_flows.alias("intranet_flows"),
        (F.col("internet_flows") / F.nullif(all_flows, F.lit(0))).alias("internet_flow_share"),
        (F.col("internet_down") / GB).alias("internet_down_gb"),
        (F.col("internet_up") / GB).alias("internet_up_gb"),
        (outer_bytes / GB).alias("internet_gb"),
        (inner_bytes / GB).alias("intranet_gb"),
        (outer_bytes / F.nullif(outer_bytes + inner_bytes, F.lit(0))).alias("internet_byte_share"),
        ((outer_bytes + inner_bytes) / GB).alias("total_gb"),
    )


def transaction_counts(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count_if(F.col("kind") == "purchase").alias("purchases"),
        F.count(F.lit(1)).alias("transactions"),
    )


def _coverage(flows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Count, share, GB and share of bytes of flows for which each condition holds."""
    sums = flows.where(~F.col("local")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(total_bytes()).alias("b"),
        *[
            F.struct(
                F.lit(name).alias("name"), F.count_if(c).alias("flow_count"),
                _sum_where(c, total_bytes()).alias("bytes"),
            ).alias(name)
            for name, c in conditions.items()
        ],
    )
    return sums.select("n", "b", F.inline(F.array(*conditions))).select(
        "name", "flow_count", (F.col("flow_count") * 100 / F.nullif(F.col("n"), F.lit(0))).alias("flow_pct"),
        (F.col("bytes") / GB).alias("gb"), (F.col("bytes") * 100 / F.nullif(F.col("b"), F.lit(0))).alias("gb_pct"),
    )


def dns_coverage(flows: DataFrame) -> DataFrame:
    named = F.col("fqdn") != ""
    return _coverage(
        flows,
        {
            "mapped": named,
            "unambiguous": named & (F.col("ambiguous_fqdn_count") == 1),
            "user_derived": F.col("fqdn_source") == "user_dns_log",
        },
    )


def category_org_coverage(flows: DataFrame) -> DataFrame:
    return _coverage(
        flows,
        {
            "category_mapped": ~F.col("category").isin(*UNMAPPED_CATEGORIES),
            "org_mapped": ~F.col("org").isin(*UNMAPPED_ORGS),
        },
    )


def distinct_classes(flows: DataFrame) -> DataFrame:
    return flows.where(~F.col("local")).agg(
        F.count_distinct("category").alias("categories"), F.count_distinct("org").alias("orgs")
    )


def down_up_ratio(flows: DataFrame) -> DataFrame:
    return flows.where(~F.col("local")).agg(
        (F.sum("bytes_down") / F.nullif(F.sum("bytes_up"), F.lit(0))).alias("dl_ul_ratio")
    )


def _peer_bytes(p2p: DataFrame) -> Column:
    whole = F.coalesce(F.sum(total_bytes("bytes_a_to_b", "bytes_b_to_a")), F.lit(0))
    return p2p.agg(whole.alias("b")).scalar()


def _shares(
    flows: DataFrame, conditions: dict[str, Column], p2p: DataFrame | None = None
) -> DataFrame:
    """GB of each group of flows, as a share of all bytes (peer flows included, where given)
    and of external bytes."""
    sums = flows.agg(
        F.sum(total_bytes()).alias("t"),
        F.sum(F.when(~F.col("local"), total_bytes())).alias("i"),
        *[
            F.struct(F.lit(n).alias("name"), _sum_where(c, total_bytes()).alias("bytes")).alias(n)
            for n, c in conditions.items()
        ],
    )
    if p2p is not None:
        sums = sums.withColumn("t", F.col("t") + _peer_bytes(p2p))
    return sums.select("t", "i", F.inline(F.array(*conditions))).select(
        "name", (F.col("bytes") / GB).alias("gb"), (F.col("bytes") / F.nullif(F.col("t"), F.lit(0))).alias("share_of_total"),
        (F.col("bytes") / F.nullif(F.col("i"), F.lit(0))).alias("share_of_internet"),
    )


def big_company_share(
    flows: DataFrame, p2p: DataFrame, facebook=("Facebook", "Instagram", "WhatsApp"),
    google=("Google",),
) -> DataFrame:
    return _shares(
        flows,
        {
            "facebook": F.col("org").isin(*facebook),
            "google": F.col("org").isin(*google),
            "both": F.col("org").isin(*facebook, *google),
        },
        p2p,
    )


def video_share(
    flows: DataFrame, p2p: DataFrame | None = None, adult: str = "Adult Video", video: str = "Video"
) -> DataFrame:
    return _shares(
        flows,
        {
            "adult": F.col("category") == adult,
            "video": F.col("category") == video,
            "all_video": F.col("category").isin(adult, video),
        },
        p2p,
    )


def video_share_of_top_spenders(
    flows: DataFrame, transactions: DataFrame, n: int = 10, adult: str = "Adult Video",
    video: str = "Video",
) -> DataFrame:
    """The video shares among the users who spend most (all users tied at rank n included)."""
    spent = (
        transactions.where((F.col("kind") == "purchase") & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.sum("amount_idr").alias("t"))
    )
    top = with_rank(spent, "t", "rank", descending=True).where(F.col("rank") <= n)
    return video_share(members(flows, top), None, adult, video)


def call_share(
    flows: DataFrame, p2p: DataFrame, peer: str = R.PEER_TO_PEER, ice: str = R.ICE
) -> DataFrame:
    return _shares(
        flows,
        {
            "p2p": F.col("category") == peer,
            "ice": F.col("category") == ice,
            "all_calls": F.col("category").isin(peer, ice),
        },
        p2p,
    )


def call_users(flows: DataFrame, peer: str = R.PEER_TO_PEER, ice: str = R.ICE) -> DataFrame:
    calls = flows.where(F.col("category").isin(peer, ice))
    return calls.agg(F.count_distinct("user_id").alias("unique_users"))


def filter_funnel(flows: DataFrame, p2p: DataFrame, activity: DataFrame) -> DataFrame:
    """Users lost to each activity rule and the flows that remain."""
    aged = F.col("days_since_first_active") >= 7
    users = activity.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(~aged).alias("joined_under_week"),
        F.count_if(aged & (F.col("days_active") < 1)).alias("active_under_day"),
        F.count_if(aged & (F.col("days_active") >= 1)).alias("final_users"),
    )
    kept = members(flows, eligible_users(activity)).agg(F.count(F.lit(1)).alias("n")).scalar()
    peers = p2p.agg(F.count(F.lit(1)).alias("n")).scalar()
    return users.select(
        "*", (F.col("final_users") / F.nullif(F.col("users"), F.lit(0))).alias("final_share"),
        kept.alias("typical_flows"), peers.alias("p2p_flows"), (kept + peers).alias("total_flows"),
    )


def consistently_online(activity: DataFrame, least: float = 0.95) -> DataFrame:
    """Median online ratio and how many users are online nearly every served day."""
    users = online_ratio(eligible_users(activity), "optimistic")
    middle = quantiles(users, "online_ratio", {"median": 0.5}).scalar()
    often = F.count_if(F.col("online_ratio") >= least)
    return users.agg(
        often.alias("consistently_on"), F.count(F.lit(1)).alias("users"),
        (often / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"),
    ).withColumn("median_ratio", middle)
