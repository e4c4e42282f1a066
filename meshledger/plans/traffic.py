"""Reports on bytes: by category, organisation, protocol, hour, weekday and kind of flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshledger.functions import rules as R
from meshledger.functions.timebins import day, week_ending, weekday_name
from meshledger.operators.calendar import calendar, densify, densify_with_observed, normal_days
from meshledger.operators.classify import protocol_name
from meshledger.operators.stats import bootstrap_mean_ci, cdf, rolling_mean, with_rank
from meshledger.study import StudyWindow

GB = 1e9
MB = 1e6
UP_DOWN = ("bytes_up", "bytes_down")


def total_bytes(a: str = "bytes_up", b: str = "bytes_down") -> Column:
    return F.col(a) + F.col(b)


def summed(df: DataFrame, keys: Sequence[str | Column], columns: Sequence[str] = UP_DOWN) -> DataFrame:
    """Sums per key; rows with a null key are left out."""
    grouped = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    return grouped.dropna(subset=[c for c in grouped.columns if c not in columns])


def label_order(column: str, labels: Sequence[str]) -> Column:
    """Position of a label in a fixed list, to sort by."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(column))


# --- reductions: one pass over the flows, then small tables ---------------------------------


def bytes_per_user(flows: DataFrame) -> DataFrame:
    """Bytes per user and direction in long form."""
    return summed(flows, ["user_id"]).unpivot(["user_id"], list(UP_DOWN), "direction", "bytes")


def daily_category_org_bytes(flows: DataFrame) -> DataFrame:
    return summed(flows, [day("start_ts").alias("date"), "category", "org"])


def weekly_bytes(daily: DataFrame, dimension: str) -> DataFrame:
    """Weeks close on Monday."""
    return summed(daily, [week_ending("date", "MON").alias("week"), dimension]).withColumn(
        "bytes_total", total_bytes()
    )


def weekly_bytes_faceted(daily: DataFrame, dimension: str) -> DataFrame:
    """Weekly GB per direction with the order of the dimension within the direction (0 = least)."""
    weekly = weekly_bytes(daily, dimension)
    long = weekly.withColumns({"Downlink": F.col("bytes_down"), "Uplink": F.col("bytes_up")}).unpivot(
        ["week", dimension], ["Downlink", "Uplink"], "direction", "bytes"
    )
    totals = long.groupBy(dimension, "direction").agg(F.sum("bytes").alias("t"))
    # One row per category or protocol name and direction: bounded by the rule tables.
    place = Window.partitionBy("direction").orderBy("t", dimension)
    order = totals.select(dimension, "direction", (F.row_number().over(place) - 1).alias("order"))
    return long.join(order, [dimension, "direction"]).select(
        "week", dimension, "direction", (F.col("bytes") / GB).alias("gb"), "order"
    )


def category_direction_totals(daily: DataFrame) -> DataFrame:
    """GB per category and direction; no bytes count as one, for a log axis."""
    long = summed(daily, ["category"]).unpivot(["category"], list(UP_DOWN), "direction", "bytes")
    bytes_ = F.when(F.col("bytes") == 0, 1).otherwise(F.col("bytes"))
    return long.select("category", "direction", (bytes_ / GB).alias("gb"))


def mapping_coverage(daily: DataFrame, dimension: str) -> DataFrame:
    """How much of the traffic can be, and is, mapped to an organisation or category."""
    total = F.sum(total_bytes())

    def of(value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(dimension) == value, total_bytes())), F.lit(0))

    sums = daily.agg(
        total.alias("t"), of(R.NO_DNS).alias("no_dns"), of(R.NOT_MAPPED).alias("not_mapped")
    )
    mappable = F.col("t") - F.col("no_dns")
    mapped = mappable - F.col("not_mapped")
    return sums.select(
        (F.col("t") / GB).alias("total_gb"),
        (F.col("no_dns") / GB).alias("unknown_gb"),
        (mappable / GB).alias("mappable_gb"),
        (mapped / GB).alias("mapped_gb"),
        (F.col("no_dns") / F.nullif(F.col("t"), F.lit(0))).alias("fraction_unmappable"),
        (mapped / F.nullif(F.col("t"), F.lit(0))).alias("fraction_mapped_of_total"),
        (mapped / F.nullif(mappable, F.lit(0))).alias("fraction_mapped_of_mappable"),
    )


def top_orgs(daily: DataFrame, n: int = 9) -> DataFrame:
    """The n organisations with most bytes."""
    totals = summed(daily, ["org"]).withColumn("bytes_total", total_bytes())
    return totals.orderBy(F.desc("bytes_total"), "org").limit(n)


def org_top_n(daily: DataFrame, n: int = 9) -> DataFrame:
    """Weekly bytes of the top organisations and of all others together ("Other N=count")."""
    weekly = weekly_bytes(daily, "org")
    main = F.broadcast(top_orgs(daily, n).select("org", F.lit(True).alias("main")))
    others = weekly.select("org").distinct().join(main, "org", "left_anti")
    count = others.agg(F.count(F.lit(1)).alias("c")).scalar()
    label = F.concat(F.lit("Other N="), count.cast("string"))
    merged = weekly.join(main, "org", "left").withColumn(
        "org", F.when(F.col("main"), F.col("org")).otherwise(label)
    )
    return summed(merged, ["week", "org"], [*UP_DOWN, "bytes_total"])


def org_others(daily: DataFrame, n: int = 9) -> DataFrame:
    """Weekly bytes of the organisations outside the top n, with their order (0 = least)."""
    weekly = weekly_bytes(daily, "org")
    main = F.broadcast(top_orgs(daily, n).select("org"))
    others = weekly.join(main, "org", "left_anti")
    totals = others.groupBy("org").agg(F.sum("bytes_total").alias("t"))
    ranked = with_rank(totals, "t", "order").select("org", (F.col("order") - 1).alias("order"))
    return others.join(ranked, "org").select("week", "org", "bytes_total", "order")


# --- time of day ------------------------------------------------------------------------------


def all_flow_bytes(flows: DataFrame, *peers: DataFrame) -> DataFrame:
    """Start, end and total bytes of typical, peer and no-user flows in one table."""
    parts = [flows.select("start_ts", "end_ts", "protocol", total_bytes().alias("bytes_total"))]
    parts += [
        p.select("start_ts", "end_ts", "protocol",
                 total_bytes("bytes_a_to_b", "bytes_b_to_a").alias("bytes_total"))
        for p in peers
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def hourly_category_bytes(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Bytes per day, hour and category; peer flows are a category of their own."""
    typical = flows.select("start_ts", "category", total_bytes().alias("bytes_total"))
    peers = p2p.select(
        "start_ts", F.lit(R.PEER_TO_PEER).alias("category"),
        total_bytes("bytes_a_to_b", "bytes_b_to_a").alias("bytes_total"),
    )
    keys = [day("start_ts").alias("date"), F.hour("start_ts").alias("hour"), "category"]
    return summed(typical.unionByName(peers), keys, ["bytes_total"])


def hour_statistics(
    per_day: DataFrame, keys: Sequence[str], value: str, names: Sequence[str]
) -> DataFrame:
    """Mean, quantiles and maximum over days in long form. A group has one row per day."""
    exact = {
        "Mean": F.avg(value),
        "90th Percentile": F.percentile(value, F.lit(0.9)),
        "99th Percentile": F.percentile(value, F.lit(0.99)),
        "Max": F.max(value).cast("double"),
    }
    wide = per_day.groupBy(*keys).agg(*[F.round(exact[n], 3).alias(n) for n in names])
    return wide.unpivot(list(keys), list(names), "type", "value")


def hourly_traffic_stats(hourly: DataFrame, window: StudyWindow) -> DataFrame:
    """Bytes per hour of the day over normal days, all categories together."""
    totals = summed(normal_days(hourly, "date", window), ["hour", "date"], ["bytes_total"])
    names = ["99th Percentile", "90th Percentile", "Mean", "Max"]
    stats = hour_statistics(totals, ["hour"], "bytes_total", names)
    return stats.select("hour", "type", (F.col("value") / MB).alias("mb"))


def hourly_category_stats(hourly: DataFrame, window: StudyWindow) -> DataFrame:
    names = ["Mean", "90th Percentile", "99th Percentile"]
    stats = hour_statistics(
        normal_days(hourly, "date", window), ["hour", "category"], "bytes_total", names
    )
    return stats.select("hour", "category", "type", (F.col("value") / MB).alias("mb"))


def hourly_category_share(hourly: DataFrame, window: StudyWindow) -> DataFrame:
    """Which share of a category's bytes falls in each hour of the day."""
    sums = summed(normal_days(hourly, "date", window), ["hour", "category"], ["bytes_total"])
    # 24 rows per category.
    whole = F.sum("bytes_total").over(Window.partitionBy("category"))
    return sums.select(
        "hour", "category", (F.col("bytes_total") / MB).alias("mb"),
        (F.col("bytes_total") / whole).alias("byte_density"),
    )


# --- weekday and day --------------------------------------------------------------------------


def daily_bytes(all_flows: DataFrame) -> DataFrame:
    daily = summed(all_flows, [day("start_ts").alias("date")], ["bytes_total"])
    return daily.withColumn("weekday", weekday_name("date"))


def weekday_mean(daily: DataFrame, window: StudyWindow) -> DataFrame:
    normal = normal_days(daily, "date", window)
    return normal.groupBy("weekday").agg((F.avg("bytes_total") / GB).alias("mean_gb"))


def weekday_mean_ci(daily: DataFrame, window: StudyWindow, replicates: int = 200) -> DataFrame:
    normal = normal_days(daily, "date", window)
    ci = bootstrap_mean_ci(normal, ["weekday"], "date", "bytes_total", replicates)
    return ci.select("weekday", *[(F.col(c) / GB).alias(f"{c}_gb") for c in ("mean", "ci_lo", "ci_hi")])


# --- protocols --------------------------------------------------------------------------------


def daily_port_bytes(flows: DataFrame) -> DataFrame:
    return summed(flows, [day("start_ts").alias("date"), "protocol", "dest_port"])


def weekly_protocol_bytes(daily_ports: DataFrame) -> DataFrame:
    named = daily_ports.withColumn("name", protocol_name("protocol", "dest_port"))
    return weekly_bytes(named, "name")


def other_udp_ports(daily_ports: DataFrame) -> DataFrame:
    named = daily_ports.withColumn("name", protocol_name("protocol", "dest_port"))
    other = named.where((F.col("protocol") == 17) & (F.col("name") == "Other UDP"))
    return summed(other, ["dest_port"]).withColumn("bytes_total", total_bytes())


# --- directions by day, local traffic ----------------------------------------------------------

DIRECTIONS = ("Down", "Up", "Local")


def daily_directions(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Bytes up, down and between peers per day in long form."""
    typical = flows.select("start_ts", F.col("bytes_up").alias("Up"), F.col("bytes_down").alias("Down"))
    peers = p2p.select("start_ts", total_bytes("bytes_a_to_b", "bytes_b_to_a").alias("Local"))
    whole = typical.unionByName(peers, allowMissingColumns=True).fillna(0)
    wide = summed(whole, [day("start_ts").alias("date")], ["Up", "Down", "Local"])
    return wide.unpivot(["date"], ["Up", "Down", "Local"], "throughput_type", "bytes")


def daily_gb_spread(directions: DataFrame) -> DataFrame:
    daily = directions.groupBy("date").agg(F.sum("bytes").alias("b"))
    return daily.agg(
        (F.avg("b") / GB).alias("mean_gb"), (F.stddev_samp("b") / GB).alias("std_gb")
    )


def weekly_rolling_directions(directions: DataFrame, window: StudyWindow) -> DataFrame:
    """Dense daily bytes per direction with their mean over the last seven days."""
    dates = calendar(directions.sparkSession, window, "day", "date")
    dense = densify(directions, dates, "date", "throughput_type", DIRECTIONS, {"bytes": 0})
    rolled = rolling_mean(dense, ["throughput_type"], "date", "bytes", "mean_bytes")
    return rolled.select(
        "date", "throughput_type", "bytes", "mean_bytes",
        label_order("throughput_type", DIRECTIONS).cast("int").alias("place"),
    )


def weekly_local_traffic(flows: DataFrame, p2p: DataFrame) -> DataFrame:
    """Weekly (closing Sunday) bytes to and from local servers and between peers, long form.

    Weeks without any flow between the first and the last are there with zeros.
    """
    local = F.col("local")

    def part(column: str, near: bool) -> Column:
        keep = local if near else ~local
        return F.when(keep, F.col(column)).otherwise(0)

    typical = flows.select(
        "start_ts",
        part("bytes_up", False).alias("external_up"),
        part("bytes_down", False).alias("external_down"),
        part("bytes_up", True).alias("Upload to Local Server"),
        part("bytes_down", True).alias("Download from Local Server"),
    )
    peers = p2p.select("start_ts", total_bytes("bytes_a_to_b", "bytes_b_to_a").alias("Peer to Peer"))
    kinds = ["external_up", "external_down", "Upload to Local Server",
             "Download from Local Server", "Peer to Peer"]
    whole = typical.unionByName(peers, allowMissingColumns=True)
    weekly = summed(whole, [week_ending("start_ts", "SUN").alias("week")], kinds).fillna(0)
    span = weekly.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    weeks = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    long = weekly.unpivot(["week"], kinds, "direction", "bytes")
    return densify(long, weeks, "week", "direction", kinds, {"bytes": 0})


def anomaly_kind() -> Column:
    silent = F.col("bytes_b_to_a") == 0
    return (
        F.when((F.col("b_port") == 1900) & silent, "SSDP Query (No Answer)")
        .when(silent, "Unanswered")
        .otherwise("Unknown")
    )


def anomaly_flows_by_day(nouser: DataFrame, window: StudyWindow) -> DataFrame:
    """Bytes of no-user flows per day and kind, on every day of the study."""
    kinds = nouser.withColumn("kind", anomaly_kind()).withColumn(
        "bytes_total", total_bytes("bytes_a_to_b", "bytes_b_to_a")
    )
    daily = summed(kinds, [day("start_ts").alias("date"), "kind"], ["bytes_total"])
    dates = calendar(nouser.sparkSession, window, "day", "date")
    return densify_with_observed(daily, dates, "date", "kind", {"bytes_total": 0})


def peer_kind() -> Column:
    one_way = (F.col("bytes_a_to_b") == 0) | (F.col("bytes_b_to_a") == 0)
    return F.when(one_way, "One-Way").otherwise("Two-Way")


def peer_pairs_by_day(p2p: DataFrame) -> DataFrame:
    """Two-way peer traffic per day and unordered pair of users."""
    pairs = p2p.where(peer_kind() == "Two-Way").select(
        day("start_ts").alias("date"),
        F.least("user_a", "user_b").alias("key_x"),
        F.greatest("user_a", "user_b").alias("key_y"),
        total_bytes("bytes_a_to_b", "bytes_b_to_a").alias("bytes_total"),
    )
    return summed(pairs, ["date", "key_x", "key_y"], ["bytes_total"])


def peer_pairs(daily_pairs: DataFrame) -> DataFrame:
    """Total, days and mean per day of every pair."""
    return daily_pairs.groupBy("key_x", "key_y").agg(
        F.sum("bytes_total").alias("bytes_total"),
        F.count(F.lit(1)).alias("days"),
        (F.sum("bytes_total") / F.count(F.lit(1))).alias("average_bytes"),
    )


def call_peers(flows: DataFrame) -> DataFrame:
    """Bytes and distinct users per address and name of call traffic."""
    calls = flows.where(F.col("category").isin(R.PEER_TO_PEER, R.ICE))
    per_user = calls.groupBy("dest_ip", "fqdn", "user_id").agg(
        *[F.sum(c).alias(c) for c in UP_DOWN]
    )
    return per_user.groupBy("dest_ip", "fqdn").agg(
        F.sum("bytes_up").alias("bytes_up"),
        F.sum("bytes_down").alias("bytes_down"),
        F.sum(total_bytes()).alias("total_bytes"),
        F.count("user_id").alias("user_count"),
    )


def host_accesses(
    requests: DataFrame, host: str = "host", exclude: Sequence[str] = (), containing: str | None = None
) -> DataFrame:
    """How often each host was asked for, some left out or only those with a substring."""
    kept = requests.where(F.col(host).isNotNull())
    if exclude:
        kept = kept.where(~F.col(host).isin(*exclude))
    if containing:
        kept = kept.where(F.col(host).contains(containing))
    return kept.groupBy(host).agg(F.count(F.lit(1)).alias("accesses"))


def value_cdf_by_type(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distributions of several columns, one under the other, told apart by ``type``."""
    long = df.select(*[F.col(c).cast("double").alias(label) for label, c in columns.items()])
    long = long.unpivot([], list(columns), "type", "v")
    return cdf(long, "v", ["type"])
