"""Raw records to typed tables: direction, routing, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions.timebins import time_bucket
from meshledger.operators.scans import ROWS_PER_BUCKET, sessionize


def flow_kind(prefix_user: str = "obfuscated", prefix_addr: str = "address") -> Column:
    """Which endpoint is a user, and whether the address fields agree with that."""
    user_a, user_b = F.col(f"{prefix_user}_a").isNotNull(), F.col(f"{prefix_user}_b").isNotNull()
    addr_a, addr_b = F.col(f"{prefix_addr}_a").isNotNull(), F.col(f"{prefix_addr}_b").isNotNull()
    return (
        F.when(user_a & ~user_b & ~addr_a & addr_b, "typical_a")
        .when(~user_a & user_b & addr_a & ~addr_b, "typical_b")
        .when(user_a & user_b & ~addr_a & ~addr_b, "p2p")
        .when(~user_a & ~user_b & addr_a & addr_b, "nouser")
        .otherwise("malformed")
    )


def route_flows(raw: DataFrame) -> dict[str, DataFrame]:
    """Split raw flow records into typical, p2p, nouser and malformed tables.

    Typical flows are turned so that the user is the near end.
    """
    tagged = raw.withColumn("flow_kind", flow_kind())
    user_is_a = F.col("flow_kind") == "typical_a"

    def near(a: str, b: str) -> Column:
        return F.when(user_is_a, F.col(a)).otherwise(F.col(b))

    times = [F.col("start_time").alias("start_ts"), F.col("end_time").alias("end_ts")]
    extra = [c for c in raw.columns if c == "event_id"]
    protocol = F.col("transport_protocol").alias("protocol")
    typical = tagged.where(F.col("flow_kind").isin("typical_a", "typical_b")).select(
        *extra,
        *times,
        near("obfuscated_a", "obfuscated_b").alias("user_id"),
        near("address_b", "address_a").alias("dest_ip"),
        near("port_a", "port_b").alias("user_port"),
        near("port_b", "port_a").alias("dest_port"),
        near("bytes_a_to_b", "bytes_b_to_a").alias("bytes_up"),
        near("bytes_b_to_a", "bytes_a_to_b").alias("bytes_down"),
        protocol,
    )
    ports_and_bytes = [
        F.col("port_a").alias("a_port"),
        F.col("port_b").alias("b_port"),
        "bytes_a_to_b",
        "bytes_b_to_a",
        protocol,
    ]
    p2p = tagged.where(F.col("flow_kind") == "p2p").select(
        *extra,
        *times,
        F.col("obfuscated_a").alias("user_a"),
        F.col("obfuscated_b").alias("user_b"),
        *ports_and_bytes,
    )
    nouser = tagged.where(F.col("flow_kind") == "nouser").select(
        *extra,
        *times,
        F.col("address_a").alias("ip_a"),
        F.col("address_b").alias("ip_b"),
        *ports_and_bytes,
    )
    malformed = tagged.where(F.col("flow_kind") == "malformed").drop("flow_kind")
    return {"typical": typical, "p2p": p2p, "nouser": nouser, "malformed": malformed}


def legacy_route(raw: DataFrame, local_server: str = "192.168.151.1") -> DataFrame:
    """Older routing: system log, netbios (user to user), local server or remote."""
    user_a, user_b = F.col("obfuscated_a").isNotNull(), F.col("obfuscated_b").isNotNull()
    at_server = F.coalesce(F.col("address_a"), F.col("address_b")) == local_server
    return raw.withColumn(
        "route",
        F.when(~user_a & ~user_b, "system")
        .when(user_a & user_b, "netbios")
        .when(at_server, "local_server")
        .otherwise("remote"),
    )


def canonicalize_dns(raw: DataFrame) -> DataFrame:
    """One row per answered address, seen from the user; unanswerable records are dropped.

    Answers and TTLs are paired up to the shorter list. The server address may come as
    ``dst_ip`` or ``dest_ip``.
    """
    server_far = F.coalesce(*[F.col(c) for c in ("dst_ip", "dest_ip") if c in raw.columns])
    user_asks = F.col("obfuscated_src").isNotNull() & F.col("obfuscated_dst").isNull()
    user_hears = F.col("obfuscated_src").isNull() & F.col("obfuscated_dst").isNotNull()
    good = (user_asks & F.col("src_ip").isNull() & server_far.isNotNull()) | (
        user_hears & server_far.isNull() & F.col("src_ip").isNotNull()
    )
    pairs = F.least(F.size("response_addresses"), F.size("response_ttls"))
    answers = F.slice(F.arrays_zip("response_addresses", "response_ttls"), F.lit(1), pairs)
    extra = [c for c in raw.columns if c == "event_id"]
    return (
        raw.where(good)
        .withColumn("answer", F.explode(answers))
        .select(
            *extra,
            "ts",
            F.when(user_asks, F.col("obfuscated_src")).otherwise(F.col("obfuscated_dst")).alias("user_id"),
            F.when(user_asks, server_far).otherwise(F.col("src_ip")).alias("dns_server"),
            F.when(user_asks, F.col("src_port")).otherwise(F.col("dst_port")).alias("user_port"),
            F.when(user_asks, F.col("dst_port")).otherwise(F.col("src_port")).alias("server_port"),
            "protocol",
            "opcode",
            "resultcode",
            F.col("host").alias("domain_name"),
            F.col("answer.response_addresses").alias("ip_address"),
            F.col("answer.response_ttls").alias("ttl"),
        )
    )


def malformed_dns(raw: DataFrame) -> DataFrame:
    """Records that name both a user and an address for the same endpoint."""
    far = F.coalesce(*[F.col(c) for c in ("dst_ip", "dest_ip") if c in raw.columns])
    asks = F.col("obfuscated_src").isNotNull() & F.col("obfuscated_dst").isNull()
    hears = F.col("obfuscated_src").isNull() & F.col("obfuscated_dst").isNotNull()
    return raw.where((asks & F.col("src_ip").isNotNull()) | (hears & far.isNotNull()))


def dedup(df: DataFrame, mode: str = "row", ts: str = "start_ts", slice_hours: int = 4) -> DataFrame:
    """Drop repeated rows.

    ``row``: rows equal in every column. ``slice``: rows equal in all columns but ``ts``
    within one time slice; the earliest stays.
    """
    if mode == "row":
        return df.dropDuplicates()
    if mode != "slice":
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in df.columns if c != ts]
    return (
        df.groupBy(*others, time_bucket(ts, slice_hours * 3600).alias("_slice"))
        .agg(F.min(ts).alias(ts))
        .select(*df.columns)
    )


def dedup_counts(df: DataFrame) -> DataFrame:
    """Rows before and after dropping repeated rows."""
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return sizes.agg(
        F.sum("copies").alias("raw_rows"),
        F.count(F.lit(1)).alias("final_rows"),
        (F.sum("copies") - F.count(F.lit(1))).alias("removed"),
    )


def dedup_dns(dns: DataFrame, slice_hours: int = 4) -> DataFrame:
    """First answer per user, domain and address in each time slice."""
    return (
        dns.groupBy(
            "user_id",
            "domain_name",
            "ip_address",
            time_bucket("ts", slice_hours * 3600).alias("_slice"),
        )
        .agg(F.min("ts").alias("ts"))
        .drop("_slice")
    )


def coalesce_flows(
    flows: DataFrame,
    tolerance_s: float = 1,
    tie: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Merge flows of one 5-tuple that start within ``tolerance_s`` of the end of the one before."""
    keys = ["user_id", "dest_ip", "user_port", "dest_port", "protocol"]

    def apart(prev_end: Column, start: Column) -> Column:
        gap = (start - prev_end).cast("interval second").cast("decimal(18,6)")
        return F.abs(gap) > F.lit(tolerance_s)

    order = ["start_ts", "end_ts", *tie]
    used = flows.select(*dict.fromkeys([*keys, *order, "bytes_up", "bytes_down"]))
    runs = sessionize(used, keys, order, "end_ts", apart, rows_per_bucket, out="run")
    return (
        runs.groupBy(*keys, "run")
        .agg(
            F.max_by("end_ts", F.struct(*order)).alias("end_ts"),
            F.sum("bytes_up").alias("bytes_up"),
            F.sum("bytes_down").alias("bytes_down"),
            F.count(F.lit(1)).alias("merged_flows"),
        )
        .select(*keys, F.col("run.start_ts").alias("start_ts"), "end_ts", "bytes_up", "bytes_down", "merged_flows")
    )
