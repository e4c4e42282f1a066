"""Which domain a flow most likely went to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshledger.functions.addresses import mark_local
from meshledger.operators.scans import (
    ROWS_PER_BUCKET,
    by_time,
    last_known,
    ordered_scan,
    running_sum,
)


def attach_fqdn(
    flows: DataFrame,
    dns: DataFrame,
    reverse_dns: DataFrame | None = None,
    only_dns_users: bool = True,
    tie: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """As-of join: the domain of the user's latest answer for the address before the flow.

    Also counts the distinct domains seen so far for that (user, address). Flows and answers
    run through one scan by (user, address); the first answer per domain, found by a
    pre-aggregated minimum, adds one to the count. An answer at exactly the flow's start is
    not used. ``reverse_dns`` (ip, host) fills global addresses with no answer; of several hosts
    of an address the first by name. Flows without user, address or start have no answer and
    come back unnamed; only ``only_dns_users`` leaves flows out.
    """
    if only_dns_users:
        flows = flows.join(dns.select("user_id").distinct(), "user_id", "left_semi")
    first_seen = (
        dns.groupBy("user_id", "ip_address", "domain_name")
        .agg(F.min("ts").alias("_at"))
        .select("user_id", F.col("ip_address").alias("dest_ip"), "_at", F.lit(1).alias("_new"),
                F.lit(2).alias("_turn"), F.col("domain_name").alias("_tie"))
    )
    answers = dns.select(
        "user_id", F.col("ip_address").alias("dest_ip"), F.col("ts").alias("_at"),
        F.col("domain_name").alias("_domain"), F.lit(1).alias("_turn"),
        F.col("domain_name").alias("_tie"),
    )
    complete = F.col("user_id").isNotNull() & F.col("dest_ip").isNotNull() & F.col("start_ts").isNotNull()
    events = flows.withColumns(
        {
            "_at": F.col("start_ts"),
            "_turn": F.lit(0),
            "_tie": F.col(tie).cast("string") if tie else F.lit(""),
        }
    )
    loose = events.where(~complete).withColumns({"_name": F.lit(None).cast("string"), "_count": F.lit(0)})
    stream = events.where(complete).unionByName(answers, allowMissingColumns=True).unionByName(
        first_seen, allowMissingColumns=True
    )
    scanned = ordered_scan(
        stream,
        ["user_id", "dest_ip"],
        ["_at", "_turn", "_tie"],
        by_time("_at", rows_per_bucket),
        {"_name": last_known("_domain"), "_count": running_sum("_new")},
    ).where(F.col("_turn") == 0)
    scanned = scanned.unionByName(loose, allowMissingColumns=True)

    known = F.col("_name").isNotNull()
    if reverse_dns is not None:
        # A column, not a filter: a filter would repeat the address test for every block of its list.
        outside = mark_local(reverse_dns, "ip", "_local").select(F.col("ip").alias("_ip"), F.when(~F.col("_local"), F.col("host")).alias("_host"))
        hosts = outside.groupBy("_ip").agg(F.min("_host").alias("_host"))
        # Only flows without an answer look for a host; the others get a key of their own, which
        # nothing has, so that they neither match nor meet in one task.
        own = F.concat(F.lit("#"), F.xxhash64("user_id", "dest_ip", "start_ts").cast("string"))
        scanned = scanned.withColumn("_ip", F.when(known, own).otherwise(F.col("dest_ip")))
        scanned = scanned.join(hosts, "_ip", "left")
        reverse = F.col("_host")
    else:
        reverse = F.lit(None).cast("string")
    return scanned.select(
        *flows.columns,
        F.coalesce(F.col("_name"), reverse, F.lit("")).alias("fqdn"),
        F.when(known, F.col("_count")).when(reverse.isNotNull(), 1).otherwise(0).cast("int")
        .alias("ambiguous_fqdn_count"),
        F.when(known, "user_dns_log").when(reverse.isNotNull(), "reverse_dns").otherwise("none")
        .alias("fqdn_source"),
    )


def users_without_dns(flows: DataFrame, dns: DataFrame) -> DataFrame:
    users = flows.select("user_id").distinct()
    return users.join(dns.select("user_id").distinct(), "user_id", "left_anti")
