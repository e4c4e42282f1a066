"""Reading, writing and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger import session
from meshledger.catalog.base import ROWS, Inputs, query
from meshledger.catalog.sql import FQDN, IP, END, PORT, PROTOCOL, using
from meshledger.functions.timebins import day
from meshledger.operators import routing
from meshledger.operators.activity import first_purchases
from meshledger.sources import derived, tables, traceroutes, transaction_log

_FLOW_COLUMNS = """event_id, start_ts, end_ts, user_id, dest_ip, user_port, dest_port, protocol,
  bytes_up, bytes_down, fqdn, category, org, local"""


def _rewritten(i: Inputs):
    path = session.scratch_path(i.spark, "flows")
    tables.write_table(i.flows, path)
    tables.write_table(i.flows, path)
    return tables.read_table(i.spark, path, i.flows.schema)


def _by_day(i: Inputs):
    path = session.scratch_path(i.spark, "by-day")
    tables.write_by_day(i.flows, path)
    days = tables.read_table(i.spark, path)
    return days.groupBy(F.col("day").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes_up").alias("bytes_up")
    )


def _csv(i: Inputs):
    path = session.scratch_path(i.spark, "first-purchases")
    tables.write_csv(first_purchases(i.tx, "event_id"), path)
    schema = "start timestamp_ntz, action string, user_id bigint, amount bigint, price bigint"
    return tables.read_csv(i.spark, path, schema, ["start", "user_id", "price"])


def _parsed(i: Inputs):
    lines = derived.log_lines(i.spark, i.sf_dir)
    parsed, _ = transaction_log.parse_transaction_log(lines)
    return parsed


def _rejects(i: Inputs):
    lines = derived.log_lines(i.spark, i.sf_dir)
    spoiled = lines.select(
        F.when(F.col("value").contains("TOPUP"), F.replace("value", F.lit("TOPUP"), F.lit("GIFT")))
        .otherwise(F.col("value")).alias("value")
    )
    _, rejects = transaction_log.parse_transaction_log(spoiled, strict=False)
    return rejects


def _scrubbed(i: Inputs):
    dirty = i.table("documents").select(
        "doc_id", F.replace("text", F.lit("e"), F.lit("\x00e")).alias("text")
    )
    return transaction_log.scrub_nul(dirty, "text").select("doc_id", "text", "nul_count")


def _routed(kind: str):
    def build(i: Inputs):
        return routing.route_flows(derived.raw_flow_records(i.spark, i.sf_dir))[kind]

    return query(build)


def _doubled(i: Inputs):
    # Every record arrives twice, from two overlapping archives.
    return tables.consolidate([i.flows, i.flows])


_RAW = f"""SELECT event_id, ts AS start_time, {END} AS end_time,
  CASE WHEN event_id % 11 IN (0,1,2,3,7,10) THEN user_id END AS oa,
  CASE WHEN event_id % 11 IN (4,5,6,7,8) THEN (user_id * 7 + 3) % 15 END AS ob,
  CASE WHEN event_id % 11 IN (4,5,6,9,10) THEN {IP} END AS aa,
  CASE WHEN event_id % 11 IN (0,1,2,3,9,8,10) THEN {IP} END AS ab,
  CAST(40000 + event_id % 5 AS INTEGER) AS pa, CAST({PORT} AS INTEGER) AS pb,
  event_id * 31 % 100000 AS ba, CAST(floor(value * 1000) AS BIGINT) AS bb,
  CAST({PROTOCOL} AS INTEGER) AS protocol FROM events"""
_TYPICAL = "(oa IS NOT NULL AND ob IS NULL AND aa IS NULL AND ab IS NOT NULL)"
_SWAPPED = "(oa IS NULL AND ob IS NOT NULL AND aa IS NOT NULL AND ab IS NULL)"
_P2P = "(oa IS NOT NULL AND ob IS NOT NULL AND aa IS NULL AND ab IS NULL)"
_NOUSER = "(oa IS NULL AND ob IS NULL AND aa IS NOT NULL AND ab IS NOT NULL)"

_LOG = """SELECT date_trunc('second', ts) AS ts,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'user_transfer'
    WHEN 'error' THEN 'admin_transfer' ELSE 'admin_topup' END AS kind,
  CASE WHEN event_type <> 'signup' THEN concat('user ', user_id) END AS user_id,
  CASE event_type WHEN 'signup' THEN concat('user ', user_id) WHEN 'purchase' THEN NULL
    ELSE concat('user ', (user_id * 7 + 3) % 15) END AS dest_user_id,
  CASE WHEN event_type = 'purchase' THEN (1 + event_id % 4) * 10000000 END AS amount_bytes,
  CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 0
      WHEN 1 THEN CAST(round_even(event_id % 1000 + 0.5, 0) AS BIGINT) ELSE event_id % 1000 END
    ELSE CAST(floor(value * 100) AS BIGINT) END AS amount_idr
  FROM events WHERE event_type <> 'view'"""

_HOST = "regexp_extract(url, 'https?://([^/]+)', 1)"
_TRACE = f"""SELECT concat('trace-', page_id, '.txt') AS file, 'Community Network' AS dataset, domain, hop, ip, latency,
  last_hop, concat('Community Network, ', domain) AS unique_name FROM (
  SELECT page_id, {_HOST} AS domain, 1 AS hop, '10.0.0.1' AS ip, page_id % 7 + 1.5 + page_id % 5 + 1.25 AS latency, 0 AS last_hop FROM pages
  UNION ALL SELECT page_id, {_HOST}, 2, '*', NULL, 0 FROM pages
  UNION ALL SELECT page_id, 'b.' || {_HOST}, 1, '10.0.0.1', NULL, 0 FROM pages
  UNION ALL SELECT page_id, 'b.' || {_HOST}, 2, concat('10.9.', page_id % 250, '.1'),
    (page_id % 90 + 10.125 + page_id % 80 + 10.375 + page_id % 70 + 10.5) / 2, 1 FROM pages)"""

_ANSWERS = f"""SELECT event_id, ts, user_id, event_id % 5 AS m, {FQDN} AS domain_name,
  ([{IP}, concat('10.0.0.', event_id % 250), '9.9.9.9'])[n] AS ip_address, ([60, 300, 3600])[n] AS ttl
  FROM events, range(1, 4) t(n) WHERE n <= least(event_id % 4, event_id % 3 + 1)"""

QUERIES = {
    "read_flows": (query(lambda i: i.flows), using("flows", f"SELECT {_FLOW_COLUMNS} FROM flows")),
    "overwrite_and_read_flows": (
        query(_rewritten), using("flows", f"SELECT {_FLOW_COLUMNS} FROM flows")
    ),
    "flows_written_by_day": (
        query(_by_day),
        using("flows", """SELECT CAST(start_ts AS DATE) AS date, count(*) AS flows,
          CAST(sum(bytes_up) AS BIGINT) AS bytes_up FROM flows GROUP BY 1"""),
    ),
    "consolidated_flow_kinds": (
        query(lambda i: tables.consolidate([
            i.flows.select("event_id", "start_ts", "user_id", "bytes_up"),
            i.p2p.select("event_id", "start_ts", "user_a", "bytes_a_to_b"),
            i.nouser.select("event_id", "start_ts", "ip_a", "bytes_a_to_b"),
        ])),
        using("flows p2p nouser", """SELECT event_id, start_ts, user_id, bytes_up, NULL::BIGINT AS user_a,
          NULL::BIGINT AS bytes_a_to_b, NULL AS ip_a FROM flows
          UNION ALL SELECT event_id, start_ts, NULL, NULL, user_a, bytes_a_to_b, NULL FROM p2p
          UNION ALL SELECT event_id, start_ts, NULL, NULL, NULL, bytes_a_to_b, ip_a FROM nouser"""),
    ),
    "first_purchases_csv": (
        query(_csv),
        using("first_buys", "SELECT start, user_id, price FROM first_buys"),
    ),
    "transaction_log": (query(_parsed), _LOG),
    "transaction_log_rejects": (
        query(_rejects),
        """SELECT concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' GIFT |user ', user_id, '| ',
          CAST(floor(value * 100) AS BIGINT)) AS value FROM events WHERE event_type = 'signup'""",
    ),
    "nul_scrub": (
        query(_scrubbed),
        """SELECT doc_id, text, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS nul_count
           FROM documents""",
    ),
    "traceroute_hops": (
        query(lambda i: traceroutes.parse_traceroutes(derived.traceroute_files(i.spark, i.sf_dir))),
        _TRACE,
    ),
    "traceroute_measured": (
        query(lambda i: traceroutes.with_measured(
            traceroutes.parse_traceroutes(derived.traceroute_files(i.spark, i.sf_dir)),
            i.table("pages").select(
                F.concat(F.lit("page-"), "page_id").alias("file"), F.lit("Other").alias("dataset"),
                F.lit("x.example").alias("domain"), F.lit(1).alias("hop"),
                (F.col("page_id") / F.lit(4.0)).alias("latency"),
            ),
        ).select("file", "dataset", "domain", "hop", "latency")),
        f"""SELECT file, dataset, domain, hop, CAST(latency AS DOUBLE) AS latency FROM ({_TRACE}) WHERE latency IS NOT NULL
           UNION ALL SELECT concat('page-', page_id), 'Other', 'x.example', 1, page_id / 4.0::DOUBLE FROM pages""",
    ),
    "route_typical": (
        _routed("typical"),
        f"""WITH raw AS ({_RAW}) SELECT event_id, start_time AS start_ts, end_time AS end_ts,
          coalesce(oa, ob) AS user_id, coalesce(ab, aa) AS dest_ip,
          CASE WHEN {_TYPICAL} THEN pa ELSE pb END AS user_port, CASE WHEN {_TYPICAL} THEN pb ELSE pa END AS dest_port,
          CASE WHEN {_TYPICAL} THEN ba ELSE bb END AS bytes_up, CASE WHEN {_TYPICAL} THEN bb ELSE ba END AS bytes_down,
          protocol FROM raw WHERE {_TYPICAL} OR {_SWAPPED}""",
    ),
    "route_p2p": (
        _routed("p2p"),
        f"""WITH raw AS ({_RAW}) SELECT event_id, start_time AS start_ts, end_time AS end_ts, oa AS user_a, ob AS user_b,
          pa AS a_port, pb AS b_port, ba AS bytes_a_to_b, bb AS bytes_b_to_a, protocol FROM raw WHERE {_P2P}""",
    ),
    "route_nouser": (
        _routed("nouser"),
        f"""WITH raw AS ({_RAW}) SELECT event_id, start_time AS start_ts, end_time AS end_ts, aa AS ip_a, ab AS ip_b,
          pa AS a_port, pb AS b_port, ba AS bytes_a_to_b, bb AS bytes_b_to_a, protocol FROM raw WHERE {_NOUSER}""",
    ),
    "route_malformed": (
        query(lambda i: routing.route_flows(derived.raw_flow_records(i.spark, i.sf_dir))["malformed"]
              .select("event_id", "obfuscated_a", "obfuscated_b", "address_a", "address_b")),
        f"""WITH raw AS ({_RAW}) SELECT event_id, oa AS obfuscated_a, ob AS obfuscated_b, aa AS address_a, ab AS address_b
          FROM raw WHERE NOT ({_TYPICAL} OR {_SWAPPED} OR {_P2P} OR {_NOUSER})""",
    ),
    "legacy_route_counts": (
        query(lambda i: routing.legacy_route(derived.raw_flow_records(i.spark, i.sf_dir))
              .groupBy("route").agg(F.count(F.lit(1)).alias("flows"))),
        f"""WITH raw AS ({_RAW}) SELECT CASE WHEN oa IS NULL AND ob IS NULL THEN 'system'
          WHEN oa IS NOT NULL AND ob IS NOT NULL THEN 'netbios'
          WHEN coalesce(aa, ab) = '192.168.151.1' THEN 'local_server' ELSE 'remote' END AS route,
          count(*) AS flows FROM raw GROUP BY 1""",
    ),
    "canonical_dns": (
        query(lambda i: routing.canonicalize_dns(derived.raw_dns_records(i.spark, i.sf_dir))),
        f"""WITH a AS ({_ANSWERS}) SELECT event_id, ts, user_id, CASE WHEN m = 3 THEN '8.8.8.8' ELSE '1.1.1.1' END AS dns_server,
          CAST(CASE WHEN m = 3 THEN 53 ELSE 50000 + event_id % 5 END AS INTEGER) AS user_port,
          CAST(CASE WHEN m = 3 THEN 50000 + event_id % 5 ELSE 53 END AS INTEGER) AS server_port,
          17 AS protocol, 0 AS opcode, CAST(event_id % 2 AS INTEGER) AS resultcode, domain_name, ip_address, ttl
          FROM a WHERE m IN (0, 1, 3)""",
    ),
    "malformed_dns": (
        query(lambda i: routing.malformed_dns(derived.raw_dns_records(i.spark, i.sf_dir)).select("event_id", "src_ip")),
        "SELECT event_id, '8.8.8.8' AS src_ip FROM events WHERE event_id % 5 = 4",
    ),
    "dedup_rows": (
        query(lambda i: routing.dedup(_doubled(i))),
        using("flows", f"SELECT {_FLOW_COLUMNS} FROM flows"),
    ),
    "dedup_time_slices": (
        query(lambda i: routing.dedup(
            i.flows.select("start_ts", "user_id", "dest_ip", "protocol"), "slice", slice_hours=96)),
        using("flows", """SELECT min(start_ts) AS start_ts, user_id, dest_ip, protocol FROM flows
          GROUP BY user_id, dest_ip, protocol, epoch_us(start_ts) // CAST(345600000000 AS BIGINT)"""),
    ),
    "dedup_counts": (
        query(lambda i: routing.dedup_counts(
            _doubled(i).select("user_id", "dest_ip", "dest_port", day("start_ts").alias("date")))),
        using("flows", """SELECT 2 * count(*) AS raw_rows,
          count(DISTINCT (user_id, dest_ip, dest_port, CAST(start_ts AS DATE))) AS final_rows,
          2 * count(*) - count(DISTINCT (user_id, dest_ip, dest_port, CAST(start_ts AS DATE))) AS removed FROM flows"""),
    ),
    "dedup_dns": (
        query(lambda i: routing.dedup_dns(i.dns, slice_hours=96)),
        using("dns", """SELECT user_id, domain_name, ip_address, min(ts) AS ts FROM dns
          GROUP BY user_id, domain_name, ip_address, epoch_us(ts) // CAST(345600000000 AS BIGINT)"""),
    ),
    "coalesced_flows": (
        query(lambda i: routing.coalesce_flows(
            i.flows.select("event_id", "start_ts", "end_ts", F.lit(0).alias("user_id"), "dest_ip",
                           F.lit(0).alias("user_port"), "dest_port", "protocol", "bytes_up", "bytes_down"),
            tolerance_s=300, tie=["event_id"], rows_per_bucket=ROWS)),
        using("flows", """SELECT 0 AS user_id, dest_ip, 0 AS user_port, dest_port, protocol, min(start_ts) AS start_ts,
          arg_max(end_ts, (start_ts, end_ts, event_id)) AS end_ts, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
          CAST(sum(bytes_down) AS BIGINT) AS bytes_down, count(*) AS merged_flows
          FROM (SELECT *, sum(CASE WHEN prev IS NULL OR abs(epoch_us(start_ts) - epoch_us(prev)) > 300000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY dest_ip, dest_port, protocol ORDER BY start_ts, end_ts, event_id ROWS UNBOUNDED PRECEDING) AS run
                FROM (SELECT *, lag(end_ts) OVER (PARTITION BY dest_ip, dest_port, protocol ORDER BY start_ts, end_ts, event_id) AS prev FROM flows))
          GROUP BY dest_ip, dest_port, protocol, run"""),
    ),
}
