"""Byte reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.base import Inputs, query, rounded
from meshledger.catalog.sql import IN_OUTAGE, using, week_monday, week_sunday
from meshledger.plans import traffic as t

_PROTO = """CASE WHEN protocol = 6 THEN CASE dest_port WHEN 22 THEN 'SSH' WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS'
    WHEN 80 THEN 'HTTP' WHEN 143 THEN 'IMAP' WHEN 220 THEN 'IMAP' WHEN 443 THEN 'HTTPS' WHEN 993 THEN 'IMAP'
    WHEN 5349 THEN 'STUN/TURN TLS' ELSE 'Other TCP' END
  WHEN protocol = 17 THEN CASE dest_port WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP/3 (QUIC)' WHEN 123 THEN 'NTP'
    WHEN 143 THEN 'IMAP' WHEN 443 THEN 'HTTP/3 (QUIC)' WHEN 3478 THEN 'STUN/TURN' ELSE 'Other UDP' END
  ELSE 'Other' END"""
_WEEKLY = f"SELECT {week_monday('date')} AS week, {{0}}, sum(bytes_up) AS u, sum(bytes_down) AS d FROM daily GROUP BY ALL"
_FACETED = """SELECT w.week, w.{0}, 'Downlink' AS direction, w.d / 1e9 AS gb, o.od AS "order" FROM weekly w JOIN ord o USING ({0})
  UNION ALL SELECT w.week, w.{0}, 'Uplink', w.u / 1e9, o.ou FROM weekly w JOIN ord o USING ({0})"""
_ORD = """SELECT {0}, CAST(row_number() OVER (ORDER BY sum(d), {0}) - 1 AS INTEGER) AS od,
  CAST(row_number() OVER (ORDER BY sum(u), {0}) - 1 AS INTEGER) AS ou FROM weekly GROUP BY 1"""
_NAMED = f"SELECT CAST(start_ts AS DATE) AS date, {_PROTO} AS name, bytes_up, bytes_down FROM flows"
_NORMAL = "SELECT * FROM hourly WHERE NOT (date >= DATE '2024-01-10' AND date < DATE '2024-01-15')"
_ALL = """SELECT start_ts, bytes_up + bytes_down AS b FROM flows
  UNION ALL SELECT start_ts, bytes_a_to_b + bytes_b_to_a FROM p2p
  UNION ALL SELECT start_ts, bytes_a_to_b + bytes_b_to_a FROM nouser"""
_DAILY = """SELECT CAST(start_ts AS DATE) AS date, CAST(sum(b) AS BIGINT) AS bytes_total,
  dayname(CAST(start_ts AS DATE)) AS weekday FROM allf GROUP BY ALL"""
_DIRS = """SELECT CAST(start_ts AS DATE) AS date, throughput_type, CAST(sum(b) AS BIGINT) AS bytes FROM (
  SELECT start_ts, 'Up' AS throughput_type, bytes_up AS b FROM flows UNION ALL SELECT start_ts, 'Down', bytes_down FROM flows
  UNION ALL SELECT start_ts, 'Local', 0 FROM flows
  UNION ALL SELECT start_ts, 'Local', bytes_a_to_b + bytes_b_to_a FROM p2p) GROUP BY ALL"""
_DAYS = """SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS date"""
_ANOMALY = """CASE WHEN b_port = 1900 AND bytes_b_to_a = 0 THEN 'SSDP Query (No Answer)'
  WHEN bytes_b_to_a = 0 THEN 'Unanswered' ELSE 'Unknown' END"""
_PAIRS = """SELECT CAST(start_ts AS DATE) AS date, least(user_a, user_b) AS key_x, greatest(user_a, user_b) AS key_y,
  CAST(sum(bytes_a_to_b + bytes_b_to_a) AS BIGINT) AS bytes_total FROM p2p WHERE bytes_a_to_b <> 0 AND bytes_b_to_a <> 0 GROUP BY ALL"""
_HOUR_STATS = """SELECT {0}, type, value / 1e6 AS mb FROM (
  SELECT {0}, unnest(['Mean', '90th Percentile', '99th Percentile', 'Max']) AS type,
    unnest([round(avg(b), 3), round(quantile_cont(b, 0.9), 3), round(quantile_cont(b, 0.99), 3), round(CAST(max(b) AS DOUBLE), 3)]) AS value
  FROM (SELECT {0}, {1} AS b FROM ({2}) {3}) GROUP BY {0})"""
_BOOT = """SELECT *, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2
  WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5
  WHEN u < 0.9999167588507119 THEN 6 ELSE 7 END AS w FROM (
  SELECT date, weekday, bytes_total, r, CAST(concat('0x', substr(md5(concat(date, '|', r, '|7')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM normal, range(1, 201) x(r))"""
_PER_HOST = """SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS host, count(*) AS accesses FROM pages WHERE {0} GROUP BY 1"""


def _hosts(i: Inputs):
    return i.table("pages").select(F.regexp_extract("url", r"https?://([^/]+)", 1).alias("host"))


def _calls(i: Inputs):
    # The test categories stand in for the two call categories.
    return i.flows.withColumn(
        "category",
        F.when(F.col("category") == "signup", "Peer to Peer")
        .when(F.col("category") == "error", "ICE (STUN/TURN)").otherwise(F.col("category")),
    )


def _coverage_daily(i: Inputs):
    return i.daily.replace({"click": "Unknown (No DNS)", "view": "Unknown (Not Mapped)"}, subset=["category"])


QUERIES = {
    "bytes_per_user": (
        query(lambda i: t.bytes_per_user(i.flows)),
        using("flows", """SELECT user_id, 'bytes_up' AS direction, CAST(sum(bytes_up) AS BIGINT) AS bytes FROM flows GROUP BY 1
          UNION ALL SELECT user_id, 'bytes_down', CAST(sum(bytes_down) AS BIGINT) FROM flows GROUP BY 1"""),
    ),
    "daily_category_org_bytes": (
        query(lambda i: i.daily),
        using("daily", "SELECT date, category, org, CAST(bytes_up AS BIGINT) AS bytes_up, CAST(bytes_down AS BIGINT) AS bytes_down FROM daily"),
    ),
    "weekly_category_bytes": (
        query(lambda i: t.weekly_bytes_faceted(i.daily, "category")),
        using("daily", _FACETED.format("category"), weekly=_WEEKLY.format("category"), ord=_ORD.format("category")),
    ),
    "weekly_org_bytes": (
        query(lambda i: t.weekly_bytes(i.daily, "org")),
        using("daily", """SELECT week, org, CAST(u AS BIGINT) AS bytes_up, CAST(d AS BIGINT) AS bytes_down, CAST(u + d AS BIGINT) AS bytes_total FROM weekly""",
              weekly=_WEEKLY.format("org")),
    ),
    "category_direction_totals": (
        query(lambda i: t.category_direction_totals(i.daily)),
        using("daily", """SELECT category, direction, (CASE WHEN b = 0 THEN 1 ELSE b END) / 1e9 AS gb FROM (
          SELECT category, 'bytes_up' AS direction, sum(bytes_up) AS b FROM daily GROUP BY 1
          UNION ALL SELECT category, 'bytes_down', sum(bytes_down) FROM daily GROUP BY 1)"""),
    ),
    "mapping_coverage": (
        query(lambda i: t.mapping_coverage(_coverage_daily(i), "category")),
        using("daily", """SELECT t / 1e9 AS total_gb, a / 1e9 AS unknown_gb, (t - a) / 1e9 AS mappable_gb, (t - a - b) / 1e9 AS mapped_gb,
          CAST(a AS DOUBLE) / t AS fraction_unmappable, CAST(t - a - b AS DOUBLE) / t AS fraction_mapped_of_total,
          CAST(t - a - b AS DOUBLE) / (t - a) AS fraction_mapped_of_mappable FROM (
          SELECT sum(bytes_up + bytes_down) AS t, sum(CASE WHEN category = 'click' THEN bytes_up + bytes_down ELSE 0 END) AS a,
            sum(CASE WHEN category = 'view' THEN bytes_up + bytes_down ELSE 0 END) AS b FROM daily)"""),
    ),
    "org_top_n": (
        query(lambda i: t.org_top_n(i.daily, 9)),
        using("daily", """SELECT week, CASE WHEN r <= 9 THEN org ELSE concat('Other N=', (SELECT count(*) - 9 FROM tot)) END AS org,
          CAST(sum(u) AS BIGINT) AS bytes_up, CAST(sum(d) AS BIGINT) AS bytes_down, CAST(sum(u + d) AS BIGINT) AS bytes_total
          FROM weekly JOIN tot USING (org) GROUP BY 1, 2""",
              weekly=_WEEKLY.format("org"),
              tot="SELECT org, row_number() OVER (ORDER BY sum(u + d) DESC, org) AS r FROM weekly GROUP BY 1"),
    ),
    "org_others": (
        query(lambda i: t.org_others(i.daily, 9)),
        using("daily", """SELECT week, org, CAST(u + d AS BIGINT) AS bytes_total, o AS "order" FROM weekly JOIN (
          SELECT org, rank() OVER (ORDER BY b) - 1 AS o FROM tot WHERE r > 9) USING (org)""",
              weekly=_WEEKLY.format("org"),
              tot="SELECT org, sum(u + d) AS b, row_number() OVER (ORDER BY sum(u + d) DESC, org) AS r FROM weekly GROUP BY 1"),
    ),
    "hourly_category_bytes": (query(lambda i: i.hourly), using("hourly", "SELECT * FROM hourly")),
    "hourly_traffic_stats": (
        query(lambda i: t.hourly_traffic_stats(i.hourly, i.window)),
        using("hourly", _HOUR_STATS.format("hour", "sum(bytes_total)", _NORMAL, "GROUP BY hour, date")),
    ),
    "hourly_category_stats": (
        query(lambda i: t.hourly_category_stats(i.hourly, i.window)),
        using("hourly", _HOUR_STATS.format("hour, category", "bytes_total", _NORMAL, "") + " WHERE type <> 'Max'"),
    ),
    "hourly_category_share": (
        query(lambda i: t.hourly_category_share(i.hourly, i.window)),
        using("hourly", f"""SELECT hour, category, b / 1e6 AS mb, CAST(b AS DOUBLE) / sum(b) OVER (PARTITION BY category) AS byte_density
          FROM (SELECT hour, category, sum(bytes_total) AS b FROM ({_NORMAL}) GROUP BY 1, 2)"""),
    ),
    "daily_bytes_of_all_flows": (
        query(lambda i: t.daily_bytes(t.all_flow_bytes(i.flows, i.p2p, i.nouser))),
        using("flows p2p nouser", _DAILY, allf=_ALL),
    ),
    "weekday_mean_bytes": (
        query(lambda i: rounded(t.weekday_mean(t.daily_bytes(t.all_flow_bytes(i.flows, i.p2p, i.nouser)), i.window), 9, "mean_gb")),
        using("flows p2p nouser", f"""SELECT weekday, round(avg(bytes_total) / 1e9, 9) AS mean_gb FROM ({_DAILY})
          WHERE NOT ({IN_OUTAGE.format('date')}) GROUP BY 1""", allf=_ALL),
    ),
    "weekday_bootstrap_ci": (
        query(lambda i: rounded(t.weekday_mean_ci(t.daily_bytes(t.all_flow_bytes(i.flows, i.p2p, i.nouser)), i.window, 200),
                                9, "mean_gb", "ci_lo_gb", "ci_hi_gb")),
        using("flows p2p nouser", """SELECT weekday, round(any_value(m), 9) AS mean_gb, round(quantile_cont(b, 0.025) / 1e9, 9) AS ci_lo_gb,
          round(quantile_cont(b, 0.975) / 1e9, 9) AS ci_hi_gb FROM (
            SELECT weekday, r, sum(bytes_total * w) / CAST(sum(w) AS DOUBLE) AS b FROM drawn GROUP BY 1, 2 HAVING sum(w) > 0)
          JOIN (SELECT weekday, avg(bytes_total) / 1e9 AS m FROM normal GROUP BY 1) USING (weekday) GROUP BY 1""",
              allf=_ALL, normal=f"SELECT * FROM ({_DAILY}) WHERE NOT ({IN_OUTAGE.format('date')})", drawn=_BOOT),
    ),
    "daily_port_bytes": (
        query(lambda i: t.daily_port_bytes(i.flows)),
        using("flows", """SELECT CAST(start_ts AS DATE) AS date, protocol, dest_port, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
          CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM flows GROUP BY ALL"""),
    ),
    "weekly_protocol_bytes": (
        query(lambda i: t.weekly_protocol_bytes(t.daily_port_bytes(i.flows))),
        using("flows", f"""SELECT {week_monday('date')} AS week, name, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
          CAST(sum(bytes_down) AS BIGINT) AS bytes_down, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS bytes_total FROM named GROUP BY 1, 2""",
              named=_NAMED),
    ),
    "weekly_protocol_facets": (
        query(lambda i: t.weekly_bytes_faceted(
            t.daily_port_bytes(i.flows).withColumn("name", t.protocol_name("protocol", "dest_port")), "name")),
        using("flows", _FACETED.format("name"), daily=_NAMED, weekly=_WEEKLY.format("name"), ord=_ORD.format("name")),
    ),
    "other_udp_ports": (
        query(lambda i: t.other_udp_ports(t.daily_port_bytes(i.flows.replace({123: 9001, 53: 9002}, subset=["dest_port"])))),
        using("flows", f"""SELECT dest_port, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down,
          CAST(sum(bytes_up + bytes_down) AS BIGINT) AS bytes_total FROM (
            SELECT * REPLACE (CAST(CASE dest_port WHEN 123 THEN 9001 WHEN 53 THEN 9002 ELSE dest_port END AS INTEGER) AS dest_port) FROM flows)
          WHERE protocol = 17 AND {_PROTO} = 'Other UDP' GROUP BY 1"""),
    ),
    "daily_directions": (
        query(lambda i: t.daily_directions(i.flows, i.p2p)), using("flows p2p", _DIRS),
    ),
    "daily_gb_spread": (
        query(lambda i: rounded(t.daily_gb_spread(t.daily_directions(i.flows, i.p2p)), 9, "mean_gb", "std_gb")),
        using("flows p2p", f"""SELECT round(avg(b) / 1e9, 9) AS mean_gb, round(stddev_samp(b) / 1e9, 9) AS std_gb
          FROM (SELECT date, sum(bytes) AS b FROM ({_DIRS}) GROUP BY 1)"""),
    ),
    "rolling_directions": (
        query(lambda i: rounded(t.weekly_rolling_directions(t.daily_directions(i.flows, i.p2p), i.window), 4, "mean_bytes")),
        using("flows p2p", f"""SELECT date, throughput_type, bytes, round(avg(bytes) OVER (PARTITION BY throughput_type ORDER BY date
            RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS mean_bytes, place
          FROM (SELECT d.date, k.throughput_type, coalesce(x.bytes, 0) AS bytes, CAST(k.place AS INTEGER) AS place FROM ({_DAYS}) d
            CROSS JOIN (VALUES ('Down', 1), ('Up', 2), ('Local', 3)) k(throughput_type, place)
            LEFT JOIN dirs x ON x.date = d.date AND x.throughput_type = k.throughput_type)""", dirs=_DIRS),
    ),
    "weekly_local_traffic": (
        query(lambda i: t.weekly_local_traffic(i.flows, i.p2p)),
        using("flows p2p", f"""SELECT {week_sunday('CAST(start_ts AS DATE)')} AS week, direction, CAST(sum(b) AS BIGINT) AS bytes FROM (
          SELECT start_ts, 'external_up' AS direction, CASE WHEN local THEN 0 ELSE bytes_up END AS b FROM flows
          UNION ALL SELECT start_ts, 'external_down', CASE WHEN local THEN 0 ELSE bytes_down END FROM flows
          UNION ALL SELECT start_ts, 'Upload to Local Server', CASE WHEN local THEN bytes_up ELSE 0 END FROM flows
          UNION ALL SELECT start_ts, 'Download from Local Server', CASE WHEN local THEN bytes_down ELSE 0 END FROM flows
          UNION ALL SELECT start_ts, 'Peer to Peer', 0 FROM flows
          UNION ALL SELECT start_ts, 'Peer to Peer', bytes_a_to_b + bytes_b_to_a FROM p2p) GROUP BY 1, 2"""),
    ),
    "anomaly_flows_by_day": (
        query(lambda i: t.anomaly_flows_by_day(i.nouser, i.window)),
        using("nouser", f"""SELECT d.date, k.kind, CAST(coalesce(sum(x.b), 0) AS BIGINT) AS bytes_total FROM ({_DAYS}) d
          CROSS JOIN (SELECT DISTINCT kind FROM kinds) k LEFT JOIN kinds x ON x.date = d.date AND x.kind = k.kind GROUP BY 1, 2""",
              kinds=f"SELECT CAST(start_ts AS DATE) AS date, {_ANOMALY} AS kind, bytes_a_to_b + bytes_b_to_a AS b FROM nouser"),
    ),
    "peer_pairs_by_day": (query(lambda i: t.peer_pairs_by_day(i.p2p)), using("p2p", _PAIRS)),
    "peer_pairs": (
        query(lambda i: t.peer_pairs(t.peer_pairs_by_day(i.p2p))),
        using("p2p", f"""SELECT key_x, key_y, CAST(sum(bytes_total) AS BIGINT) AS bytes_total, count(*) AS days,
          CAST(sum(bytes_total) AS DOUBLE) / count(*) AS average_bytes FROM ({_PAIRS}) GROUP BY 1, 2"""),
    ),
    "call_peers": (
        query(lambda i: t.call_peers(_calls(i))),
        using("flows", """SELECT dest_ip, fqdn, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down,
          CAST(sum(bytes_up + bytes_down) AS BIGINT) AS total_bytes, count(DISTINCT user_id) AS user_count
          FROM flows WHERE category IN ('signup', 'error') GROUP BY 1, 2"""),
    ),
    "host_accesses": (
        query(lambda i: t.host_accesses(_hosts(i), exclude=["example.org"])),
        _PER_HOST.format("regexp_extract(url, 'https?://([^/]+)', 1) NOT IN ('example.org')"),
    ),
    "host_accesses_containing": (
        query(lambda i: t.host_accesses(_hosts(i), containing="com")),
        _PER_HOST.format("contains(regexp_extract(url, 'https?://([^/]+)', 1), 'com')"),
    ),
}
