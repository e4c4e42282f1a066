"""Flow, DNS and transaction tables derived from the ``events`` test table.

The same derivation is written for DuckDB in ``catalog/sql.py``; together they let every
report be checked on equal rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshledger.functions.rules import DOMAIN_RULES, FACEBOOK_MARKS, GOOGLE_MARKS
from meshledger.study import StudyWindow

# Study period and outage that fit the events table.
TEST_WINDOW = StudyWindow(
    lo=dt.datetime(2024, 1, 1),
    hi=dt.datetime(2024, 2, 1),
    outage_lo=dt.datetime(2024, 1, 10),
    outage_hi=dt.datetime(2024, 1, 15),
)

_END = "timestampadd(SECOND, CAST(event_id * 7919 % 600 AS INT), ts)"
_IP = """element_at(array('157.240.25.9', '74.125.24.1', '10.10.20.1', '192.168.151.1',
  '169.136.65.204', '8.37.232.4', '23.248.162.7', '203.0.113.5'), CAST(event_id % 8 + 1 AS INT))"""
_FQDN = """element_at(array('www.google.co.id', 'yt3.ggpht.com', 'lh3.ggpht.com',
  'video.xx.fbcdn.net', 'edge-mqtt.facebook.com', 'mmg.whatsapp.net', 'v16.tiktokcdn.com',
  'example.org', 'stun.example.org', ''), CAST(event_id % 10 + 1 AS INT))"""
_PORT = "element_at(array(443, 80, 53, 3478, 123, 22, 9999), CAST(event_id % 7 + 1 AS INT))"
_PROTOCOL = "IF(event_id % 7 IN (2, 3, 4) OR event_id % 21 = 0, 17, 6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_of(table(spark, sf_dir, "events"))


def flows_of(events: DataFrame) -> DataFrame:
    """Flows from an events table or an events stream."""
    return events.selectExpr(
        "event_id",
        "ts AS start_ts",
        f"{_END} AS end_ts",
        "user_id",
        f"{_IP} AS dest_ip",
        "CAST(40000 + event_id % 5 AS INT) AS user_port",
        f"{_PORT} AS dest_port",
        f"{_PROTOCOL} AS protocol",
        "event_id * 31 % 100000 AS bytes_up",
        "IF(event_id % 4 = 0, 0L, CAST(floor(value * 1000) AS BIGINT)) AS bytes_down",
        f"{_FQDN} AS fqdn",
        "event_type AS category",
        "IF(event_id % 2500 = 0, 'rare', concat('org', CAST(event_id % 13 AS STRING))) AS org",
        "event_id % 8 IN (2, 3) AS local",
    )


def past_outage(df: DataFrame, window: StudyWindow = TEST_WINDOW) -> DataFrame:
    """All flows, those of the outage moved behind it: whole days without flows, and no flow lost."""
    start = F.col("start_ts").cast("date")
    moved = (start >= F.lit(window.outage_lo.date())) & (start < F.lit(window.outage_hi.date()))
    days = (window.outage_hi - window.outage_lo).days
    later = lambda c: F.when(moved, F.timestamp_add("DAY", F.lit(days), F.col(c))).otherwise(F.col(c))
    return df.withColumns({"start_ts": later("start_ts"), "end_ts": later("end_ts")})


def p2p_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr(
        "event_id",
        "ts AS start_ts",
        f"{_END} AS end_ts",
        "user_id AS user_a",
        "(user_id * 7 + 3) % 15 AS user_b",
        "event_id * 31 % 1000 AS bytes_a_to_b",
        "event_id % 3 * 100 AS bytes_b_to_a",
        "17 AS protocol",
    )


def nouser_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "event_id",
        "ts AS start_ts",
        f"{_END} AS end_ts",
        f"{_IP} AS ip_a",
        "'192.168.151.1' AS ip_b",
        "IF(event_id % 2 = 0, 1900, 80) AS b_port",
        "event_id * 31 % 1000 AS bytes_a_to_b",
        "event_id % 3 * 100 AS bytes_b_to_a",
        "17 AS protocol",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'view'").selectExpr(
        "event_id",
        "ts",
        """CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'user_transfer'
           WHEN 'error' THEN 'admin_transfer' ELSE 'admin_topup' END AS kind""",
        "IF(event_type = 'signup', NULL, user_id) AS user_id",
        """CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN user_id
           ELSE (user_id * 7 + 3) % 15 END AS dest_user_id""",
        "IF(event_type = 'purchase', (1 + event_id % 4) * 10000000, NULL) AS amount_bytes",
        "CAST(floor(value * 100) AS BIGINT) AS amount_idr",
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event. Some users have none, and many answers are for an address no flow goes to."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "timestampadd(SECOND, -1800, ts) AS ts",
        "IF(user_id % 7 = 3, user_id + 1, user_id) AS user_id",
        f"IF(event_id % 3 = 0 AND event_id % 10 <> 9, {_IP}, '203.0.113.200') AS ip_address",
        f"{_FQDN} AS domain_name",
    )


def raw_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flow records of every shape, some with contradictory address fields."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts AS start_time",
        f"{_END} AS end_time",
        "IF(event_id % 11 IN (0, 1, 2, 3, 7, 10), user_id, NULL) AS obfuscated_a",
        "IF(event_id % 11 IN (4, 5, 6, 7, 8), (user_id * 7 + 3) % 15, NULL) AS obfuscated_b",
        f"IF(event_id % 11 IN (4, 5, 6, 9, 10), {_IP}, NULL) AS address_a",
        f"IF(event_id % 11 IN (0, 1, 2, 3, 9, 8, 10), {_IP}, NULL) AS address_b",
        "CAST(40000 + event_id % 5 AS INT) AS port_a",
        f"{_PORT} AS port_b",
        "event_id * 31 % 100000 AS bytes_a_to_b",
        "CAST(floor(value * 1000) AS BIGINT) AS bytes_b_to_a",
        f"{_PROTOCOL} AS transport_protocol",
    )


def raw_dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw DNS records from both directions, with answer lists of unequal length."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "IF(event_id % 5 IN (0, 1, 2, 4), user_id, NULL) AS obfuscated_src",
        "IF(event_id % 5 = 3, user_id, NULL) AS obfuscated_dst",
        "IF(event_id % 5 IN (3, 4), '8.8.8.8', NULL) AS src_ip",
        "IF(event_id % 5 IN (0, 1), '1.1.1.1', NULL) AS dst_ip",
        "CAST(50000 + event_id % 5 AS INT) AS src_port",
        "53 AS dst_port",
        "17 AS protocol",
        "0 AS opcode",
        "CAST(event_id % 2 AS INT) AS resultcode",
        f"{_FQDN} AS host",
        f"""slice(array({_IP}, concat('10.0.0.', event_id % 250), '9.9.9.9'), 1,
            CAST(event_id % 4 AS INT)) AS response_addresses""",
        "slice(array(60, 300, 3600), 1, CAST(event_id % 3 + 1 AS INT)) AS response_ttls",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction log lines; some transfers have no amount or a fraction."""
    return table(spark, sf_dir, "events").where("event_type <> 'view'").selectExpr(
        """concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'),
             CASE event_type
               WHEN 'purchase' THEN concat(' PURCHASE |user ', user_id, '| ',
                 (1 + event_id % 4) * 10000000, ' ', CAST(floor(value * 100) AS BIGINT))
               WHEN 'click' THEN concat(' USERTRANSFER |user ', user_id, '| |user ',
                 (user_id * 7 + 3) % 15, '| ',
                 CASE event_id % 3 WHEN 0 THEN '||' WHEN 1 THEN concat(event_id % 1000, '.5')
                   ELSE CAST(event_id % 1000 AS STRING) END)
               WHEN 'error' THEN concat(' ADMINTRANSFER |user ', user_id, '| |user ',
                 (user_id * 7 + 3) % 15, '| ', CAST(floor(value * 100) AS BIGINT))
               ELSE concat(' TOPUP |user ', user_id, '| ', CAST(floor(value * 100) AS BIGINT))
             END) AS value"""
    )


def traceroute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traceroute text per web page: two traces of four hops to the page's host."""
    return table(spark, sf_dir, "pages").selectExpr(
        "concat('trace-', page_id, '.txt') AS file",
        """concat(
          'traceroute to ', regexp_extract(url, 'https?://([^/]+)', 1), ' (203.0.113.9), 30 hops max\n',
          ' 1  gw (10.0.0.1)  ', page_id % 7 + 1, '.500 ms  ', page_id % 5 + 1, '.250 ms  *\n',
          ' 2  * * *\n',
          'traceroute to b.', regexp_extract(url, 'https?://([^/]+)', 1), ' (203.0.113.9), 30 hops max\n',
          ' 1  gw (10.0.0.1)  0.000 ms  0.000 ms  0.000 ms\n',
          ' 2  far.example (10.9.', page_id % 250, '.1)  ', page_id % 90 + 10, '.125 ms  ', page_id % 80 + 10, '.375 ms  ', page_id % 70 + 10, '.500 ms\n') AS text""",
    )


def named_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain per event, walking through every substring of the domain rules and a set of
    Google and Facebook names."""
    names = sample_domains()
    listed = ", ".join(repr(name) for name in names)
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        f"element_at(array({listed}), CAST(event_id % {len(names)} + 1 AS INT)) AS fqdn",
    )


def sample_domains() -> list[str]:
    # Host prefixes that reach the sub-categories of the two big organisations.
    google = [
        "www.google.com", "id.google.co.id", "accounts.google.com", "clients4.google.com",
        "android.clients.google.com", "lh3.googleusercontent.com", "ytimg.googleusercontent.com",
        "connectivitycheck.gstatic.com", "t0.gstatic.com", "yt3.ggpht.com", "lh4.ggpht.com",
        "redirector.gvt1.com", "beacons.gcp.gvt2.com", "r3.googlevideo.com", "i.ytimg.com",
        "www.youtube.com", "ad.doubleclick.net", "pagead2.googlesyndication.com",
        "ssl.google-analytics.com", "adservice.google.co.id", "cdn.ampproject.org",
        "backup.googleapis.com", "photos.googleapis.com", "mail.google.com",
        "mtalk.google.com", "alt1-mtalk.google.com", "translate.google.com",
        "oddname.googleapis.com", "strange.1e100.net", "smtp.gmail.com",
    ]
    facebook = [
        "www.facebook.com", "m.facebook.com", "video.fcgk1.fbcdn.net", "static.xx.fbcdn.net",
        "scontent.xx.fbcdn.net", "graph.facebook.com", "b-api.facebook.com", "portal.fb.com",
        "connect.facebook.net", "graph.accountkit.com", "cdn.fbsbx.com", "edge-star.facebook.com",
        "edge-snaptu.facebook.com", "rupload.facebook.com", "an.facebook.com",
        "mqtt-mini.facebook.com", "edge-mqtt.facebook.com", "edge-turnservice.facebook.com",
        "whatsapp-cdn.fbcdn.net", "instagram.fcgk1.fbcdn.net", "odd.fbsbx.com",
    ]
    rules = []
    for _, _, marks in DOMAIN_RULES:
        for mark in marks:
            rules.append("a" + "x".join(mark) if isinstance(mark, tuple) else f"a.{mark}.b")
    others = [f"q.{m}" for m in (*GOOGLE_MARKS, *FACEBOOK_MARKS)] + ["", "example.org"]
    return google + facebook + rules + others


