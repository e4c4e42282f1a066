"""DNS join and ledgers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meshledger.catalog.base import ROWS, Inputs, query
from meshledger.catalog.sql import cdf_sql, secs, using
from meshledger.operators import calendar as cal
from meshledger.operators import dns as d
from meshledger.operators import ledger as g
from meshledger.operators.stats import cdf
from meshledger.study import StudyWindow

_EARLY = StudyWindow(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4))
_REVERSE = ("74.125.24.1", "23.248.162.7", "10.10.20.1")

_NAMED = """SELECT f.event_id, any_value(f.user_id) AS user_id, any_value(f.dest_ip) AS dest_ip,
  arg_max(d.domain_name, (d.ts, d.domain_name)) AS name, count(DISTINCT d.domain_name) AS n
  FROM flows f LEFT JOIN dns d ON d.user_id = f.user_id AND d.ip_address = f.dest_ip AND d.ts < f.start_ts
  WHERE f.user_id IN (SELECT user_id FROM dns) GROUP BY f.event_id"""
_USAGE = """SELECT start_ts AS ts, end_ts, user_id, 'ext' AS type, bytes_up, bytes_down, 0 AS bytes_purchased, event_id AS row_id
  FROM served WHERE NOT local AND user_id IN (SELECT user_id FROM users7)
  UNION ALL SELECT ts, ts, user_id, 'purchase', 0, 0, amount_bytes, 0 FROM sessions WHERE user_id IN (SELECT user_id FROM users7)"""
_RANGES = """SELECT p.user_id, max(e.end_ts) AS range_start, p.ts AS range_end FROM usage p JOIN usage e
  ON e.user_id = p.user_id AND e.type = 'ext' AND e.bytes_down > 0 AND e.end_ts <= p.ts
  WHERE p.type = 'purchase' GROUP BY p.user_id, p.ts HAVING max(e.end_ts) < p.ts"""
_COUNTED = """SELECT r.user_id, r.range_start, r.range_end, count(f.ts) AS overlaps FROM ranges r LEFT JOIN usage f
  ON f.user_id = r.user_id AND f.type = 'ext' AND f.bytes_down <= 0 AND f.ts <= r.range_end AND f.end_ts >= r.range_start
  GROUP BY 1, 2, 3"""
_HISTORY = """SELECT *, CASE type WHEN 'init' THEN 0 WHEN 'tare' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS turn,
  coalesce(end_ts, ts) AS sort_end, CAST(bytes_purchased - bytes_up - bytes_down AS BIGINT) AS net FROM (
  SELECT * FROM usage
  UNION ALL SELECT range_start, range_end, user_id, 'tare', 0, 0, 0, 0 FROM counted c WHERE c.overlaps >= 1
  UNION ALL SELECT min(ts) - INTERVAL 1 SECOND, NULL, user_id, 'init', 0, 0, 0, 0 FROM usage GROUP BY user_id)"""
_ORDERED = "PARTITION BY user_id ORDER BY ts, turn, sort_end, row_id"
_BALANCED = f"""SELECT *, greatest(0, -min(CASE WHEN type <> 'init' THEN raw END) OVER (PARTITION BY user_id)) AS off,
  min(CASE WHEN type = 'tare' OR (type = 'ext' AND bytes_down > 0) THEN raw END)
    OVER ({_ORDERED} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM (
  SELECT *, sum(net) OVER ({_ORDERED} ROWS UNBOUNDED PRECEDING) AS raw, row_number() OVER ({_ORDERED}) - 1 AS i FROM history)"""
_TARED = f"""SELECT *, CASE type WHEN 'init' THEN off WHEN 'tare' THEN coalesce(before_, 0) - (low + off) ELSE net END AS net2 FROM (
  SELECT *, lag(low + off) OVER (PARTITION BY user_id, type = 'tare' ORDER BY ts, turn, sort_end, row_id) AS before_ FROM balanced)"""
_SHARES = f"""SELECT s.user_id, s.at_zero AS days_at_zero, days_active, corrected, days_since_first_active,
  s.at_zero / days_active AS fraction_at_zero, 1.0::DOUBLE - s.at_zero / days_active AS fraction_nonzero FROM (
    SELECT user_id, coalesce(sum(CASE WHEN balance <= 0 THEN us END), 0) / 1000000.0::DOUBLE / 86400 AS at_zero, bool_or(corrected) AS corrected FROM (
      SELECT *, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, entry_id, side)) - epoch_us(ts), 0) AS us FROM lifted) GROUP BY 1) s
  JOIN users7 u ON s.user_id = u.user_id"""


def _reverse(i: Inputs):
    seen = i.flows.select(F.col("dest_ip").alias("ip")).where(F.col("dest_ip").isin(*_REVERSE)).distinct()
    return seen.withColumn("host", F.concat(F.lit("host-"), "ip"))


def _plain(i: Inputs):
    return i.flows.select("event_id", "user_id", "start_ts", "dest_ip")


def _shares(i: Inputs):
    return g.credit_time_share(i.corrected[0], i.activity)


def _overlaps(i: Inputs):
    return g.likely_zero_ranges(i.usage, 0, ROWS)


QUERIES = {
    "flows_with_domain": (
        query(lambda i: d.attach_fqdn(_plain(i), i.dns, tie="event_id", rows_per_bucket=ROWS).drop("start_ts")),
        using("flows dns", f"""SELECT event_id, user_id, dest_ip, coalesce(name, '') AS fqdn, CAST(n AS INTEGER) AS ambiguous_fqdn_count,
          CASE WHEN name IS NULL THEN 'none' ELSE 'user_dns_log' END AS fqdn_source FROM ({_NAMED})"""),
    ),
    "flows_with_domain_or_reverse": (
        query(lambda i: d.attach_fqdn(_plain(i), i.dns, _reverse(i), tie="event_id", rows_per_bucket=ROWS).drop("start_ts")),
        using("flows dns", f"""SELECT event_id, user_id, dest_ip, CASE WHEN name IS NOT NULL THEN name WHEN dest_ip IN ('74.125.24.1', '23.248.162.7')
            THEN concat('host-', dest_ip) ELSE '' END AS fqdn,
          CAST(CASE WHEN name IS NOT NULL THEN n WHEN dest_ip IN ('74.125.24.1', '23.248.162.7') THEN 1 ELSE 0 END AS INTEGER) AS ambiguous_fqdn_count,
          CASE WHEN name IS NOT NULL THEN 'user_dns_log' WHEN dest_ip IN ('74.125.24.1', '23.248.162.7') THEN 'reverse_dns' ELSE 'none' END AS fqdn_source
          FROM ({_NAMED})"""),
    ),
    "users_without_dns": (
        query(lambda i: d.users_without_dns(i.flows, cal.trim(i.dns, "ts", _EARLY))),
        using("flows dns", """SELECT DISTINCT user_id FROM flows WHERE user_id NOT IN
          (SELECT user_id FROM dns WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-04')"""),
    ),
    "currency_ledger": (query(lambda i: i.ledger), using("ledger", "SELECT ts, kind, entry_id, side, user_id, amount_idr, balance FROM ledger")),
    "currency_ledger_corrected": (query(lambda i: i.corrected[0].drop("next_ts")), using("lifted", "SELECT * FROM lifted")),
    "early_registered_users": (query(lambda i: i.corrected[1]), using("offsets", "SELECT user_id FROM offsets")),
    "credit_time_share": (query(_shares), using("lifted users7", _SHARES)),
    "credit_time_distribution": (
        query(lambda i: cdf(_shares(i), "fraction_nonzero")), using("lifted users7", cdf_sql("shares", "fraction_nonzero"), shares=_SHARES),
    ),
    "credit_time_summary": (
        query(lambda i: g.credit_summary(_shares(i))),
        using("lifted users7", """SELECT count(*) AS users, count(*) FILTER (days_at_zero = 0) AS never_zero, count(*) FILTER (fraction_nonzero > 0.95) AS mostly_credit,
          count(*) FILTER (days_active > 30) AS active_over_30_days, count(*) FILTER (fraction_nonzero > 0.95 AND days_active > 30) AS mostly_credit_over_30_days FROM shares""",
              shares=_SHARES),
    ),
    "usage_events": (query(lambda i: i.usage), using("served sessions users7", "SELECT * FROM usage", usage=_USAGE)),
    "failed_flow_overlaps": (
        query(_overlaps), using("served sessions users7", "SELECT * FROM counted", usage=_USAGE, ranges=_RANGES, counted=_COUNTED),
    ),
    "data_balance": (
        query(lambda i: g.data_balance(i.usage, 1, ROWS)),
        using("served sessions users7", f"""SELECT ts, end_ts, user_id, type, CAST(bytes_up AS BIGINT) AS bytes_up, CAST(bytes_down AS BIGINT) AS bytes_down,
          CAST(bytes_purchased AS BIGINT) AS bytes_purchased, CAST(net2 AS BIGINT) AS net_bytes,
          CAST(greatest(0, sum(net2) OVER ({_ORDERED} ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS balance, i AS user_hist_i FROM tared""",
              usage=_USAGE, ranges=_RANGES, counted=_COUNTED, history=_HISTORY, balanced=_BALANCED, tared=_TARED),
    ),
    "hourly_data_ledger": (
        query(lambda i: g.hourly_ledger(i.flows, i.tx, rows_per_bucket=ROWS)),
        using("flows purchases", """SELECT user_id, ts, bytes, type, CAST(sum(bytes) OVER (PARTITION BY user_id ORDER BY ts, type, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
          FROM (SELECT user_id, CAST(date_trunc('hour', start_ts) AS TIMESTAMP) AS ts, CAST(-sum(bytes_up + bytes_down) AS BIGINT) AS bytes, 'spend' AS type, 0 AS e FROM flows GROUP BY 1, 2
            UNION ALL SELECT user_id, ts, amount_bytes, 'topup', event_id FROM purchases)"""),
    ),
}
