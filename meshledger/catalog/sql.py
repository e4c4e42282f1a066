"""DuckDB text of the derived views, and helpers to build a statement from them."""

from __future__ import annotations

IP = """(['157.240.25.9','74.125.24.1','10.10.20.1','192.168.151.1','169.136.65.204',
  '8.37.232.4','23.248.162.7','203.0.113.5'])[event_id % 8 + 1]"""
FQDN = """(['www.google.co.id','yt3.ggpht.com','lh3.ggpht.com','video.xx.fbcdn.net',
  'edge-mqtt.facebook.com','mmg.whatsapp.net','v16.tiktokcdn.com','example.org',
  'stun.example.org',''])[event_id % 10 + 1]"""
PORT = "([443,80,53,3478,123,22,9999])[event_id % 7 + 1]"
PROTOCOL = "CASE WHEN event_id % 7 IN (2,3,4) OR event_id % 21 = 0 THEN 17 ELSE 6 END"
END = "ts + to_seconds(event_id * 7919 % 600)"
IN_OUTAGE = "CAST({0} AS DATE) >= DATE '2024-01-10' AND CAST({0} AS DATE) < DATE '2024-01-15'"

MOVED = "CASE WHEN " + IN_OUTAGE.format("start_ts") + " THEN {0} + INTERVAL 5 DAY ELSE {0} END"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE)"


def day(ts: str) -> str:
    return f"CAST({ts} AS DATE)"


def week_monday(d: str) -> str:
    return f"CAST(date_trunc('week', {d} - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)"


def week_sunday(d: str) -> str:
    return f"CAST(date_trunc('week', {d}) + INTERVAL 6 DAY AS DATE)"


VIEWS = {
    "flows": f"""SELECT event_id, ts AS start_ts, {END} AS end_ts, user_id, {IP} AS dest_ip,
  CAST(40000 + event_id % 5 AS INTEGER) AS user_port, CAST({PORT} AS INTEGER) AS dest_port,
  CAST({PROTOCOL} AS INTEGER) AS protocol, event_id * 31 % 100000 AS bytes_up,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) END AS bytes_down,
  {FQDN} AS fqdn, event_type AS category,
  CASE WHEN event_id % 2500 = 0 THEN 'rare' ELSE concat('org', CAST(event_id % 13 AS VARCHAR)) END AS org,
  event_id % 8 IN (2,3) AS local FROM events""",
    "p2p": f"""SELECT event_id, ts AS start_ts, {END} AS end_ts, user_id AS user_a,
  (user_id * 7 + 3) % 15 AS user_b, event_id * 31 % 1000 AS bytes_a_to_b,
  event_id % 3 * 100 AS bytes_b_to_a, 17 AS protocol FROM events WHERE event_type = 'signup'""",
    "nouser": f"""SELECT event_id, ts AS start_ts, {END} AS end_ts, {IP} AS ip_a,
  '192.168.151.1' AS ip_b, CASE WHEN event_id % 2 = 0 THEN 1900 ELSE 80 END AS b_port,
  event_id * 31 % 1000 AS bytes_a_to_b, event_id % 3 * 100 AS bytes_b_to_a, 17 AS protocol
  FROM events WHERE event_type = 'error'""",
    "tx": """SELECT event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'user_transfer'
    WHEN 'error' THEN 'admin_transfer' ELSE 'admin_topup' END AS kind,
  CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS user_id,
  CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN user_id
    ELSE (user_id * 7 + 3) % 15 END AS dest_user_id,
  CASE WHEN event_type = 'purchase' THEN (1 + event_id % 4) * 10000000 ELSE NULL END AS amount_bytes,
  CAST(floor(value * 100) AS BIGINT) AS amount_idr FROM events WHERE event_type <> 'view'""",
    "dns": f"""SELECT event_id, ts - INTERVAL 1800 SECOND AS ts, CASE WHEN user_id % 7 = 3 THEN user_id + 1 ELSE user_id END AS user_id,
  CASE WHEN event_id % 3 = 0 AND event_id % 10 <> 9 THEN {IP} ELSE '203.0.113.200' END AS ip_address,
  {FQDN} AS domain_name FROM events""",
    # All flows, those of the outage moved behind it, which leaves gaps of whole days.
    "served": f"SELECT * REPLACE ({MOVED.format('start_ts')} AS start_ts, {MOVED.format('end_ts')} AS end_ts) FROM flows",
    "served_p2p": f"SELECT * REPLACE ({MOVED.format('start_ts')} AS start_ts, {MOVED.format('end_ts')} AS end_ts) FROM p2p",
    "gaps": """SELECT lag(end_ts) OVER (ORDER BY start_ts, end_ts, event_id) AS gap_start, start_ts AS gap_end
  FROM (SELECT event_id, start_ts, end_ts FROM served UNION ALL SELECT event_id, start_ts, end_ts FROM served_p2p)
  QUALIFY start_ts > lag(end_ts) OVER (ORDER BY start_ts, end_ts, event_id)""",
    "gap_days": f"""SELECT CAST(gap_start AS DATE) + CAST(n AS INTEGER) AS day FROM gaps,
  LATERAL (SELECT unnest(range(1, CAST(floor({secs('gap_start', 'gap_end')} / 86400) AS BIGINT) + 1)) AS n)
  WHERE {secs('gap_start', 'gap_end')} > 86400""",
    "spans": f"""SELECT f.user_id, days_online,
  least(first_flow, first_purchase) AS earliest,
  CASE WHEN first_flow < first_purchase THEN 'Flow' ELSE 'Purchase' END AS earliest_kind,
  greatest(last_flow_end, last_purchase) AS latest,
  CASE WHEN last_flow_end > last_purchase THEN 'Flow' ELSE 'Purchase' END AS latest_kind
  FROM (SELECT user_id, min(start_ts) AS first_flow, arg_max(end_ts, start_ts) AS last_flow_end,
          count(DISTINCT CAST(start_ts AS DATE)) AS days_online FROM served GROUP BY user_id) f
  JOIN (SELECT user_id, min(ts) AS first_purchase, max(ts) AS last_purchase FROM tx
        WHERE kind = 'purchase' GROUP BY user_id) p ON f.user_id = p.user_id""",
    "activity": f"""SELECT *, days_online + outage_impact_days AS optimistic_days_online FROM (
  SELECT *, {secs('earliest', "TIMESTAMP '2024-02-01'")} / 86400 AS days_since_first_active,
    {secs('earliest', 'latest')} / 86400 AS days_active,
    CAST((SELECT count(DISTINCT day) FROM gap_days WHERE CAST(day AS TIMESTAMP) >= earliest
      AND CAST(day AS TIMESTAMP) <= latest) AS INTEGER) AS outage_impact_days FROM spans)""",
    "users7": "SELECT * FROM activity WHERE days_since_first_active >= 7 AND days_active >= 1",
    "users7s": "SELECT * FROM activity WHERE days_since_first_active > 7 AND days_active > 1",
    "daily": """SELECT CAST(start_ts AS DATE) AS date, category, org, sum(bytes_up) AS bytes_up,
  sum(bytes_down) AS bytes_down FROM flows GROUP BY ALL""",
    "hourly": """SELECT date, hour, category, CAST(sum(b) AS BIGINT) AS bytes_total FROM (
  SELECT CAST(start_ts AS DATE) AS date, CAST(hour(start_ts) AS INTEGER) AS hour, category, bytes_up + bytes_down AS b FROM flows
  UNION ALL SELECT CAST(start_ts AS DATE), CAST(hour(start_ts) AS INTEGER), 'Peer to Peer', bytes_a_to_b + bytes_b_to_a FROM p2p)
  GROUP BY ALL""",
    "purchases": "SELECT * FROM tx WHERE kind = 'purchase'",
    # Sessions with a gap of one day, the setting at which the test purchases merge.
    "sessions": f"""SELECT min(ts) AS ts, 'purchase' AS kind, user_id, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes,
  CAST(sum(amount_idr) AS BIGINT) AS amount_idr,
  {secs("lag(min(ts)) OVER (PARTITION BY user_id ORDER BY min(ts))", "min(ts)")} AS time_since_last_purchase
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 86400 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT *, {secs("lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)", "ts")} AS gap FROM purchases))
  GROUP BY user_id, s""",
    "user_days": """SELECT CAST(start_ts AS DATE) AS date, user_id, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS bytes_total
  FROM served GROUP BY ALL""",
    "grouped": """SELECT user_id, category, org, sum(bytes_up) AS bytes_up, sum(bytes_down) AS bytes_down
  FROM served GROUP BY ALL""",
    "entries": """SELECT ts, kind, event_id AS entry_id, 0 AS side, dest_user_id AS user_id, amount_idr FROM tx
  WHERE kind <> 'purchase' AND dest_user_id IS NOT NULL
  UNION ALL SELECT ts, kind, event_id, 1, user_id, -amount_idr FROM tx
  WHERE kind <> 'admin_topup' AND user_id IS NOT NULL""",
    "ledger": """SELECT *, CAST(sum(amount_idr) OVER (PARTITION BY user_id ORDER BY ts, entry_id, side
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM entries""",
    "offsets": "SELECT user_id, -min(balance) AS off FROM ledger WHERE balance < 0 GROUP BY user_id",
    "lifted": """SELECT ts, l.kind, entry_id, side, l.user_id, amount_idr,
  balance + coalesce(off, 0) AS balance, off IS NOT NULL AS corrected
  FROM ledger l LEFT JOIN offsets o ON l.user_id = o.user_id
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
    "rates": """SELECT t.user_id, amount_idr, amount_bytes, amount_bytes / 1e9 AS amount_gb,
  amount_idr / 14150.0::DOUBLE AS amount_usd, days_active, amount_idr / 14150.0::DOUBLE / days_active AS usd_per_day
  FROM (SELECT user_id, CAST(sum(amount_idr) AS BIGINT) AS amount_idr, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes
        FROM purchases GROUP BY user_id) t JOIN users7 u ON t.user_id = u.user_id""",
    "first_buys": """SELECT min(ts) AS start, 'purchase' AS action, user_id,
  arg_min(amount_bytes, ts) AS amount, arg_min(amount_idr, ts) AS price FROM purchases GROUP BY user_id""",
    "registered": """SELECT day, CAST(sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS registered FROM (
  SELECT CAST(s AS DATE) AS day, count(*) AS n FROM (
    SELECT user_id, min(s) AS s FROM (SELECT user_id, start AS s FROM first_buys
      UNION ALL SELECT user_id, TIMESTAMP '2024-01-01' FROM offsets) GROUP BY user_id) GROUP BY 1)""",
}

# Which views a view is built from.
_NEEDS = {
    "served": ["flows"],
    "served_p2p": ["p2p"],
    "gaps": ["served", "served_p2p"],
    "gap_days": ["gaps"],
    "spans": ["served", "tx"],
    "activity": ["spans", "gap_days"],
    "users7": ["activity"],
    "users7s": ["activity"],
    "daily": ["flows"],
    "hourly": ["flows", "p2p"],
    "purchases": ["tx"],
    "sessions": ["purchases"],
    "user_days": ["served"],
    "grouped": ["served"],
    "entries": ["tx"],
    "ledger": ["entries"],
    "offsets": ["ledger"],
    "lifted": ["ledger", "offsets"],
    "rates": ["purchases", "users7"],
    "first_buys": ["purchases"],
    "registered": ["first_buys", "offsets"],
}


def using(views: str, body: str, **extra: str) -> str:
    """``body`` with the named views, and those they need, in front; ``extra`` views come last."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({t})" for n, t in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# Slope, p-value and R-squared of y on x in {0}; the p-value integrates Student's density from t on.
SIGNIFICANCE = """SELECT round(m, 6) AS slope, round(CASE WHEN r >= 1 THEN 0 ELSE (
    SELECT 2 * sum(exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(pi() * f)
      - (f + 1) / 2 * ln(1 + (t + u / (1 - u)) * (t + u / (1 - u)) / f)) / ((1 - u) * (1 - u))) / 20000
    FROM (SELECT (i + 0.5) / 20000.0::DOUBLE AS u FROM range(0, 20000) s(i))) END, 6) AS p_value, round(r, 6) AS r2
  FROM (SELECT m, r, f, sqrt(r * f / nullif(1 - r, 0)) AS t FROM (
    SELECT regr_slope(y, x) AS m, regr_r2(y, x) AS r, regr_count(y, x) - 2.0::DOUBLE AS f FROM ({0})))"""


def cdf_sql(source: str, value: str) -> str:
    """Distribution of ``value`` over the rows of ``source``."""
    return f"""SELECT v AS value, n AS base_count, n / t::DOUBLE AS pdf,
  CAST(sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) / t::DOUBLE AS cdf
  FROM (SELECT v, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS t
        FROM (SELECT {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY v)"""
