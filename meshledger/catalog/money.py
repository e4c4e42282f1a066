"""Purchase, transfer and revenue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.base import ROWS, Inputs, query, rounded
from meshledger.catalog.sql import cdf_sql, using
from meshledger.operators import activity as act
from meshledger.operators import sessions as ses
from meshledger.plans import money as m


_RANKED = """SELECT date, amount_idr, r FROM (SELECT CAST(ts AS DATE) AS date, user_id, CAST(sum(amount_idr) AS BIGINT) AS amount_idr
  FROM purchases GROUP BY 1, 2) JOIN (SELECT user_id, rank() OVER (ORDER BY sum(amount_idr) DESC) AS r FROM purchases GROUP BY 1) USING (user_id)"""
_COSTS = """SELECT date, sum(usd) AS usd FROM (VALUES (DATE '2024-01-01', 9334.0::DOUBLE), (DATE '2024-01-15', 1000.0::DOUBLE),
  (DATE '2024-01-31', 300.0::DOUBLE), (DATE '2024-01-31', 1300000 / 14150.0::DOUBLE)) c(date, usd) GROUP BY 1"""
_SERIES = """SELECT date, kind, sum(amount_idr) / 14150.0::DOUBLE AS usd, any_value(place) AS place FROM ranked
  JOIN (VALUES ('Total Revenue', 0, 2), ('Revenue Sans Top 5', 5, 3), ('Revenue Sans Top 10', 10, 4),
    ('Revenue Sans Top 15', 15, 5), ('Revenue Sans Top 20', 20, 6)) k(kind, n, place) ON r > n GROUP BY 1, 2
  UNION ALL SELECT date, 'Costs', usd, 1 FROM costs"""
_DAILY_MB = "SELECT user_id, CAST(ts AS DATE) AS date, sum(amount_bytes) / 1e6 AS mb FROM purchases GROUP BY 1, 2"

QUERIES = {
    "package_sales": (
        query(lambda i: m.package_sales(i.tx)),
        using("purchases", """SELECT amount_bytes, count(*) AS count, amount_bytes / 1e6 AS amount_mb,
          amount_bytes * count(*) / 1e9 AS total_gb FROM purchases GROUP BY 1"""),
    ),
    "purchase_totals": (
        query(lambda i: m.purchase_totals(i.tx)),
        using("purchases", """SELECT user_id, CAST(sum(amount_idr) AS BIGINT) AS amount_idr, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes,
          sum(amount_bytes) / 1e9 AS amount_gb, sum(amount_idr) / 14150.0::DOUBLE AS amount_usd FROM purchases GROUP BY 1"""),
    ),
    "purchase_total_distribution": (
        query(lambda i: m.purchase_total_cdf(i.tx, i.activity)), using("rates", cdf_sql("rates", "amount_usd")),
    ),
    "spend_rate_per_user": (
        query(lambda i: m.spend_rate(i.tx, i.activity)),
        using("rates", "SELECT user_id, amount_idr, amount_bytes, amount_gb, amount_usd, days_active, usd_per_day FROM rates"),
    ),
    "spend_rate_distribution": (
        query(lambda i: m.spend_rate_cdf(i.tx, i.activity)), using("rates", cdf_sql("rates", "usd_per_day")),
    ),
    "spend_inequality": (
        query(lambda i: rounded(m.spend_inequality(i.tx, i.activity), 9, "mean", "median", "max_over_mean", "max_over_median")),
        using("rates", """SELECT min(usd_per_day) AS min, max(usd_per_day) AS max, round(avg(usd_per_day), 9) AS mean,
          round(median(usd_per_day), 9) AS median, round(max(usd_per_day) / avg(usd_per_day), 9) AS max_over_mean,
          round(max(usd_per_day) / median(usd_per_day), 9) AS max_over_median FROM rates"""),
    ),
    "expenses": (
        query(lambda i: i.tx.groupBy(m.day("ts").alias("date")).agg(F.sum("amount_idr").alias("idr")).join(
            rounded(m.expenses(i.spark, i.window), 6, "amount_usd"), "date", "full")),
        using("tx", """SELECT coalesce(a.date, c.date) AS date, idr, round(usd, 6) AS amount_usd FROM (
          SELECT CAST(ts AS DATE) AS date, CAST(sum(amount_idr) AS BIGINT) AS idr FROM tx GROUP BY 1) a FULL JOIN (VALUES (DATE '2024-01-01', 9334.0::DOUBLE),
          (DATE '2024-01-15', 1000.0::DOUBLE), (DATE '2024-01-31', 300.0::DOUBLE), (DATE '2024-01-31', 1300000 / 14150.0::DOUBLE)) c(date, usd) ON a.date = c.date"""),
    ),
    "revenue_series": (
        query(lambda i: rounded(m.revenue_series(i.tx, i.window), 6, "amount_usd", "amount_cum")),
        using("purchases", """SELECT date, kind, round(usd, 6) AS amount_usd,
          round(sum(usd) OVER (PARTITION BY kind ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS amount_cum, CAST(place AS INTEGER) AS place FROM series""",
              ranked=_RANKED, costs=_COSTS, series=_SERIES),
    ),
    "arpu": (
        query(lambda i: m.arpu(i.tx, i.window)),
        using("purchases", """SELECT users, revenue_idr, revenue_idr / CAST(users AS DOUBLE) AS arpu_idr, revenue_idr / CAST(users AS DOUBLE) / 12 AS arpu_twelfth_idr,
          revenue_idr / CAST(users AS DOUBLE) / 31 AS arpu_day_idr FROM (
          SELECT count(DISTINCT user_id) AS users, CAST(sum(amount_idr) AS BIGINT) AS revenue_idr FROM purchases)"""),
    ),
    "purchases_per_user": (
        query(lambda i: m.purchases_per_user(i.tx)),
        using("purchases", "SELECT user_id, count(*) AS purchase_count FROM purchases GROUP BY 1"),
    ),
    "transfers_per_user": (
        query(lambda i: m.transfers_per_user(i.tx)),
        using("tx", """SELECT coalesce(a.user_id, b.user_id) AS user_id, unnest(['transfer_src', 'transfer_dst']) AS direction,
          unnest([a.n, b.n]) AS count, unnest([a.s, b.s]) AS idr, unnest([a.s, b.s]) / 14150.0::DOUBLE AS usd FROM (
          SELECT user_id, count(*) AS n, CAST(sum(amount_idr) AS BIGINT) AS s FROM tx WHERE kind = 'user_transfer' GROUP BY 1) a FULL JOIN (
          SELECT dest_user_id AS user_id, count(*) AS n, CAST(sum(amount_idr) AS BIGINT) AS s FROM tx WHERE kind = 'user_transfer' GROUP BY 1) b
          ON a.user_id = b.user_id"""),
    ),
    "cumulative_topups": (
        query(lambda i: m.cumulative_topups(i.tx)),
        using("tx", """SELECT date, idr, c AS idr_cumulative, c / 14150.0::DOUBLE AS usd_cumulative FROM (
          SELECT date, idr, CAST(sum(idr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM (
            SELECT CAST(ts AS DATE) AS date, CAST(sum(amount_idr) AS BIGINT) AS idr FROM tx WHERE kind = 'admin_topup' GROUP BY 1))"""),
    ),
    "daily_purchase_mb": (
        query(lambda i: m.daily_purchase_mb(i.tx)),
        using("purchases", """SELECT CAST(ts AS DATE) AS date, dayname(CAST(ts AS DATE)) AS weekday, sum(amount_bytes) / 1e6 AS mb FROM purchases GROUP BY 1, 2"""),
    ),
    "purchase_variation": (
        query(lambda i: rounded(m.purchase_variation(i.tx), 6, "mean", "std", "c_of_v")),
        using("purchases", f"""SELECT user_id, round(avg(mb), 6) AS mean, round(stddev_samp(mb), 6) AS std, count(*) AS days,
          round(stddev_samp(mb) / avg(mb), 6) AS c_of_v FROM ({_DAILY_MB}) GROUP BY 1 HAVING count(*) > 1"""),
    ),
    "packages_per_user": (
        query(lambda i: m.packages_per_user(i.tx)),
        using("purchases", """SELECT user_id, amount_bytes, count(*) AS count, amount_bytes / 1e6 AS amount_mb,
          count(*) * amount_bytes AS bytes_per_package FROM purchases GROUP BY 1, 2"""),
    ),
    "transfer_histogram": (
        query(lambda i: m.transfer_histogram(i.tx, exclude_dest=3)),
        using("tx", """SELECT amount_idr, count(*) AS count FROM tx WHERE kind = 'user_transfer' AND dest_user_id <> 3 GROUP BY 1"""),
    ),
    "transactions_per_user": (
        query(lambda i: m.transactions_per_user(i.tx)),
        using("tx", "SELECT coalesce(user_id, dest_user_id) AS user_id, count(*) AS transactions FROM tx GROUP BY 1"),
    ),
    "purchases_per_price": (
        query(lambda i: m.purchases_per_price(i.tx)),
        using("purchases", "SELECT amount_idr, count(*) AS transactions FROM purchases GROUP BY 1"),
    ),
    "first_purchases": (
        query(lambda i: act.first_purchases(i.tx, "event_id")), using("first_buys", "SELECT * FROM first_buys"),
    ),
    "purchase_sessions": (query(lambda i: i.sessions), using("sessions", "SELECT * FROM sessions")),
    "purchase_sessions_one_minute": (
        query(lambda i: ses.consolidate_purchases(i.tx, tie=["event_id"], rows_per_bucket=ROWS).select("ts", "user_id", "amount_bytes", "amount_idr")),
        using("purchases", """SELECT min(ts) AS ts, user_id, CAST(sum(amount_bytes) AS BIGINT) AS amount_bytes, CAST(sum(amount_idr) AS BIGINT) AS amount_idr
          FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
            FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM purchases)) GROUP BY user_id, s"""),
    ),
    "session_amounts": (
        query(lambda i: m.session_amounts(i.sessions)),
        using("sessions", "SELECT amount_bytes, count(*) AS count, amount_bytes / 1e6 AS amount_mb FROM sessions GROUP BY 1"),
    ),
    "purchase_timing_per_user": (
        query(lambda i: rounded(ses.purchase_timing(i.sessions), 3, "mean", "q90", "q99")),
        using("sessions", """SELECT user_id, round(avg(time_since_last_purchase), 3) AS mean, round(quantile_cont(time_since_last_purchase, 0.9), 3) AS q90,
          round(quantile_cont(time_since_last_purchase, 0.99), 3) AS q99 FROM sessions WHERE time_since_last_purchase IS NOT NULL GROUP BY 1"""),
    ),
    "purchase_timing_distributions": (
        query(lambda i: rounded(ses.purchase_timing_cdf(i.sessions), 6, "days", "pdf", "cdf")),
        using("sessions", """SELECT type, round(v / 86400, 6) AS days, n AS base_count, round(n / CAST(t AS DOUBLE), 6) AS pdf,
          round(sum(n) OVER (PARTITION BY type ORDER BY v ROWS UNBOUNDED PRECEDING) / CAST(t AS DOUBLE), 6) AS cdf FROM (
            SELECT type, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY type) AS t FROM (
              SELECT unnest(['User''s Mean', 'User''s 90% Quantile', 'User''s 99% Quantile']) AS type, unnest([m, a, b]) AS v FROM (
                SELECT avg(time_since_last_purchase) AS m, quantile_cont(time_since_last_purchase, 0.9) AS a, quantile_cont(time_since_last_purchase, 0.99) AS b
                FROM sessions WHERE time_since_last_purchase IS NOT NULL GROUP BY user_id)) GROUP BY 1, 2)"""),
    ),
}
