"""User reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.base import Inputs, query, rounded
from meshledger.catalog.sql import SIGNIFICANCE, cdf_sql, using, week_monday
from meshledger.operators import activity as act
from meshledger.operators import sketches, stats
from meshledger.plans import users as u
from meshledger.session import cut_lineage

_RATIO = {
    "observed": "least(days_online, days_active) / days_active",
    "optimistic": "least(days_online, days_active) / nullif(days_active - outage_impact_days, 0)",
    "capped": "least(days_online, days_active - outage_impact_days) / nullif(days_active - outage_impact_days, 0)",
}
_PARTS = "SELECT user_id, {0}, sum(bytes_up + bytes_down) AS b FROM grouped GROUP BY ALL"
_TOTALS = """SELECT t.user_id, t, days_online, t / CAST(days_online AS DOUBLE) AS daily FROM (
  SELECT user_id, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS t FROM grouped GROUP BY 1) t JOIN users7s s ON t.user_id = s.user_id"""
_ORDER = """SELECT {0}, rank() OVER (ORDER BY sum(bytes_up + bytes_down) DESC) AS r FROM grouped GROUP BY 1"""
_SHARE = """SELECT p.user_id, p.{0}, CAST(p.b AS BIGINT) AS bytes_total, ur AS user_rank, o.r AS dimension_rank,
  CAST(p.b AS DOUBLE) / days_online AS bytes_avg_online_day, CAST(p.b AS DOUBLE) / t AS share
  FROM parts p JOIN (SELECT *, rank() OVER (ORDER BY daily) AS ur FROM totals) x ON p.user_id = x.user_id JOIN ord o ON p.{0} = o.{0}"""
_BINS = """SELECT user_id, t, days_online, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor(10 * CAST(r - lo AS DOUBLE) / (hi - lo)) + 1, 10) END AS INTEGER) AS quantile
  FROM (SELECT *, min(r) OVER () AS lo, max(r) OVER () AS hi FROM (SELECT *, rank() OVER (ORDER BY daily) AS r FROM totals))"""
_QUANTILE = """SELECT quantile, p.{0}, any_value(o.r) AS rank, round(sum(CAST(p.b AS DOUBLE) / days_online) / {1}, 4) AS normalized_bytes_total,
  round(sum(CAST(p.b AS DOUBLE) / t) / {1}, 9) AS category_share
  FROM parts p JOIN bins x ON p.user_id = x.user_id JOIN ord o ON p.{0} = o.{0} {2} GROUP BY quantile, p.{0}"""
_HEAT = """SELECT p.user_id, p.{0}, b / 1e9 AS gb, round(log10(b / 1e9), 9) AS log_gb, CAST(b AS DOUBLE) / t AS normalized,
  round(b / 1e9 * 1000 / days_active, 9) AS mb_per_day, round(log10(b / 1e9 * 1000 / days_active), 9) AS log_mb_per_day
  FROM parts p JOIN (SELECT user_id, sum(b) AS t FROM parts GROUP BY 1) x ON p.user_id = x.user_id
  JOIN activity a ON a.user_id = p.user_id WHERE days_since_first_active >= 7"""
_RARE = "SELECT org FROM served WHERE bytes_up + bytes_down <> 0 GROUP BY org HAVING count(DISTINCT user_id) < 5"
_RATES = """SELECT t.user_id, b / 1e6 / days_online AS mb_per_online_day, b / 1e6 / days_active AS mb_per_active_day
  FROM (SELECT user_id, sum(bytes_total) AS b FROM user_days GROUP BY 1) t JOIN activity a ON t.user_id = a.user_id"""
_TWO_CDF = """SELECT '{0}' AS type, * FROM ({1}) UNION ALL SELECT '{2}', * FROM ({3})"""
_UPLINK = """SELECT t.user_id, CAST(bu AS BIGINT) AS bytes_up, CAST(bd AS BIGINT) AS bytes_down, top_category,
  CAST(bu + bd AS BIGINT) AS bytes_total, days_active, days_online, (bu + bd) / CAST(days_online AS DOUBLE) AS bytes_avg_per_online_day,
  bu / CAST(days_online AS DOUBLE) AS bytes_up_avg_per_online_day, bd / CAST(days_online AS DOUBLE) AS bytes_down_avg_per_online_day,
  least(days_online, days_active) / days_active AS normalized_days_online, CAST(bu AS DOUBLE) / (bu + bd) AS ul_ratio,
  CAST(bd AS DOUBLE) / (bu + bd) AS dl_ratio, (bu + bd) / CAST(days_online AS DOUBLE) / 1e6 AS mb_avg_per_online_day,
  rank() OVER (ORDER BY bu + bd) AS rank_total, rank() OVER (ORDER BY (bu + bd) / CAST(days_online AS DOUBLE)) AS rank_daily
  FROM (SELECT user_id, sum(u) AS bu, sum(d) AS bd, arg_max(category, (u + d, category)) AS top_category FROM (
          SELECT user_id, category, CAST(sum(bytes_up) AS BIGINT) AS u, CAST(sum(bytes_down) AS BIGINT) AS d FROM served GROUP BY 1, 2) GROUP BY 1) t
  JOIN users7s s ON t.user_id = s.user_id"""
_RATE = f"""SELECT t.user_id, {_RATIO['capped']} AS online_ratio, days_online, b / 1e6 / days_online AS mb_per_online_day
  FROM (SELECT user_id, sum(bytes_total) AS b FROM user_days GROUP BY 1) t JOIN users7 s ON t.user_id = s.user_id"""
_HOURLY_USERS = """SELECT CAST(start_ts AS DATE) AS date, CAST(hour(start_ts) AS INTEGER) AS hour, count(DISTINCT user_id) AS users
  FROM flows GROUP BY 1, 2"""
_DAYS = "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS date"
_MONTHLY = "SELECT last_day(date) AS date, count(DISTINCT user_id) AS n FROM user_days GROUP BY 1"
_WEEKLY = f"SELECT {week_monday('date')} AS date, count(DISTINCT user_id) AS n FROM user_days GROUP BY 1"
_WIDE = """SELECT * FROM (SELECT date,
  last_value(reg IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS registered,
  first_value(m IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS monthly,
  first_value(w IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weekly,
  daily FROM (
    SELECT coalesce(k.date, w.date, m.date) AS date, reg, w.n AS w, m.n AS m, coalesce(d.n, 0) AS daily
    FROM known k FULL JOIN weekly w ON k.date = w.date FULL JOIN monthly m ON coalesce(k.date, w.date) = m.date
    LEFT JOIN (SELECT date, count(DISTINCT user_id) AS n FROM user_days GROUP BY 1) d ON d.date = k.date))
  WHERE date < DATE '2024-02-01'"""
_WIDE_VIEWS = dict(
    known=f"""SELECT * FROM (SELECT d.date, last_value(r.registered IGNORE NULLS) OVER (ORDER BY d.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reg FROM ({_DAYS}) d LEFT JOIN registered r ON r.day = d.date) WHERE reg IS NOT NULL""",
    weekly=f"SELECT coalesce(a.date, b.date) AS date, n FROM (SELECT date FROM ({_DAYS}) WHERE dayofweek(date) = 1) a FULL JOIN ({_WEEKLY}) b ON a.date = b.date",
    monthly=f"SELECT coalesce(a.date, b.date) AS date, coalesce(n, 0) AS n FROM (SELECT date FROM ({_DAYS}) WHERE date = last_day(date)) a FULL JOIN ({_MONTHLY}) b ON a.date = b.date",
    wide=_WIDE,
)


def _registered(i: Inputs):
    return act.registered_users(i.tx, i.corrected[1], i.window)


def _rates(i: Inputs):
    return u.mb_per_day(i.user_days, i.activity)




def _active_from_days(i: Inputs):
    """Estimates from daily summaries next to the exact counts: is the error within its bound?"""
    days = cut_lineage(sketches.distinct_sketches(i.user_days, "user_id", ["date"]), "user-day-sketches")
    exact = [
        counts(i.user_days).select(F.lit(name).alias("period"), "date", F.col("users").alias("exact"))
        for name, counts in (("day", u.daily_active), ("week", u.weekly_active), ("month", u.monthly_active))
    ]
    both = u.active_from_days(days).join(exact[0].unionByName(exact[1]).unionByName(exact[2]), ["period", "date"], "full")
    off = F.abs(F.col("users") - F.col("exact"))
    return both.select("period", "date", "exact", F.coalesce(off <= sketches.DISTINCT_ERROR * F.col("exact"), F.lit(False)).alias("within"))


QUERIES = {
    "user_category_org_bytes": (
        query(lambda i: i.grouped),
        using("grouped", """SELECT user_id, category, org, CAST(bytes_up AS BIGINT) AS bytes_up, CAST(bytes_down AS BIGINT) AS bytes_down FROM grouped"""),
    ),
    "category_sort_order": (
        query(lambda i: u.sort_order(i.grouped, "category")),
        using("grouped", """SELECT category, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS bytes_total,
          rank() OVER (ORDER BY sum(bytes_up + bytes_down) DESC) AS rank FROM grouped GROUP BY 1"""),
    ),
    "user_activity": (
        query(lambda i: i.activity),
        using("activity", """SELECT user_id, days_online, earliest, earliest_kind, latest, latest_kind, days_since_first_active,
          days_active, outage_impact_days, optimistic_days_online FROM activity"""),
    ),
    "flow_ranges": (
        query(lambda i: act.flow_ranges(i.flows)),
        using("flows", """SELECT user_id, min(start_ts) AS first_flow, arg_max(end_ts, start_ts) AS last_flow_end,
          count(DISTINCT CAST(start_ts AS DATE)) AS days_online FROM flows GROUP BY 1"""),
    ),
    "purchase_ranges": (
        query(lambda i: act.purchase_ranges(i.tx)),
        using("purchases", "SELECT user_id, min(ts) AS first_purchase, max(ts) AS last_purchase FROM purchases GROUP BY 1"),
    ),
    "online_ratio_observed": (
        query(lambda i: act.online_ratio(i.activity, "observed").select("user_id", "online_ratio")),
        using("activity", f"SELECT user_id, {_RATIO['observed']} AS online_ratio FROM activity"),
    ),
    "online_ratio_optimistic": (
        query(lambda i: act.online_ratio(i.activity, "optimistic").select("user_id", "online_ratio")),
        using("activity", f"SELECT user_id, {_RATIO['optimistic']} AS online_ratio FROM activity"),
    ),
    "online_ratio_capped": (
        query(lambda i: act.online_ratio(i.activity, "capped").select("user_id", "online_ratio")),
        using("activity", f"SELECT user_id, {_RATIO['capped']} AS online_ratio FROM activity"),
    ),
    "online_ratio_distributions": (
        query(lambda i: u.online_ratio_cdf(i.activity)),
        using("users7", _TWO_CDF.format("Optimistic (ignore outages)", cdf_sql("users7", _RATIO["optimistic"]),
                                        "Observed", cdf_sql("users7", _RATIO["observed"]))),
    ),
    "user_share_of_category": (
        query(lambda i: u.user_share_of_category(i.grouped, i.activity)),
        using("grouped users7s", _SHARE.format("category"), parts=_PARTS.format("category"), totals=_TOTALS, ord=_ORDER.format("category")),
    ),
    "category_share_per_quantile": (
        query(lambda i: rounded(rounded(u.quantile_shares(i.grouped, i.activity), 4, "normalized_bytes_total"), 9, "category_share")),
        using("grouped users7s", _QUANTILE.format("category", "count(*)", ""), parts=_PARTS.format("category"),
              totals=_TOTALS, ord=_ORDER.format("category"), bins=_BINS),
    ),
    "org_share_per_quantile": (
        query(lambda i: rounded(rounded(u.quantile_shares(i.grouped, i.activity, "org", include_zero=True), 4, "normalized_bytes_total"), 9, "category_share")),
        using("grouped users7s", _QUANTILE.format("org", "any_value(z.n)", "JOIN (SELECT quantile AS q, count(*) AS n FROM bins GROUP BY 1) z ON z.q = x.quantile"),
              parts=_PARTS.format("org"), totals=_TOTALS, ord=_ORDER.format("org"), bins=_BINS),
    ),
    "user_category_heat_map": (
        query(lambda i: rounded(u.heat_map(i.grouped, i.activity), 9, "log_gb", "mb_per_day", "log_mb_per_day")),
        using("grouped activity", _HEAT.format("category"), parts=_PARTS.format("category")),
    ),
    "user_org_heat_map": (
        query(lambda i: rounded(u.org_heat_map(i.grouped, i.activity, 5), 9, "log_gb", "mb_per_day", "log_mb_per_day")),
        using("grouped activity", _HEAT.format("org"), rare=_RARE,
              parts="""SELECT user_id, CASE WHEN org IN (SELECT org FROM rare) THEN 'Aggregated (Users < 5)' ELSE org END AS org,
                sum(bytes_up + bytes_down) AS b FROM grouped GROUP BY ALL"""),
    ),
    "users_split_outliers": (
        query(lambda i: u.split_outliers(i.grouped, 20)),
        using("grouped", """SELECT p.user_id, category, b / 1e9 AS gb, CASE WHEN r <= 20 THEN 'Top 20' ELSE concat('Bottom ', n) END AS top_n
          FROM parts p JOIN (SELECT user_id, row_number() OVER (ORDER BY sum(b) DESC, user_id) AS r, count(*) OVER () - 20 AS n FROM parts GROUP BY 1) x
          ON p.user_id = x.user_id""", parts=_PARTS.format("category")),
    ),
    "user_day_bytes": (query(lambda i: i.user_days), using("user_days", "SELECT * FROM user_days")),
    "mb_per_day_per_user": (query(_rates), using("user_days activity", _RATES)),
    "mb_per_day_distributions": (
        query(lambda i: u.mb_per_day_cdf(_rates(i))),
        using("user_days activity", _TWO_CDF.format("Online Ratio", cdf_sql("rates_", "mb_per_online_day"),
              "Active Ratio", cdf_sql("rates_", "mb_per_active_day")), rates_=_RATES),
    ),
    "mb_per_day_medians": (
        query(lambda i: rounded(u.median_of_values(u.mb_per_day_cdf(_rates(i))), 9, "median")),
        using("user_days activity", """SELECT 'Online Ratio' AS type, round(median(v), 9) AS median FROM (SELECT DISTINCT mb_per_online_day AS v FROM rates_)
          UNION ALL SELECT 'Active Ratio', round(median(v), 9) FROM (SELECT DISTINCT mb_per_active_day AS v FROM rates_)""", rates_=_RATES),
    ),
    "top_category_per_user": (
        query(lambda i: u.top_category(i.flows)),
        using("flows", """SELECT user_id, arg_max(category, (b, category)) AS top_category FROM (
          SELECT user_id, category, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS b FROM flows GROUP BY 1, 2) GROUP BY 1"""),
    ),
    "uplink_ratio_per_user": (
        query(lambda i: u.uplink_ratio(i.served, i.activity)), using("served users7s", _UPLINK),
    ),
    "uplink_ratio_regression": (
        query(lambda i: rounded(stats.ols(u.uplink_ratio(i.served, i.activity), "mb_avg_per_online_day", "ul_ratio", log=True),
                                6, "slope", "intercept", "r2").select("n", "slope", "intercept", "r2")),
        using("served users7s", f"""SELECT count(*) AS n, round(regr_slope(ln(ul_ratio), ln(mb_avg_per_online_day)), 6) AS slope,
          round(regr_intercept(ln(ul_ratio), ln(mb_avg_per_online_day)), 6) AS intercept,
          round(regr_r2(ln(ul_ratio), ln(mb_avg_per_online_day)), 6) AS r2 FROM ({_UPLINK})"""),
    ),
    "uplink_ratio_significance": (
        query(lambda i: rounded(stats.ols_significance(
            u.uplink_ratio(i.served, i.activity), "mb_avg_per_online_day", "ul_ratio", log=True), 6, "slope", "p_value", "r2")),
        using("served users7s", SIGNIFICANCE.format(f"SELECT ln(mb_avg_per_online_day) AS x, ln(ul_ratio) AS y FROM ({_UPLINK})")),
    ),
    "online_rate_per_user": (
        query(lambda i: u.online_rate(i.user_days, i.activity)), using("user_days users7", _RATE),
    ),
    "online_rate_regression": (
        query(lambda i: rounded(stats.ols(u.online_rate(i.user_days, i.activity), "mb_per_online_day", "online_ratio"),
                                6, "slope", "intercept", "r2").select("n", "slope", "intercept", "r2")),
        using("user_days users7", f"""SELECT count(*) AS n, round(regr_slope(online_ratio, mb_per_online_day), 6) AS slope,
          round(regr_intercept(online_ratio, mb_per_online_day), 6) AS intercept,
          round(regr_r2(online_ratio, mb_per_online_day), 6) AS r2 FROM ({_RATE})"""),
    ),
    "hourly_active_users": (query(lambda i: u.hourly_active_users(i.flows)), using("flows", _HOURLY_USERS)),
    "hourly_user_stats": (
        query(lambda i: u.hourly_user_stats(u.hourly_active_users(i.flows), i.window)),
        using("flows", f"""SELECT hour, unnest(['Mean', '90th Percentile', '99th Percentile', 'Max']) AS type,
          unnest([round(avg(users), 3), round(quantile_cont(users, 0.9), 3), round(quantile_cont(users, 0.99), 3), round(CAST(max(users) AS DOUBLE), 3)]) AS value
          FROM ({_HOURLY_USERS}) WHERE NOT (date >= DATE '2024-01-10' AND date < DATE '2024-01-15') GROUP BY 1"""),
    ),
    "daily_active_users": (
        query(lambda i: u.daily_active(i.user_days)),
        using("user_days", "SELECT date, count(DISTINCT user_id) AS users FROM user_days GROUP BY 1"),
    ),
    "weekly_active_users": (
        query(lambda i: u.weekly_active(i.user_days)), using("user_days", f"SELECT date, n AS users FROM ({_WEEKLY})"),
    ),
    "monthly_active_users": (
        query(lambda i: u.monthly_active(i.user_days)), using("user_days", f"SELECT date, n AS users FROM ({_MONTHLY})"),
    ),
    "active_users_from_days": (
        query(_active_from_days),
        using("user_days", f"""SELECT 'day' AS period, date, count(DISTINCT user_id) AS exact, true AS within FROM user_days GROUP BY 2
          UNION ALL SELECT 'week', date, n, true FROM ({_WEEKLY}) UNION ALL SELECT 'month', date, n, true FROM ({_MONTHLY})"""),
    ),
    "registered_users": (query(_registered), using("registered", "SELECT * FROM registered")),
    "user_counts_over_time": (
        query(lambda i: u.user_counts(i.user_days, _registered(i), i.window)),
        using("user_days registered", """SELECT * FROM (SELECT date, unnest(['Registered', 'Unique Monthly Online', 'Unique Weekly Online', 'Unique Daily Online']) AS user_type,
          unnest([registered, monthly, weekly, daily]) AS num_users, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS place FROM wide) WHERE num_users IS NOT NULL""", **_WIDE_VIEWS),
    ),
    "user_counts_rolling": (
        query(lambda i: rounded(u.user_counts_rolling(i.user_days, _registered(i), i.window), 6, "mean_7")),
        using("user_days registered", """SELECT date, daily, CASE WHEN count(*) OVER w = 7 THEN round(avg(daily) OVER w, 6) END AS mean_7
          FROM wide WINDOW w AS (ORDER BY date ROWS 6 PRECEDING)""", **_WIDE_VIEWS),
    ),
}
