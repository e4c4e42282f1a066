"""Filters, calendars, distributions and other shared shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meshledger.catalog.base import ROWS, Inputs, query, rounded
from meshledger.catalog.sql import IN_OUTAGE, SIGNIFICANCE, cdf_sql, secs, using, week_monday, week_sunday
from meshledger.functions.timebins import day, month_end, week_ending
from meshledger.operators import activity as act
from meshledger.operators import calendar as cal
from meshledger.operators import sessions as ses
from meshledger.operators import sketches, stats
from meshledger.plans import traffic
from meshledger.session import cut_lineage
from meshledger.study import StudyWindow

_HALF = StudyWindow(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
_YEARS = StudyWindow(dt.datetime(1995, 1, 1), dt.datetime(2001, 9, 1))


def _order_days(i: Inputs, end):
    return i.table("orders").groupBy(end.alias("bin")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers")
    )


def _dense_orders(i: Inputs):
    monthly = i.table("orders").groupBy(
        month_end("o_orderdate").alias("date"), F.col("o_orderpriority").alias("kind")
    ).agg(F.count(F.lit(1)).alias("orders"))
    months = cal.calendar(i.spark, _YEARS, "month", "date")
    return cal.densify(monthly, months, "date", "kind", ["1-URGENT", "5-LOW", "9-NONE"], {"orders": 0})


def _quantiles_from_days(i: Inputs):
    """Price quantiles per month from one summary per day: is the share of rows up to them as asked?"""
    prices = i.table("lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.floor("l_extendedprice").cast("bigint").alias("price"))
    days = cut_lineage(sketches.quantile_sketches(prices, "price", ["date"]), "price-day-sketches")
    month = days.withColumn("month", F.trunc("date", "MONTH"))
    guessed = sketches.merged_quantiles(month, [0.1, 0.5, 0.9, 0.99], ["month"])
    by_month = prices.withColumn("month", F.trunc("date", "MONTH")).join(guessed, "month")
    places = by_month.groupBy("month", "prob", "n").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price") < F.col("value")).alias("below"),
        F.count_if(F.col("price") <= F.col("value")).alias("up_to"))
    # a value that many rows share covers a range of ranks
    within = ((F.col("below") / F.col("rows") <= F.col("prob") + sketches.RANK_ERROR)
              & (F.col("up_to") / F.col("rows") >= F.col("prob") - sketches.RANK_ERROR))
    return places.select("month", "prob", "rows", (within & (F.col("n") == F.col("rows"))).alias("within"))


def _line_prices(i: Inputs):
    return i.table("lineitem").select(
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("price"), "l_returnflag", "l_orderkey"
    )


def _user_bytes(i: Inputs):
    return i.flows.groupBy("user_id").agg(F.sum("bytes_down").alias("b"))


def _pairs(i: Inputs):
    return i.flows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("x"), F.sum(F.col("bytes_up")).alias("y")
    )


_PAIRS = "SELECT user_id, count(*) AS x, CAST(sum(bytes_up) AS BIGINT) AS y FROM flows GROUP BY 1"
_OLS = """SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
  round(regr_r2(y, x), 6) AS r2 FROM ({0})"""

QUERIES = {
    "local_time_shift": (
        query(lambda i: cal.shift_local_time(i.flows, ["start_ts", "end_ts"]).select("event_id", "start_ts", "end_ts")),
        using("flows", "SELECT event_id, start_ts + INTERVAL 9 HOUR AS start_ts, end_ts + INTERVAL 9 HOUR AS end_ts FROM flows"),
    ),
    "trim_to_period": (
        query(lambda i: cal.trim(i.flows, "start_ts", _HALF).select("event_id", "start_ts", "bytes_up")),
        using("flows", """SELECT event_id, start_ts, bytes_up FROM flows
          WHERE start_ts >= TIMESTAMP '2024-01-05' AND start_ts < TIMESTAMP '2024-01-20'"""),
    ),
    "outage_label_counts": (
        query(lambda i: cal.label_outage(i.flows, "start_ts", i.window).groupBy("outage").agg(
            F.count(F.lit(1)).alias("flows"))),
        using("flows", f"""SELECT CASE WHEN {IN_OUTAGE.format('start_ts')} THEN 'Outage' ELSE 'Normal' END AS outage,
          count(*) AS flows FROM flows GROUP BY 1"""),
    ),
    "normal_day_flows": (
        query(lambda i: i.served.select("event_id", "start_ts")),
        using("served", "SELECT event_id, start_ts FROM served"),
    ),
    "eligible_users": (
        query(lambda i: act.eligible_users(i.activity).select("user_id", "days_active")),
        using("users7", "SELECT user_id, days_active FROM users7"),
    ),
    "eligible_users_strict": (
        query(lambda i: act.eligible_users(i.activity, 30, 29.5, strict=True).select("user_id")),
        using("activity", "SELECT user_id FROM activity WHERE days_since_first_active > 30 AND days_active > 29.5"),
    ),
    "eligible_users_by_age": (
        query(lambda i: act.eligible_users(i.activity, 30.5, None).select("user_id")),
        using("activity", "SELECT user_id FROM activity WHERE days_since_first_active >= 30.5"),
    ),
    "flows_of_eligible_users": (
        query(lambda i: act.members(i.flows, act.eligible_users(i.activity, 30.5, None)).select("event_id", "user_id")),
        using("flows activity", """SELECT event_id, user_id FROM flows WHERE user_id IN
          (SELECT user_id FROM activity WHERE days_since_first_active >= 30.5)"""),
    ),
    "external_flows": (
        query(lambda i: i.flows.where(~F.col("local")).select("event_id", "dest_ip")),
        using("flows", "SELECT event_id, dest_ip FROM flows WHERE NOT local"),
    ),
    "known_mistake_left_out": (
        query(lambda i: act.exclude_user_after(i.tx, 7, dt.datetime(2024, 1, 15)).select("event_id", "user_id")),
        using("tx", """SELECT event_id, user_id FROM tx
          WHERE NOT coalesce(user_id = 7 AND ts > TIMESTAMP '2024-01-15', false)"""),
    ),
    "low_traffic_days": (
        query(lambda i: cal.low_traffic_days(
            traffic.daily_bytes(traffic.all_flow_bytes(i.flows, i.p2p, i.nouser)), "bytes_total", 0.035)
            .select("date", "bytes_total")),
        using("flows p2p nouser", """SELECT date, bytes_total FROM (SELECT CAST(start_ts AS DATE) AS date, CAST(sum(b) AS BIGINT) AS bytes_total FROM (
          SELECT start_ts, bytes_up + bytes_down AS b FROM flows UNION ALL SELECT start_ts, bytes_a_to_b + bytes_b_to_a FROM p2p
          UNION ALL SELECT start_ts, bytes_a_to_b + bytes_b_to_a FROM nouser) GROUP BY 1) WHERE bytes_total / 1e9 < 0.035"""),
    ),
    "orders_per_week_ending_monday": (
        query(lambda i: _order_days(i, week_ending("o_orderdate", "MON"))),
        f"""SELECT {week_monday('CAST(o_orderdate AS DATE)')} AS bin, count(*) AS orders,
          count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
    ),
    "orders_per_week_ending_sunday": (
        query(lambda i: _order_days(i, week_ending("o_orderdate", "SUN"))),
        f"""SELECT {week_sunday('CAST(o_orderdate AS DATE)')} AS bin, count(*) AS orders,
          count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
    ),
    "orders_per_month": (
        query(lambda i: _order_days(i, month_end("o_orderdate"))),
        """SELECT last_day(o_orderdate) AS bin, count(*) AS orders, count(DISTINCT o_custkey) AS customers
          FROM orders GROUP BY 1""",
    ),
    "densified_orders": (
        query(_dense_orders),
        """WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-09-01', INTERVAL 1 DAY)) AS DATE) AS d),
          grid AS (SELECT d AS date, kind FROM days, (VALUES ('1-URGENT'), ('5-LOW'), ('9-NONE')) k(kind) WHERE d = last_day(d)),
          facts AS (SELECT last_day(o_orderdate) AS date, o_orderpriority AS kind, count(*) AS orders FROM orders GROUP BY 1, 2)
          SELECT g.date, g.kind, coalesce(orders, 0) AS orders FROM grid g LEFT JOIN facts f ON g.date = f.date AND g.kind = f.kind""",
    ),
    "price_distribution": (
        query(lambda i: stats.cdf(_line_prices(i), "price")),
        cdf_sql("lineitem", "CAST(floor(l_extendedprice) AS BIGINT)"),
    ),
    "price_quantiles_by_flag": (
        query(lambda i: rounded(stats.quantiles(
            _line_prices(i), "price", {"median": 0.5, "q90": 0.9, "q99": 0.99}, ["l_returnflag"]), 3, "median", "q90", "q99")),
        """SELECT l_returnflag, round(quantile_cont(p, 0.5), 3) AS median, round(quantile_cont(p, 0.9), 3) AS q90,
          round(quantile_cont(p, 0.99), 3) AS q99 FROM (SELECT l_returnflag, floor(l_extendedprice) AS p FROM lineitem) GROUP BY 1""",
    ),
    "price_quantiles_from_days": (
        query(_quantiles_from_days),
        """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, prob, count(*) AS rows, true AS within
          FROM lineitem, (SELECT unnest([CAST(0.1 AS DOUBLE), 0.5, 0.9, 0.99]) AS prob) GROUP BY 1, 2""",
    ),
    "customer_ranks": (
        query(lambda i: stats.with_rank(stats.with_rank(stats.with_rank(
            i.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")),
            "orders", "rank_up"), "orders", "rank_down", descending=True), "orders", "rank_share", share=True)),
        """SELECT *, rank() OVER (ORDER BY orders) AS rank_up, rank() OVER (ORDER BY orders DESC) AS rank_down,
          rank() OVER (ORDER BY orders) / CAST(count(*) OVER () AS DOUBLE) AS rank_share
          FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1)""",
    ),
    "user_rank_bins": (
        query(lambda i: stats.rank_bins(stats.with_rank(_user_bytes(i), "b", "r"), "r", "bin").select("user_id", "r", "bin")),
        using("flows", """SELECT user_id, r, CAST(least(floor(10 * CAST(r - lo AS DOUBLE) / (hi - lo)) + 1, 10) AS INTEGER) AS bin FROM (
          SELECT user_id, r, min(r) OVER () AS lo, max(r) OVER () AS hi FROM (
            SELECT user_id, rank() OVER (ORDER BY sum(bytes_down)) AS r FROM flows GROUP BY 1))"""),
    ),
    "rolling_seven_rows": (
        query(lambda i: rounded(stats.rolling_mean_rows(
            i.flows.groupBy(day("start_ts").alias("date")).agg(F.count(F.lit(1)).alias("flows")),
            [], "date", "flows", "mean_7"), 6, "mean_7")),
        using("flows", """SELECT date, flows, CASE WHEN count(*) OVER w = 7 THEN round(avg(flows) OVER w, 6) END AS mean_7
          FROM (SELECT CAST(start_ts AS DATE) AS date, count(*) AS flows FROM flows GROUP BY 1)
          WINDOW w AS (ORDER BY date ROWS 6 PRECEDING)"""),
    ),
    "ols_line": (
        query(lambda i: rounded(rounded(stats.ols(_pairs(i), "x", "y"), 6, "slope", "r2"), 4, "intercept")
              .select("n", "slope", "intercept", "r2")),
        using("flows", _OLS.format(_PAIRS)),
    ),
    "ols_log_line": (
        query(lambda i: rounded(rounded(stats.ols(_pairs(i), "x", "y", log=True), 6, "slope", "r2"), 4, "intercept")
              .select("n", "slope", "intercept", "r2")),
        using("flows", _OLS.format(f"SELECT ln(x) AS x, ln(y) AS y FROM ({_PAIRS})")),
    ),
    "ols_log_curve": (
        query(lambda i: rounded(stats.ols_curve(stats.ols(_pairs(i), "x", "y", log=True), log=True), 3, "x", "prediction")),
        using("flows", f"""SELECT CAST(i AS INTEGER) AS i, round(lo + (hi - lo) * (i / 999.0::DOUBLE), 3) AS x,
          round(exp(c + m * ln(lo + (hi - lo) * (i / 999.0::DOUBLE))), 3) AS prediction
          FROM (SELECT regr_slope(ln(y), ln(x)) AS m, regr_intercept(ln(y), ln(x)) AS c, min(x) AS lo, max(x) AS hi FROM ({_PAIRS})),
          range(0, 1000) t(i)"""),
    ),
    "ols_significance": (
        query(lambda i: rounded(stats.ols_significance(_pairs(i), "x", "y"), 6, "slope", "p_value", "r2")),
        using("flows", SIGNIFICANCE.format(_PAIRS)),
    ),
    "log_gaps": (
        query(lambda i: ses.log_gaps(i.flows, tie=["event_id"], rows_per_bucket=ROWS)),
        using("flows", """SELECT gap_start, start_ts AS gap_end FROM (
          SELECT start_ts, lag(end_ts) OVER (ORDER BY start_ts, end_ts, event_id) AS gap_start FROM flows)
          WHERE start_ts > gap_start"""),
    ),
    "log_gaps_running_max": (
        query(lambda i: ses.log_gaps(i.flows, "running_max", ["event_id"], ROWS)),
        using("flows", """SELECT gap_start, start_ts AS gap_end FROM (
          SELECT start_ts, max(end_ts) OVER (ORDER BY start_ts, end_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM flows)
          WHERE start_ts > gap_start"""),
    ),
    "full_gap_days": (query(lambda i: i.gap_days), using("gap_days", "SELECT day FROM gap_days")),
    "outage_durations": (
        query(lambda i: ses.outage_cdf(i.gaps)),
        using("gaps", cdf_sql("gaps", f"{secs('gap_start', 'gap_end')} / 3600")
              .replace("WHERE v IS NOT NULL", "WHERE v IS NOT NULL AND v >= 10 / 3600.0::DOUBLE")),
    ),
    "uptime": (
        query(lambda i: rounded(ses.uptime(i.gaps, i.window), 4, "downtime_s", "downtime_pct")),
        using("gaps", f"""SELECT round(sum({secs('gap_start', 'gap_end')}), 4) AS downtime_s, 2678400.0::DOUBLE AS period_s,
          round(sum({secs('gap_start', 'gap_end')}) / 2678400 * 100, 4) AS downtime_pct FROM gaps"""),
    ),
}
