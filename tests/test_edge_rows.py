"""Ordinary rows the test tables do not hold: zero bytes, nulls, doubled hosts, crowded days."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from meshledger.functions import rules as R
from meshledger.functions.addresses import mark_local
from meshledger.operators import classify, dns, scans, stats
from meshledger.plans import coverage, traffic, users
from meshledger.sources import derived, tables, traceroutes

T0 = dt.datetime(2024, 1, 1)
FLOWS = "event_id bigint, user_id bigint, dest_ip string, start_ts timestamp_ntz, end_ts timestamp_ntz"
ANSWERS = "user_id bigint, ip_address string, ts timestamp_ntz, domain_name string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def grouped(spark):
    """User 1 has only zero-byte flows."""
    rows = [(1, "A", "x", 0, 0), (2, "A", "x", 5, 5), (2, "B", "y", 0, 30), (3, "A", "y", 1, 9)]
    return spark.createDataFrame(rows, "user_id bigint, category string, org string, bytes_up bigint, bytes_down bigint")


@pytest.fixture(scope="module")
def activity(spark):
    rows = [(u, 3, 20.0, 10.0) for u in (1, 2, 3)]
    return spark.createDataFrame(rows, "user_id bigint, days_online bigint, days_since_first_active double, days_active double")


def test_a_user_without_bytes_has_no_share(grouped, activity):
    shares = {(r["user_id"], r["category"]): r["share"] for r in users.user_share_of_category(grouped, activity).collect()}
    assert shares == {(1, "A"): None, (2, "A"): 0.25, (2, "B"): 0.75, (3, "A"): 1.0}


@pytest.mark.parametrize("include_zero", [False, True])
def test_quantile_shares_with_a_user_without_bytes(grouped, activity, include_zero):
    rows = users.quantile_shares(grouped, activity, bins=1, include_zero=include_zero).collect()
    share = {r["category"]: r["category_share"] for r in rows}
    assert share == pytest.approx({"A": 1.25 / (3 if include_zero else 2), "B": 0.75 / (3 if include_zero else 1)})


def test_logarithm_of_zero_is_minus_infinity(grouped, activity):
    row = users.heat_map(grouped, activity).where("user_id = 1").first()
    assert row["log_gb"] == row["log_mb_per_day"] == -math.inf and row["normalized"] is None


def test_nothing_mappable(spark):
    daily = spark.createDataFrame([(R.NO_DNS, 3, 4)], "category string, bytes_up bigint, bytes_down bigint")
    row = traffic.mapping_coverage(daily, "category").first()
    assert (row["fraction_unmappable"], row["fraction_mapped_of_total"], row["fraction_mapped_of_mappable"]) == (1.0, 0.0, None)
    assert traffic.mapping_coverage(daily.limit(0), "category").first()["fraction_unmappable"] is None


def test_shares_of_nothing(spark):
    flows = spark.createDataFrame([("A", "x", True, 0, 0)], "category string, org string, local boolean, bytes_up bigint, bytes_down bigint")
    assert {r["share_of_total"] for r in coverage.video_share(flows).collect()} == {None}
    assert {r["flow_pct"] for r in coverage.category_org_coverage(flows).collect()} == {None}
    assert coverage.down_up_ratio(flows).first()["dl_ul_ratio"] is None


def test_every_flow_comes_back_named_or_not(spark):
    rows = [(1, 7, "8.8.8.8", at(10), at(11)), (2, 7, None, at(10), at(11)), (3, 7, "8.8.8.8", None, None), (4, 7, "9.9.9.9", at(5), at(6)),
            (5, None, "8.8.8.8", at(10), at(11))]
    flows = spark.createDataFrame(rows, FLOWS)
    answers = spark.createDataFrame([(7, "8.8.8.8", at(1), "a.example"), (7, None, at(1), "b.example"), (7, "8.8.8.8", None, "c.example")], ANSWERS)
    hosts = spark.createDataFrame([("9.9.9.9", "z.example"), ("9.9.9.9", "y.example"), ("8.8.8.8", "w.example")], "ip string, host string")
    got = {r["event_id"]: (r["fqdn"], r["fqdn_source"]) for r in dns.attach_fqdn(flows, answers, hosts, only_dns_users=False, tie="event_id").collect()}
    assert got[1] == ("a.example", "user_dns_log")
    assert got[4] == ("y.example", "reverse_dns")
    assert got[2] == ("", "none") and set(got) == {1, 2, 3, 4, 5}
    assert dns.attach_fqdn(flows, answers, hosts, only_dns_users=False, tie="event_id").count() == 5


def test_rows_without_an_order_value_stay(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", at(1), 2), ("k", at(2), 4)], "k string, ts timestamp_ntz, v int")
    out = scans.ordered_scan(df, ["k"], ["ts"], scans.by_time("ts", 1), {"s": scans.running_sum("v")})
    assert sorted(r["s"] for r in out.collect()) == [1, 3, 7]


def test_flows_without_a_name_are_classified_without_the_join(spark):
    rows = [(i, "" if i % 2 else None) for i in range(90)] + [(90 + i, "www.google.com") for i in range(10)]
    out = classify.classify_domain(spark.createDataFrame(rows, "event_id bigint, fqdn string"))
    got = {(r["org"], r["category"] == R.NO_DNS): r["count"] for r in out.groupBy("org", "category").count().collect()}
    assert got == {(R.NO_DNS, True): 90, ("Google", False): 10}


@pytest.mark.parametrize("ip,local", [
    ("::ffff:8.8.8.8", True), ("64:ff9b::8.8.8.8", False), ("fe80::1.2.3.4", True), ("999.1.1.1", False), ("10.0.0.256", False),
    ("2001:db8::192.0.2.33", True), ("2600::ffff:10.0.0.1", False)])
def test_dotted_tails_and_large_octets(spark, ip, local):
    assert mark_local(spark.createDataFrame([(ip,)], "dest_ip string")).first()["local"] is local


def test_log_fit_counts_what_it_leaves_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (0.0, 3.0), (3.0, 0.0), (None, 1.0)], "x double, y double")
    row = stats.ols(df, "x", "y", log=True).first()
    assert (row["n"], row["left_out"]) == (3, 3) and row["slope"] == pytest.approx(1.0)


def test_p_value_against_known_quantiles(spark):
    # two-sided 5 % points of Student's t
    rows = [(1.0, 12.7062047), (2.0, 4.30265273), (10.0, 2.22813885), (100.0, 1.98397152), (5000.0, 1.96043861)]
    df = spark.createDataFrame(rows, "f double, t double")
    p = [r["p"] for r in df.select(stats.student_p(F.col("t") * F.col("t"), F.col("f")).alias("p")).collect()]
    assert p == pytest.approx([0.05] * 5, abs=1e-6)


def test_a_busy_day_is_written_in_several_files(spark, tmp_path):
    flows = spark.range(4000).select(F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(T0)).cast("timestamp_ntz").alias("start_ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one file
    try:
        tables.write_by_day(flows, str(tmp_path / "days"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "days" / "day=2024-01-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "days")).count() == 4000


def test_the_outage_moves_flows_and_loses_none(spark, sf_dir):
    flows = derived.flows(spark, sf_dir)
    moved = derived.past_outage(flows)
    assert moved.count() == flows.count()
    inside = (F.col("start_ts") >= F.lit(derived.TEST_WINDOW.outage_lo)) & (F.col("start_ts") < F.lit(derived.TEST_WINDOW.outage_hi))
    assert moved.where(inside).count() == 0


def test_domain_of_the_header_above(spark):
    text = "traceroute to a.example\n 1 gw (10.0.0.1) 1 ms\ntraceroute to b.example\n 1 gw (10.0.0.1) 2 ms\n 2 x (10.0.0.2) 4 ms\n"
    files = spark.createDataFrame([("f", text), ("g", " 1 gw (10.0.0.1) 1 ms")], "file string, text string")
    got = sorted((r["file"], r["domain"], r["hop"], r["last_hop"]) for r in traceroutes.parse_traceroutes(files).collect())
    assert got == [("f", "a.example", 1, 0), ("f", "b.example", 1, 0), ("f", "b.example", 2, 1), ("g", "", 1, 1)]
