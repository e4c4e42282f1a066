"""Worked examples for rules, boundaries and formats."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meshledger.functions import rules as R
from meshledger.functions import timebins as tb
from meshledger.functions.addresses import mark_local
from meshledger.operators import activity as act
from meshledger.operators import classify as c
from meshledger.operators import dns as d
from meshledger.operators import routing, sessions as ses
from meshledger.operators import stats
from meshledger.sources import tables, traceroutes, transaction_log as log

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


TX = "event_id bigint, ts timestamp_ntz, kind string, user_id string, dest_user_id string, amount_bytes bigint, amount_idr bigint"


def buy(i, seconds, amount=10, user="u"):
    return (i, at(seconds), "purchase", user, None, amount, amount * 2)


def test_purchases_merge_below_a_minute_only(spark):
    tx = spark.createDataFrame([buy(1, 0), buy(2, 59), buy(3, 119), buy(4, 178.9), buy(5, 300)], TX)
    for rows in (1, 100):
        out = ses.consolidate_purchases(tx, rows_per_bucket=rows).orderBy("ts").collect()
        assert [(r["ts"], r["amount_bytes"], r["time_since_last_purchase"]) for r in out] == [
            (at(0), 20, None), (at(119), 20, 119.0), (at(300), 10, 181.0)]


def test_session_sums_equal_raw_sums(spark):
    tx = spark.createDataFrame([buy(i, i * 41 % 900, i + 1, "uvw"[i % 3]) for i in range(60)], TX)
    out = ses.consolidate_purchases(tx, rows_per_bucket=4).agg(F.sum("amount_bytes"), F.sum("amount_idr")).first()
    assert tuple(out) == (sum(range(1, 61)), 2 * sum(range(1, 61)))


def test_gap_modes_differ_under_a_long_flow(spark):
    flows = spark.createDataFrame(
        [(at(0), at(1000)), (at(10), at(20)), (at(500), at(600)), (at(2000), at(2001))], "start_ts timestamp_ntz, end_ts timestamp_ntz")
    plain = {tuple(r) for r in ses.log_gaps(flows, rows_per_bucket=1).collect()}
    assert plain == {(at(20), at(500)), (at(600), at(2000))}
    assert [tuple(r) for r in ses.log_gaps(flows, "running_max", rows_per_bucket=1).collect()] == [(at(1000), at(2000))]


def test_full_gap_days(spark):
    gaps = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 4, 11)), (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2))],
        "gap_start timestamp_ntz, gap_end timestamp_ntz")
    assert sorted(r[0] for r in ses.full_gap_days(gaps).collect()) == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_week_and_month_ends(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 7, 8)], "d date")
    out = days.select(tb.week_ending("d", "MON"), tb.week_ending("d", "SUN"), tb.month_end("d")).collect()
    assert [(r[0].day, r[1].day, r[2].day) for r in out] == [(1, 7, 31), (8, 7, 31), (8, 7, 31), (8, 14, 31)]


FLOW = "event_id bigint, start_ts timestamp_ntz, user_id string, dest_ip string"
DNS = "ts timestamp_ntz, user_id string, ip_address string, domain_name string"


def test_answer_at_the_flow_start_is_not_used(spark):
    flows = spark.createDataFrame([(1, at(10), "u", "8.8.4.4"), (2, at(11), "u", "8.8.4.4"), (3, at(50), "u", "8.8.4.4"),
                                   (4, at(50), "u", "10.0.0.1"), (5, at(50), "u", "9.9.9.9"), (6, at(50), "w", "8.8.4.4")], FLOW)
    dns = spark.createDataFrame([(at(10), "u", "8.8.4.4", "a"), (at(20), "u", "8.8.4.4", "b"), (at(30), "u", "8.8.4.4", "a")], DNS)
    reverse = spark.createDataFrame([("9.9.9.9", "nine"), ("10.0.0.1", "ten")], "ip string, host string")
    for rows in (1, 100):
        out = d.attach_fqdn(flows, dns, reverse, rows_per_bucket=rows).orderBy("event_id").collect()
        assert [(r["event_id"], r["fqdn"], r["ambiguous_fqdn_count"], r["fqdn_source"]) for r in out] == [
            (1, "", 0, "none"), (2, "a", 1, "user_dns_log"), (3, "a", 2, "user_dns_log"), (4, "", 0, "none"),
            (5, "nine", 1, "reverse_dns")]
    assert d.attach_fqdn(flows, dns, only_dns_users=False).count() == 6
    assert [r[0] for r in d.users_without_dns(flows, dns).collect()] == ["w"]


@pytest.mark.parametrize("ip,local", [
    ("8.8.8.8", False), ("10.1.2.3", True), ("100.64.0.1", True), ("100.128.0.1", False), ("172.31.255.255", True),
    ("172.32.0.0", False), ("192.0.0.8", False), ("192.0.0.7", True), ("198.19.0.1", True), ("224.0.0.1", False),
    ("2001:0db8:0000:0000:0000:0000:0000:0001", True), ("2001:4860:4860::8888", False), ("::1", True), ("fe80::1", True),
    ("fd00:1::", True), ("2600::", False), (None, False),
])
def test_local_addresses(spark, ip, local):
    assert mark_local(spark.createDataFrame([(ip,)], "ip string"), "ip").first()["local"] is local


@pytest.mark.parametrize("name,org,category", [
    ("", R.NO_DNS, R.NO_DNS), (None, R.NO_DNS, R.NO_DNS), ("nothing.example", R.NOT_MAPPED, R.NOT_MAPPED),
    ("accounts.google.com", "Google", "API"), ("android.clients.google.com", "Google", "Software or Updates"),
    ("yt3.ggpht.com", "Google", "Video"), ("lh3.ggpht.com", "Google", "Non-video Content"),
    ("connectivitycheck.gstatic.com", "Google", "API"), ("beacons.gvt2.com", "Google", "API"),
    ("r1.gvt1.com", "Google", "Mixed CDN"), ("some.googleapis.com", "Google", "API"), ("x.1e100.net", "Google", R.NOT_MAPPED),
    ("scontent.xx.fbcdn.net", "Facebook", "Social Media"), ("connect.facebook.net", "Facebook", "API"),
    ("whatsapp-cdn.fbcdn.net", "Facebook", "Messaging"), ("mmg.whatsapp.net", "WhatsApp", "Messaging"),
    ("video.twimg.com", "Twitter", "Video"), ("abs.twimg.com", "Twitter", "Social Media"),
    ("s3.amazonaws.com", "Amazon Web Services", "IAAS"), ("amazon.com", "Amazon", "Non-video Content"),
    ("avatar.x.com", "Avatar Tracker", "Ad Network"), ("avatar.x.net", R.NOT_MAPPED, R.NOT_MAPPED),
    ("ev.rdtcdn.com", "RdtCDN", "Mixed CDN"), ("ht.rdtcdn.com", "Rdt CDN", "Mixed CDN"),
    ("img.vidmatefilm.org", "VidMateFilm", "Video"), ("a.vidmatefilm.org", "Vidmate", "Video"),
])
def test_domain_rules(spark, name, org, category):
    row = c.classify_domain(spark.createDataFrame([(name,)], "fqdn string")).first()
    assert (row["org"], row["category"]) == (org, category)


def test_address_rules_keep_their_order(spark):
    ips = ["169.136.65.204", "8.37.232.40", "174.125.1.1", "74.125.1.1", "157.240.2.9", "1.2.3.4"]
    rows = c.classify_ip(spark.createDataFrame([(ip,) for ip in ips], "dest_ip string")).collect()
    assert [r["org"] for r in rows] == ["Likee", "Level3", R.NO_DNS, "Google", "Facebook", R.NO_DNS]


def test_anonymized_output_names_no_small_org(spark):
    rows = [(o, u) for o, n in (("big", 6), ("five", 5), ("four", 4)) for u in range(n)]
    out = c.k_anonymize(spark.createDataFrame(rows, "org string, user_id int"))
    assert {r["org"] for r in out.select("org").distinct().collect()} == {"big", "five", R.ANONYMIZED_ORG}
    assert out.count() == len(rows)


def test_transaction_log_formats(spark):
    lines = ["2019-03-10 10:00:00 PURCHASE |u 1| 100 5000", "2019-03-10 10:00:01 USERTRANSFER a b 12.5", "2019-03-10 10:00:02 USERTRANSFER a b 13.5",
             "2019-03-10 10:00:03 USERTRANSFER a b ", "2019-03-10 10:00:04 TOPUP z 70", "2019-03-10 10:00:05 ADMINTRANSFER a b 9"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    out, _ = log.parse_transaction_log(df)
    assert [tuple(r)[1:] for r in out.orderBy("ts").collect()] == [
        ("purchase", "u 1", None, 100, 5000), ("user_transfer", "a", "b", None, 12), ("user_transfer", "a", "b", None, 14),
        ("user_transfer", "a", "b", None, 0), ("admin_topup", None, "z", None, 70), ("admin_transfer", "a", "b", None, 9)]
    bad = spark.createDataFrame([(lines[0],), ("2019-03-10 10:00:00 GIFT a 1",)], "value string")
    with pytest.raises(PySparkException):
        log.parse_transaction_log(bad)[0].collect()
    good, rejects = log.parse_transaction_log(bad, strict=False)
    assert (good.count(), rejects.count()) == (1, 1)


def test_nul_scrub(spark):
    row = log.scrub_nul(spark.createDataFrame([("a\x00b\x00",)], "value string")).first()
    assert tuple(row) == ("ab", 2)


def test_traceroute_example(spark):
    text = "traceroute to h.example (1.2.3.4), 30 hops max\n 1  gw (10.0.0.1)  1.0 ms  2.0 ms  3.0 ms\n 2  * * *\n"
    out = traceroutes.parse_traceroutes(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("hop").collect()
    # The host name counts as a failed probe: (1 + 2 + 3) / (3 - 1).
    assert [(r["domain"], r["hop"], r["ip"], r["latency"], r["last_hop"]) for r in out] == [
        ("h.example", 1, "10.0.0.1", 3.0, 0), ("h.example", 2, "*", None, 1)]


def test_coalesced_flows_touch_within_a_second(spark):
    rows = [("u", "d", 1, 2, 6, at(0), at(10), 1, 1), ("u", "d", 1, 2, 6, at(11), at(20), 1, 1), ("u", "d", 1, 2, 6, at(21.5), at(30), 1, 1)]
    df = spark.createDataFrame(rows, "user_id string, dest_ip string, user_port int, dest_port int, protocol int, start_ts timestamp_ntz, end_ts timestamp_ntz, bytes_up bigint, bytes_down bigint")
    out = routing.coalesce_flows(df, rows_per_bucket=1).orderBy("start_ts").collect()
    assert [(r["start_ts"], r["end_ts"], r["merged_flows"]) for r in out] == [(at(0), at(20), 2), (at(21.5), at(30), 1)]


def test_dedup_is_idempotent_and_slices_keep_the_earliest(spark):
    df = spark.createDataFrame([(at(0), "a"), (at(0), "a"), (at(60), "a"), (at(5 * 3600), "a")], "start_ts timestamp_ntz, x string")
    once = routing.dedup(df)
    assert once.count() == routing.dedup(once).count() == 3
    assert sorted(r["start_ts"] for r in routing.dedup(df, "slice").collect()) == [at(0), at(5 * 3600)]


def test_ratio_is_null_when_nothing_is_left(spark):
    df = spark.createDataFrame([(1, 2.0, 2), (5, 4.0, 1)], "days_online int, days_active double, outage_impact_days int")
    got = {k: [r[0] for r in act.online_ratio(df, k).select("online_ratio").collect()] for k in ("observed", "optimistic", "capped")}
    assert got == {"observed": [0.5, 1.0], "optimistic": [None, 4 / 3], "capped": [None, 1.0]}


def test_regression_matches_closed_form(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1 + (x % 3)) for x in range(1, 30)], "x double, y double")
    line, tested = stats.ols(df, "x", "y").first(), stats.ols_significance(df, "x", "y").first()
    assert line["slope"] == pytest.approx(tested["slope"])
    assert line["r2"] == pytest.approx(tested["r2"])
    assert tested["p_value"] < 1e-6
    assert stats.ols_curve(stats.ols(df, "x", "y")).count() == 1000


def test_write_table_checks_its_input_and_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(TypeError):
        tables.write_table([1, 2], path)
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3
    tables.write_table(spark.range(4), str(tmp_path / "u"))
    assert tables.read_archives(spark, [path, str(tmp_path / "u")], spark.range(1).schema).count() == 7
    tables.write_table(spark.range(3).withColumn("p", F.lit("x")), str(tmp_path / "p"), "p")
    assert tables.read_table(spark, str(tmp_path / "p")).columns == ["id", "p"]
