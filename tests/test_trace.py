"""Call tracing against reachability from the call setups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meshledger.functions import rules as R
from meshledger.operators.trace import trace_ice
from meshledger.streaming import live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = """event_id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz, user_id bigint, dest_ip string,
  user_port int, dest_port int, protocol int, fqdn string, org string, category string"""
CLASSES = [("", R.NO_DNS, R.NO_DNS), ("x.example", R.NOT_MAPPED, R.NOT_MAPPED), ("a.facebook.com", "Facebook", "API"),
           ("v.example", "Vidio", "Video"), ("q.emome-ip.hinet.net", "HiNet", "IAAS"), ("p.turnservice", "Z", "Games")]


def random_flows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = T0 + dt.timedelta(seconds=rng.randrange(0, 400))
        setup = rng.random() < 0.08
        fqdn, org, category = rng.choice(CLASSES)
        rows.append((
            i, start, start + dt.timedelta(seconds=rng.choice([0, 1, 3, 8, 60])), rng.randrange(2), rng.choice(["1.1.1.1", "2.2.2.2"]),
            rng.choice([40000, 40001]), 3478 if setup else rng.choice([443, 9000]), 17 if setup else rng.choice([6, 17]),
            fqdn, org, R.ICE if setup else category,
        ))
    return rows


def in_call(rows, setup_s=60, chain_s=5):
    """Ids of the flows a call reaches, as the closure of two relations.

    Only flows of an open class can be reached. Such a flow is a seed when a setup from its user and
    port started at most ``setup_s`` before, that second not included. It reaches every later flow of
    its 5-tuple that starts less than ``chain_s`` after its end.
    """
    setup = lambda r: (r[7], r[6]) == (17, 3478)
    own = lambda r: (r[3], r[5])
    path = lambda r: (*own(r), r[6], r[7], r[4])
    open_ = [r for r in rows if not setup(r) and label(r) is not None]
    reached = {r[0] for r in open_ for s in rows if setup(s) and own(s) == own(r) and 0 <= (r[1] - s[1]).total_seconds() < setup_s}
    while True:
        more = {r[0] for r in open_ for a in open_ if a[0] in reached and path(a) == path(r)
                and r[1] > a[1] and (r[1] - a[2]).total_seconds() < chain_s} - reached
        if not more:
            return reached
        reached |= more


def label(r):
    """(org, category) of a flow in a call; None for classes that stay as they are."""
    if R.HINET in r[8] or (r[10] in (R.NO_DNS, R.NOT_MAPPED) and "Unknown" in r[9]):
        return R.ICE_PEER_ORG, R.PEER_TO_PEER
    if any(part in r[8] for part in ("turnservice", "facebook")) or r[9] == "Facebook" or r[10] in (R.NOT_MAPPED, "API"):
        return r[9], R.ICE
    return None


def labelled(rows):
    calls = in_call(rows)
    return {r[0]: label(r) if r[0] in calls else (r[9], r[10]) for r in rows}


@pytest.mark.parametrize("seed,rows_per_bucket", [(1, 1), (2, 5), (3, 40), (4, 10_000)])
def test_batch_trace_follows_the_rules(spark, seed, rows_per_bucket):
    rows = random_flows(seed, 500)
    got = trace_ice(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=rows_per_bucket).collect()
    want = labelled(rows)
    assert any(c == R.PEER_TO_PEER for _, c in want.values())
    assert {r["event_id"]: (r["org"], r["category"]) for r in got} == want


def test_long_chain_crosses_many_buckets(spark):
    rows = [(0, T0, T0, 1, "1.1.1.1", 40000, 3478, 17, "", R.NO_DNS, R.ICE)]
    for i in range(1, 300):
        start = T0 + dt.timedelta(seconds=4 * i)
        rows.append((i, start, start, 1, "9.9.9.9", 40000, 9000, 6, "", R.NO_DNS, R.NO_DNS))
    out = trace_ice(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=3)
    assert out.where(F.col("category") == R.PEER_TO_PEER).count() == 299


def test_exact_repeats_collapse_unless_told_not_to(spark):
    rows = random_flows(9, 30)
    df = spark.createDataFrame(rows + rows, SCHEMA)
    assert trace_ice(df).count() == 30
    assert trace_ice(df, collapse_duplicates=False).count() == 60


def test_live_trace_equals_batch_up_to_the_watermark(spark, tmp_path):
    rows = random_flows(6, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = live.run_to_end(live.trace_stream(stream, delay="0 seconds"), "trace")
    last = max(r[1] for r in rows)
    want = labelled(rows)
    sent = {r["event_id"]: (r["org"], r["category"]) for r in got.collect()}
    assert sent == {r[0]: want[r[0]] for r in rows if r[1] < last}
