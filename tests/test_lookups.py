"""Lookups in sorted intervals and running counts against plain loops."""

import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from meshledger.functions import addresses
from meshledger.operators.activity import count_days_inside


def test_addresses_next_to_every_block_end(spark):
    v4 = [ipaddress.ip_network(b) for b in addresses.NOT_GLOBAL_V4]
    v6 = [ipaddress.ip_network(b) for b in addresses.NOT_GLOBAL_V6]
    cases = {}
    for nets, kind, top in ((v4, ipaddress.IPv4Address, 2**32), (v6, ipaddress.IPv6Address, 2**128)):
        for n in nets:
            for at in (int(n.network_address) + k for k in (-1, 0, 1)):
                cases.setdefault(at % top, kind)
            for at in (int(n.broadcast_address) + k for k in (-1, 0, 1)):
                cases.setdefault(at % top, kind)
        rows = [(a, str(kind(a)), any(kind(a) in n for n in nets)) for a, k in cases.items() if k is kind]
        rows += [(a, kind(a).exploded.upper(), local) for a, _, local in rows]
        got = addresses.mark_local(spark.createDataFrame([(t, w) for _, t, w in rows], "ip string, want boolean"), "ip").where("local <> want").collect()
        assert got == []
    odd = spark.createDataFrame([(None,), ("",), ("1.2.3",), ("::g",)], "ip string")
    assert [r.local for r in addresses.mark_local(odd, "ip").collect()] == [False] * 4


def test_intervals_are_sorted_and_disjoint():
    for blocks in (addresses.NOT_GLOBAL_V4, addresses.NOT_GLOBAL_V6, ("10.0.0.0/8", "10.1.0.0/16", "11.0.0.0/8")):
        spans = addresses.intervals(blocks)
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
    assert len(addresses.intervals(("10.0.0.0/8", "10.1.0.0/16", "11.0.0.0/8"))) == 1


def test_days_inside_spans(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    days = [(start + dt.timedelta(days=rng.randint(0, 40))).date() for _ in range(25)]
    spans = []
    for k in range(200):
        lo = start + dt.timedelta(days=rng.randint(-5, 45), seconds=rng.choice((0, 0, 1, 40_000)))
        spans.append((k, lo, lo + dt.timedelta(days=rng.randint(0, 30), seconds=rng.choice((0, 1, 86_399)))))
    spans += [(900, None, start), (901, start, None), (902, start + dt.timedelta(days=9), start)]
    df = spark.createDataFrame(spans, "k int, lo timestamp_ntz, hi timestamp_ntz")
    midnight = [dt.datetime.combine(d, dt.time()) for d in set(days)]
    want = {k: None if lo is None or hi is None else sum(lo <= d <= hi for d in midnight) for k, lo, hi in spans}
    table = spark.createDataFrame([(d,) for d in days], "day date")
    found = count_days_inside(df, table, "lo", "hi", "n")
    assert {r.k: r.n for r in found.collect()} == want
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()
    none = count_days_inside(df, table.limit(0), "lo", "hi", "n").where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    assert {r.n for r in none.collect()} == {0}
