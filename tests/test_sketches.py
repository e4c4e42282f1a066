"""Merged summaries against exact results; candidates for the largest totals; few users by slots."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshledger.operators import sketches
from meshledger.operators.classify import k_anonymize


def test_merged_quantiles_keep_to_their_rank_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"))
    days = sketches.quantile_sketches(rows.unionByName(rows.select("day", F.lit(None).cast("long").alias("v"))), "v", ["day"])
    assert days.count() == 30
    exact = sorted(r.v for r in rows.collect())
    for r in sketches.merged_quantiles(days, [0.01, 0.5, 0.99]).collect():
        assert r.n == len(exact)
        assert abs(sum(v <= r.value for v in exact) / len(exact) - r.prob) <= sketches.RANK_ERROR


def test_no_rows_have_no_quantiles(spark):
    empty = spark.createDataFrame([], "day int, v long")
    days = sketches.quantile_sketches(empty, "v", ["day"])
    assert sketches.merged_quantiles(days, [0.5]).count() == 0
    assert sketches.merged_quantiles(days, [0.5], ["day"]).count() == 0


def test_merged_distinct_counts(spark):
    rows = spark.range(90_000).select((F.col("id") % 9).alias("day"), (F.col("id") % 20_011).alias("user"))
    got = sketches.merged_distinct(sketches.distinct_sketches(rows, "user", ["day"]), F.col("day") % 2, "users").collect()
    assert len(got) == 2 and all(abs(r.users - 20_011) <= sketches.DISTINCT_ERROR * 20_011 for r in got)


@pytest.mark.parametrize("buckets", [1, 7, 1 << 15])
@pytest.mark.parametrize("n", [1, 5, 10_000])
def test_candidates_hold_the_largest(spark, n, buckets):
    draw = random.Random(3)
    rows = [(None if k == 5 else f"k{k}", draw.randint(-3, 2000) // (1 + k)) for k in range(400) for _ in range(3)]
    rows += [("t1", 999), ("t2", 999), ("t3", 999), ("no", None)]
    found = sketches.heavy_candidates(spark.createDataFrame(rows, "key string, w long"), "key", F.col("w"), n, buckets)
    total, kept = defaultdict(int), defaultdict(int)
    for key, w in rows:
        total[key] += w or 0
    for r in found.collect():
        kept[r.key] += r.w or 0
    floor = sorted(total.values(), reverse=True)[:n][-1]
    assert {k: t for k, t in total.items() if t >= floor}.items() <= kept.items()
    assert all(total[k] == t for k, t in kept.items())
    if buckets > 1000 and n < 10:
        assert len(kept) < 60


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_few_users_by_slots(spark, k):
    rows = [(f"o{u}", f"u{v % u}" if u else None) for u in range(45) for v in range(60)] + [(None, "u1")]
    got = k_anonymize(spark.createDataFrame(rows, "org string, user_id string"), k=k, label="few")
    want = [(org if org is None or int(org[1:]) >= k else "few", user) for org, user in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
