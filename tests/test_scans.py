"""Running columns against plain pandas, with one hot key and one crowded moment."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshledger.operators import scans
from meshledger.operators.stats import cdf, quantiles, rank_bins, value_distribution, with_rank

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(5)
    n = 900
    # A third of the rows belong to one key, a third to one minute.
    seconds = np.where(rng.random(n) < 0.33, 7200 + rng.integers(0, 60, n), rng.integers(0, 864000, n))
    frame = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.33, 0, rng.integers(1, 40, n)),
        "ts": [START + dt.timedelta(seconds=int(s)) for s in seconds],
        "id": np.arange(n),
        "v": rng.integers(-50, 50, n),
    })
    frame["maybe"] = [None if r < 0.6 else int(v) for r, v in zip(rng.random(n), frame["v"])]
    return frame


@pytest.fixture(scope="module")
def table(spark, events):
    rows = [
        (int(r.k), r.ts.to_pydatetime(), int(r.id), int(r.v), None if pd.isna(r.maybe) else int(r.maybe))
        for r in events.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, id bigint, v bigint, maybe bigint")


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_running_columns_equal_pandas(table, events, rows):
    got = scans.ordered_scan(
        table, ["k"], ["ts", "id"], scans.by_time("ts", rows),
        {
            "total": scans.running_sum("v"), "top": scans.running_max("v"),
            "top_before": scans.running_max("v", strict=True), "low": scans.running_min("v"),
            "low_ahead": scans.min_ahead("v"), "known": scans.last_known("maybe"),
            "coming": scans.next_known("maybe"), "before": scans.previous("v"),
            "after": scans.following("v"), "ts_before": scans.previous_time("ts"),
            "ts_after": scans.following_time("ts"), "whole": scans.key_total("v"),
        },
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = events.sort_values(["k", "ts", "id"]).copy()
    g = want.groupby("k")
    want["total"], want["top"], want["low"] = g.v.cumsum(), g.v.cummax(), g.v.cummin()
    want["top_before"] = want.groupby("k").top.shift(1)
    want["low_ahead"] = want[::-1].groupby("k").v.cummin()[::-1]
    want["maybe"] = want["maybe"].astype(float)
    want["known"], want["coming"] = want.groupby("k").maybe.ffill(), want.groupby("k").maybe.bfill()
    want["before"], want["after"] = g.v.shift(1), g.v.shift(-1)
    want["ts_before"], want["ts_after"] = g.ts.shift(1), g.ts.shift(-1)
    want["whole"] = g.v.transform("sum")
    want = want.sort_values("id").reset_index(drop=True)
    for column in ("total", "top", "top_before", "low", "low_ahead", "known", "coming", "before",
                   "after", "whole"):
        pd.testing.assert_series_equal(
            got[column].astype(float), want[column].astype(float), check_names=False, obj=column
        )
    for column in ("ts_before", "ts_after"):
        assert (got[column].fillna(START) == want[column].fillna(START)).all(), column


def test_scan_without_keys(table, events):
    got = scans.ordered_scan(
        table, [], ["ts", "id"], scans.by_time("ts", 11), {"total": scans.running_sum("v")}
    ).toPandas().sort_values("id")
    want = events.sort_values(["ts", "id"]).assign(total=lambda f: f.v.cumsum()).sort_values("id")
    assert got["total"].tolist() == want["total"].tolist()


def test_buckets_split_the_hot_key_and_the_crowded_minute(table):
    sizes = scans.with_bucket(table, scans.by_time("ts", 50), "b").groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 110
    order = scans.with_bucket(table, scans.by_time("ts", 50), "b").toPandas().sort_values(["ts", "b"])
    assert order["b"].is_monotonic_increasing


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([(None, 1, 5), (1, 1, 7)], "k int, o int, v int")
    out = scans.ordered_scan(df, ["k"], ["o"], F.lit(0), {"s": scans.running_sum("v")}).collect()
    assert [tuple(r) for r in out] == [(1, 1, 7, 7)]


@pytest.mark.parametrize("rows", [1, 9, 10_000])
def test_sessions_follow_gaps_through_buckets(table, events, rows):
    gap = 3000.0
    got = scans.sessionize(
        table, ["k"], ["ts", "id"], "ts",
        lambda last, ts: (ts - last).cast("interval second").cast("decimal(18,6)") >= gap, rows,
    ).select("id", F.col("session.id").alias("s")).toPandas().sort_values("id")
    want = events.sort_values(["k", "ts", "id"]).copy()
    opens = want.groupby("k").ts.diff().dt.total_seconds()
    want["s"] = want["id"].where(opens.isna() | (opens >= gap))
    want["s"] = want.groupby("k").s.ffill().astype(int)
    assert got["s"].tolist() == want.sort_values("id")["s"].tolist()


def test_distribution_ends_at_one_and_never_falls(table, events):
    rows = cdf(table, "v").orderBy("value").collect()
    assert rows[-1]["cdf"] == 1.0
    assert all(a["cdf"] < b["cdf"] for a, b in zip(rows, rows[1:]))
    assert sum(r["base_count"] for r in rows) == len(events)
    assert [r["value"] for r in rows] == sorted(events.v.unique())


def test_keyed_quantiles_equal_pandas(table, events):
    got = quantiles(table, "v", {"a": 0.5, "b": 0.9}, ["k"]).toPandas().set_index("k").sort_index()
    want = events.groupby("k").v.quantile([0.5, 0.9]).unstack()
    np.testing.assert_allclose(got[["a", "b"]].values, want.values)


def test_ranks_and_bins_equal_pandas(table, events):
    ranked = with_rank(with_rank(table, "v", "r"), "v", "share", descending=True, share=True)
    got = rank_bins(ranked, "r", "bin").toPandas().sort_values("id")
    want = events.sort_values("id")
    r = want.v.rank(method="min")
    assert got["r"].tolist() == r.astype(int).tolist()
    np.testing.assert_allclose(got["share"], want.v.rank(method="min", ascending=False, pct=True))
    assert got["bin"].tolist() == (pd.cut(r, 10, right=False, labels=False) + 1).tolist()


def test_distribution_table_totals(table, events):
    rows = value_distribution(table, "v", ["k"]).toPandas()
    assert (rows.groupby("k").n.sum() == rows.groupby("k").n_total.first()).all()
    assert rows.n.sum() == len(events)
