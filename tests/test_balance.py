"""Data balance, ledgers and overlap counts: cases worked by hand and properties."""

import datetime as dt
import random

import pytest

from meshledger.operators import ledger as g

T0 = dt.datetime(2024, 1, 1)
EVENTS = """ts timestamp_ntz, end_ts timestamp_ntz, user_id string, type string, bytes_up bigint, bytes_down bigint,
  bytes_purchased bigint, row_id bigint"""


def random_events(seed, n=150):
    rng = random.Random(seed)
    times = rng.sample(range(20_000), n)
    rows = []
    for i, t in enumerate(times):
        user = "hot" if rng.random() < 0.5 else rng.choice("abc")
        ts = T0 + dt.timedelta(seconds=t)
        if rng.random() < 0.15:
            rows.append((ts, ts, user, "purchase", 0, 0, rng.randrange(1, 40) * 10, 0))
        else:
            down = 0 if rng.random() < 0.6 else rng.randrange(1, 200)
            rows.append((ts, ts + dt.timedelta(seconds=rng.randrange(0, 900)), user, "ext", rng.randrange(0, 9), down, 0, i))
    return rows


def secs(*at):
    return [T0 + dt.timedelta(seconds=a) for a in at]


def bought(t, amount, user="u"):
    return (*secs(t, t), user, "purchase", 0, 0, amount, 0)


def flow(start, end, down, up=0, user="u", row=0):
    return (*secs(start, end), user, "ext", up, down, 0, row)


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 10_000])
def test_balance_of_a_small_history(spark, rows_per_bucket):
    """Worked by hand: 60 are left before two failed flows, 40 of them cannot have been there, as the
    next purchase of 50 ends in a balance of 40 without a correction."""
    rows = [bought(0, 100), flow(10, 11, 40), flow(20, 21, 0, row=1), flow(22, 23, 0, row=2), bought(30, 50), flow(40, 41, 70, row=3)]
    out = g.data_balance(spark.createDataFrame(rows, EVENTS), 2, rows_per_bucket).orderBy("user_hist_i").collect()
    assert [(r["type"], r["net_bytes"], r["balance"]) for r in out] == [
        ("init", 0, 0), ("purchase", 100, 100), ("ext", -40, 60), ("tare", -40, 20), ("ext", 0, 20), ("ext", 0, 20), ("purchase", 50, 70), ("ext", -70, 0)]


def test_a_debt_is_lifted_from_the_start(spark):
    rows = [flow(5, 6, 30), bought(10, 20), flow(15, 16, 5, row=1)]
    out = g.data_balance(spark.createDataFrame(rows, EVENTS), 1).orderBy("user_hist_i").collect()
    assert [(r["type"], r["net_bytes"], r["balance"]) for r in out] == [
        ("init", 30, 30), ("ext", -30, 0), ("tare", 0, 0), ("purchase", 20, 20), ("ext", -5, 15)] or [
        r["type"] for r in out] == ["init", "ext", "purchase", "ext"] and [r["balance"] for r in out] == [30, 0, 20, 15]


@pytest.mark.parametrize("failed,tares", [(49, 0), (50, 1)])
def test_fifty_failed_flows_make_a_range(spark, failed, tares):
    rows = [bought(0, 1000), flow(10, 11, 100), *[flow(20 + k, 21 + k, 0, row=k + 1) for k in range(failed)], bought(500, 100),
            flow(510, 511, 1, row=99)]
    out = g.data_balance(spark.createDataFrame(rows, EVENTS))
    assert out.where("type = 'tare'").count() == tares


@pytest.mark.parametrize("seed,rows_per_bucket", [(1, 1), (2, 6), (3, 10_000), (4, 25)])
def test_balance_properties(spark, seed, rows_per_bucket):
    rows = random_events(seed)
    out = g.data_balance(spark.createDataFrame(rows, EVENTS), 2, rows_per_bucket).collect()
    assert any(r["type"] == "tare" for r in out)
    kept = {(r[2], r[0], r[7], r[3]): r[6] - r[4] - r[5] for r in rows}
    for user in {r[2] for r in rows}:
        mine = sorted((r for r in out if r["user_id"] == user), key=lambda r: r["user_hist_i"])
        assert [r["user_hist_i"] for r in mine] == list(range(len(mine)))
        assert [r["ts"] for r in mine] == sorted(r["ts"] for r in mine)
        running, after_tare = 0, []
        for r in mine:
            running += r["net_bytes"]
            assert r["balance"] == max(0, running)
            if r["type"] == "tare":
                assert r["net_bytes"] <= 0  # a tare only takes off
                after_tare = []
            # where a flow succeeded, and at a tare, the balance cannot be below zero
            if r["type"] == "tare" or r["type"] == "ext" and r["bytes_down"] > 0:
                assert running >= 0
                after_tare.append(running)
        changed = [r["net_bytes"] for r in mine if r["type"] in ("ext", "purchase")]
        assert sorted(changed) == sorted(v for (u, *_), v in kept.items() if u == user)
        if any(r["type"] == "tare" for r in mine):
            assert min(after_tare) == 0  # the last tare takes off all that was never needed again


def test_overlaps_count_touching_intervals(spark):
    """A range reaches from the end of the last flow that got data to the purchase; a failed flow
    touches it unless it ends before or starts after."""
    rows = [flow(0, 10, 5), flow(2, 9, 0, row=1), flow(3, 10, 0, row=2), flow(10, 11, 0, row=3), flow(5, 40, 0, row=4), flow(20, 25, 0, row=5),
            flow(30, 35, 0, row=6), flow(31, 33, 0, row=7), bought(30, 7), flow(1, 2, 3, user="v"), bought(50, 1, user="w")]
    got = g.likely_zero_ranges(spark.createDataFrame(rows, EVENTS), 0, 3).collect()
    assert [tuple(r) for r in got] == [("u", *secs(10, 30), 5)]


def test_balance_is_never_negative_and_purchases_add_up(spark):
    rows = random_events(11)
    out = g.data_balance(spark.createDataFrame(rows, EVENTS), 1_000).collect()
    assert min(r["balance"] for r in out) >= 0
    for user in {r[2] for r in rows}:
        mine = [r for r in out if r["user_id"] == user]
        last = max(mine, key=lambda r: r["user_hist_i"])
        assert last["balance"] == sum(r["net_bytes"] for r in mine)


TX = "event_id bigint, ts timestamp_ntz, kind string, user_id string, dest_user_id string, amount_bytes bigint, amount_idr bigint"


def test_currency_ledger_balances_and_lifts(spark):
    at = [T0 + dt.timedelta(hours=h) for h in range(5)]
    tx = spark.createDataFrame(
        [(1, at[0], "admin_topup", None, "shop", None, 100), (2, at[1], "user_transfer", "shop", "a", None, 30),
         (3, at[2], "purchase", "a", None, 10, 50), (4, at[3], "admin_transfer", "a", "a", None, 5)], TX)
    ledger = g.currency_ledger(tx, rows_per_bucket=1)
    rows = {(r["entry_id"], r["side"]): (r["user_id"], r["amount_idr"], r["balance"]) for r in ledger.collect()}
    assert rows == {(1, 0): ("shop", 100, 100), (2, 0): ("a", 30, 30), (2, 1): ("shop", -30, 70),
                    (3, 1): ("a", -50, -20), (4, 0): ("a", 5, -15), (4, 1): ("a", -5, -20)}
    lifted, early = g.correct_negative(ledger)
    assert [r["user_id"] for r in early.collect()] == ["a"]
    low = {r["user_id"]: r for r in lifted.groupBy("user_id").agg({"balance": "min", "corrected": "max"}).collect()}
    assert (low["a"]["min(balance)"], low["a"]["max(corrected)"]) == (0, True)
    assert low["shop"]["max(corrected)"] is False
