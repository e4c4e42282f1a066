"""Rows of a live feed out of order: written, repeated or late, none lost without a count."""

import os
from datetime import datetime, timedelta

import pandas as pd
import pytest

from meshledger.streaming import live

START = datetime(2024, 3, 1)


def _feed(spark, tmp_path, batches):
    """A stream of one micro-batch for each list of (event_id, hours after START)."""
    schema = "event_id long, start_ts timestamp_ntz"
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(i, START + timedelta(hours=h)) for i, h in rows], schema)
        path = str(tmp_path / "feed" / f"{k}")
        made.coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_000_000 + k, 1_000_000 + k))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .parquet(str(tmp_path / "feed")))


def test_rows_of_a_feed_out_of_order_add_up(spark, tmp_path):
    batches = [
        [(1, 0), (2, 1), (2, 1)],
        [(3, 20), (1, 0)],  # 1 comes again while the watermark is low
        [(4, 2), (5, 21)],  # Spark judges lateness by the watermark one batch back, which is still low for 4
        [(3, 20), (6, 22), (7, 3), (8, 19)],  # and behind which 7 falls now
    ]
    stream = live.dedup_stream(_feed(spark, tmp_path, batches), "start_ts", ["event_id"], "4 hours")
    written, counts = live.run_counted(stream, "counted")
    got = sorted(r.event_id for r in written.collect())
    assert got == [1, 2, 3, 4, 5, 6, 8]
    assert counts == {"rows_in": 11, "late": 1, "repeats": 3}
    assert counts["rows_in"] == len(got) + counts["late"] + counts["repeats"]


def test_counts_that_lack_a_batch_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = live.dedup_stream(_feed(spark, tmp_path, [[(k, k)] for k in range(4)]), "start_ts", ["event_id"])
        with pytest.raises(RuntimeError):
            live.run_counted(stream, "short")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


class _Map:
    """A map of a processor's state that counts what is read."""

    def __init__(self):
        self.held, self.reads = {}, 0

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):
        state = _Map()
        state.exists, state.get = lambda: 0 in state.held, lambda: state.held[0]
        state.update = lambda value: state.held.__setitem__(0, value)
        return state

    def registerTimer(self, at):
        self.timers.add(at)


class _Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_timer_of_a_hot_port_touches_due_flows_only():
    tracer, handle = live._CallTracer(60_000_000, 5_000_000, ("peer", "p2p", "ice")), _Handle()
    tracer.init(handle)
    flows = [(k * 500_000, k * 500_000 + 1000, k == 0, k % 2 == 1, False, f"f{k % 500}", k, "org", "cat") for k in range(100_000)]
    list(tracer.handleInputRows(None, iter([pd.DataFrame(flows[::-1], columns=live._COLUMNS)]), None))
    waiting, timers = handle.maps["waiting"], sorted(handle.timers)
    assert len(waiting.held) == len(timers) == 100_000
    out = []
    for at in timers[:300]:
        waiting.reads = handle.maps["open_until"].reads = 0
        out += list(tracer.handleExpiredTimer(None, None, _Expired(at)))[0].itertuples(index=False, name=None)
        assert waiting.reads == 1 and handle.maps["open_until"].reads <= 2
    assert len(waiting.held) == 99_700
    # open for a minute after the setup: 120 flows, of which every other one is an unknown peer
    assert [r[0] for r in out] == list(range(300))
    assert [r[0] for r in out if r[1] == "peer"] == list(range(1, 120, 2))
    # closed far ends are forgotten when their time comes
    for at in sorted(handle.timers - set(timers)):
        list(tracer.handleExpiredTimer(None, None, _Expired(at)))
    assert not handle.maps["open_until"].held and not handle.maps["closing"].held
