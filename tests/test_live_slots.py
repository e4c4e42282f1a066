"""The live call trace files flows by slots of time: many due at once cost one step, the order stays that of time."""

import random
from datetime import datetime, timedelta
from itertools import groupby

import pandas as pd
import pytest

from meshledger.streaming import live
from test_live import _Expired, _Handle

SETUP, CHAIN = 60_000_000, 5_000_000


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def _expected(flows):
    """All flows in order of time, each cohort judged by those before it."""
    setup, until, out = None, {}, {}
    for now, cohort in groupby(sorted(flows, key=lambda r: r[0]), key=lambda r: r[0]):
        cohort = list(cohort)
        setup = now if any(r[2] for r in cohort) else setup
        hits = [r for r in cohort if not r[2] and (r[3] or r[4])
                and (setup is not None and now - setup < SETUP or until.get(r[5], 0) > now)]
        out |= {r[6]: (r[7], r[8]) for r in cohort}
        out |= {r[6]: ("peer", "p2p") if r[3] else (r[7], "ice") for r in hits}
        for r in hits:
            until[r[5]] = max(until.get(r[5], 0), r[1] + CHAIN)
    return out


def _run(batches, levels):
    """Micro-batches of (rows, watermark): rows first, then the timers that had expired when they came."""
    tracer, handle, out, steps = live._CallTracer(SETUP, CHAIN, ("peer", "p2p", "ice"), levels), _Handle(), {}, 0
    tracer.init(handle)
    for rows, watermark in batches:
        frames = [pd.DataFrame(rows[k:k + 50], columns=live._COLUMNS) for k in range(0, len(rows), 50)]
        list(tracer.handleInputRows(None, iter(frames), _Watermark(watermark)))
        for at in sorted(t for t in handle.timers if t <= watermark):
            steps += 1
            for frame in tracer.handleExpiredTimer(None, _Watermark(watermark), _Expired(at)):
                for event_id, org, category in frame.itertuples(index=False, name=None):
                    assert event_id not in out
                    out[event_id] = org, category
            handle.timers.discard(at)
    return out, steps, handle


def _flows(rng, number, span_ms):
    base = 1_706_000_000_000
    made = []
    for k in range(number):
        start = (base + rng.randrange(span_ms)) * 1000 + rng.randrange(3)
        made.append((start, start + rng.randrange(3_000_000), rng.random() < .05, rng.random() < .4, rng.random() < .3,
                     f"f{rng.randrange(6)}", k, f"org{k % 3}", "cat"))
    return made


@pytest.mark.parametrize("seed,span_ms", [(1, 400), (2, 40_000), (3, 4_000_000), (4, 4_000_000_000)])
def test_slots_follow_flows_in_the_order_of_time(seed, span_ms):
    rng = random.Random(seed)
    flows = _flows(rng, 3000, span_ms)
    # out of order by up to a tenth of the span; a watermark lags by that much, and by a batch
    arrived = sorted(flows, key=lambda r: r[0] + rng.random() * span_ms * 100)
    batches, watermark = [], 0
    for k in range(0, 3000, 250):
        batches.append((arrived[k:k + 250], watermark))
        watermark = max(watermark, max(r[0] for r in arrived[k:k + 250]) // 1000 - span_ms // 10)
    end = max(r[0] for r in flows) // 1000 + 1
    batches += [([], watermark), ([], end)]
    want = _expected(flows)
    for levels in (1, 2, live._LEVELS):
        got, _, handle = _run(batches, levels)
        assert got == want
        assert not handle.maps["waiting"].held and not handle.maps["waiting_parts"].held
        assert len(handle.maps["open_until"].held) == sum(len(v[0]) for v in handle.maps["closing"].held.values())
    # when their time comes, far ends are forgotten
    _, _, handle = _run([*batches, *[([], end + 100_000 * k) for k in range(1, 4)]], live._LEVELS)
    assert not handle.maps["open_until"].held and not handle.maps["closing"].held


def test_flows_due_at_once_are_one_step():
    flows = _flows(random.Random(5), 500, 2_000_000_000)
    got, steps, handle = _run([(flows, 0), ([], 1_800_000_000_000)], live._LEVELS)
    assert got == _expected(flows)
    waiting = handle.maps["waiting"]
    # ten parts came, ten were read; before, each flow was an entry, a timer and a step of its own
    assert steps <= 10 and waiting.reads == 10


def test_a_slot_of_many_parts_is_cut_before_it_is_read(monkeypatch):
    monkeypatch.setattr(live, "_PART_ROWS", 50)
    flows = _flows(random.Random(6), 20_000, 2_000_000_000)
    middle = sorted(r[0] for r in flows)[10_000] // 1000
    most = 0
    follow = live._CallTracer._follow

    def counted(self, some):
        nonlocal most
        most = max(most, len(some))
        return follow(self, some)

    monkeypatch.setattr(live._CallTracer, "_follow", counted)
    got, _, handle = _run([(flows, 0), ([], middle), ([], 1_800_000_000_000)], live._LEVELS)
    assert got == _expected(flows)
    assert most <= 100 * live._PARTS
    # each flow came down by a few levels, as one of many in a part
    assert handle.maps["waiting"].reads < 20_000


def test_a_flow_of_the_millisecond_before_the_last_goes_out(spark, tmp_path):
    start = datetime(2024, 3, 1)
    rows = [(k, start + timedelta(milliseconds=ms)) for k, ms in enumerate([0, 70_000, 70_001, 70_002])]
    spark.createDataFrame(rows, "event_id long, start_ts timestamp_ntz").selectExpr(
        "event_id", "start_ts", "start_ts AS end_ts", "1L AS user_id", "40000 AS user_port", "3478 AS dest_port",
        "17 AS protocol", "'203.0.113.5' AS dest_ip", "'' AS fqdn", "'org' AS org", "'cat' AS category",
    ).coalesce(1).write.parquet(str(tmp_path / "flows"))
    schema = spark.read.parquet(str(tmp_path / "flows")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "flows"))
    traced = live.run_to_end(live.trace_stream(stream, delay="0 seconds"), "slots")
    assert sorted(r.event_id for r in traced.collect()) == [0, 1, 2]
