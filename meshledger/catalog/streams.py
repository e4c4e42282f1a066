"""Streaming forms, run over the test tables as a stream to the end."""

from __future__ import annotations

from meshledger.catalog.base import Inputs, query
from meshledger.catalog.classes import few_peers, trace_sql
from meshledger.catalog.sql import using
from meshledger.operators.classify import classify_flows
from meshledger.sources import derived
from meshledger.streaming import live


def _live_flows(i: Inputs):
    events = live.as_stream(i.spark, i.sf_dir, "events", i.table("events").schema)
    return derived.flows_of(events).select("event_id", "start_ts", "category", "bytes_up", "bytes_down")


def _traced(i: Inputs):
    i.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    events = live.as_stream(i.spark, i.sf_dir, "events", i.table("events").schema)
    flows = few_peers(classify_flows(derived.flows_of(events), per_name=False))
    return live.run_to_end(live.trace_stream(flows, 21600, 43200, "0 seconds"), "trace")


def _deduplicated(i: Inputs):
    # Every flow arrives twice, from two feeds.
    both = _live_flows(i).unionByName(_live_flows(i))
    return live.run_to_end(live.dedup_stream(both, "start_ts", ["event_id"]), "dedup")


def _binned(width: str):
    def build(i: Inputs):
        bins = live.binned_bytes_stream(_live_flows(i), "start_ts", ["category"], width)
        return live.run_to_last_state(bins, "bins", ["bin_start", "category"])

    return query(build)


_BINS = """SELECT CAST(date_trunc('{0}', start_ts) AS TIMESTAMP) AS bin_start, category, CAST(sum(bytes_up) AS BIGINT) AS bytes_up,
  CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM flows GROUP BY 1, 2"""

# The state of a live trace needs this store.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

QUERIES = {
    # Flows go out once the watermark, in milliseconds, has passed their start.
    "live_call_trace": (
        query(_traced), f"""SELECT t.* FROM ({trace_sql(21600, 43200)}) t JOIN events e ON t.event_id = e.event_id
          WHERE e.ts < date_trunc('millisecond', (SELECT max(ts) FROM events))""",
    ),
    "live_deduplicated_flows": (
        query(_deduplicated), using("flows", "SELECT event_id, start_ts, category, bytes_up, bytes_down FROM flows"),
    ),
    "live_daily_bytes": (_binned("1 day"), using("flows", _BINS.format("day"))),
    "live_hourly_bytes": (_binned("1 hour"), using("flows", _BINS.format("hour"))),
}
