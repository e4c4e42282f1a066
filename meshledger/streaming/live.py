"""Live forms of deduplication, binned bytes and call tracing.

Tables carry wall-clock times; the watermark runs on their UTC reading.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from meshledger import session
from meshledger.functions import rules as R
from meshledger.operators.classify import is_call_setup
from meshledger.operators.trace import generic_service, micros, unknown_peer

# The processor travels to the workers with its code, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COLUMNS = ["start_us", "end_us", "setup", "peer", "service", "far", "event_id", "org", "category"]
_FLOWS = """flows array<struct<start_us: long, end_us: long, setup: boolean, peer: boolean, service: boolean, far: string,
  event_id: long, org: string, category: string>>"""
# A slot of level k holds 2 ** (_DIGIT * k) milliseconds; the longest of _LEVELS levels holds two years. Up to
# _PARTS parts of a slot, each of about an Arrow batch at most, are read at once; parts made by cutting a slot
# have _PART_ROWS flows where there are as many.
_DIGIT, _LEVELS, _PARTS, _PART_ROWS = 6, 7, 16, 2000


def dedup_stream(
    stream: DataFrame, ts: str, keys: Sequence[str] | None = None, delay: str = "4 hours"
) -> DataFrame:
    """Drop repeats that arrive within ``delay`` of the first copy; state is kept no longer."""
    columns = stream.columns
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp"))
    once = timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys or columns))
    return once.select(*columns)


def binned_bytes_stream(
    stream: DataFrame, ts: str, keys: Sequence[str], width: str = "1 day", delay: str = "4 hours"
) -> DataFrame:
    """Bytes up and down per time bin and key; in append mode sent out once the bin can get no more rows."""
    return (
        stream.withColumn("event_time", F.col(ts).cast("timestamp"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width), *keys)
        .agg(F.sum("bytes_up").alias("bytes_up"), F.sum("bytes_down").alias("bytes_down"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("bin_start"), *keys, "bytes_up",
            "bytes_down",
        )
    )


class _Slots:
    """Entries of a key, filed by the first millisecond of a slot of time and in parts: what is added to a slot
    reads none of its entries. A slot has a timer."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        self.handle = handle
        self.entries = handle.getMapState(name, "at_ms long, part int", kind)
        self.parts = handle.getMapState(f"{name}_parts", "at_ms long", "parts int, level int")

    def add(self, at_ms: int, entries: list, level: int = 0) -> None:
        if not self.entries.containsKey((at_ms, 0)):
            self.put(at_ms, 0, entries)
            self.leave(at_ms, 1, level)
        else:
            parts = self.size(at_ms)[0]
            self.put(at_ms, parts, entries)
            self.parts.updateValue((at_ms,), (parts + 1, level))

    def put(self, at_ms: int, part: int, entries: list) -> None:
        self.entries.updateValue((at_ms, part), (entries,))

    def leave(self, at_ms: int, parts: int, level: int) -> None:
        """Ask for the timer that takes the parts put into a slot out."""
        self.handle.registerTimer(at_ms + 1)
        if parts > 1:
            self.parts.updateValue((at_ms,), (parts, level))

    def size(self, at_ms: int) -> tuple[int, int]:
        """The parts of a slot and its level, which is kept for several parts only."""
        if not self.entries.containsKey((at_ms, 0)):
            return 0, 0
        return tuple(self.parts.getValue((at_ms,))) if self.parts.containsKey((at_ms,)) else (1, 0)

    def take(self, at_ms: int, parts: int) -> Iterator[list]:
        """The entries of each part, which goes before the next is read."""
        if parts > 1 and self.parts.containsKey((at_ms,)):
            self.parts.removeKey((at_ms,))
        for part in range(parts):
            entries = self.entries.getValue((at_ms, part))[0]
            self.entries.removeKey((at_ms, part))
            yield entries


class _CallTracer(StatefulProcessor):
    """Follows the calls of one user port.

    Flows wait, filed by their start, until the watermark has passed it. The farther ahead a start is, the
    longer its slot: up to ``levels`` lengths, of 64 to the power of the level milliseconds (one level: the
    millisecond itself). A slot's timer is its first millisecond; once it comes, the due flows are followed
    cohort by cohort and the others move to shorter slots, so a flow is read at most once a level and a
    watermark that passes many flows at once takes them in one step. Slots never overlap, for all are cut by the
    last millisecond done when flows last moved (``done``), which none of them holds. Of a slot with many parts
    no more than a few are read at once: it is cut into shorter ones first.

    Other state: when the last setup was, until when each far end is open, and which far ends close until a
    time, so that a timer forgets those, too. What waits or is open but not due is read when it moves only.
    """

    def __init__(self, setup_us: int, chain_us: int, names: tuple[str, str, str], levels: int = 1):
        self.setup_us, self.chain_us, self.levels = setup_us, chain_us, levels
        self.peer_org, self.peer_category, self.ice = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = _Slots(handle, "waiting", _FLOWS)
        self.last_setup = handle.getValueState("last_setup", "at long")
        self.done = handle.getValueState("done", "at_ms long")
        self.open_until = handle.getMapState("open_until", "far string", "at long")
        self.closing = _Slots(handle, "closing", "fars array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.levels > 1 and self.done.exists() else 0
        for batch in rows:
            self._file(sorted(zip(*[batch[c].tolist() for c in _COLUMNS]), key=_start), done)
        return iter(())

    def _file(self, flows: list, done: int) -> None:
        """File flows in order of time."""
        for (at_ms, level), some in groupby(flows, key=lambda r: self._slot(int(r[0] // 1000), done)):
            self.waiting.add(at_ms, list(some), level)

    def _slot(self, at_ms: int, done: int) -> tuple[int, int]:
        """First millisecond and level of the longest slot that holds this millisecond and begins after ``done``."""
        level = min(((at_ms ^ done).bit_length() - 1) // _DIGIT, self.levels - 1) if at_ms > done else 0
        return at_ms >> _DIGIT * level << _DIGIT * level, level

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        passed = at_ms + 1 if self.levels == 1 else timerValues.getCurrentWatermarkInMs()
        for out in self._due(at_ms, *self.waiting.size(at_ms), passed):
            yield pd.DataFrame(out, columns=["event_id", "org", "category"])
        self._close(at_ms)

    def _due(self, at_ms: int, parts: int, level: int, passed: int) -> Iterator[list]:
        """Follow the flows of a slot that start before ``passed``; the others move to shorter slots."""
        if parts > _PARTS and level:
            yield from self._cut(at_ms, parts, level - 1, passed)
        elif parts:
            flows = sorted((tuple(f) for some in self.waiting.take(at_ms, parts) for f in some), key=_start)
            due = bisect_left(flows, passed * 1000, key=_start)
            if due:
                yield self._follow(flows[:due])
            if due < len(flows):
                self.done.update((passed - 1,))
                self._file(flows[due:], passed - 1)

    def _cut(self, at_ms: int, parts: int, level: int, passed: int) -> Iterator[list]:
        sizes, held, shift = {}, {}, _DIGIT * level

        def put(start: int) -> None:
            # the first shorter slot has the place of the whole, of which no fewer parts are gone
            self.waiting.put(start, sizes.get(start, 0), held.pop(start))
            sizes[start] = sizes.get(start, 0) + 1

        for some in self.waiting.take(at_ms, parts):
            for flow in some:
                held.setdefault(flow[0] // 1000 >> shift << shift, []).append(tuple(flow))
            for start in [s for s, flows in held.items() if len(flows) >= _PART_ROWS]:
                put(start)
        for start in list(held):
            put(start)
        for start in sorted(sizes):
            if start < passed:
                yield from self._due(start, sizes[start], level, passed)
            else:
                self.done.update((passed - 1,))
                self.waiting.leave(start, sizes[start], level)

    def _follow(self, flows: list) -> list:
        setup = self.last_setup.get()[0] if self.last_setup.exists() else None
        before, known, prolonged, out = setup, {}, set(), []
        for now, cohort in groupby(flows, key=_start):
            cohort = list(cohort)
            if any(r[2] for r in cohort):
                setup = now
            fresh = setup is not None and now - setup < self.setup_us
            opened = {}
            for _, end, is_setup, peer, service, far, event_id, org, category in cohort:
                # without a setup so far nothing is open
                if not is_setup and (peer or service) and setup is not None and (fresh or self._open(far, known) > now):
                    org = self.peer_org if peer else org
                    category = self.peer_category if peer else self.ice
                    opened[far] = max(opened.get(far, 0), end + self.chain_us)
                out.append((event_id, org, category))
            # What this cohort opens counts from the next one on.
            for far, at in opened.items():
                if at > max(now, self._open(far, known)):
                    known[far] = at, known[far][1]
                    prolonged.add(far)
        if setup != before:
            self.last_setup.update((setup,))
        # whatever follows starts after the last of these flows
        self._keep_open({far: known[far] for far in prolonged if known[far][0] > now}, now)
        return out

    def _open(self, far: str, known: dict[str, tuple[int, bool]]) -> int:
        """Until when a far end is open; ``known`` also holds whether the state has it."""
        if far not in known:
            stored = self.open_until.containsKey((far,))
            known[far] = self.open_until.getValue((far,))[0] if stored else 0, stored
        return known[far][0]

    def _keep_open(self, until: dict[str, tuple[int, bool]], now: int) -> None:
        closing = {}
        for far, (at, stored) in until.items():
            self.open_until.updateValue((far,), (at,))
            if not stored:
                closing.setdefault(_closing_ms(at, now), []).append(far)
        for at_ms, fars in closing.items():
            self.closing.add(at_ms, fars)

    def _close(self, at_ms: int) -> None:
        """Forget the far ends that are closed now; those prolonged since are filed again."""
        later = {}
        for fars in self.closing.take(at_ms, self.closing.size(at_ms)[0]):
            for far in fars:
                at = self.open_until.getValue((far,))[0]
                if at // 1000 <= at_ms:
                    self.open_until.removeKey((far,))
                else:
                    later.setdefault(_closing_ms(at, at_ms * 1000), []).append(far)
        for at, fars in later.items():
            self.closing.add(at, fars)

    def close(self) -> None:
        pass


def _start(flow: tuple) -> int:
    return flow[0]


def _closing_ms(at: int, now: int) -> int:
    """The millisecond of a time, or one after it by less than a quarter of the time until then, so that many share it."""
    shift = max((at // 1000 - now // 1000).bit_length() - 3, 0)
    return -(-(at // 1000) >> shift) << shift


def trace_stream(
    flows: DataFrame, setup_validity_s: int = 60, chain_validity_s: int = 5, delay: str = "1 minute"
) -> DataFrame:
    """Call labels of a live flow table, keyed by user and user port, in event time.

    A flow is sent out once the watermark has passed its start.
    """
    prepared = flows.select(
        "user_id", "user_port", F.col("start_ts").cast("timestamp").alias("event_time"),
        micros("start_ts").alias("start_us"), micros("end_ts").alias("end_us"),
        is_call_setup().alias("setup"), unknown_peer().alias("peer"),
        generic_service().alias("service"),
        F.concat_ws("|", "dest_port", "protocol", "dest_ip").alias("far"),
        "event_id", "org", "category",
    ).withWatermark("event_time", delay)
    tracer = _CallTracer(
        setup_validity_s * 1_000_000, chain_validity_s * 1_000_000,
        (R.ICE_PEER_ORG, R.PEER_TO_PEER, R.ICE), _LEVELS,
    )
    return prepared.groupBy("user_id", "user_port").transformWithStateInPandas(
        tracer, "event_id long, org string, category string", "append", "eventTime"
    )


def as_stream(spark: SparkSession, sf_dir: str, table: str, schema: StructType) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_to_last_state(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream over all there is now, and return the last state of every group.

    Groups the watermark has not closed yet are there, too: when a finite feed ends, nothing more
    comes for them. Each micro-batch writes the groups it changed under its number, so a repeated
    batch does no harm.
    """
    spark = stream.sparkSession
    path, marks = session.scratch_path(spark, label), session.scratch_path(spark, f"{label}-marks")

    def keep(changed: DataFrame, number: int) -> None:
        changed.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    running = (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", marks)
        .outputMode("update").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(f"{_ddl(stream)}, _batch int").parquet(path)
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in stream.columns])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _written_to_end(stream: DataFrame, label: str) -> tuple[DataFrame, StreamingQuery]:
    spark = stream.sparkSession
    path, marks = session.scratch_path(spark, label), session.scratch_path(spark, f"{label}-marks")
    running = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), running


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all there is now, and return what it wrote."""
    return _written_to_end(stream, label)[0]


def run_counted(stream: DataFrame, label: str) -> tuple[DataFrame, dict[str, int]]:
    """Run a deduplicating stream over all there is now: what it wrote, and where its rows went.

    ``rows_in`` are those read, ``late`` those that came behind the watermark and were dropped,
    ``repeats`` those dropped as repeats; ``rows_in`` = rows written + ``late`` + ``repeats`` where
    nothing before the deduplication filters. Raises if the session no longer holds the progress of every
    micro-batch (``spark.sql.streaming.numRecentProgressUpdates``), as counts would then lack some.
    """
    written, running = _written_to_end(stream, label)
    reports = [json.loads(p.json) for p in running.recentProgress]
    if reports and {p["batchId"] for p in reports} != set(range(reports[-1]["batchId"] + 1)):
        raise RuntimeError("progress of some micro-batches is gone: raise spark.sql.streaming.numRecentProgressUpdates")
    states = [state for p in reports for state in p["stateOperators"]]
    return written, {
        "rows_in": sum(p["numInputRows"] for p in reports),
        "late": sum(state["numRowsDroppedByWatermark"] for state in states),
        "repeats": sum(state.get("customMetrics", {}).get("numDroppedDuplicateRows", 0) for state in states),
    }
