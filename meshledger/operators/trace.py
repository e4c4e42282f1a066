"""Call-setup (STUN) tracing: which flows belong to a call that was set up just before.

A setup flow (UDP to port 3478) opens its user port for a minute. A flow of an unknown or
generic class on an open port is relabelled, and keeps its own 5-tuple open until some
seconds after its end; later flows of that 5-tuple are relabelled too, and so on.

The chain along one 5-tuple is sequential. It is cut into buckets of time: inside a bucket the
flows are folded from a closed state, and the effect of an open state on a whole bucket turns
out to need three numbers only (see ``_bucket_effects``), so the buckets of a 5-tuple are then
folded over a table whose size is bounded by the calendar. Both folds stream over sorted rows
and keep a constant state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions import rules as R
from meshledger.operators.classify import is_call_setup
from meshledger.operators.scans import (
    ROWS_PER_BUCKET,
    by_time,
    ordered_scan,
    running_max,
    with_bucket,
)
from meshledger.session import cut_lineage

_TUPLE = ["user_id", "user_port", "dest_port", "protocol", "dest_ip"]
_CLOSED = -(2**62)

# The folds below travel to the workers with their code, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unknown_peer() -> Column:
    unknown = F.col("category").isin(R.NO_DNS, R.NOT_MAPPED) & F.col("org").contains("Unknown")
    return unknown | F.col("fqdn").contains(R.HINET)


def generic_service() -> Column:
    return (
        F.col("fqdn").contains("turnservice")
        | F.col("fqdn").contains("facebook")
        | (F.col("org") == "Facebook")
        | F.col("category").isin(R.NOT_MAPPED, "API")
    )


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp."""
    elapsed = F.col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (elapsed.cast("interval second").cast("decimal(18,6)") * 1000000).cast("bigint")


def _fold_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (tuple, bucket), from a closed state: is the cohort reached, and where does its
    stretch of overlapping cohorts begin?"""
    group, open_until, cover_until, stretch = None, _CLOSED, _CLOSED, 0
    for batch in batches:
        reached, stretches = [], []
        rows = zip(
            *[batch[c].array for c in (*_TUPLE, "bucket")], batch["start_us"].array,
            batch["end_us"].array, batch["seed"].array,
        )
        for *key, start, end, seed in rows:
            if key != group:
                group, open_until, cover_until = key, _CLOSED, _CLOSED
            if start >= cover_until:
                stretch = start
            cover_until = max(cover_until, end)
            hit = bool(seed) or open_until > start
            if hit:
                open_until = max(open_until, end)
            reached.append(hit)
            stretches.append(stretch)
        yield batch.assign(reached=reached, stretch_us=stretches)


def _fold_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per tuple, bucket by bucket: until when is the tuple open when the bucket begins?"""
    group, open_until = None, _CLOSED
    for batch in batches:
        before = []
        rows = zip(
            *[batch[c].array for c in _TUPLE], batch["open_alone_us"].array,
            batch["last_stretch_us"].array, batch["cover_us"].array,
        )
        for *key, alone, last_stretch, cover in rows:
            if key != group:
                group, open_until = key, _CLOSED
            before.append(open_until)
            carried = cover if open_until > last_stretch else open_until
            open_until = max(open_until, carried, _CLOSED if pd.isna(alone) else int(alone))
        yield batch[[*_TUPLE, "bucket"]].assign(open_before_us=before)


def _bucket_effects(folded: DataFrame) -> DataFrame:
    """What a bucket does to the state that enters it.

    Taken alone, a bucket is a row of disjoint stretches of overlapping cohorts. A state that
    is still open when a stretch begins runs through that whole stretch; only the last stretch
    can reach out of the bucket. So the state after is the largest of: the state before, what
    the bucket's own seeds leave open, and the bucket's cover if the state before was open at
    the last stretch's begin.
    """
    return folded.groupBy(*_TUPLE, "bucket").agg(
        F.max(F.when(F.col("reached"), F.col("end_us"))).alias("open_alone_us"),
        F.max("stretch_us").alias("last_stretch_us"),
        F.max("end_us").alias("cover_us"),
    )


def traced_cohorts(
    flows: DataFrame, setup_validity_s: int = 60, chain_validity_s: int = 5, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The (5-tuple, start) cohorts that are reached by a call setup."""
    marked = flows.select(
        *_TUPLE, "start_ts", "end_ts",
        is_call_setup().alias("setup"),
        (unknown_peer() | generic_service()).alias("open_class"),
    )
    # Distinct cohorts first: repeats on a hot port collapse before the ordered scan.
    cohorts = marked.groupBy(*_TUPLE, "start_ts", "setup", "open_class").agg(
        F.max("end_ts").alias("end_ts")
    ).withColumn("turn", F.when(F.col("setup"), 0).otherwise(1))
    cohorts = cut_lineage(cohorts, "cohorts")
    validity = F.lit(setup_validity_s * 1_000_000)
    seeded = ordered_scan(
        cohorts,
        ["user_id", "user_port"],
        ["start_ts", "turn", "dest_port", "protocol", "dest_ip", "open_class"],
        by_time("start_ts", rows_per_bucket),
        {"setup_ts": running_max(F.when(F.col("setup"), F.col("start_ts")))},
    ).where(~F.col("setup") & F.col("open_class"))
    timed = seeded.select(
        *_TUPLE,
        "start_ts",
        micros("start_ts").alias("start_us"),
        (micros("end_ts") + F.lit(chain_validity_s * 1_000_000)).alias("end_us"),
        F.coalesce(micros("start_ts") - micros("setup_ts") < validity, F.lit(False)).alias("seed"),
    )
    timed = cut_lineage(timed, "seeds")
    # Only tuples with a seed, from their first seed on, can change.
    first_seed = (
        timed.where("seed").groupBy(*_TUPLE).agg(F.min("start_us").alias("first_seed_us"))
    )
    timed = timed.join(first_seed, _TUPLE).where("start_us >= first_seed_us").drop("first_seed_us")
    timed = with_bucket(timed, by_time("start_ts", rows_per_bucket), "bucket")

    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in timed.schema.fields
    )
    folded = (
        timed.repartition(*_TUPLE, "bucket")
        .sortWithinPartitions(*_TUPLE, "bucket", "start_us")
        .mapInPandas(_fold_inside, f"{columns}, reached boolean, stretch_us bigint")
    )
    folded = cut_lineage(folded, "reached")
    effects = _bucket_effects(folded)
    keys = ", ".join(
        f"{f.name} {f.dataType.simpleString()}"
        for f in timed.schema.fields
        if f.name in (*_TUPLE, "bucket")
    )
    key_order = [f.name for f in timed.schema.fields if f.name in (*_TUPLE, "bucket")]
    states = (
        effects.repartition(*_TUPLE)
        .sortWithinPartitions(*_TUPLE, "bucket")
        .mapInPandas(_fold_buckets, f"{keys}, open_before_us bigint")
        .select(*key_order, "open_before_us")
    )
    reached = F.col("reached") | (F.col("open_before_us") > F.col("stretch_us"))
    return (
        folded.join(states, [*_TUPLE, "bucket"])
        .where(reached)
        .select(*_TUPLE, "start_ts", F.lit(True).alias("in_call"))
    )


def trace_ice(
    flows: DataFrame,
    setup_validity_s: int = 60,
    chain_validity_s: int = 5,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    collapse_duplicates: bool = True,
) -> DataFrame:
    """Relabel flows that belong to a call. Exact repeats of a flow collapse, unless told not to."""
    base = flows.dropDuplicates() if collapse_duplicates else flows
    cohorts = traced_cohorts(base, setup_validity_s, chain_validity_s, rows_per_bucket)
    joined = base.join(cohorts, [*_TUPLE, "start_ts"], "left")
    hit = F.coalesce("in_call", F.lit(False)) & ~is_call_setup()
    peer, service = hit & unknown_peer(), hit & ~unknown_peer() & generic_service()
    return joined.withColumns(
        {
            "org": F.when(peer, R.ICE_PEER_ORG).otherwise(F.col("org")),
            "category": F.when(peer, R.PEER_TO_PEER).when(service, R.ICE).otherwise(
                F.col("category")
            ),
        }
    ).select(*base.columns)
