"""Ordered (running) computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(time)`` puts the whole history of one key in one
task. Here the order column (time or value) is cut into buckets, so the rows of one key spread
over many tasks:

1. the cut points follow the data (``Cut``): a bucket holds about the same number of rows of
   the whole table, so neither a hot key nor a busy hour makes a large (key, bucket) group,
2. the rows are dealt by (key, bucket) in one exchange, which the steps below all read (``dealt``),
   and every bucket is scanned by itself (``Window.partitionBy(key, bucket)``),
3. a one-row summary per bucket is scanned along the buckets of the key; it has one row per bucket, not per row,
4. the carried value is joined back on (key, bucket) and merged with the local one.

Keys must not be null; rows with a null key are left out, as in a group-by that drops nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from meshledger.functions.timebins import seconds_since_epoch, time_bucket, value_bucket

# Rows of the whole table per bucket; small enough for one task to sort in memory.
ROWS_PER_BUCKET = 1_000_000
_SLOT_SECONDS = 60
# Time slots: minutes as far as EXACT minutes from REFERENCE (about two years before and after),
# beyond that COARSE slots for each doubling of the distance. Whatever the time stamps are, there are
# at most 2 * (EXACT + 13 * COARSE), about 2.5 million slots.
REFERENCE = "2024-01-01"
EXACT, COARSE = 1 << 20, 1 << 14
_ALL_BEFORE = (Window.unboundedPreceding, -1)
_ALL_AFTER = (1, Window.unboundedFollowing)


@dataclass(frozen=True)
class Cut:
    """How to cut an order column into buckets of about ``rows`` rows.

    ``slot`` is a coarse bin of the order column whose number of values is bounded (``time_slot``, or
    logarithmic bins of a value), ``position`` the column as a number.
    """

    slot: Column
    position: Column
    rows: int = ROWS_PER_BUCKET


def time_slot(ts: str) -> Column:
    """Number of the minute, or of a wider slot far from REFERENCE; never falls along ``ts``."""
    minutes = time_bucket(ts, _SLOT_SECONDS) - F.lit(int(pd.Timestamp(REFERENCE).timestamp()) // _SLOT_SECONDS)
    far = F.abs(minutes)
    octave = F.floor(F.log2(far / F.lit(float(EXACT))))
    beyond = F.floor((far / (F.lit(float(EXACT)) * F.pow(F.lit(2.0), octave)) - 1) * COARSE)
    number = F.when(far < EXACT, far).otherwise(EXACT + octave * COARSE + beyond)
    return F.when(minutes < 0, -number).otherwise(number).cast("bigint")


def by_time(ts: str, rows: int = ROWS_PER_BUCKET) -> Cut:
    return Cut(time_slot(ts), seconds_since_epoch(ts), rows)


def by_value(value: str, rows: int = ROWS_PER_BUCKET) -> Cut:
    return Cut(value_bucket(value), F.col(value).cast("double"), rows)


def with_bucket(df: DataFrame, cut: Cut, out: str = "_bucket") -> DataFrame:
    """Add a bucket number that never falls along the order column.

    Rows are counted per slot; inside a slot the count is taken to grow evenly from its least
    to its greatest position. A crowded slot is thereby split, and quiet ones are merged. Rows
    without an order value get bucket -1, as nulls come first in an ordered window.
    """
    counted = (
        df.select(cut.slot.alias("_slot"), cut.position.alias("_at"))
        .where(F.col("_slot").isNotNull())
        .groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    )
    # One row per slot: by the bound of ``Cut`` small enough for one window and a broadcast.
    before = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(*_ALL_BEFORE))
    slots = counted.withColumn("_before", F.coalesce(before, F.lit(0)))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    share = F.coalesce((cut.position - F.col("_lo")) / width, F.lit(0.0))
    number = F.floor((F.col("_before") + F.col("_n") * share) / F.lit(float(cut.rows)))
    return (
        df.withColumn("_slot", cut.slot)
        .join(F.broadcast(slots), "_slot", "left")
        .select(*df.columns, F.coalesce(number.cast("bigint"), F.lit(-1)).alias(out))
    )


@dataclass(frozen=True)
class Running:
    """How one output column is summarised per bucket, carried and merged."""

    summary: Callable[[Column], Column]
    carry: Callable[[str, WindowSpec], Column]
    local: Callable[[WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def running_sum(value: Column | str) -> Running:
    v = _c(value)
    return Running(
        summary=lambda order: F.sum(v),
        carry=lambda s, w: F.sum(s).over(w.rowsBetween(*_ALL_BEFORE)),
        local=lambda w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        merge=lambda carried, local: F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0)),
    )


def running_max(value: Column | str, strict: bool = False) -> Running:
    """Largest value so far; ``strict`` leaves the current row out."""
    v = _c(value)
    upto = -1 if strict else 0
    return Running(
        summary=lambda order: F.max(v),
        carry=lambda s, w: F.max(s).over(w.rowsBetween(*_ALL_BEFORE)),
        local=lambda w: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, upto)),
        merge=lambda carried, local: F.greatest(carried, local),
    )


def running_min(value: Column | str) -> Running:
    v = _c(value)
    return Running(
        summary=lambda order: F.min(v),
        carry=lambda s, w: F.min(s).over(w.rowsBetween(*_ALL_BEFORE)),
        local=lambda w: F.min(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        merge=lambda carried, local: F.least(carried, local),
    )


def min_ahead(value: Column | str) -> Running:
    """Smallest value from the current row on."""
    v = _c(value)
    return Running(
        summary=lambda order: F.min(v),
        carry=lambda s, w: F.min(s).over(w.rowsBetween(*_ALL_AFTER)),
        local=lambda w: F.min(v).over(w.rowsBetween(0, Window.unboundedFollowing)),
        merge=lambda carried, local: F.least(carried, local),
    )


def last_known(value: Column | str) -> Running:
    """Last non-null value up to and with the current row (forward fill)."""
    v = _c(value)
    return Running(
        summary=lambda order: F.max_by(v, F.when(v.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*_ALL_BEFORE)),
        local=lambda w: F.last(v, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        ),
        merge=lambda carried, local: F.coalesce(local, carried),
    )


def next_known(value: Column | str) -> Running:
    """Next non-null value from the current row on (backward fill)."""
    v = _c(value)
    return Running(
        summary=lambda order: F.min_by(v, F.when(v.isNotNull(), order)),
        carry=lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(*_ALL_AFTER)),
        local=lambda w: F.first(v, ignorenulls=True).over(
            w.rowsBetween(0, Window.unboundedFollowing)
        ),
        merge=lambda carried, local: F.coalesce(local, carried),
    )


def previous(value: Column | str) -> Running:
    """Value of the row before; null on the first row of the key."""
    boxed = F.struct(_c(value).alias("v"))
    return Running(
        summary=lambda order: F.max_by(boxed, order),
        carry=lambda s, w: F.lag(s).over(w),
        local=lambda w: F.lag(boxed).over(w),
        merge=lambda carried, local: F.coalesce(local, carried).getField("v"),
    )


def following(value: Column | str) -> Running:
    """Value of the next row; null on the last row of the key."""
    boxed = F.struct(_c(value).alias("v"))
    return Running(
        summary=lambda order: F.min_by(boxed, order),
        carry=lambda s, w: F.lead(s).over(w),
        local=lambda w: F.lead(boxed).over(w),
        merge=lambda carried, local: F.coalesce(local, carried).getField("v"),
    )


def previous_time(time: str) -> Running:
    """As ``previous`` for the first order column itself: needs only a plain maximum."""
    return Running(
        summary=lambda order: F.max(time),
        carry=lambda s, w: F.lag(s).over(w),
        local=lambda w: F.lag(time).over(w),
        merge=lambda carried, local: F.coalesce(local, carried),
    )


def following_time(time: str) -> Running:
    """As ``following`` for the first order column itself: needs only a plain minimum."""
    return Running(
        summary=lambda order: F.min(time),
        carry=lambda s, w: F.lead(s).over(w),
        local=lambda w: F.lead(time).over(w),
        merge=lambda carried, local: F.coalesce(local, carried),
    )


def key_total(value: Column | str) -> Running:
    """Sum over all rows of the key, on every row."""
    v = _c(value)
    return Running(
        summary=lambda order: F.sum(v),
        carry=lambda s, w: F.sum(s).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
        local=lambda w: F.lit(None),
        merge=lambda carried, local: carried,
    )


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` in one exchange by (keys, _bucket) for all that reads them.

    A reader that needs fewer columns would get an exchange of its own, as columns are pruned below
    it. So the columns travel as one, in an array, whose parts are not pruned; all readers then have
    the same exchange, which Spark runs once (``ReusedExchange``). Callers leave out the columns they
    do not need.
    """
    dealt_by = [*keys, "_bucket"]
    rest = [c for c in rows.columns if c not in dealt_by]
    packed = rows.select(*dealt_by, F.array(F.struct(*rest)).alias("_row")).repartition(*dealt_by)
    return packed.select(*dealt_by, *[F.element_at("_row", 1)[c].alias(c) for c in rest])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cut: Cut | Column,
    outputs: dict[str, Running],
) -> DataFrame:
    """Add one running column per entry of ``outputs``.

    ``order`` must be a total order within a key, and ``cut`` a cut of its first column (or a
    ready bucket column). With no keys the summary is one row per bucket for the whole table.
    ``df`` is read once for the rows, with all its columns, and with a ``Cut`` once more for its slots.
    """
    keys = list(keys)
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    rows = df.where(present)
    rows = with_bucket(rows, cut) if isinstance(cut, Cut) else rows.withColumn("_bucket", cut)
    rows = dealt(rows, keys)
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    along = Window.partitionBy(*keys).orderBy("_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)

    summary = rows.groupBy(*keys, "_bucket").agg(
        *[spec.summary(rank).alias(f"_s_{name}") for name, spec in outputs.items()]
    )
    carried = summary.select(
        *keys,
        "_bucket",
        *[spec.carry(f"_s_{name}", along).alias(f"_c_{name}") for name, spec in outputs.items()],
    )
    local = rows.select(
        "*", *[spec.local(inside).alias(f"_l_{name}") for name, spec in outputs.items()]
    )
    merged = local.join(carried, [*keys, "_bucket"])
    kept = [c for c in df.columns if c not in outputs]
    return merged.select(
        *kept,
        *[
            spec.merge(F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, spec in outputs.items()
        ],
    )


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous_value: str,
    starts_new: Callable[[Column, Column], Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    out: str = "session",
    bucket: str | None = None,
) -> DataFrame:
    """Name each row's session by the order columns of the session's first row.

    A row opens a session when it is the first of its key or when
    ``starts_new(previous row's value, this row's first order column)`` holds. The chain of
    rows is followed through buckets of time, so a long session or a hot key is never held
    in one task. ``bucket`` names a column that gets the row's bucket, which later scans in the same
    order can take as their cut.
    """
    keys = list(keys)
    stamp = order[0]
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    rank = F.struct(*order)

    local = (
        dealt(with_bucket(df.where(present), by_time(stamp, rows_per_bucket)), keys)
        .withColumn("_before", F.lag(previous_value).over(inside))
        .withColumn("_opens", F.when(starts_new(F.col("_before"), F.col(stamp)), rank))
        .withColumn(
            "_open_here",
            F.last("_opens", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )
    edges = local.groupBy(*keys, "_bucket").agg(
        F.min(rank).alias("_first"),
        F.max_by(previous_value, rank).alias("_last_value"),
        F.max("_opens").alias("_last_open"),
    )
    before = F.lag("_last_value").over(along)
    edges = edges.withColumn(
        "_edge_open",
        F.when(before.isNull() | starts_new(before, F.col(f"_first.{stamp}")), F.col("_first")),
    ).withColumn("_open_at_end", F.coalesce("_last_open", "_edge_open"))
    carried = edges.select(
        *keys,
        "_bucket",
        F.coalesce(
            "_edge_open",
            F.last("_open_at_end", ignorenulls=True).over(along.rowsBetween(*_ALL_BEFORE)),
        ).alias("_open_before"),
    )
    return local.join(carried, [*keys, "_bucket"]).select(
        *df.columns, F.coalesce("_open_here", "_open_before").alias(out),
        *([F.col("_bucket").alias(bucket)] if bucket else []),
    )
