"""Windows of a text that also start in a document with a smaller id: the steps two operators share.

1. Anchors. Each text gives hashes at sampled positions, such that equal windows share an anchor.
   Hashes that occur in two documents flag their positions; all others can hold no repeat.
2. Regions. Runs of windows that lean on flagged anchors are cut out. Equal regions (128-bit hash of
   their bytes) are one: only the row with the smallest rank keeps the bytes, in all others every
   window is a repeat.
3. The operator compares the windows of the regions that are left and gives spans of repeats.

Groups may be huge (a passage in a third of all documents), so every task first settles what it can
see itself: of equal hashes, regions or windows inside one block of rows only the one with the
smallest rank goes on, and the others are flagged or spans at once. What meets in one task is then
bounded by the number of blocks. Hashes travel as packed arrays, one row for each block and
partition it has something for (`repartitionById`), not as rows of their own.

Rows are named by ``rank`` and ``key`` (see `common.texts`); a row is smaller than another if its
rank is. Rows that share an id never make each other repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.llm import common

#: Megabytes of text for each shuffle partition (``n`` below).
SHARE = 12
#: Bytes of text whose anchors are settled together before they leave a task.
BLOCK = 8 << 20
KNOWN = np.uint32(0xFFFFFFFF)

Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Regions = Callable[[np.ndarray, np.ndarray, list], Iterator[tuple[int, int, int, int, int]]]


def pack(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values.astype(kind)).tobytes()


def packed(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, str]]) -> Iterator[dict]:
    """One dict per bucket with its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    columns = {name: (values[order], kind) for name, (values, kind) in columns.items()}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        yield {"bucket": int(bucket[order[a]])} | {name: pack(values[a:b], kind) for name, (values, kind) in columns.items()}


def unpacked(rows: list[dict], columns: dict[str, str]) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(r[name] for r in rows), kind) for name, kind in columns.items()}


def record_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other, of partitions sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First positions of runs of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def least_of_equals(rank: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have an equal of smaller rank, all others), each sorted by the two hashes that name equals."""
    order = np.lexsort((rank, r2, r1))
    first = group_starts(r1[order], r2[order])
    later = rank[order] > np.repeat(rank[order][first], np.diff(np.r_[first, len(order)]))
    return order[later], order[~later]


def place(rank: np.ndarray, buckets: np.uint64) -> np.ndarray:
    """The bucket that all that is found about a row meets in."""
    return (common.mix(rank.astype(np.int64).view(np.uint64)) % buckets).astype(np.int64)


ANCHOR_ROWS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("rank", pa.binary()), ("pos", pa.binary()),
                         ("done", pa.bool_())])
FLAGS = pa.schema([("rank", pa.int64()), ("pos", pa.binary())])


def flagged(rows: DataFrame, anchors: Anchors, n: int) -> DataFrame:
    """(rank, pos): packed positions of anchors whose hash occurs in two documents at least, one row per rank."""
    buckets = np.uint64(n)

    def told(rank: np.ndarray, pos: np.ndarray) -> Iterator[dict]:
        for row in packed(place(rank, buckets), {"rank": (rank, "<i8"), "pos": (pos, "<u4")}):
            yield row | {"h": b"", "done": True}

    def settle(found: list) -> Iterator[dict]:
        rank, pos, h = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        rank, pos, h = rank[order], pos[order], h[order]
        starts = group_starts(h)
        if not len(starts):
            return
        repeated = np.minimum.reduceat(rank, starts) != np.maximum.reduceat(rank, starts)
        each = np.repeat(repeated, np.diff(np.r_[starts, len(h)]))
        yield from told(rank[each], pos[each])
        known = starts[repeated]
        h_ = np.concatenate([h[~each], h[known]])
        columns = {"h": (h_, "<u8"), "rank": (np.concatenate([rank[~each], rank[known]]), "<i8"),
                   "pos": (np.concatenate([pos[~each], np.full(len(known), KNOWN)]), "<u4")}
        for row in packed((h_ % buckets).astype(np.int64), columns):
            yield row | {"done": False}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found, size = [], 0
        for batch in batches:
            rank = batch.column(0).to_numpy()
            for row, _, data, offsets in common.text_blocks(batch.column(1)):
                owner, pos, h = anchors(data, offsets)
                found.append((rank[row + owner], pos.astype(np.uint32), h))
                size += len(data)
                if size >= BLOCK:
                    yield from settle(found)
                    found, size = [], 0
        if found:
            yield from settle(found)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in buckets_of(batches):
            yield from (row for row in held if row["done"])
            x = unpacked([row for row in held if not row["done"]], {"h": "<u8", "rank": "<i8", "pos": "<u4"})
            if not len(x["h"]):
                continue
            order = np.argsort(x["h"], kind="stable")
            h, rank, pos = x["h"][order], x["rank"][order], x["pos"][order]
            starts = group_starts(h)
            repeated = np.minimum.reduceat(rank, starts) != np.maximum.reduceat(rank, starts)
            repeated |= np.maximum.reduceat(pos, starts) == KNOWN
            each = np.repeat(repeated, np.diff(np.r_[starts, len(h)])) & (pos != KNOWN)
            yield from told(rank[each], pos[each])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in buckets_of(batches):
            x = unpacked(held, {"rank": "<i8", "pos": "<u4"})
            order = np.lexsort((x["pos"], x["rank"]))
            rank, pos = x["rank"][order], x["pos"][order]
            cuts = group_starts(rank)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)]):
                yield {"rank": int(rank[a]), "pos": pack(pos[a:b], "<u4")}

    kinds = "bucket int, h binary, rank binary, pos binary, done boolean"
    sent = rows.select("rank", "text").mapInArrow(lambda it: record_batches(sample(it), ANCHOR_ROWS), kinds).repartitionById(n, "bucket").sortWithinPartitions("bucket")
    told_ = sent.mapInArrow(lambda it: record_batches(compare(it), ANCHOR_ROWS), kinds).select("bucket", "rank", "pos").repartitionById(n, "bucket").sortWithinPartitions("bucket")
    return common.store(told_.mapInArrow(lambda it: record_batches(gather(it), FLAGS), "rank long, pos binary"), "flagged", large=True)


REGION_TYPE = "r1 long, r2 long, rank long, key long, start long, windows long, body binary"
REGION_ROWS = pa.schema([(n, pa.int64()) for n in ("r1", "r2", "rank", "key", "start", "windows")] + [("body", pa.binary())])


def regions(rows: DataFrame, flags: DataFrame, cut: Regions, n: int) -> DataFrame:
    """Rows (rank, key, start, windows, body): regions to compare, and with a null body spans of repeats."""
    def settle(held: dict) -> Iterator[dict]:
        for (r1, r2), (body, found) in held.items():
            least = min(found)[0]
            for rank, key, start, windows in found:
                yield {"r1": r1, "r2": r2, "rank": rank, "key": key, "start": start, "windows": windows,
                       "body": body if rank == least else None}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[tuple[int, int], tuple[bytes, list]] = {}
        size = 0
        for batch in batches:
            rank, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, end, data, offsets in common.text_blocks(batch.column(2)):
                flags_ = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(3).slice(row, end - row).to_pylist()]
                found = list(cut(data, offsets, flags_))
                if not found:
                    continue
                owner, start, windows, a, b = (np.array(x, np.int64) for x in zip(*found))
                r1, r2 = (common.span_hashes(data, a, b, seed).view(np.int64).tolist() for seed in (101, 102))
                body = data.tobytes()
                for k, (x, y) in enumerate(zip(r1, r2)):
                    at = int(row + owner[k])
                    held.setdefault((x, y), (body[a[k]:b[k]], []))[1].append((int(rank[at]), int(key[at]), int(start[k]), int(windows[k])))
                size += int((b - a).sum())
                if size >= BLOCK:
                    yield from settle(held)
                    held, size = {}, 0
        yield from settle(held)

    def first_of_equals(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        before, least = None, 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if row["body"] is not None:
                    if (row["r1"], row["r2"]) != before:
                        before, least = (row["r1"], row["r2"]), row["rank"]
                    if row["rank"] > least:
                        row["body"] = None
                yield row

    found = (rows.select("rank", "key", "text").join(flags, "rank").select("rank", "key", "text", "pos")
             .mapInArrow(lambda it: record_batches(cut_out(it), REGION_ROWS), REGION_TYPE))
    # spans go where their row's id leads, so that a hot region's spans do not follow its hash
    to = F.when(F.col("body").isNull(), F.xxhash64("rank", "start")).otherwise(F.col("r1"))
    sorted_ = found.withColumn("place", to).repartition(n, "place").sortWithinPartitions("place", "r1", "r2", "rank").drop("place")
    return sorted_.mapInArrow(lambda it: record_batches(first_of_equals(it), REGION_ROWS), REGION_TYPE)


SPAN_TYPE = "bucket int, rank binary, key binary, start binary, count binary"
SPANS = {"rank": "<i8", "key": "<i8", "start": "<u4", "count": "<u4"}
SPAN_ROWS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in SPANS)])
GATHERED = pa.schema([("rank", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary())])


def joined(rank: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans in order, those that touch or overlap made one."""
    order = np.lexsort((start, key, rank))
    rank, key, start = rank[order], key[order], start[order].astype(np.int64)
    first = group_starts(rank, key)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    reach = np.maximum.accumulate(group << 34 | start + count[order].astype(np.int64))
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] << 34 | start[1:]) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(order)] - 1
    return rank[at], key[at], start[at], (reach[last] & ((1 << 34) - 1)) - start[at] if len(at) else start


def span_rows(rank: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, buckets: np.uint64) -> Iterator[dict]:
    """Spans of repeats, packed by the bucket of their row."""
    if len(rank):
        found = joined(rank, key, start, count)
        yield from packed(place(found[0], buckets), dict(zip(SPANS, zip(found, SPANS.values()))))


def whole_spans(found: DataFrame, n: int) -> DataFrame:
    """Spans of the regions that are repeats as a whole."""
    buckets = np.uint64(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from span_rows(*(batch.column(i).to_numpy() for i in range(4)), buckets)

    return (found.where("body IS NULL").select("rank", "key", "start", "windows")
            .mapInArrow(lambda it: record_batches(work(it), SPAN_ROWS), SPAN_TYPE))


def gather_spans(spans: DataFrame, n: int) -> DataFrame:
    """(rank, key, starts, counts): one row for each row of the input that has repeats."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in buckets_of(batches):
            rank, key, start, count = joined(*unpacked(held, SPANS).values())
            cuts = group_starts(rank, key)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)]):
                yield {"rank": int(rank[a]), "key": int(key[a]), "starts": pack(start[a:b], "<u4"), "counts": pack(count[a:b], "<u4")}

    return spans.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda it: record_batches(gather(it), GATHERED), "rank long, key long, starts binary, counts binary")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, starts, counts) of every row, the packed spans null where there is no repeat."""
    return rows.join(spans, ["rank", "key"], "left").select("id", "text", "starts", "counts")


def covered(starts: bytes | None, counts: bytes | None, length: int, window: int) -> np.ndarray | None:
    """Which of ``length`` units lie in a repeated window; None if there is none."""
    if not starts:
        return None
    start, count = (np.frombuffer(x, "<u4").astype(np.int64) for x in (starts, counts))
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + window - 1, -1)
    return np.cumsum(edge)[:-1] > 0
