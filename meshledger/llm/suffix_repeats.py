"""Repeated byte strings from common-prefix interval trees of suffix arrays.

Equal strings of WINDOW bytes hold the same smallest hash of GRAM bytes at the same place, so
windows are dealt to tasks by that hash: a run of windows with one smallest gram travels as one
piece of text. Each task takes one of equal pieces, leaves out the windows that a table of slots shows
to occur once, sorts the suffixes that start with the others, takes the common prefix of neighbours, and scans them with a stack. The intervals of the scan are the nodes of
the common-prefix tree: strings with all their occurrences. Those whose occurrences differ in the
byte before are the maximal repeats; every other repeat is part of one. In each maximal repeat all
occurrences but those with the smallest rank are spans of repeats.

A gram may be very frequent (the edge of a passage that a third of all documents hold, each time
before other words). Grams with more than a bound of different pieces, a list of bounded length, are
split: their windows travel singly by a hash of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common, repeats

WINDOW, GRAM = 50, 16
#: Windows whose grams are hashed together; their hashes stay in a core's cache.
SEGMENT = 1 << 15
#: Suffix arrays that a task sorts one after the other.
PARTS = 4
#: A gram is split if it has more pieces than this and than a HOT_LIST-th of all pieces.
HOT, HOT_LIST = 20_000, 50_000
#: The two hashes that name a piece.
PIECE_SEEDS = 103, 104


def smallest_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, windows, place of the smallest gram, its hash) of runs of windows with one smallest gram.

    Windows lie inside a text; of equal grams the leftmost is the smallest. A gram serves windows of one text
    only, and they are neighbours.
    """
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    place_bits = np.uint64(24)
    ends = offsets[1:]
    for low in range(0, max(len(data) - WINDOW + 1, 0), SEGMENT):
        high = min(low + SEGMENT, len(data) - WINDOW + 1)  # windows low to high, whose bytes end WINDOW - 1 later
        h = common.run_hashes(data[low:high + WINDOW - 1], GRAM, 31)
        least = h >> place_bits << place_bits | np.arange(len(h), dtype=np.uint64)
        span, width = 1, WINDOW - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[:span - width], least[width - span:])
        crossed = np.zeros(high - low + 1, np.int64)  # windows that cross the end of a text are no windows
        near = ends[np.searchsorted(ends, low, side="right"):np.searchsorted(ends, high + WINDOW)]
        np.add.at(crossed, np.clip(near - WINDOW + 1 - low, 0, high - low), 1)
        np.add.at(crossed, np.clip(near - low, 0, high - low), -1)
        first = np.cumsum(crossed)[:-1] == 0
        last = first.copy()
        other = least[1:] != least[:-1]
        first[1:] &= other | ~last[:-1]
        last[:-1] &= other | (crossed[1:-1] > 0)
        a = np.flatnonzero(first)
        place = (least[a] & np.uint64((1 << 24) - 1)).astype(np.int64)
        found.append((a + low, np.flatnonzero(last) + 1 - a, place + low, h[place]))
    at, count, place, h = (np.concatenate(x) for x in zip(*found))
    once = repeats.group_starts(place)  # a run may go on in the next segment
    return at[once], np.add.reduceat(count, once) if len(once) else count, place[once], h[once]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte number, hash) of the grams that are smallest in some window."""
    _, _, place, h = smallest_grams(data, offsets)
    owner = np.searchsorted(offsets, place, side="right") - 1
    return owner, place - offsets[owner], h


def cut(data: np.ndarray, offsets: np.ndarray, flags: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first window, windows, first byte, end byte) of runs of windows whose smallest gram is flagged."""
    flag = np.zeros(len(data) + 1, bool)
    for k, at in enumerate(flags):
        flag[np.minimum(offsets[k] + at, offsets[k + 1])] = True
    first, count, place, _ = smallest_grams(data, offsets)
    some = flag[place]
    first, end = first[some], first[some] + count[some]
    if not len(first):
        return
    # windows of two texts are never neighbours: those that cross the end are between them
    new = np.flatnonzero(np.r_[True, first[1:] != end[:-1]])
    a, count = first[new], end[np.r_[new[1:], len(first)] - 1] - first[new]
    k = np.searchsorted(offsets, a, side="right") - 1
    yield from zip(k.tolist(), (a - offsets[k]).tolist(), count.tolist(), a.tolist(), (a + count + WINDOW - 1).tolist())


def _leading_equal(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit differences."""
    return sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8)) + (x == 0)


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings ``data[start:end]`` in byte order, and the common prefix of each with the one before.

    Sorted by eight bytes at a time; only strings that still tie are looked at again.
    """
    n = len(start)
    octets = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)  # the eight bytes from each place on
    for width in (1, 2, 4):
        octets = octets[:-width] << np.uint64(8 * width) | octets[width:]
    length = end - start
    shortest = int(length.min(initial=0))

    def word(which: np.ndarray, depth: int) -> np.ndarray:
        value = octets[np.minimum(start[which] + 8 * depth, len(data))]
        if shortest >= 8 * (depth + 1):
            return value
        short = np.clip(8 * (depth + 1) - length[which], 0, 8).astype(np.uint64)
        return np.where(short == 8, np.uint64(0), value >> (np.minimum(short, np.uint64(7)) * np.uint64(8)) << (np.minimum(short, np.uint64(7)) * np.uint64(8)))

    shared = np.full(n, -1, np.int64)
    values = word(np.arange(n), 0)
    order = np.argsort(values, kind="stable")
    values = values[order]
    parted = np.r_[True, values[1:] != values[:-1]] if n else np.zeros(0, bool)
    at = np.flatnonzero(parted)
    shared[at] = _leading_equal(values[at] ^ values[at - 1])
    if n:
        shared[0] = 0
    for depth in range(1, int(length.max(initial=0) + 7) // 8):
        alone = parted & np.r_[parted[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(parted)[tied]
        values = word(order[tied], depth)
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][(values[1:] != values[:-1]) & (group[1:] == group[:-1])]] = True
        some = mixed[group]  # groups that tie on these bytes, too, are in order as they are
        tied, group, values = tied[some], group[some], values[some]
        if not len(tied):
            continue
        by = np.lexsort((values, group))
        order[tied], values = order[tied][by], values[by]
        new = np.r_[True, values[1:] != values[:-1]] & ~parted[tied]
        shared[tied[new]] = 8 * depth + _leading_equal(values[new] ^ values[np.flatnonzero(new) - 1])
        parted[tied[new]] = True
    tied = np.flatnonzero(~(parted & np.r_[parted[1:], True])) if n else np.zeros(0, np.int64)
    if len(tied):  # equal but for their length: the shorter one first
        group = np.cumsum(parted)[tied]
        order[tied] = order[tied][np.lexsort((length[order[tied]], group))]
    shared[shared < 0] = np.iinfo(np.int64).max
    if n:
        shared[1:] = np.minimum(shared[1:], np.minimum(length[order[1:]], length[order[:-1]]))
        shared[0] = 0
    return order, shared


def maximal_repeats(shared: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, length) arrays of the tree's intervals of ``least`` bytes at least whose left bytes differ.

    ``before`` holds the byte before each suffix, a value of its own where there is none. Positions
    are those of the sorted suffixes. Runs of one common prefix are one interval each; the others
    are scanned with a stack.
    """
    turns = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    deep = shared >= least
    edge = np.flatnonzero(np.diff(np.r_[False, deep, False].astype(np.int8)))
    if not len(edge):
        return
    first, last = edge[::2] - 1, edge[1::2] - 1
    low, high = np.minimum.reduceat(shared, first + 1), np.zeros(len(first), np.int64)
    capped = np.where(deep, shared, 0)
    high = np.maximum.reduceat(capped, first + 1)
    masked = np.where(deep, shared, np.iinfo(np.int64).max)
    low = np.minimum.reduceat(masked, first + 1)
    flat = low == high
    keep = flat & (turns[first] != turns[last])
    yield first[keep], last[keep], low[keep]
    out: list[tuple[int, int, int]] = []
    for a, b in zip(first[~flat].tolist(), last[~flat].tolist()):
        stack = [(least - 1, a)]
        for i, value in enumerate([*shared[a + 1:b + 1].tolist(), least - 1], a + 1):
            begin = i - 1
            while stack[-1][0] > value:
                length, begin = stack.pop()
                if turns[begin] != turns[i - 1]:
                    out.append((begin, i - 1, length))
            if stack[-1][0] < value:
                stack.append((value, begin))
    if out:
        yield tuple(np.array(x, np.int64) for x in zip(*out))


def repeat_spans(data: np.ndarray, piece_end: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, windows) of all occurrences of maximal repeats that have one of smaller rank.

    Of equal pieces those with the smallest rank are sorted, the others are such occurrences as a whole.
    """
    piece_start = np.r_[0, piece_end[:-1]]
    later, stay = repeats.least_of_equals(rank, *(common.span_hashes(data, piece_start, piece_end, seed) for seed in PIECE_SEEDS))
    whole = later, np.zeros(len(later), np.int64), windows[later]
    windows = windows[stay]
    piece = np.repeat(stay, windows)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = piece_start[piece] + off
    # a window alone in its slot has no equal, so no repeat of a window's length starts there
    bits = max(10, len(start).bit_length() + 3)
    slot = (common.span_hashes(data, start, start + WINDOW, 41) >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slot, minlength=1 << bits)[slot] > 1
    piece, off, start = piece[again], off[again], start[again]
    order, shared = suffix_array(data, start, piece_end[piece])
    piece, off, start = piece[order], off[order], start[order]
    before = np.where(off > 0, data[start - 1].astype(np.int64), -1 - np.arange(len(start)))
    owner = rank[piece]
    found = [whole]
    for first, last, length in maximal_repeats(shared, before, WINDOW):
        if not len(first):
            continue
        size = last - first + 1
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        least = np.minimum.reduceat(owner[at], np.cumsum(size) - size)
        later = owner[at] > np.repeat(least, size)
        found.append((piece[at][later], off[at][later], np.repeat(length, size)[later] - WINDOW + 1))
    return tuple(np.concatenate(x) for x in zip(*found))


COLUMNS = {"size": "<u4", "windows": "<u4", "rank": "<i8", "key": "<i8", "start": "<u4"}
PIECE_ROWS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in COLUMNS), ("body", pa.binary()), ("count", pa.binary())])
PIECE_TYPE = ", ".join(["bucket int", *(f"{c} binary" for c in COLUMNS), "body binary, count binary"])


def pieces(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, windows, hash) of the runs of windows with one smallest gram; those of ``hot`` grams singly."""
    at, count, _, h = smallest_grams(data, offsets)
    if len(hot):
        many = np.isin(h, hot)
        rest = ~many
        single = np.repeat(at[many], count[many]) + np.arange(count[many].sum()) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
        at, count = np.r_[at[rest], single], np.r_[count[rest], np.ones(len(single), np.int64)]
        h = np.r_[h[rest], common.span_hashes(data, single, single + WINDOW, 41)]
    return np.searchsorted(offsets, at, side="right") - 1, at, count, h


def _bodies(found: DataFrame) -> DataFrame:
    return found.where("body IS NOT NULL").select("rank", "key", "start", "body")


def hot_grams(found: DataFrame, hot: int = HOT) -> np.ndarray:
    """Hashes of the grams to split; a block counts a piece once however often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.text_blocks(batch.column(3)):
                _, _, _, h = pieces(data, offsets, np.zeros(0, np.uint64))
                h, n = np.unique(h, return_counts=True)
                total = int(n.sum())
                often = n > 1  # a gram of many pieces shows in most blocks more than once
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[h[often].view(np.int64), 0]), pa.array(np.r_[n[often], 0]), pa.array(np.r_[np.zeros(int(often.sum()), np.int64), total])],
                    ["h", "n", "total"])

    counts = _bodies(found).mapInArrow(count, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = common.store(counts.where((F.col("n") > hot) | (F.col("total") > 0)), "gram-counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    listed = counts.where(F.col("n") > max(hot, total // HOT_LIST)).select("h").toArrow()
    return np.sort(listed["h"].to_numpy().astype(np.int64).view(np.uint64))


def compare(found: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """Spans of repeats among the windows of the regions."""
    spark = found.sparkSession
    split = spark.sparkContext.broadcast(hot_grams(found, hot))
    buckets = np.uint64(n)

    def settle(held: list) -> Iterator[dict]:
        rank, key, start, count, h, r1, r2 = (np.concatenate([x[i] for x in held]) for i in range(7))
        body = [b for x in held for b in x[7]]
        later, stay = repeats.least_of_equals(rank, r1, r2)
        yield from repeats.span_rows(rank[later], key[later], start[later], count[later], buckets)
        bucket = (h[stay] % np.uint64(n * PARTS)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        stay, bucket = stay[by], bucket[by]
        columns = {"size": count[stay] + WINDOW - 1, "windows": count[stay], "rank": rank[stay], "key": key[stay], "start": start[stay]}
        cuts = repeats.group_starts(bucket)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(stay)]):
            yield {"bucket": int(bucket[a]), "body": b"".join([body[i] for i in stay[a:b].tolist()])} | {
                c: repeats.pack(columns[c][a:b], kind) for c, kind in COLUMNS.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            rank, key, start = (batch.column(i).to_numpy() for i in range(3))
            for row, _, data, offsets in common.text_blocks(batch.column(3)):
                owner, at, count, h = pieces(data, offsets, split.value)
                stop, body = at + count + WINDOW - 1, data.tobytes()
                r1, r2 = (common.span_hashes(data, at, stop, seed) for seed in PIECE_SEEDS)
                held.append((rank[row + owner], key[row + owner], start[row + owner] + at - offsets[owner], count, h, r1, r2,
                             [body[a:b] for a, b in zip(at.tolist(), stop.tolist())]))
                size += len(at)
                if size >= 1 << 18:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in repeats.buckets_of(batches):
            yield from (row for row in rows if row["count"] is not None)
            held = [row for row in rows if row["count"] is None]
            if not held:
                continue
            x = repeats.unpacked(held, COLUMNS)
            data = np.frombuffer(b"".join(r["body"] for r in held), np.uint8)
            piece, off, count = repeat_spans(data, np.cumsum(x["size"].astype(np.int64)), x["windows"].astype(np.int64), x["rank"])
            yield from repeats.span_rows(x["rank"][piece], x["key"][piece], x["start"][piece].astype(np.int64) + off, count, buckets)

    sent = _bodies(found).mapInArrow(lambda it: repeats.record_batches(deal(it), PIECE_ROWS), PIECE_TYPE)
    sent = sent.repartitionById(n, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lambda it: repeats.record_batches(judge(it), repeats.SPAN_ROWS), repeats.SPAN_TYPE)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        for row in range(0, batch.num_rows, 1000):
            part = batch.slice(row, 1000)
            sizes, removed, runs, kept = [], [], [], []
            for text, starts, counts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                own = text.encode()
                gone = repeats.covered(starts, counts, len(own), WINDOW)
                sizes.append(len(own))
                removed.append(0 if gone is None else int(gone.sum()))
                runs.append(0 if gone is None else int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                kept.append(own if gone is None else np.frombuffer(own, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], names)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    A byte goes if a string of 50 bytes over it also starts in a document with a smaller id. Null
    texts are empty; rows with a null id rank last; rows that share an id (repeated rows, too) never
    remove each other's bytes. Matches never cross documents.
    """
    rows = common.texts(docs, id_col, text_col)
    n = common.parts(rows.sparkSession, common.text_megabytes(rows), repeats.SHARE)
    flags = repeats.flagged(rows, anchors, n)
    found = common.store(repeats.regions(rows, flags, cut, n), "regions", large=True)
    common.discard(flags)
    spans = repeats.whole_spans(found, n).unionByName(compare(found, n, hot))
    spans = common.store(repeats.gather_spans(spans, n), "spans", large=True)
    common.discard(found)
    return repeats.with_spans(rows, spans).mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(common.table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  windows AS (SELECT doc_id, s, substring(h, 2 * s + 1, 100) AS run FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM texts)),
  hits AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY run) AS least FROM windows) WHERE least < doc_id),
  marked AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span
    FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM hits)),
  spans AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM marked GROUP BY doc_id, span),
  counts AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY 1),
  ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM texts),
  pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS x, a AS y FROM ends),
  kept AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM pieces JOIN texts USING (doc_id) WHERE y > x GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)"""
