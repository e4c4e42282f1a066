"""Repeated word windows found through difference-cover anchors.

Runs of RUN words are hashed only where the word's number modulo PERIOD lies in COVER, a difference
cover: any two residues are moved into it by one common shift of less than PERIOD. Two equal windows
of PERIOD - 1 + RUN words, wherever they start, therefore hold an equal run at the same shift that
is an anchor in both. Anchors that match are extended to the windows around them, and the windows
themselves decide, by 128-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common, repeats

PERIOD, COVER, RUN = 7, (1, 2, 4), 7
WINDOW = PERIOD - 1 + RUN


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return common.word_spans(data, offsets, common.NOT_SPACE)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, hash) of the runs at cover positions of texts of a window at least."""
    begin, stop, first = _words(data, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(begin)) - first[:-1][owner]
    at = np.flatnonzero(np.isin(number % PERIOD, COVER) & (number + RUN <= count[owner]) & (count[owner] >= WINDOW))
    return owner[at], number[at], common.span_hashes(common.span_hashes(data, begin, stop, 1), at, at + RUN, 2)


def cut(data: np.ndarray, offsets: np.ndarray, flags: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first window, windows, first byte, end byte) of runs of windows around flagged anchors."""
    begin, stop, first = _words(data, offsets)
    for k, at in enumerate(flags):
        windows = int(first[k + 1] - first[k]) - WINDOW + 1
        if windows <= 0 or not len(at):
            continue
        at = at[at + RUN <= windows + WINDOW - 1]
        edge = np.zeros(windows + 1, np.int64)
        np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
        np.add.at(edge, np.minimum(at + 1, windows), -1)
        turn = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(edge)[:-1] > 0).astype(np.int8), 0]))
        for a, b in turn.reshape(-1, 2).tolist():
            yield k, a, b - a, int(begin[first[k] + a]), int(stop[first[k] + b + WINDOW - 2])


COLUMNS = {"w1": "<u8", "w2": "<u8", "rank": "<i8", "key": "<i8", "start": "<u4"}
WINDOW_ROWS = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in COLUMNS] + [("count", pa.binary())])


def _smallest(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Windows sorted by hash, which of them have a smaller rank in their group, and the first of each group."""
    order = np.lexsort((x["rank"], x["w2"], x["w1"]))
    x = {c: v[order] for c, v in x.items()}
    starts = repeats.group_starts(x["w1"], x["w2"])
    least = np.repeat(x["rank"][starts], np.diff(np.r_[starts, len(order)]))
    return x, x["rank"] > least, starts


def compare(found: DataFrame, n: int) -> DataFrame:
    """Spans of repeats among the windows of the regions: all windows with a smaller rank in their group."""
    buckets = np.uint64(n)

    def spans(x: dict, repeat: np.ndarray) -> Iterator[dict]:
        yield from repeats.span_rows(x["rank"][repeat], x["key"][repeat], x["start"][repeat], np.ones(int(repeat.sum()), np.int64), buckets)

    def settle(held: list) -> Iterator[dict]:
        x, repeat, _ = _smallest({c: np.concatenate([h[i] for h in held]) for i, c in enumerate(COLUMNS)})
        yield from spans(x, repeat)
        columns = {c: (x[c][~repeat], kind) for c, kind in COLUMNS.items()}
        yield from repeats.packed((columns["w1"][0] % buckets).astype(np.int64), columns)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            rank, key, start = (batch.column(i).to_numpy() for i in range(3))
            for row, end, data, offsets in common.text_blocks(batch.column(3)):
                begin, stop, first = _words(data, offsets)
                count = np.maximum(np.diff(first) - WINDOW + 1, 0)
                owner = np.repeat(np.arange(end - row), count)
                off = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                at = first[:-1][owner] + off
                w = [common.span_hashes(common.span_hashes(data, begin, stop, s), at, at + WINDOW, s + 1) for s in (11, 21)]
                held.append((*w, rank[row + owner], key[row + owner], (start[row + owner] + off).astype(np.uint32)))
                size += len(owner)
                if size >= 1 << 20:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in repeats.buckets_of(batches):
            yield from (row for row in held if row["count"] is not None)
            x, repeat, _ = _smallest(repeats.unpacked([row for row in held if row["count"] is None], COLUMNS))
            yield from spans(x, repeat)

    kinds = ", ".join(["bucket int", *(f"{c} binary" for c in COLUMNS), "count binary"])
    sent = (found.where("body IS NOT NULL").select("rank", "key", "start", "body")
            .mapInArrow(lambda it: repeats.record_batches(windows(it), WINDOW_ROWS), kinds)
            .repartitionById(n, "bucket").sortWithinPartitions("bucket"))
    return sent.mapInArrow(lambda it: repeats.record_batches(judge(it), repeats.SPAN_ROWS), repeats.SPAN_TYPE)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 1000):
            part = batch.slice(row, 1000)
            words, removed, texts = [], [], []
            for text, starts, counts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                own = text.encode().split()
                gone = repeats.covered(starts, counts, len(own), WINDOW)
                words.append(len(own))
                removed.append(0 if gone is None else int(gone.sum()))
                texts.append(b" ".join(own if gone is None else [w for w, g in zip(own, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(removed), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, text (the words that stay, joined by a space).

    A word goes if it lies in a window of 13 words that also starts in a document with a smaller id.
    Null texts have no words; rows with a null id rank last; rows that share an id (repeated rows,
    too) never remove each other's words. Shorter texts than a window keep all words.
    """
    rows = common.texts(docs, id_col, text_col)
    n = common.parts(rows.sparkSession, common.text_megabytes(rows), repeats.SHARE)
    flags = repeats.flagged(rows, anchors, n)
    found = common.store(repeats.regions(rows, flags, cut, n), "regions", large=True)
    common.discard(flags)
    spans = repeats.whole_spans(found, n).unionByName(compare(found, n))
    spans = common.store(repeats.gather_spans(spans, n), "spans", large=True)
    common.discard(found)
    return repeats.with_spans(rows, spans).mapInArrow(_remove, "id long, n_words long, n_removed long, text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(common.table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  windows AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS run FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM texts)),
  hits AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY run) AS least FROM windows) WHERE least < doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM hits),
  placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM texts),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""
