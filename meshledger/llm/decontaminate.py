"""Benchmark decontamination by winnowing.

Words are hashed, every run of K words gets a hash, and of each W = 10 - K + 1 neighbouring runs the
smallest hash is kept, in documents and benchmark items alike. Two texts that share ten words in a
row hold the same window of runs there, hence the same smallest hash: an equi-join of the kept
hashes finds every such pair. The hits are then extended on the words themselves: a document's words
count only where a whole window of an item stands. Items of fewer than ten words are one window;
their hash is looked up among all word runs of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common

WINDOW, RUN = 10, 5
#: Rows of benchmark hashes (16 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_WORD = common.byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
NONE = np.uint64((1 << 64) - 1)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(LOWER), np.uint8)


def _runs(words: np.ndarray, first: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the largest value where the text ends before."""
    n = len(words)
    out = np.full(n, NONE)
    if n >= size:
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        at = np.flatnonzero(left >= size)
        out[at] = common.span_hashes(words, at, at + size, seed) >> np.uint64(1)
    return out


def _winnow(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash (the leftmost of equals) of every window of ten words."""
    span = WINDOW - RUN + 1
    windows = len(runs) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    least, chosen = runs[:windows].copy(), np.zeros(windows, np.int64)
    for j in range(1, span):
        smaller = runs[j:j + windows] < least
        least[smaller] = runs[j:j + windows][smaller]
        chosen[smaller] = j
    left = np.repeat(first[1:], np.diff(first))[:windows] - np.arange(windows)
    at = np.flatnonzero(left >= WINDOW)
    return np.unique(at + chosen[at])


def fingerprints(rows: DataFrame, short: list[int], whole: bool) -> DataFrame:
    """(rank, key, h): winnowed hashes of each text, and for the lengths in ``short`` the hashes of
    all its runs of that many words (``whole``: of texts of that many words only)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in common.text_blocks(batch.column(2)):
                data = _lowered(data)
                begin, stop, first = common.word_spans(data, offsets, IS_WORD)
                words = common.span_hashes(data, begin, stop, 1)
                owner = np.repeat(np.arange(end - row), np.diff(first))
                at = _winnow(runs := _runs(words, first, RUN, 2), first)
                rows_, found = [owner[at]], [runs[at]]
                for size in short:
                    runs = _runs(words, first, size, 10 + size)
                    at = first[:-1][np.diff(first) == size] if whole else np.flatnonzero(runs != NONE)
                    rows_.append(owner[at])
                    found.append(runs[at])
                rows_, found = np.concatenate(rows_), np.concatenate(found)
                order = np.lexsort((found, rows_))
                rows_, found = rows_[order], found[order]
                new = np.ones(len(found), bool)
                new[1:] = (rows_[1:] != rows_[:-1]) | (found[1:] != found[:-1])
                rows_, found = rows_[new], found[new]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rows_, np.arange(end - row + 1)).astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), lists], ["rank", "key", "h"])

    hashed = rows.select("rank", "key", "text").mapInArrow(work, "rank long, key long, h array<long>")
    return hashed.select("rank", "key", F.explode("h").alias("h"))


def _short_lengths(items: DataFrame) -> list[int]:
    """Which lengths below a window occur among the items: nine numbers at most."""
    words = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                           F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    sizes = items.select(words.alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    return sorted(r.n for r in sizes.collect())


def _windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact hits: (id, key, n_words, n_hit, items) of each text, given the items that may occur in it."""
    names = ["id", "key", "n_words", "n_hit", "items"]
    for batch in batches:
        candidates = batch.column(3)
        for row, end, data, offsets in common.text_blocks(batch.column(2)):
            body = data.tobytes().translate(LOWER)
            begin, stop, first = common.word_spans(np.frombuffer(body, np.uint8), offsets, IS_WORD)
            n_hit, lists = np.zeros(end - row, np.int64), [[]] * (end - row)
            for k in np.flatnonzero(candidates.slice(row, end - row).is_valid().to_numpy(zero_copy_only=False)):
                words = [body[a:b] for a, b in zip(begin[first[k]:first[k + 1]].tolist(), stop[first[k]:first[k + 1]].tolist())]
                owners: dict[int, dict[bytes, set]] = {}
                for item in candidates[row + int(k)].as_py():
                    own = item["text"].encode().translate(LOWER)
                    a, b, _ = common.word_spans(np.frombuffer(own, np.uint8), np.array([0, len(own)]), IS_WORD)
                    own = [own[x:y] for x, y in zip(a.tolist(), b.tolist())]
                    size = min(WINDOW, len(own))
                    for window in _windows(own, size) if size else ():
                        owners.setdefault(size, {}).setdefault(window, set()).add(item["item"])
                hit, found = np.zeros(len(words) + 1, np.int64), set()
                for size, known in owners.items():
                    for i, window in enumerate(_windows(words, size)):
                        if window in known:
                            found |= known[window]
                            hit[i] += 1
                            hit[i + size] -= 1
                n_hit[k] = np.count_nonzero(np.cumsum(hit)[:-1] > 0)
                lists[k] = sorted(x for x in found if x is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(np.diff(first)), pa.array(n_hit), pa.array(lists, pa.list_(pa.string()))], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, key, n_words, n_hit, items (ids as strings, sorted, each once).

    Null texts have no words. An item without an id marks words as hit but is not listed. Rows of
    the benchmark that repeat an id add their windows to that item. Empty tables are allowed.
    """
    items = common.texts(benchmark, item_col, item_text_col).select(
        F.xxhash64("rank", "key").alias("item_key"), F.col("id").cast("string").alias("item"), "rank", "key", "text").distinct()
    short = _short_lengths(items)
    marks = common.store(
        fingerprints(items.select(F.col("item_key").alias("rank"), "key", "text"), short, whole=True)
        .select("h", F.col("rank").alias("item_key")).distinct(), "benchmark-hashes")
    small = marks.count() <= BROADCAST_ROWS
    rows = common.texts(docs, id_col, text_col)
    pairs = (fingerprints(rows, short, whole=False).join(F.broadcast(marks) if small else marks, "h")
             .select("rank", "key", "item_key").distinct())
    owners = items.select("item_key", F.struct("item", "text").alias("item"))
    candidates = common.store(
        pairs.join(F.broadcast(owners) if small else owners, "item_key")
        .groupBy("rank", "key").agg(F.collect_list("item").alias("items")), "benchmark-candidates")
    return (rows.join(candidates, ["rank", "key"], "left").select("id", "key", "text", "items")
            .mapInArrow(_extend, "id long, key long, n_words long, n_hit long, items array<string>"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no window of a benchmark item, unchanged."""
    found = decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.where("n_hit > 0"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
         lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
