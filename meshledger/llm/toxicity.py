"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning is online and per coordinate; L1 keeps almost all of the 2^DIM_BITS weights at zero, so the
model is a short list that is broadcast. The labelled rows, at most MAX_ROWS of them (those with the
smallest hash of their id), are dealt to shards of about SHARD_ROWS; each task runs FTRL over its
rows from the common state. Each coordinate then becomes the average over the shards that met it, so that
a word of few shards isn't held back by the others, and the next round starts from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common
from meshledger.llm.decontaminate import IS_WORD, LOWER

DIM_BITS, MAX_ROWS, SHARD_ROWS, ROUNDS = 20, 24_000, 3000, 3
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.0
THRESHOLD, STEMS = 0.7, (4, 5, 6)

#: Odd multipliers that tell a word's place in a bigram or skip-gram.
HERE, NEXT, SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, index of each feature) of a block of texts.

    Features are the words (runs of letters and digits, A-Z lower-cased), their stems (the first
    STEMS bytes of longer words, so that inflected forms meet), the pairs of neighbours and the
    pairs with one word between; index 0 is left to the constant.
    """
    for row, end, data, offsets in common.text_blocks(column):
        data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
        begin, stop, first = common.word_spans(data, offsets, IS_WORD)
        h = common.span_hashes(data, begin, stop, 1)
        owner = np.repeat(np.arange(end - row), np.diff(first))
        near, far = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
        hashes = [h, common.mix(h[:-1] * HERE + h[1:] * NEXT)[near], common.mix(h[:-2] * HERE + h[2:] * SKIP)[far]]
        owners = [owner, owner[:-1][near], owner[:-2][far]]
        for size in STEMS:
            longer = np.flatnonzero(stop - begin > size)
            hashes.append(common.span_hashes(data, begin[longer], begin[longer] + size, 2))
            owners.append(owner[longer])
        index = (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)
        yield row, end, np.concatenate(owners), np.maximum(index, 1)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step in closed form; zero where |z| <= L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _run_shard(index: list[np.ndarray], labels: list[int], z: np.ndarray, n: np.ndarray) -> None:
    for own, y in zip(index, labels):
        w = weights_of(z[own], n[own])
        g = _sigmoid(w.sum()) - y
        step = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
        z[own] += g - step * w
        n[own] += g * g


def train(rows: DataFrame, bits: int = DIM_BITS, rounds: int = ROUNDS, shards: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of the nonzero weights. ``rows`` (order, text, label) is bounded by the caller."""
    spark = rows.sparkSession
    dealt = common.store(rows.withColumn("shard", F.pmod("order", F.lit(shards)))
                         .repartition(shards, "shard").sortWithinPartitions("shard", "order"), "toxicity-rows")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(rounds):
        at = np.flatnonzero(n)
        state = spark.sparkContext.broadcast((at, z[at], n[at]))

        def work(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            shards_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                shard = batch.column(0).to_numpy()
                label = batch.column(2).to_numpy()
                for row, end, owner, index in features(batch.column(1), bits):
                    order = np.argsort(owner, kind="stable")
                    cuts = np.searchsorted(owner[order], np.arange(end - row + 1))
                    for k in range(end - row):
                        if int(shard[row + k]) not in shards_:
                            own = shards_[int(shard[row + k])] = np.zeros(1 << bits), np.zeros(1 << bits)
                            own[0][state.value[0]], own[1][state.value[0]] = state.value[1], state.value[2]
                        seen = np.unique(index[order[cuts[k]:cuts[k + 1]]])
                        _run_shard([np.append(seen, 0)], [int(label[row + k])], *shards_[int(shard[row + k])])
            common_n = np.zeros(1 << bits)
            common_n[state.value[0]] = state.value[2]
            for z_, n_ in shards_.values():
                at = np.flatnonzero(n_ != common_n)  # every gradient adds to n
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(z_[at]), pa.array(n_[at])], ["i", "z", "n"])

        states = (dealt.select("shard", "text", "label").mapInArrow(work, "i long, z double, n double")
                  .groupBy("i").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))).toArrow()
        at = states["i"].to_numpy()
        z[at], n[at] = states["z"].to_numpy(), states["n"].to_numpy()
        state.unpersist()
        common.release(spark)
    common.discard(dealt)
    w = weights_of(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def score(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = DIM_BITS) -> DataFrame:
    """(id, key, score) for every text of ``rows`` (id, key, text); each feature counts once a text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << bits)
        weights[sent.value[0]] = sent.value[1]
        for batch in batches:
            for row, end, owner, index in features(batch.column(2), bits):
                used = np.flatnonzero(weights[index])
                once = np.unique(owner[used] << bits | index[used])
                total = np.bincount(once >> bits, weights[once & ((1 << bits) - 1)], end - row) + weights[0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(_sigmoid(total))],
                    ["id", "key", "score"])

    return rows.select("id", "key", "text").mapInArrow(work, "id long, key long, score double")


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: id, key, held_out, score (0 to 1), predicted.

    At most ``max_rows`` labelled rows are learned from, none of them held out. Null texts are
    empty; an empty text gets the constant's score. Labels without an id or value are left out, of
    several labels of an id the highest counts. Without any labelled row every score is 0.5.
    """
    rows = common.texts(docs, id_col, text_col)
    marks = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
             .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")))
    order = F.xxhash64("id", F.lit("toxicity"))
    sample = common.store(marks.withColumn("order", order).orderBy("order", "id").limit(max_rows), "toxicity-sample")
    shards = max(1, sample.count() // SHARD_ROWS)
    model = train(rows.join(F.broadcast(sample), "id").select("order", "text", "label"), shards=shards)
    return score(rows, model).select(
        "id", "key", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not predicted toxic, unchanged."""
    found = toxicity(docs, common.table(spark, sf_dir, "labels"))
    return common.without(docs, found.where("predicted = 1"))
