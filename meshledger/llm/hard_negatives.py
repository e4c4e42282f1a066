"""Hard negatives of anchors by an inverted multi-index, with whole results.

Vectors are cut into two halves, each with a codebook fitted on a bounded sample; a pair of codes is a
cell. Rows are dealt over shards of bounded size by a hash, so a crowded cell is spread over all of
them. Inside a shard the rows lie cell by cell, and each code has a radius: the greatest distance of
its rows' halves. For an anchor q, ``q1.c + |q1| r`` bounds the half-score of all rows of a code, and
the sum of two such bounds the score of a cell. A heap visits the cells by falling bound
(multi-sequence) and stops when no unvisited cell can hold a row that a window still wants: the
result is certified, not approximate.

First the positives of each anchor are searched, then, by their scores, the windows of its negatives.
The anchors are a stated query set, streamed past each shard in batches; what shards find, at most
five rows for each window, is cut to five again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshledger.llm import common, vectors

SCALE, ANCHORS_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and at most the positive's.
LEAST_PERCENT = 80
#: Rows of a shard, rows from which the codebooks are fitted, most codes of a half, rows a cell shall have.
SHARD_ROWS, SAMPLE, CODES, CELL_ROWS, ROUNDS = 100_000, 20_000, 32, 64, 8
_NONE = -(1 << 62)


def prepared(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, x) of the rows that take part; rows that repeat all three count once."""
    vec, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    rows = table.where(vec.isNotNull() & label.isNotNull() & vectors.whole(F.col(vector_col))).select(
        vec.alias("id"), F.when(vec % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        vectors.scaled(F.col(vector_col), SCALE).alias("x"))
    d = vectors.dimension(rows, "x")
    return rows.where(F.size("x") == d).distinct()


def _nearest(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Index of the nearest code, in blocks of rows."""
    own = (codebook**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(own - x[a:a + 8192] @ codebook.T).argmin(axis=1) for a in range(0, len(x), 8192)]])


def fit_codebook(x: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of distinct rows, begun at evenly spaced ones along their first direction."""
    x = np.unique(x, axis=0)
    if len(x) <= codes:
        return x if len(x) else np.zeros((1, x.shape[1]))
    book = x[np.linspace(0, len(x) - 1, codes).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, book)
        total, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


class Shard:
    """Rows in the order of their cells, with exact radii of the codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = books[0].shape[1]
        # products of integers are exact as doubles below 2^53, and quicker
        self.exact = len(x) == 0 or np.square(x.astype(float)).sum(axis=1).max() < 1 << 53
        near = [_nearest(h.astype(float), b) for h, b in zip((x[:, :half], x[:, half:]), books)]
        cell = near[0] * len(books[1]) + near[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order].astype(float if self.exact else np.int64)
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.books, self.half = books, half
        self.radii = []
        for h, b, at in zip((x[:, :half], x[:, half:]), books, near):
            radius = np.full(len(b), -np.inf)  # codes without rows are never visited
            np.maximum.at(radius, at, np.sqrt(np.square(h - b[at]).sum(axis=1)))
            self.radii.append(radius * (1 + 1e-12))

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, end row) of the cells with rows, by falling upper bound."""
        bounds = []
        for part, book, radius in zip((q[:self.half], q[self.half:]), self.books, self.radii):
            centre, reach = book @ part, np.linalg.norm(part) * np.maximum(radius, 0)
            upper = np.where(radius < 0, -np.inf, centre + reach)
            order = np.argsort(-upper, kind="stable")[:int((radius >= 0).sum())]
            bounds.append((order.tolist(), upper[order].tolist(), (centre - reach)[order].tolist()))
        (code1, up1, low1), (code2, up2, low2) = bounds
        if not code1:
            return
        wide, taken = len(self.books[1]), [0] * len(code1)  # so many cells of a row of the grid were visited
        heap = [(-(up1[0] + up2[0]), 0, 0)]
        slack = 1.0 + 1e-9 * (abs(up1[0]) + abs(up2[0]))  # scores are integers; bounds are rounded
        while heap:
            upper, i, j = heapq.heappop(heap)
            taken[i] = j + 1
            # a cell is pushed once the cell above it and the one to its left were visited
            if i + 1 < len(code1) and taken[i + 1] == j:
                heapq.heappush(heap, (-(up1[i + 1] + up2[j]), i + 1, j))
            if j + 1 < len(code2) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            cell = code1[i] * wide + code2[j]
            if self.starts[cell] < self.starts[cell + 1]:
                yield -upper + slack, low1[i] + low2[j] - slack, self.starts[cell], self.starts[cell + 1]

    def search(self, own: tuple[int, int], q: np.ndarray, same: bool, windows: list[tuple[int, int]], count: int) -> list[list[tuple[int, int]]]:
        """Per window (least, most score) the first ``count`` rows (score, id): higher scores, then smaller ids.

        ``own`` is the anchor's (id, label); ``same`` asks for other rows of its label, else for rows
        of other labels. A window is certified when the next bound is below its least wanted score.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        want, top = [least for least, _ in windows], max(most for _, most in windows)
        q = q.astype(self.x.dtype)
        for upper, lower, a, z in self.cells(q):
            least = min(want)
            if upper < least:
                break
            if lower > top:
                continue
            score = self.x[a:z] @ q
            at = np.flatnonzero((score >= least) & ((self.labels[a:z] == own[1]) if same else (self.labels[a:z] != own[1])))
            if same and len(at):
                at = at[(self.ids[a:z][at] != own[0]) | (self.x[a:z][at] != q).any(axis=1)]
            if not len(at):
                continue
            score, ids = score[at].astype(np.int64), self.ids[a:z][at]
            for w, (_, most) in enumerate(windows):
                good = np.flatnonzero((score >= want[w]) & (score <= most))
                if len(good):
                    order = good[np.lexsort((ids[good], -score[good]))[:count]]
                    merged = sorted([*found[w], *zip(score[order].tolist(), ids[order].tolist())], key=lambda t: (-t[0], t[1]))[:count]
                    found[w] = merged
                    if len(merged) == count:
                        want[w] = max(want[w], merged[-1][0])
        return found


ROW = "shard int, kind int, id long, label long, x array<long>, windows array<struct<place:int,least:long,most:long>>"
FOUND = "anchor_id long, anchor_label long, anchor_x array<long>, place int, least long, most long, score long, id long"


def _searcher(books: tuple[np.ndarray, np.ndarray], same: bool, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, shard = None, [], None
        for b in batches:
            numbers, kinds = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (np.diff(numbers) != 0) | (np.diff(kinds) != 0), True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(a, z - a)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                x = part.column("x").flatten().to_numpy().reshape(len(ids), -1)
                if numbers[a] != current:
                    current, kept, shard = numbers[a], [], None
                if kinds[a] == 0:  # rows of the index come before the anchors
                    kept.append((ids.copy(), labels.copy(), x.copy()))
                    continue
                if shard is None and kept:
                    shard, kept = Shard(*map(np.concatenate, zip(*kept)), books), []
                if shard is None:
                    continue
                out: list[tuple] = []
                for k, windows in enumerate(part.column("windows").to_pylist()):
                    bounds = [(w["least"], w["most"]) for w in windows]
                    for w, hits in zip(windows, shard.search((int(ids[k]), int(labels[k])), x[k], same, bounds, count)):
                        out += [(k, w["place"], w["least"], w["most"], score, i) for score, i in hits]
                if out:
                    k, place, least, most, score, i = zip(*out)
                    k = pa.array(k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(k), part.column("label").take(k), part.column("x").take(k), pa.array(place, pa.int32()),
                         *[pa.array(v, pa.int64()) for v in (least, most, score, i)]],
                        ["anchor_id", "anchor_label", "anchor_x", "place", "least", "most", "score", "id"])

    return run


def _look_up(rows: DataFrame, anchors: DataFrame, books, shards: int, same: bool, count: int) -> DataFrame:
    """FOUND rows: for each anchor and window the first ``count`` rows of all shards, ranked from 1."""
    index = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "label", "x",
                        F.lit(None).cast("array<struct<place:int,least:long,most:long>>").alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "label", "x", "windows")
    dealt = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_searcher(books, same, count), FOUND)
    best = Window.partitionBy("anchor_id", "anchor_label", "anchor_x", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def mine(table: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label, vector or entry, or an entry that is not finite, take no part, nor do
    vectors of another length than the commonest. Rows that repeat id, label and vector are one; rows
    that share an id but differ otherwise are different rows. Equal scores rank by id; equal ids with
    equal scores give equal output rows. An anchor without other rows of its label, and a positive
    without a row in its window (any positive with a score below zero), give none; nor does an empty
    table. Scores must fit a long. ``anchor`` picks the anchors by ``id``; by default those whose id is divisible by 100.
    """
    spark = table.sparkSession
    rows = common.store(prepared(table, id_col, vector_col, label_col), "vectors")
    n = rows.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    chosen = rows.select("x", F.xxhash64("id", "x").alias("h")).orderBy("h").limit(sample).select("x").toArrow()["x"]
    points = chosen.combine_chunks().flatten().to_numpy().reshape(len(chosen), -1).astype(float)
    # small tables are still spread over the session's tasks
    shards = max(n // shard_rows + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4096 + 1))
    codes = int(min(CODES, max(1, (n / shards / CELL_ROWS) ** 0.5)))
    half = points.shape[1] // 2
    books = (fit_codebook(points[:, :half], codes), fit_codebook(points[:, half:], codes))

    anchors = rows.where(F.col("id") % ANCHORS_EVERY == 0 if anchor is None else anchor)
    window = lambda place, least, most: F.struct(place.cast("int").alias("place"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    everything = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(_NONE), F.lit(-_NONE))))
    positives = common.store(_look_up(rows, everything, books, shards, True, POSITIVES).select(
        "anchor_id", "anchor_label", "anchor_x", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most five windows for each anchor; a negative score leaves its window empty
    ceiling = F.ceil(F.col("positive_score") * LEAST_PERCENT / F.lit(100).cast("decimal(3,0)")).cast("long")
    asked = (positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), F.col("anchor_x").alias("x"))
             .agg(F.collect_list(window(F.col("place"), ceiling, F.col("positive_score"))).alias("windows")))
    negatives = _look_up(rows, asked, books, shards, False, NEGATIVES).select(
        "anchor_id", "anchor_label", "anchor_x", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "anchor_label", "anchor_x", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM rows AS a, rows AS r WHERE a.vec_id % {ANCHORS_EVERY} = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""
