"""A Brown class-based bigram model: P(text) = product of P(class | class before) P(word | class).

Words with at least UNIT_SHARE of all tokens (a list of bounded length) are units of their own, all
others are first pooled by their ending into POOLS units. Exchange clustering deals the units to CLASSES.
Its passes over the bigram counts are distributed: for a slice of the units at a time they count the
neighbours by class. With these few numbers a unit each, the units of the slice then move, one after
the other, to the class that raises the mutual information of neighbouring classes most, until hardly
any moves. Then each pooled word that occurs EVIDENCE times, however large the corpus, gets the class that is best
for its own neighbours by the same objective, against the finished table of class pairs; this pass is
distributed by word. Rarer words keep the class of their pool. Class pairs are then counted again.
Every word of the corpus so has a class; its emission probability uses its own count.

Counts cover all training texts. Words with at least KNOWN_SHARE of all tokens (a bounded list, too)
are broadcast with their counts and classes; the counts and classes of all others are joined to their
places in the texts, by buckets of words sent as packed arrays. That is done once: every text is then
stored as one byte for the class of each token, from which class pairs and scores are counted.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common, repeats

CLASSES, POOLS, ROUNDS, SLICES = 64, 512, 30, 6
#: The exchange ends with a round that moves less than this share of the tokens, or after ROUNDS.
SETTLED = 1e-3
#: Occurrences from which a pooled word has a class of its own.
EVIDENCE = 10
UNIT_SHARE, KNOWN_SHARE = 5e-5, 1e-6
#: Pseudo-count of the class unigram in a class transition.
BACKOFF = 5.0
#: The token that ends every text; no word holds a space.
END = b" "
BLOCK = 16 << 20
#: The class of a neighbour that is not listed.
OPEN = 255


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All words of a block, lower-cased, with END after each text; and the first token of each text."""
    body, words, first = data.tobytes().lower(), [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        words += body[a:b].split()
        words.append(END)
        first.append(len(words))
    return words, np.array(first)


def _pool(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % POOLS


def held_out(id_col: Column) -> Column:
    """Texts that nothing is learned from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n) of all tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for a in range(0, len(words), 50_000):
                own = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([held[w] for w in own], pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, data, offsets in common.text_blocks(batch.column(0)):
                held.update(_tokens(data, offsets)[0])
                size += len(data)
                if size >= BLOCK:
                    yield from out()
                    held, size = Counter(), 0
        yield from out()

    return train.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What is broadcast: the frequent words, their units and counts, and the class tables."""

    tokens: int = 0
    words: int = 0
    known: dict[bytes, int] = field(default_factory=dict)
    unit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    log_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    units: int = 0
    of_unit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    log_move: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    log_total: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the known list or -1, unit) of each token."""
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        unit = np.full(len(words), -1, np.int64)
        unit[at >= 0] = self.unit[at[at >= 0]]
        pooled = np.flatnonzero(unit < 0)
        unit[pooled] = [_pool(words[i]) for i in pooled.tolist()]
        return at, unit


def known_least(model: Model) -> float:
    """Occurrences from which a word is listed."""
    return max(KNOWN_SHARE * model.tokens, 2)


def frequent_words(counts: DataFrame) -> Model:
    """Totals and the frequent words; both lists are bounded by one over their share."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    model = Model(tokens=int(total.n or 0), words=int(total.v))
    listed = counts.where((F.col("n") >= known_least(model)) | (F.col("word") == F.lit(END))).toArrow()
    words, n = listed["word"].to_pylist(), listed["n"].to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    model.known = {w: i for i, w in enumerate(words)}
    model.log_count = np.log10(n + 1)
    own = int(np.count_nonzero(n >= UNIT_SHARE * model.tokens))
    model.units = POOLS + own
    model.unit = np.array([POOLS + i if i < own else _pool(w) for i, w in enumerate(words)], np.int32)
    return model


def unit_sizes(counts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of every unit, over the whole vocabulary."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(sent.value.units), np.zeros(sent.value.units, np.int64)
        for batch in batches:
            _, unit = sent.value.units_of(batch.column(0).to_pylist())
            n += np.bincount(unit, batch.column(1).to_numpy(), len(n))
            v += np.bincount(unit, minlength=len(v))
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64)), pa.array(v[at])], ["unit", "n", "v"])

    found = counts.select("word", "n").mapInArrow(work, "unit long, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    n, v = np.zeros(model.units), np.zeros(model.units)
    at = found["unit"].to_numpy()
    n[at], v[at] = found["n"].to_numpy(), found["v"].to_numpy()
    return n, v


def unit_bigrams(train: DataFrame, model: Model) -> DataFrame:
    """One row per unit: (unit, after, n_after, before, n_before), its neighbours on both sides with counts.

    A text begins after an end. The lists are no longer than the bounded number of units.
    """
    sent = train.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, end = sent.value.units, sent.value.unit[sent.value.known[END]]
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            for a in range(0, len(code), 1 << 18):
                c, k = code[a:a + (1 << 18)], n[a:a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(c // units), pa.array(c % units), pa.array(k)], ["u", "v", "n"])

        for batch in batches:
            for _, _, data, offsets in common.text_blocks(batch.column(0)):
                _, unit = sent.value.units_of(_tokens(data, offsets)[0])
                held.append(np.r_[end, unit[:-1]] * units + unit)
                size += len(unit)
                if size >= 6 << 20:
                    yield from out()
                    held, size = [], 0
        yield from out()

    pairs = train.select("text").mapInArrow(work, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))
    pairs = common.store(pairs, "unit-bigrams")
    after = pairs.groupBy(F.col("u").alias("unit")).agg(F.collect_list("v").alias("after"), F.collect_list("n").alias("n_after"))
    before = pairs.groupBy(F.col("v").alias("unit")).agg(F.collect_list("u").alias("before"), F.collect_list("n").alias("n_before"))
    return common.store(after.join(before, "unit", "full"), "unit-neighbours")


def _entropy_term(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def move(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, at: int, to: int) -> None:
    """Carry a unit's pairs over to another class, in place."""
    for target, sign in ((at, -1), (to, 1)):
        table[target] += sign * right
        table[:, target] += sign * left
        # pairs of the unit with itself are in right and left under its old class, and belong under the new
        table[target, at] -= sign * own
        table[at, target] -= sign * own
        table[target, target] += sign * own


def best_class(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, at: int) -> int:
    """The class for a unit of class ``at`` that makes sum N log N over class pairs, less both margins, largest.

    ``table`` counts class pairs; ``right`` and ``left`` count the unit's neighbours by class, with
    ``own`` pairs of the unit with itself, which are in both under ``at``.
    """
    right, left = right.copy(), left.copy()
    right[at] -= own
    left[at] -= own
    rest = table.copy()
    rest[at] -= right
    rest[:, at] -= left
    rest[at, at] -= own
    rows, columns = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    gain = (_entropy_term(rest[:, after] + right[after]) - _entropy_term(rest[:, after])).sum(axis=1)
    gain += (_entropy_term(rest[before] + left[before, None]) - _entropy_term(rest[before])).sum(axis=0)
    d = np.diagonal(rest)
    gain += _entropy_term(d + right + left + own) - _entropy_term(d + right) - _entropy_term(d + left) + _entropy_term(d)
    more_rows, more_columns = right.sum() + own, left.sum() + own
    gain -= _entropy_term(rows + more_rows) - _entropy_term(rows) + _entropy_term(columns + more_columns) - _entropy_term(columns)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[at] + 1e-9 else at


_MOVES = pa.schema([("unit", pa.int64()), ("own", pa.float64()), ("right", pa.list_(pa.float64())), ("left", pa.list_(pa.float64()))])


def exchange(neighbours: DataFrame, sizes: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class pairs) after rounds of distributed exchange, until hardly any unit moves."""
    spark = neighbours.sparkSession
    of_unit = np.zeros(len(sizes), np.int64)
    of_unit[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes)) % classes

    def class_pairs() -> np.ndarray:
        sent = spark.sparkContext.broadcast(of_unit)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(classes * classes, np.int64)
            for batch in batches:
                for u, v, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if v.is_valid:
                        code = sent.value[u] * classes + sent.value[v.values.to_numpy()]
                        table += np.bincount(code, n.values.to_numpy(), classes * classes).astype(np.int64)
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

        found = neighbours.select("unit", "after", "n_after").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(classes * classes)
        table[found["at"].to_numpy()] = found["n"].to_numpy()
        return table.reshape(classes, classes)

    for turn in range(rounds * SLICES):
        if turn % SLICES == 0:
            if turn and moved < SETTLED * sizes.sum():
                break
            table, moved = class_pairs(), 0.0
        sent = spark.sparkContext.broadcast(of_unit)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for u, after, n_after, before, n_before in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                    right, left, own = np.zeros(classes), np.zeros(classes), 0.0
                    if after.is_valid:
                        v, n = after.values.to_numpy(), n_after.values.to_numpy()
                        right, own = np.bincount(sent.value[v], n, classes), float(n[v == u].sum())
                    if before.is_valid:
                        left = np.bincount(sent.value[before.values.to_numpy()], n_before.values.to_numpy(), classes)
                    found.append({"unit": u, "own": own, "right": right.tolist(), "left": left.tolist()})
                if found:
                    yield pa.RecordBatch.from_pylist(found, _MOVES)

        seen = (neighbours.where(F.pmod(F.xxhash64("unit"), F.lit(SLICES)) == turn % SLICES)
                .mapInArrow(work, "unit long, own double, right array<double>, left array<double>").toArrow())
        sizes_ = sizes[seen["unit"].to_numpy()]
        for k in np.argsort(-sizes_, kind="stable").tolist():
            u, own = seen["unit"][k].as_py(), seen["own"][k].as_py()
            right, left = (np.array(seen[c][k].as_py()) for c in ("right", "left"))
            at, best = int(of_unit[u]), best_class(table, right, left, own, int(of_unit[u]))
            if best != at:
                move(table, right, left, own, at, best)
                of_unit[u] = best
                moved += float(sizes[u])
    return of_unit, class_pairs()


ENTRY_ROWS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "sizes", "code", "count"))])


def word_classes(train: DataFrame, model: Model, table: np.ndarray, n: int) -> DataFrame:
    """(word, n, cls) of every pooled word: with EVIDENCE the best class for its neighbours, else that of its pool.

    Each word is tried by itself against ``table``, with the classes its neighbours' units have.
    """
    sent, width = train.sparkSession.sparkContext.broadcast((model, table)), 2 * CLASSES + 1

    def out(held: dict[bytes, int], codes: list[np.ndarray]) -> Iterator[dict]:
        if not held:
            return
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        words = list(held)
        name = np.array([zlib.crc32(w) % n for w in words])
        size, order = np.bincount(code // width, minlength=len(words)), np.argsort(name, kind="stable")
        cuts = np.searchsorted(name[order], np.arange(n + 1))
        for row in repeats.packed(name[code // width], {"code": (code % width, "u1"), "count": (count, "<u4")}):
            own = order[cuts[row["bucket"]]:cuts[row["bucket"] + 1]]
            yield row | {"words": b"\n".join(words[i] for i in own.tolist()), "sizes": repeats.pack(size[own], "<u4")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = sent.value[0]
        end = int(m.of_unit[m.unit[m.known[END]]])
        held, codes, size = {}, [], 0
        for batch in batches:
            for _, _, data, offsets in common.text_blocks(batch.column(0)):
                words, _ = _tokens(data, offsets)
                _, unit = m.units_of(words)
                cls = m.of_unit[unit]
                pooled = np.flatnonzero(unit < POOLS)
                places = np.fromiter((held.setdefault(words[i], len(held)) for i in pooled.tolist()), np.int64, len(pooled))
                # the end before the block's first text is the end of its last
                codes += [places * width + np.roll(cls, -1)[pooled], places * width + CLASSES + np.r_[end, cls][pooled]]
                twice = np.flatnonzero((np.r_[pooled[1:], pooled[:1] + len(words)] == pooled + 1) & (np.roll(places, -1) == places))
                codes.append(places[twice] * width + 2 * CLASSES)
                size += len(data)
                if size >= BLOCK:
                    yield from out(held, codes)
                    held, codes, size = {}, [], 0
        yield from out(held, codes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pairs = sent.value
        for rows in repeats.buckets_of(batches):
            held: dict[bytes, int] = {}
            places = np.concatenate([np.repeat([held.setdefault(w, len(held)) for w in row["words"].split(b"\n")], np.frombuffer(row["sizes"], "<u4"))
                                     for row in rows])
            x = repeats.unpacked(rows, {"code": "u1", "count": "<u4"})
            code, which = np.unique(places * width + x["code"], return_inverse=True)
            count = np.bincount(which, x["count"])
            owner, code = code // width, code % width
            words = list(held)
            total = np.bincount(owner, np.where((code >= CLASSES) & (code < 2 * CLASSES), count, 0), len(words))
            cls = np.array([m.of_unit[_pool(w)] for w in words], np.int64)
            cut = np.searchsorted(owner, np.arange(len(words) + 1))
            for i in np.flatnonzero(total >= EVIDENCE).tolist():
                own = np.zeros(width)
                own[code[cut[i]:cut[i + 1]]] = count[cut[i]:cut[i + 1]]
                cls[i] = best_class(pairs, own[:CLASSES], own[CLASSES:2 * CLASSES], own[-1], int(cls[i]))
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a:a + 50_000], pa.binary()), pa.array(total[a:a + 50_000].astype(np.int64)),
                                                  pa.array(cls[a:a + 50_000].astype(np.int32))], ["word", "n", "cls"])

    entries = train.select("text").mapInArrow(lambda it: repeats.record_batches(read(it), ENTRY_ROWS, 200),
                                              "bucket int, words binary, sizes binary, code binary, count binary")
    found = entries.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(choose, "word binary, n long, cls int")
    return common.store(found, "word-classes", large=True)


def fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table (word, n, cls) of all words, and the class strings of all texts (`class_strings`).

    Learned from those ``rows`` (rank, key, text, train) whose ``train`` is true. ``cls`` is null for the units.
    """
    spark, train = rows.sparkSession, rows.where("train").select("text")
    parts = common.parts(spark, common.text_megabytes(rows), 40)
    counts = common.store(word_counts(train), "word-counts")
    model = frequent_words(counts)
    if not model.tokens:
        words = counts.withColumn("cls", F.lit(0))
        return model, words, class_strings(rows, model, words, parts)
    n, _ = unit_sizes(counts, model)
    neighbours = unit_bigrams(train, model)
    model.of_unit, table = exchange(neighbours, n)
    common.discard(neighbours)
    classed = word_classes(train, model, table, parts)
    # listed words with evidence are units of their own from here on
    own = model.units - POOLS
    listed = classed.where((F.col("n") >= known_least(model)) & (F.col("n") >= EVIDENCE)).select("word", "cls").toArrow()
    at = np.array([model.known[w] for w in listed["word"].to_pylist()], np.int64)
    model.of_unit = np.r_[model.of_unit, np.zeros(len(model.known) - own, np.int64)]
    model.of_unit[POOLS + at] = listed["cls"].to_numpy()
    model.unit[at] = POOLS + at
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classed.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r.cls], words[r.cls] = r.n, r.v
    tokens += np.bincount(model.of_unit[POOLS:POOLS + own], n[POOLS:POOLS + own], CLASSES)
    words += np.bincount(model.of_unit[POOLS:POOLS + own], minlength=CLASSES)
    strings = class_strings(rows, model, classed, parts)
    table = class_pairs(strings)
    prior = (tokens + 1) / (tokens.sum() + CLASSES)
    model.log_move = np.log10((table + BACKOFF * prior) / (table.sum(axis=1, keepdims=True) + BACKOFF))
    model.log_total = np.log10(tokens + words + 1)
    units = counts.where(F.col("n") >= UNIT_SHARE * model.tokens).join(classed.select("word"), "word", "left_anti")
    return model, classed.unionByName(units.withColumn("cls", F.lit(None).cast("int"))), strings


#: Rows of words with their counts and classes, of words at their places, of places with class and count, of texts.
COUNTS, TOKENS, PLACES, TEXTS = 0, 1, 2, 3
SENT_KINDS = {"words": "binary", "sizes": "<u4", "rank": "<i8", "key": "<i8", "pos": "<u4", "cls": "u1", "n": "<i8", "copies": "<u4",
              "tokens": "<u4", "known": "<u4", "value": "<f8"}
SENT_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in SENT_KINDS)])
SENT_TYPE = ", ".join(["bucket int, kind int", *(f"{c} binary" for c in SENT_KINDS)])
PLACE = {c: SENT_KINDS[c] for c in ("rank", "key", "pos", "cls", "n")}
TEXT = {c: SENT_KINDS[c] for c in ("rank", "key", "copies", "tokens", "known", "value")}
#: Places that a bucket of words holds before it sends them on; words that are sent together.
GATHERED_PLACES, SENT_WORDS = 1 << 20, 200_000
STRING_TYPE = "rank long, key long, copies long, n_tokens long, n_known long, log_counts double, cls binary"


def class_strings(rows: DataFrame, model: Model, words: DataFrame, n: int) -> DataFrame:
    """(rank, key, copies, n_tokens, n_known, log_counts, cls): every text of ``rows`` (rank, key, text, train) as the classes of its tokens.

    Rows that agree in rank and key are one; ``copies`` counts those to learn from. ``log_counts`` sums
    log10(count + 1) over the tokens. Classes and counts of listed words are broadcast; all others
    are sent to the bucket of their word, where they meet the table ``words`` (word, n, cls), and from there
    to the bucket of their text: one row for each two buckets, whatever the number of blocks.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    least = known_least(model)

    def text_bucket(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (common.mix(rank.view(np.uint64) ^ key.view(np.uint64)) % np.uint64(n)).astype(np.int64)

    def rare_out(held: dict[bytes, int], found: list) -> Iterator[dict]:
        if not held:
            return
        words_, place = list(held), np.concatenate([x[0] for x in found])
        columns = dict(zip(("rank", "key", "pos"), (np.concatenate(x) for x in list(zip(*found))[1:])))
        name, size = np.array([zlib.crc32(w) % n for w in words_]), np.bincount(place, minlength=len(words_))
        order = np.argsort(name, kind="stable")
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        at = np.argsort(turn[place], kind="stable")
        cuts = np.searchsorted(name[order], np.arange(n + 1))
        ends = np.r_[0, np.cumsum(size[order])][cuts]
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own, tokens = order[cuts[bucket]:cuts[bucket + 1]], at[ends[bucket]:ends[bucket + 1]]
            yield {"bucket": bucket, "kind": TOKENS, "words": b"\n".join([words_[i] for i in own.tolist()]), "sizes": repeats.pack(size[own], "<u4"),
                   **{c: repeats.pack(x[tokens], SENT_KINDS[c]) for c, x in columns.items()}}

    def texts_out(m: Model, rank: np.ndarray, key: np.ndarray, train: np.ndarray, at: np.ndarray, cls: np.ndarray, first: np.ndarray) -> Iterator[dict]:
        listed, value = at >= 0, np.zeros(len(at))
        value[listed] = m.log_count[at[listed]]
        x = {"rank": rank, "key": key, "copies": train, "tokens": np.diff(first), "known": np.add.reduceat(listed.astype(np.int64), first[:-1]),
             "value": np.add.reduceat(value, first[:-1])}
        # of rows that agree in rank and key one text goes on
        order = np.lexsort((key, rank))
        starts = repeats.group_starts(rank[order], key[order])
        stay = order[starts]
        x = {c: v[stay] for c, v in x.items()} | {"copies": np.add.reduceat(train[order].astype(np.int64), starts)}
        name = text_bucket(x["rank"], x["key"])
        by = np.argsort(name, kind="stable")
        cuts = np.searchsorted(name[by], np.arange(n + 1))
        body = cls.astype(np.uint8).tobytes()
        for row in repeats.packed(name, {c: (v, SENT_KINDS[c]) for c, v in x.items()}):
            own = stay[by[cuts[row["bucket"]]:cuts[row["bucket"] + 1]]].tolist()
            yield row | {"kind": TEXTS, "cls": b"".join([body[first[k]:first[k + 1]] for k in own])}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = sent.value
        held, found, size = {}, [], 0
        for batch in batches:
            rank, key, train = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for row, end, data, offsets in common.text_blocks(batch.column(2)):
                tokens, first = _tokens(data, offsets)
                if m.tokens:
                    at, unit = m.units_of(tokens)
                    cls = np.where(at >= 0, m.of_unit[unit], OPEN)
                    rare = np.flatnonzero(at < 0)
                    place = np.array([held.setdefault(tokens[i], len(held)) for i in rare.tolist()], np.int64)
                    owner = np.searchsorted(first, rare, side="right") - 1
                    found.append((place, rank[row + owner], key[row + owner], rare - first[owner]))
                else:
                    at, cls = np.full(len(tokens), -1), np.zeros(len(tokens), np.int64)
                yield from texts_out(m, rank[row:end], key[row:end], train[row:end], at, cls, first)
                size += len(data)
                if size >= BLOCK:
                    yield from rare_out(held, found)
                    held, found, size = {}, [], 0
        yield from rare_out(held, found)

    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def out(held: list[pa.RecordBatch]) -> Iterator[dict]:
            own = [w for b in held for w in b.column(0).to_pylist()]
            k, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
            name = np.array([zlib.crc32(w) % n for w in own])
            order = np.argsort(name, kind="stable")
            cuts = np.searchsorted(name[order], np.arange(n + 1))
            for row in repeats.packed(name, {"n": (k, "<i8"), "cls": (c, "u1")}):
                yield row | {"kind": COUNTS, "words": b"\n".join([own[i] for i in order[cuts[row["bucket"]]:cuts[row["bucket"] + 1]].tolist()])}

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SENT_WORDS:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    def places_out(held: list[dict[str, np.ndarray]]) -> Iterator[dict]:
        if held:
            x = {c: np.concatenate([h[c] for h in held]) for c in PLACE}
            for row in repeats.packed(text_bucket(x["rank"], x["key"]), {c: (x[c], kind) for c, kind in PLACE.items()}):
                yield row | {"kind": PLACES}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = sent.value
        bucket, table, parts, counts, held, size = -1, {}, [], None, [], 0
        for batch in batches:
            for row in (r for a in range(0, batch.num_rows, 64) for r in batch.slice(a, 64).to_pylist()):
                if row["kind"] == TEXTS:
                    yield row
                    continue
                if row["bucket"] != bucket or size >= GATHERED_PLACES:
                    yield from places_out(held)
                    held, size = [], 0
                if row["bucket"] != bucket:
                    # what no table row names ends the arrays, and is found at -1
                    bucket, table, parts, counts = row["bucket"], {}, [], None
                own = row["words"].split(b"\n")
                if row["kind"] == COUNTS:
                    table.update(zip(own, range(len(table), len(table) + len(own))))
                    parts.append((np.frombuffer(row["n"], "<i8"), np.frombuffer(row["cls"], "u1")))
                    continue
                if counts is None:
                    counts = tuple(np.concatenate([*x, np.zeros(1, np.int64)]).astype(np.int64) for x in (zip(*parts) if parts else ((), ())))
                at = np.fromiter((table.get(w, -1) for w in own), np.int64, len(own))
                k, cls = counts[0][at], counts[1][at]
                for i in np.flatnonzero(at < 0).tolist():
                    cls[i] = m.of_unit[_pool(own[i])]
                each = np.frombuffer(row["sizes"], "<u4")
                held.append({c: np.frombuffer(row[c], SENT_KINDS[c]) for c in ("rank", "key", "pos")} | {"cls": np.repeat(cls, each), "n": np.repeat(k, each)})
                size += int(each.sum())
        yield from places_out(held)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in repeats.buckets_of(batches):
            texts, body = [r for r in held if r["kind"] == TEXTS], []
            x = repeats.unpacked(texts, TEXT)
            cls = np.frombuffer(b"".join(r["cls"] for r in texts), "u1").copy()
            first = np.r_[0, np.cumsum(x["tokens"], dtype=np.int64)]
            # rows of one rank and key met in several blocks: the first has the string
            ranks, keys = np.unique(x["rank"]), np.unique(x["key"])
            code = lambda rank, key: np.searchsorted(ranks, rank) * len(keys) + np.searchsorted(keys, key)
            codes, stay, which = np.unique(code(x["rank"], x["key"]), return_index=True, return_inverse=True)
            copies = np.bincount(which, x["copies"], len(codes)).astype(np.int64)
            value, known = np.zeros(len(cls)), np.zeros(len(cls), bool)
            for row in held:
                if row["kind"] == PLACES:
                    p = repeats.unpacked([row], PLACE)
                    at = first[stay[np.searchsorted(codes, code(p["rank"], p["key"]))]] + p["pos"]
                    cls[at], value[at], known[at] = p["cls"], np.log10(p["n"] + 1.0), p["n"] > 0
            more, listed = (np.add.reduceat(v, first[:-1])[stay] for v in (value, known.astype(np.int64)))
            x = {c: v[stay] for c, v in x.items()}
            body = cls.tobytes()
            for a in range(0, len(stay), 2000):
                b = slice(a, a + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["rank"][b]), pa.array(x["key"][b]), pa.array(copies[b]), pa.array(x["tokens"][b].astype(np.int64)),
                     pa.array(x["known"][b] + listed[b]), pa.array(x["value"][b] + more[b]), pa.array([body[first[k]:first[k + 1]] for k in stay[b].tolist()], pa.binary())],
                    ["rank", "key", "copies", "n_tokens", "n_known", "log_counts", "cls"])

    rare = words.where((F.col("n") < least) & F.col("cls").isNotNull()).select("word", "n", "cls")
    parts = (rows.select("rank", "key", "text", "train").mapInArrow(lambda it: repeats.record_batches(read(it), SENT_ROWS, 200), SENT_TYPE)
             .unionByName(rare.mapInArrow(lambda it: repeats.record_batches(send_counts(it), SENT_ROWS, 200), SENT_TYPE)))
    looked = (parts.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")
              .mapInArrow(lambda it: repeats.record_batches(look_up(it), SENT_ROWS, 200), SENT_TYPE))
    strings = looked.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(assemble, STRING_TYPE)
    return common.store(strings, "class-strings", large=True)


def _steps(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, first token of each text) over the class strings of a batch; a text begins after an end."""
    texts = batch.column(column).to_pylist()
    cls = np.frombuffer(b"".join(texts), "u1").astype(np.int64)
    # each text ends with the end, so the end's class stands before the next one
    before = np.roll(cls, 1)
    return before, cls, np.cumsum([0, *map(len, texts)])


def class_pairs(strings: DataFrame) -> np.ndarray:
    """Counts of neighbouring classes over the texts to learn from."""
    cells = CLASSES * CLASSES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells)
        for batch in batches:
            before, cls, first = _steps(batch, 1)
            table += np.bincount(before * CLASSES + cls, np.repeat(batch.column(0).to_numpy(), np.diff(first)), cells)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["at", "n"])

    found = strings.select("copies", "cls").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(cells)
    table[found["at"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(CLASSES, CLASSES)


def scores(strings: DataFrame, model: Model) -> DataFrame:
    """(rank, key, n_tokens, n_known, log_counts, log_model) of every text; ``log_model`` sums all terms of the model but the counts."""
    sent = strings.sparkSession.sparkContext.broadcast((model.log_move, model.log_total))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_move, log_total = sent.value
        for batch in batches:
            if batch.num_rows:
                before, cls, first = _steps(batch, 5)
                inner = np.add.reduceat(log_move[before, cls] - log_total[cls], first[:-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(inner)], ["rank", "key", "n_tokens", "n_known", "log_counts", "log_model"])

    return strings.select("rank", "key", "n_tokens", "n_known", "log_counts", "cls").mapInArrow(
        work, "rank long, key long, n_tokens long, n_known long, log_counts double, log_model double")


def brown_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are the end token alone. Rows with a null id are learned from. Without any
    training text both scores give every token 1 of 1 (zero).
    """
    rows = common.texts(docs, id_col, text_col)
    model, _, strings = fit(rows.withColumn("train", ~held_out(F.col("id"))))
    found = scores(strings, model)
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(model.tokens + model.words + 1))
    return rows.select("id", "rank", "key").join(found, ["rank", "key"]).select(
        "id", held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("log_counts") + F.col("log_model")).alias("score"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
