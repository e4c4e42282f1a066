"""SimHash near-duplicates found with tables of distances to reference fingerprints (pivots).

For any pivot p, |d(x, p) - d(y, p)| <= d(x, y). The references are REFERENCES fingerprints of the corpus
itself, those of smallest hash; each is a pivot as it is, and once for every one of GROUPS groups of bits
with just that group inverted. From d(x, p) and d(x, p with g inverted) follows how many bits of group g
tell x from p, so two fingerprints that agree inside a group have the same distances there to every
reference, and fingerprints within ``max_bits`` agree in GROUPS - max_bits groups at least. Each choice of
so many groups is a join key, made of its distances to all references; joined pairs are discarded by their
largest coordinate difference over all pivots, and the survivors are verified bit by bit.

Equal fingerprints are one node, so copies never meet in pairs. A key shared by more than CROWD
distinct fingerprints is not paired: its members are linked through the fingerprints one bit away
from them (two within two bits share one), 65 rows each, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common
from meshledger.llm.components import components

SHINGLE, MAX_BITS, GROUPS, REFERENCES, CROWD = 3, 2, 5, 16, 64

#: BITS[b] holds the eight bits of b in eight bytes, for sums over up to 255 hashes at a time.
BITS = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits set in more than half of its hashes."""
    count = np.diff(first)
    votes = np.zeros((len(count), 64), np.int64)
    full = np.flatnonzero(count)
    if len(full):
        # texts are cut into runs of 255 hashes, whose bit counts fit the lanes of a 64-bit word
        pieces = (count[full] + 254) // 255
        owner = np.repeat(full, pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = first[:-1][owner] + 255 * number
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            sums = np.add.reduceat(BITS[octets[:, lane]], starts).view(np.uint8).reshape(-1, 8)
            np.add.at(votes, (owner, slice(8 * lane, 8 * lane + 8)), sums.astype(np.int64))
    bits = (2 * votes > count[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _shingle_hashes(words: list[bytes], size: int) -> list[int]:
    if not words:
        return []
    body, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    size = min(size, len(words))
    starts = [0, *ends[:len(words) - size]]
    return [xxhash.xxh64_intdigest(body[a:b - 1], 42) for a, b in zip(starts, ends[size - 1:])]


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, rank, key, fp): the 64-bit SimHash of each text; zero where there are no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in common.text_blocks(batch.column(3), 1 << 20):
                hashes, first = [], [0]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    hashes += _shingle_hashes(data[a:b].tobytes().lower().split(), shingle)
                    first.append(len(hashes))
                fp = _majority(np.array(hashes, np.uint64), np.array(first))
                own = [batch.column(i).slice(row, end - row) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fp.view(np.int64))], ["id", "rank", "key", "fp"])

    return rows.select("id", "rank", "key", "text").mapInArrow(work, "id long, rank long, key long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(groups: int = GROUPS) -> list[int]:
    """The bits of each group; the 64 bits are dealt to the groups in runs."""
    return [sum(1 << bit for bit in range(64) if bit * groups // 64 == g) for g in range(groups)]


def references(fps: DataFrame, number: int = REFERENCES) -> list[int]:
    """Reference fingerprints: those of the table with the smallest hash, fewer where it has fewer."""
    order = F.xxhash64("fp", F.lit("reference"))
    return [r.fp for r in fps.select("fp").distinct().orderBy(order, "fp").limit(number).collect()]


def distance_table(fps: DataFrame, refs: list[int], groups: int = GROUPS) -> DataFrame:
    """(fp, d): distances to all pivots; for each reference to itself, then to it with each group inverted."""
    pivots = F.array(*[F.lit(_signed(m) ^ p) for p in refs for m in [0, *masks(groups)]])
    return fps.select("fp", F.transform(pivots, lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)).cast("byte")).alias("d"))


def _codes(refs: list[int], groups: int, max_bits: int) -> Column:
    """Join keys: for every choice of groups, the distances to all references inside its groups.

    The distances inside a group are hashed once, and the choices are made of these hashes; written out for
    every choice, the expression outgrows what Spark compiles.
    """
    rows = F.sequence(F.lit(0), F.lit((len(refs) - 1) * (groups + 1)), F.lit(groups + 1))
    # d(x, p inverted in g) = d(x, p) + size of g - 2 x the distance inside g
    distances = lambda g: F.transform(rows, lambda r: F.get("d", r) - F.get("d", r + F.lit(g + 1)))
    inside = [F.xxhash64(distances(g)) for g in range(groups)]
    chosen = combinations(range(groups), groups - max_bits)
    return F.transform(F.array(F.array(*inside)), lambda own: F.array(*[
        F.struct(F.lit(n).alias("choice"), F.xxhash64(*[F.get(own, F.lit(g)) for g in some]).alias("code")) for n, some in enumerate(chosen)]))[0]


def links(fps: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within ``max_bits`` (2)."""
    if max_bits != 2:
        raise ValueError("crowded keys are linked through fingerprints one bit away, which serves two bits")
    refs = references(fps)
    if not refs:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    # distinct numbers are few bytes, the steps below are not: no task should hold many of them
    spread = fps.repartition(common.parts(fps.sparkSession, 0, 1))
    table = common.store(distance_table(spread, refs, groups), "pivot-distances")
    keyed = common.store(table.select("fp", F.explode(_codes(refs, groups, max_bits)).alias("k")).select("k.choice", "k.code", "fp"), "pivot-keys")
    sizes = keyed.groupBy("choice", "code").agg(F.count("*").alias("n")).where("n > 1")
    sizes = common.store(sizes, "pivot-key-sizes")
    few = keyed.join(sizes.where(F.col("n") <= crowd).drop("n"), ["choice", "code"])
    pairs = (few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["choice", "code"])
             .where("a < b").select("a", "b").distinct())
    near, far = (table.select(F.col("fp").alias(x), F.col("d").alias(f"{x}d")) for x in "ab")
    apart = F.array_max(F.zip_with("ad", "bd", lambda x, y: F.abs(x - y)))
    pairs = (pairs.join(near, "a").join(far, "b").where(apart <= max_bits)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))
    many = keyed.join(sizes.where(F.col("n") > crowd).drop("n"), ["choice", "code"], "left_semi").select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]]
    stars = many.select("fp", F.explode(F.array(*flips)).alias("near"))
    hubs = stars.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("near", "a")
    starred = stars.join(hubs, "near").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, rank, key, fp (bigint), root (smallest fp reachable), component (smallest id reachable).

    Null texts are empty; a text without words has fingerprint zero and is linked like any other. A
    null id ranks last: the component is null only where no reachable document has an id. Unlinked
    groups may share a component, by null or repeated ids; they differ in their root.
    """
    rows = common.store(fingerprints(common.texts(docs, id_col, text_col), shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("rank").alias("rank"))
    linked = common.store(links(common.store(rows.select("fp").distinct(), "distinct-fingerprints"), max_bits), "links")
    classes = components(linked, nodes)
    return rows.join(classes, "fp", "left").select(
        "id", "rank", "key", "fp", "root", F.nullif(F.col("component"), F.lit(common.NO_ID)).alias("component"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest id, unchanged.

    In a group, rows that repeat this id with another text go; of rows that repeat id and text one stays.
    Null and repeated ids do not make unlinked documents a group.
    """
    found = near_duplicates(docs)
    keep = found.groupBy("root").agg(F.min(F.struct("rank", "key")).alias("first")).select(
        F.col("first.rank").alias("keep_rank"), F.col("first.key").alias("keep_key"))
    keep = common.store(keep, "kept")
    rank = F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID))
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(keep, (rank == keep["keep_rank"]) & (key == keep["keep_key"]), "left_semi")
    # only a table with repeated rows pays for a shuffle of its texts
    repeated = found.groupBy("rank", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
