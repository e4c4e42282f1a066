"""What the corpus operators share: table access, text buffers of Arrow batches, rolling hashes."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.session import scratch_path

NO_ID = (1 << 63) - 1
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (bigint, may be null), ``rank`` (the id; a null id ranks last), ``key`` and ``text`` (null: empty).

    ``rank`` and ``key`` name a row: rows that agree in both have the same id and text, so every
    operator gives them the same result. Other columns are not read, whatever their names.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text")).select(
        "id", F.coalesce("id", F.lit(NO_ID)).alias("rank"), F.xxhash64("text").alias("key"), "text")


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose id and text ``bad`` (id, key) names."""
    names = store(bad.select(F.coalesce("id", F.lit(NO_ID)).alias("bad_rank"), F.col("key").alias("bad_key")).distinct(), "rejected")
    rank = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(names, (rank == names["bad_rank"]) & (key == names["bad_key"]), "left_anti")


def store(df: DataFrame, label: str, large: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files; they outlive lost executors.

    ``large``: its shuffles are worth freeing before the next step makes its own.
    """
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    del df
    if large:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files of a table made by `store` that no later plan reads."""
    spark = stored.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not at some later collection.

    The session's listeners let go of a finished plan within a second or two.
    """
    for wait in (1, 2):
        time.sleep(wait)
        gc.collect()
        spark._jvm.System.gc()


def parts(spark: SparkSession, megabytes: float, each: float) -> int:
    """Partitions for so many megabytes at ``each`` a partition, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(megabytes / each) + 1)


def text_megabytes(rows: DataFrame) -> float:
    """Size of all texts, counted: a plan's own estimate may be far off after joins or for tables without files."""
    return float(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, one row at least."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within each text, and each text's first word."""
    inside = is_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = offsets[:-1], offsets[1:]
    full = first < last
    starts[first[full]] = inside[first[full]]
    ends[last[full] - 1] = inside[last[full] - 1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


#: Odd base of the rolling hashes; seeds differ in the values of the bytes.
BASE = 0xA0761D6478BD642F


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each; the longest so far are kept."""
    if len(_POWERS[0]) <= size:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full((1 << max(16, size.bit_length())) + 1, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS


@lru_cache(maxsize=64)
def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of ``units[start:end]``; units are bytes, or 64-bit values such as word hashes
    (whose own seed then tells hashes apart)."""
    step, back = _powers(len(units))
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((_values(seed)[units] if units.dtype == np.uint8 else units) * step[:len(units)], out=total[1:])
    # the length enters by the seed of the mix, so that runs of zero units differ
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def run_hashes(units: np.ndarray, size: int, seed: int) -> np.ndarray:
    """`span_hashes` of all runs of ``size`` bytes, by their first."""
    step, back = _powers(len(units))
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(_values(seed)[units] * step[:len(units)], out=total[1:])
    return mix((total[size:] - total[:-size]) * back[:len(total) - size] + np.uint64(size))


def byte_class(chars: bytes, inverted: bool = False) -> np.ndarray:
    """Which of the 256 bytes are in ``chars`` (``inverted``: are not)."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if inverted else out


NOT_SPACE = byte_class(b" \t\n\v\f\r", inverted=True)
