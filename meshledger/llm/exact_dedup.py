"""Exact duplicates with the frequent digests split off.

A Misra-Gries summary (`DataFrame.stat.freqItems`, one pass, mergeable) names every digest that may
hold more than a share of the rows: at most 1/share candidates. Their exact counts decide which are
frequent indeed; those are joined by broadcast, so rows of a huge group never meet in one task. All
other digests, each below the share, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common

SHARE = 0.002


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with white-space runs as one space; a null text is empty."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.regexp_replace(body, common.ASCII_SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(plain, 256)).alias("digest"))


def frequent(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Digests that hold more than ``share`` of the rows, with smallest id and count: at most 1/share rows."""
    summary = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], share)
    candidates = summary.select(F.explode("digest_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    return (rows.join(F.broadcast(candidates), "digest", "left_semi")
            .groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
            .where(F.col("group_size") > share * rows.count()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The smallest id of a group stays. Null ids rank last: a group has a null keep_id only if all its
    ids are null, and then all its rows count as kept. Rows repeated with the smallest id are all
    kept, since the id names them both. An empty table gives no rows.
    """
    rows = common.store(digests(docs, id_col, text_col), "digests")
    heavy = common.store(frequent(rows, share), "frequent")
    groups = (rows.join(F.broadcast(heavy), "digest", "left_anti")
              .groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")))
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(groups, "digest")
    return hot.unionByName(rest).select(
        F.col("id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
