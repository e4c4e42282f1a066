"""Summaries that are stored once, for a day or another small bin, and merged for any longer period.

Quantiles (KLL) and distinct counts (HyperLogLog) from stored summaries are the approximate, opt-in forms;
the exact ones in ``stats`` and the reports stay the default. ``heavy_candidates`` is exact: its summary of
sums only names what cannot be left out of a list of the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.session import cut_lineage

#: Size of a quantile summary, and the rank error it keeps to (six standard deviations at this size).
KLL_K, RANK_ERROR = 800, 0.02
#: Logarithm of the registers of a distinct count, and the relative error (six standard deviations).
HLL_LG_K, DISTINCT_ERROR = 14, 0.05
#: Buckets of each of the HASHES sums that bound the total of a key.
BUCKETS, HASHES = 1 << 15, 2


def quantile_sketches(df: DataFrame, value: str, bins: Sequence[str], k: int = KLL_K) -> DataFrame:
    """(bins, sketch): one mergeable summary of a whole-number column per bin; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*bins).agg(
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("sketch")
    )


def merged_quantiles(
    sketches: DataFrame, probs: Sequence[float], period: Sequence[str] = (), k: int = KLL_K
) -> DataFrame:
    """(period, prob, n, value): the quantiles of a period from the summaries of its bins, and its rows.

    The share of rows up to ``value`` is off ``prob`` by ``RANK_ERROR`` at most.
    """
    merged = sketches.groupBy(*period).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    values = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("value"))
        for p in probs
    ])
    found = merged.where(F.col("sketch").isNotNull() & (F.kll_sketch_get_n_bigint("sketch") > 0))
    return found.select(*period, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.explode(values).alias("v")).select(
        *period, "v.prob", "n", "v.value"
    )


def distinct_sketches(df: DataFrame, value: str, bins: Sequence[str], lg_k: int = HLL_LG_K) -> DataFrame:
    """(bins, sketch): one mergeable summary of the distinct values per bin; nulls do not count."""
    return df.groupBy(*bins).agg(F.hll_sketch_agg(F.col(value), lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, period: Column, out: str) -> DataFrame:
    """(date, out): distinct values of each period from the summaries of its bins."""
    merged = sketches.groupBy(period.alias("date")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("date", F.hll_sketch_estimate("sketch").alias(out))


def heavy_candidates(
    df: DataFrame, key: str, weight: Column, n: int, buckets: int = BUCKETS
) -> DataFrame:
    """The rows of ``df`` whose key may be among the ``n`` of largest total weight; ties are kept.

    Weights are summed by bucket of two hashes of the key, so no key's total is above the smaller of its
    two bucket sums. The exact totals of the keys in the ``n`` largest buckets give a floor that the n-th
    largest total reaches; keys bounded below it go. Two exchanges of at most ``buckets`` sums a task and
    hash, and one of the keys in the largest buckets; the tail is not shuffled. Only positive weights
    bound a total from above, so negative ones count as none in the bound. A null key is a key.
    """
    names = [f"_slot{h}" for h in range(HASHES)]
    # read several times below: key, weight and all that the caller needs, once
    slots = {s: F.pmod(F.xxhash64(F.col(key), F.lit(h)), F.lit(buckets)) for h, s in enumerate(names)}
    rows = cut_lineage(df.withColumns(slots | {"_weight": F.coalesce(weight, F.lit(0))}), "heavy")
    sums = [
        rows.groupBy(s).agg(F.sum(F.greatest("_weight", F.lit(0))).alias(f"_bound{h}"))
        for h, s in enumerate(names)
    ]
    top = sums[0].orderBy(F.desc("_bound0"), names[0]).limit(n).select(names[0])
    totals = rows.join(F.broadcast(top), names[0], "left_semi").groupBy(key).agg(F.sum("_weight").alias("_total"))
    largest = totals.orderBy(F.desc("_total")).limit(n)
    # with fewer than n keys nothing is known of the n-th
    floor = largest.agg(F.when(F.count(F.lit(1)) == n, F.min("_total")).alias("floor")).scalar()
    for h, s in enumerate(names):
        may = sums[h].where(F.coalesce(F.col(f"_bound{h}") >= floor, F.lit(True))).select(s)
        # at most ``buckets`` numbers
        rows = rows.join(F.broadcast(may), s, "left_semi")
    return rows.select(*df.columns)
