"""Distributions, ranks, quantiles, regressions.

All of them go through the table of distinct values (``value_distribution``), which is
pre-aggregated and scanned in value buckets, so no column of values is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshledger.operators.scans import by_value, key_total, ordered_scan, running_sum


def value_distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value) -> n, number of rows up to the value, number of rows in all.

    The counts are the result of one aggregate, which the cut and the scan both read.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # True of every count; it keeps ``n`` in the plan of the cut, too, so that both share one exchange.
    counts = counts.where(F.col("n") > 0)
    return ordered_scan(
        counts,
        keys,
        [value],
        by_value(value),
        {"n_up_to": running_sum("n"), "n_total": key_total("n")},
    )


def cdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution: one row per distinct value; nulls are left out."""
    return value_distribution(df, value, keys).select(
        *keys,
        F.col(value).alias("value"),
        F.col("n").alias("base_count"),
        (F.col("n") / F.col("n_total")).alias("pdf"),
        (F.col("n_up_to") / F.col("n_total")).alias("cdf"),
    )


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Only the two values next to each position take part, found by their place in the
    distribution; groups may be of any size.
    """
    spread = value_distribution(df, value, keys)
    first = F.col("n_up_to") - F.col("n")
    v = F.col(value).cast("double")
    ends, result = [], []
    for name, p in probs.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        lower, upper = F.floor(place), F.ceil(place)
        ends += [
            F.max(F.when((first <= lower) & (lower < F.col("n_up_to")), v)).alias(f"_lo_{name}"),
            F.max(F.when((first <= upper) & (upper < F.col("n_up_to")), v)).alias(f"_hi_{name}"),
            F.max(place - lower).alias(f"_part_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + (hi - lo) * F.col(f"_part_{name}")).alias(name))
    grouped = spread.groupBy(*keys) if keys else spread.groupBy()
    return grouped.agg(*ends).select(*keys, *result)


def _rank(descending: bool, share: bool) -> Column:
    """Rank of a value from its distribution; ties take the lowest, ``share`` divides by the row count."""
    place = (
        F.col("n_total") - F.col("n_up_to") if descending else F.col("n_up_to") - F.col("n")
    ) + F.lit(1)
    return place / F.col("n_total") if share else place


def with_rank(
    df: DataFrame, value: str, out: str, descending: bool = False, share: bool = False
) -> DataFrame:
    """Rank by value, ties take the lowest rank; ``share`` divides by the row count.

    Rows whose value is null get no rank.
    """
    table = value_distribution(df, value).select(value, _rank(descending, share).alias(out))
    return df.join(table, value, "left").select(*df.columns, out)


def with_ranks(df: DataFrame, values: dict[str, str], descending: bool = False, share: bool = False) -> DataFrame:
    """As ``with_rank`` for several columns (rank: value) by one scan; the values are compared as double.

    The values of all columns are one long table, scanned per column, so ``df`` is read once for all
    ranks and once for the rows.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(out).alias("_rank_of"), F.col(value).cast("double").alias("_value")) for out, value in values.items()])))
    table = value_distribution(long, "_value", ["_rank_of"]).select("_rank_of", "_value", _rank(descending, share).alias("_r"))
    ranked = df
    for out, value in values.items():
        own = table.where(F.col("_rank_of") == out).select(F.col("_value").alias(f"_at_{out}"), F.col("_r").alias(out))
        ranked = ranked.join(own, F.col(value).cast("double") == F.col(f"_at_{out}"), "left").drop(f"_at_{out}")
    return ranked.select(*df.columns, *values)


def rank_bins(df: DataFrame, value: str, out: str = "bin", bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins of a column, closed on the left; the last takes the maximum."""
    v = F.col(value).cast("double")
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo = edges.select("lo").scalar()
    hi = edges.select("hi").scalar()
    number = F.width_bucket(v, lo, hi, F.lit(bins))
    return df.withColumn(
        out,
        F.when(lo == hi, F.lit(1)).otherwise(F.least(number, F.lit(bins))).cast("int"),
    )


def coefficient_of_variation(value: Column) -> Column:
    return F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))


def rolling_mean(
    df: DataFrame, keys: Sequence[str], date: str, value: str, out: str, days: int = 7
) -> DataFrame:
    """Mean over the last ``days`` calendar days of a daily table (one row per key and day)."""
    span = (
        Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date))).rangeBetween(-(days - 1), 0)
    )
    return df.withColumn(out, F.avg(value).over(span))


def rolling_mean_rows(
    df: DataFrame, keys: Sequence[str], date: str, value: str, out: str, rows: int = 7
) -> DataFrame:
    """Mean over the last ``rows`` rows of a daily table; null until the window is full."""
    span = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(rows - 1), 0)
    return df.withColumn(
        out, F.when(F.count(F.lit(1)).over(span) == rows, F.avg(value).over(span))
    )


def ols(df: DataFrame, x: str, y: str, log: bool = False) -> DataFrame:
    """Least-squares line of y on x (or of ln y on ln x) as a one-row table.

    Rows with a null take no part, nor with ``log`` rows whose x or y has no logarithm;
    ``left_out`` counts them.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    used = F.col("x").isNotNull() & F.col("y").isNotNull()
    pairs = df.select(
        (F.ln(xs) if log else xs).alias("x"), (F.ln(ys) if log else ys).alias("y"), xs.alias("raw")
    ).select(used.alias("used"), *[F.when(used, F.col(c)).alias(c) for c in ("x", "y", "raw")])
    return pairs.agg(
        F.count_if("used").alias("n"),
        F.count_if(~F.col("used")).alias("left_out"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.min("raw").alias("x_lo"),
        F.max("raw").alias("x_hi"),
    )


def ols_curve(model: DataFrame, log: bool = False, points: int = 1000) -> DataFrame:
    """Fitted values on an even grid between the smallest and largest x of the model."""
    step = F.col("i") / F.lit(float(points - 1))
    grid = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("x", F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * step)
    line = F.col("intercept") + F.col("slope") * (F.ln("x") if log else F.col("x"))
    return grid.select("i", "x", (F.exp(line) if log else line).alias("prediction"))


def student_p(t_squared: Column, freedom: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of Student's t.

    With t = sqrt(freedom) tan(a) the density becomes a power of the cosine, so the p-value is the
    ratio of two integrals of it, from a and from 0 to a right angle, here by Simpson's rule. Beyond
    ``top`` the integrand is zero in double precision.
    """
    top = F.least(F.lit(math.pi / 2), F.lit(40.0) / F.sqrt(freedom))
    angle = F.atan(F.sqrt(t_squared / freedom))

    def integral(low: Column) -> Column:
        width = (top - low) / F.lit(float(steps))
        weight = lambda i: F.when((i == 0) | (i == steps), F.lit(1.0)).otherwise(F.lit(2.0) + 2 * (i % 2))
        return width * F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0),
            lambda total, i: total + weight(i) * F.pow(F.cos(low + width * i), freedom - 1))

    return F.when(angle >= top, F.lit(0.0)).otherwise(integral(angle) / integral(F.lit(0.0)))


def ols_significance(df: DataFrame, x: str, y: str, log: bool = False) -> DataFrame:
    """Slope, p-value of the slope and R-squared as a one-row table; null p-value below three points."""
    freedom = F.col("n") - F.lit(2.0)
    # A perfect fit has no residual, so no uncertainty.
    t_squared = F.col("r2") * freedom / F.nullif(1 - F.col("r2"), F.lit(0.0))
    p = F.when(F.col("r2") >= 1, F.lit(0.0)).otherwise(student_p(t_squared, freedom))
    return ols(df, x, y, log).select("slope", F.when(freedom > 0, p).alias("p_value"), "r2")


def bootstrap_mean_ci(
    df: DataFrame, keys: Sequence[str], unit: str, value: str, replicates: int = 200, seed: int = 7
) -> DataFrame:
    """Mean and 95 % bootstrap interval of ``value`` per key.

    Each row is drawn a Poisson(1) number of times per replicate. The draw is a hash of the
    row's ``unit``, the replicate and the seed, so replicates are the same on every run and
    the replicates of one key spread over all tasks.
    """
    token = F.concat_ws("|", F.col(unit).cast("string"), F.col("replicate"), F.lit(seed))
    uniform = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    # Upper ends of the Poisson(1) distribution function for 0..6 draws.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
             0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = F.lit(len(steps))
    for draws, end in reversed(list(enumerate(steps))):
        weight = F.when(F.col("uniform") < end, F.lit(draws)).otherwise(weight)
    drawn = (
        df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("uniform", uniform)
        .withColumn("weight", weight)
    )
    means = (
        drawn.groupBy(*keys, "replicate")
        .agg(F.try_divide(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias("m"))
        .where(F.col("m").isNotNull())
    )
    interval = means.groupBy(*keys).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_lo"),
        F.percentile("m", F.lit(0.975)).alias("ci_hi"),
    )
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(interval, list(keys))
