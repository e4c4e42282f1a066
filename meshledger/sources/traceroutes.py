"""Traceroute output as one row per hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Texts removed from a hop line before it is split.
REMOVED = (" ms", "(", ")", "\n")


def read_traceroutes(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file whole, since the last line of a file is special."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_traceroutes(files: DataFrame, dataset: str = "Community Network") -> DataFrame:
    """Hop rows with the mean latency of the hop's probes.

    A header line names the domain of the hop lines after it; the first and third word of a
    hop line are hop number and address, every other word counts one probe if it is a number
    and takes one off if it is not. No positive latency means null.
    """
    split = files.select("file", F.split(F.regexp_replace(F.col("text"), r"\n$", ""), "\n").alias("all"))
    lines = split.select("file", (F.size("all") - 1).alias("last_line"), F.posexplode("all").alias("line_no", "line"))
    is_header = F.col("line").startswith("traceroute to")
    named = F.when(is_header, F.get(F.split(F.trim("line"), r"\s+"), F.lit(2)))
    # A file came as one row, so its lines fit one task.
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    hops = lines.withColumn("domain", F.last(named, ignorenulls=True).over(above)).where(~is_header)
    domain = F.coalesce("domain", F.lit(""))

    cleaned = F.col("line")
    for text_out in REMOVED:
        cleaned = F.replace(cleaned, F.lit(text_out), F.lit(""))
    words = F.split(F.trim(cleaned), r"\s+")
    probes = F.transform(
        F.filter(words, lambda w, i: (i != 0) & (i != 2)), lambda w: w.try_cast("double")
    )
    total = F.aggregate(probes, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    count = F.aggregate(
        probes, F.lit(0), lambda acc, x: acc + F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(1))
    )
    latency = total / F.greatest(count, F.lit(1))
    return hops.select(
        "file",
        F.lit(dataset).alias("dataset"),
        domain.alias("domain"),
        F.get(words, F.lit(0)).try_cast("int").alias("hop"),
        F.get(words, F.lit(2)).alias("ip"),
        F.when(latency > 0, latency).alias("latency"),
        (F.col("line_no") == F.col("last_line")).cast("int").alias("last_hop"),
        F.concat_ws(", ", F.lit(dataset), domain).alias("unique_name"),
    )


def with_measured(hops: DataFrame, other: DataFrame) -> DataFrame:
    """Hop rows of two sources together, those without a latency left out."""
    return hops.unionByName(other, allowMissingColumns=True).where(F.col("latency").isNotNull())
