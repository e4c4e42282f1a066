"""The space-separated transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FIELDS = "d STRING, t STRING, action STRING, a STRING, b STRING, c STRING, rest STRING"
# Record names of the log and the kinds they become.
KINDS = {
    "PURCHASE": "purchase",
    "USERTRANSFER": "user_transfer",
    "TOPUP": "admin_topup",
    "ADMINTRANSFER": "admin_transfer",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def scrub_nul(lines: DataFrame, column: str = "value") -> DataFrame:
    """Delete NUL characters; ``nul_count`` says how many there were in the line."""
    nul = F.lit("\x00")
    clean = F.translate(F.col(column), "\x00", "")
    return lines.withColumns(
        {"nul_count": F.length(column) - F.length(clean), column: clean}
    ).select(*lines.columns, "nul_count")


def _whole(text: Column) -> Column:
    """Amount as a whole number: empty is 0, fractions round half to even."""
    decimal = F.bround(text.try_cast("decimal(28,6)"), 0).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).when(text.contains("."), decimal).otherwise(
        text.try_cast("bigint")
    )


def parse_transaction_log(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected lines) from a frame with one line per row in ``value``.

    The record name decides which field is what. ``strict`` makes the transactions fail on the
    first line that does not parse; otherwise such lines are only set aside.
    """
    record = F.from_csv("value", F.lit(_FIELDS), {"sep": " ", "quote": "|"})
    parsed = lines.withColumn("r", record)
    action, a, b, c = (F.col(f"r.{n}") for n in ("action", "a", "b", "c"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.when(action.isin(*KINDS), F.try_element_at(kinds, action))
    two_sided = action.isin("USERTRANSFER", "ADMINTRANSFER")
    rows = parsed.select(
        "value",
        F.concat_ws(" ", "r.d", "r.t").try_cast("timestamp_ntz").alias("ts"),
        kind.alias("kind"),
        F.when(action != "TOPUP", a).alias("user_id"),
        F.when(two_sided, b).when(action == "TOPUP", a).alias("dest_user_id"),
        F.when(action == "PURCHASE", b.try_cast("bigint")).alias("amount_bytes"),
        F.when(action == "USERTRANSFER", _whole(F.coalesce(c, F.lit(""))))
        .when(action == "TOPUP", b.try_cast("bigint"))
        .otherwise(c.try_cast("bigint"))
        .alias("amount_idr"),
    )
    good = (
        F.col("ts").isNotNull()
        & F.col("kind").isNotNull()
        & F.col("amount_idr").isNotNull()
        & ((F.col("kind") != "purchase") | F.col("amount_bytes").isNotNull())
    )
    rejects = rows.where(~good).select("value")
    columns = ["ts", "kind", "user_id", "dest_user_id", "amount_bytes", "amount_idr"]
    if not strict:
        return rows.where(good).select(*columns), rejects
    message = F.concat(F.lit("cannot parse transaction: "), F.col("value"))
    checked = F.when(good, F.col("kind")).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("kind", checked).select(*columns), rejects
