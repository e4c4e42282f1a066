"""What the plans must and must not contain."""

import re

import __spark_entry__ as entry
from meshledger.catalog.base import Inputs
from meshledger.operators import scans
from meshledger.operators.stats import with_rank, with_ranks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    """The plan that ran, as adaptive execution left it."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_a_scan_reads_its_rows_through_one_exchange(spark, sf_dir):
    """Rows and bucket summaries share the exchange by (keys, bucket): the events are read once for it and once for the slots."""
    i = Inputs(spark, sf_dir)
    plain = i.table("events").select("user_id", "ts", "event_id", "value")
    scanned = scans.ordered_scan(plain, ["user_id"], ["ts", "event_id"], scans.by_time("ts", 500), {"s": scans.running_sum("value")})
    for df, tables in ((scanned, 1), (i.gaps, 2), (i.ledger, 1)):  # gaps are of two tables, both made from the events
        lines = final_plan_of(df).split("\n")
        dealt = [x for x in lines if "REPARTITION_BY_COL" in x]
        assert sorted("ReusedExchange" in x for x in dealt) == [False, True]
        assert sum("Scan parquet" in x for x in lines) == 2 * tables
    narrow = [x for x in final_plan_of(scanned).split("\n") if "ReadSchema" in x]
    assert sorted("value" in x for x in narrow) == [False, True]


def test_time_slots_are_bounded_and_in_order(spark):
    """Minutes near the reference, logarithmic slots beyond, for any time stamp."""
    near = spark.sql("select explode(sequence(timestamp_ntz'2023-12-30', timestamp_ntz'2024-01-02', interval 20 second)) as ts")
    wide = spark.sql("select make_timestamp_ntz(y, 1 + y * 7 % 12, 1, y % 24, 0, 0) as ts from (select explode(sequence(1, 9999)) as y)")
    rows = near.unionByName(wide).select("ts", scans.time_slot("ts").alias("slot")).orderBy("ts").collect()
    slots = [r.slot for r in rows]
    assert slots == sorted(slots) and max(map(abs, slots)) < scans.EXACT + 13 * scans.COARSE
    minutes = {r.ts.replace(second=0): r.slot for r in rows if r.ts.year in (2023, 2024)}
    assert len(set(minutes.values())) == len(minutes)


def test_ranks_share_one_table_of_values(spark, sf_dir):
    df = spark.createDataFrame([(k, k % 7, (k * 5) % 11) for k in range(100)] + [(100, None, 3)], "k int, a int, b int")
    both = with_ranks(df, {"ra": "a", "rb": "b"}, descending=True)
    one = with_rank(with_rank(df, "a", "ra", descending=True), "b", "rb", descending=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, one.collect()))


def test_scan_reads_only_what_a_report_uses(spark, sf_dir):
    plan = plan_of(entry.queries()["daily_category_org_bytes"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "user_id" not in schema


def test_period_reaches_the_scan(spark, sf_dir):
    plan = plan_of(entry.queries()["trim_to_period"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan


def test_windows_without_keys_run_over_summaries_only(spark, sf_dir):
    """A gather into one partition must come after an aggregate, never from raw rows."""
    i = Inputs(spark, sf_dir)
    for df in (i.gaps, i.ledger, i.user_days):
        lines = plan_of(df).split("\n")
        for n, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any("HashAggregate" in x or "SortAggregate" in x for x in lines[n + 1 : n + 3])
