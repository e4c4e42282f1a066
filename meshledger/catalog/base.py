"""Input tables of the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshledger.operators.activity import user_activity
from meshledger.operators.ledger import correct_negative, currency_ledger, usage_events
from meshledger.operators.sessions import consolidate_purchases, full_gap_days, log_gaps
from meshledger.plans import traffic, users
from meshledger.session import cut_lineage
from meshledger.sources import derived
from meshledger.sources.derived import TEST_WINDOW

SESSION_GAP_S = 86400
# Far smaller than the default, so that the small test tables are cut into many buckets too.
ROWS = 2000


class Inputs:
    """The derived tables of one test data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.window = TEST_WINDOW

    def table(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    @cached_property
    def flows(self) -> DataFrame:
        return derived.flows(self.spark, self.sf_dir)

    @cached_property
    def p2p(self) -> DataFrame:
        return derived.p2p_flows(self.spark, self.sf_dir)

    @cached_property
    def nouser(self) -> DataFrame:
        return derived.nouser_flows(self.spark, self.sf_dir)

    @cached_property
    def tx(self) -> DataFrame:
        return derived.transactions(self.spark, self.sf_dir)

    @cached_property
    def dns(self) -> DataFrame:
        return derived.dns(self.spark, self.sf_dir)

    @cached_property
    def served(self) -> DataFrame:
        return derived.past_outage(self.flows, self.window)

    @cached_property
    def served_p2p(self) -> DataFrame:
        return derived.past_outage(self.p2p, self.window)

    @cached_property
    def all_served(self) -> DataFrame:
        columns = ["event_id", "start_ts", "end_ts"]
        return self.served.select(*columns).unionByName(self.served_p2p.select(*columns))

    @cached_property
    def gaps(self) -> DataFrame:
        return log_gaps(self.all_served, tie=["event_id"], rows_per_bucket=ROWS)

    @cached_property
    def gap_days(self) -> DataFrame:
        return full_gap_days(self.gaps)

    @cached_property
    def activity(self) -> DataFrame:
        # A shared derived table: small, costly to build and read by many reports.
        return cut_lineage(
            user_activity(self.served, self.tx, self.gap_days, self.window), "activity"
        )

    @cached_property
    def daily(self) -> DataFrame:
        return traffic.daily_category_org_bytes(self.flows)

    @cached_property
    def hourly(self) -> DataFrame:
        return traffic.hourly_category_bytes(self.flows, self.p2p)

    @cached_property
    def grouped(self) -> DataFrame:
        return cut_lineage(users.user_category_org_bytes(self.served), "grouped")

    @cached_property
    def user_days(self) -> DataFrame:
        return cut_lineage(users.user_day_bytes(self.served), "user-days")

    @cached_property
    def sessions(self) -> DataFrame:
        return cut_lineage(
            consolidate_purchases(self.tx, SESSION_GAP_S, ["event_id"], ROWS), "timed-sessions"
        )

    @cached_property
    def usage(self) -> DataFrame:
        # A shared derived table, as the balance reads it from several sides.
        return cut_lineage(usage_events(self.served, self.sessions, self.activity), "usage")

    @cached_property
    def ledger(self) -> DataFrame:
        return currency_ledger(self.tx, rows_per_bucket=ROWS)

    @cached_property
    def corrected(self) -> tuple[DataFrame, DataFrame]:
        return correct_negative(currency_ledger(self.tx, rows_per_bucket=ROWS, with_next=True), self.window)


def query(build):
    """A registered query from a function of the input tables."""
    return lambda spark, sf_dir: build(Inputs(spark, sf_dir))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
