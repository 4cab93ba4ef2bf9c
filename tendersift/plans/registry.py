"""Registry of the queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersift.operators import edges, graph, network, portraits, rules, screens
from tendersift.plans.mapping_sql import MAPPING
from tendersift.session import plan_by_row_sizes
from tendersift.sources import mapping
from tendersift.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Tables of one data folder. Results of a detector are written once and read by the reports."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        plan_by_row_sizes(spark)
        self.spark, self.folder = spark, folder

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stage(self.spark, self.folder, name, build)

    @cached_property
    def tenders(self) -> DataFrame:
        return mapping.tenders(self.spark, self.folder)

    @cached_property
    def bids(self) -> DataFrame:
        return mapping.bids(self.spark, self.folder)

    @cached_property
    def buyers(self) -> DataFrame:
        """Buyer portraits with a name and a region."""
        return self.staged("buyers", lambda: portraits.buyer_portrait(self.tenders)).select(
            "*", F.concat(F.lit("buyer "), F.col("buyer_id")).alias("buyer_name"),
            F.concat(F.lit("region "), F.col("buyer_id") % 5).alias("buyer_region"))

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.staged("suppliers", lambda: portraits.supplier_portrait(self.tenders)).select(
            "*", F.concat(F.lit("supplier "), F.col("supplier_id")).alias("supplier_name"))

    @cached_property
    def bidders(self) -> DataFrame:
        """Bid counts per bidder, in the shape of the bidder reference table."""
        joined = self.bids.join(self.tenders.select("tender_id", "buyer_id"), "tender_id", "left")
        return joined.groupBy("bidder_id").agg(
            F.count("*").alias("total_bids"), F.count_distinct("tender_id").alias("unique_tenders"),
            F.count_distinct("buyer_id").alias("unique_buyers"), F.min("bid_date").alias("first_bid_date"),
            F.max("bid_date").alias("last_bid_date"))

    @cached_property
    def ruled(self) -> DataFrame:
        return self.staged("ruled", lambda: rules.detect(self.tenders, self.bids))

    @cached_property
    def screened(self) -> DataFrame:
        return self.staged("screened", lambda: screens.detect(self.tenders, self.bids))

    @cached_property
    def cobid(self) -> DataFrame:
        return self.staged("cobid", lambda: edges.cobid_edges(self.tenders, self.bids, 3))

    @cached_property
    def winlose(self) -> DataFrame:
        return self.staged("winlose", lambda: edges.winlose_edges(self.tenders, self.bids, 3))

    @cached_property
    def contracts(self) -> DataFrame:
        return self.staged("contracts", lambda: edges.buyer_supplier_edges(self.tenders, 3))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.staged("metrics", lambda: graph.clustering(self.cobid))

    @cached_property
    def networked(self) -> DataFrame:
        return self.staged("networked", lambda: network.detect(self.tenders, self.bids, cobid=self.cobid, winlose=self.winlose))


def query(name: str, sql: str | None = None, mapped: bool = True):
    """Register a query. ``sql`` continues the mapping's WITH clause or stands alone."""

    def wrap(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = (MAPPING + sql) if mapped else sql
        return build

    return wrap


def also(name: str, known: str) -> None:
    """A second name of a registered query."""
    QUERIES[name] = QUERIES[known]
    ORACLES[name] = ORACLES[known]


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns so that two engines agree on the last digit."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def exact_round(column: str, digits: int):
    """Round half up on three more decimals, so that the last bits of a sum cannot decide a tie; ``exact_round_sql`` is its SQL."""
    return F.round(F.col(column).cast(f"decimal(30,{digits + 3})"), digits).cast("double").alias(column)


def exact_round_sql(column: str, digits: int, name: str | None = None) -> str:
    return f"round(CAST({column} AS DECIMAL(30, {digits + 3})), {digits})::DOUBLE AS {name or column}"
