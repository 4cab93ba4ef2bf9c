"""Tenders and bids derived from the order tables.

An order is a tender, a line is a bid, the line's supplier is the bidder and a customer bucket is the
buyer. Both tables come from one shuffle of the lines by order: the winner and the per-tender counts are
one aggregate on the join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tendersift.staging import stage


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    o = _read(spark, folder, "orders")
    split = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 5 == 2)
    placed = F.col("o_orderdate").cast("timestamp")
    value = (
        F.when(F.col("o_orderkey") % 50 == 1, F.col("o_totalprice") * 60)
        .when(split, F.lit(40000.0) + F.col("o_orderkey") % 9999)
        .when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 5)
        .when(F.col("o_orderkey") % 9 == 0, F.floor(F.col("o_totalprice") / 1000) * 1000)
        .otherwise(F.col("o_totalprice"))
        .cast("double")
    )
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "limited")
        .when(F.col("o_orderpriority") == "2-HIGH", "selective")
        .otherwise("open")
    )
    return o.select(
        "o_orderkey",
        (F.col("o_custkey") % 40).alias("b"),
        "o_orderstatus",
        F.when(split, F.date_trunc("year", placed)).otherwise(placed).alias("pub"),
        F.coalesce(split, F.lit(False)).cast("int").alias("split_case"),
        method.alias("m"),
        value.alias("tv"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    li = _read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    bidder = (
        F.when(F.col("o_orderkey") % 500 == 1, F.col("o_orderkey") + 100000)
        .when(F.col("l_suppkey") == 13, F.col("b") + 200000)
        .when(F.col("l_suppkey") == 11, F.lit(11).cast("long"))
        .when(F.col("l_suppkey") % 100 < (F.col("b") % 20) * 5, F.col("b") * 2)
        .otherwise(F.col("l_suppkey"))
    )
    amount = F.when(F.col("l_suppkey") == 11, 3).otherwise(1) * F.when(
        F.col("o_orderkey") % 7 == 0, F.col("l_extendedprice")
    ).otherwise(F.col("tv") * (1 - F.col("l_discount") + F.col("l_tax") / 2))
    dropped = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    minutes = (F.col("l_linenumber") * F.col("l_quantity")).cast("int")
    return li.join(_orders(spark, folder), li.l_orderkey == F.col("o_orderkey")).select(
        "o_orderkey",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("bid_id"),
        bidder.alias("bidder_id"),
        amount.alias("bid_amount"),
        F.when(dropped, "disqualified").otherwise("active").alias("bid_status"),
        (F.col("pub") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("bid_date"),
        "l_partkey",
        F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
    )


def _active() -> Column:
    return F.when(
        F.col("bid_status") == "active",
        F.struct("bid_amount", "bidder_id", "bid_id", "l_partkey", "l_shipdate"),
    )


def _per_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("o_orderkey").agg(
        F.min(_active()).alias("win"),
        F.count("*").alias("n"),
        F.count_distinct("bidder_id").alias("nd"),
        F.max((F.col("bid_status") == "disqualified").cast("int")).alias("dq"),
    )


def build_bids(spark: SparkSession, folder: str) -> DataFrame:
    # Lines are dealt and sorted by order already, so their winner is a window over them and they are not shuffled again for it.
    win = F.min(_active()).over(Window.partitionBy("o_orderkey"))
    return _lines(spark, folder).withColumn("win_bid", win["bid_id"]).select(
        F.col("o_orderkey").alias("tender_id"), "bid_id", "bidder_id", "bid_status", "bid_amount",
        "bid_date", F.coalesce(F.col("bid_id") == F.col("win_bid"), F.lit(False)).cast("int").alias("is_winner"),
    )


def build_tenders(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder)
    per_order = _per_order(_lines(spark, folder))
    key = F.col("o_orderkey")
    supplier = (
        F.when(key % 150 == 1, F.lit(88888888).cast("long"))
        .when(key % 100 == 0, F.lit(900000) + F.floor(key / 100).cast("long") % 3)
        .otherwise(F.col("win.bidder_id"))
    )
    cpv = (
        F.when(F.col("split_case") == 1, F.lit(45).cast("long"))
        .when(key % 100 == 0, F.lit(90).cast("long"))
        .otherwise(F.col("win.l_partkey") % 25)
    )
    base = orders.join(per_order, "o_orderkey", "left").select(
        key.alias("tender_id"),
        F.col("b").alias("buyer_id"),
        supplier.alias("supplier_id"),
        F.col("m").alias("procurement_method"),
        F.when(F.col("o_orderstatus") == "F", "lowestCost")
        .when(F.col("o_orderstatus") == "O", "ratedCriteria").alias("award_criteria"),
        cpv.alias("main_cpv_2_digit"),
        F.col("tv").alias("tender_value"),
        F.col("win.bid_amount").alias("award_value"),
        F.col("pub").alias("published_date"),
        F.col("win.l_shipdate").alias("award_date"),
        F.year("pub").alias("year"),
        F.month("pub").alias("month"),
        F.quarter("pub").alias("quarter"),
        F.weekday("pub").alias("day_of_week"),
        (F.weekday("pub") >= 5).cast("int").alias("is_weekend"),
        (F.quarter("pub") == 4).cast("int").alias("is_q4"),
        (F.month("pub") == 12).cast("int").alias("is_december"),
        F.coalesce("n", F.lit(0)).cast("long").alias("number_of_bids"),
        F.coalesce("nd", F.lit(0)).cast("long").alias("number_of_tenderers"),
        F.coalesce("dq", F.lit(0)).alias("has_unsuccessful_awards"),
        (key % 41 == 0).cast("int").alias("has_cancelled_awards"),
        (key % 3 == 0).cast("int").alias("has_enquiries"),
        (key % 11).alias("number_of_documents"),
    )
    change = F.try_divide(F.col("tender_value") - F.col("award_value"), F.col("tender_value")) * 100
    one = lambda condition: F.when(condition, 1).otherwise(0)
    return base.select(
        "*",
        one(F.col("number_of_tenderers") == 1).alias("is_single_bidder"),
        one(F.col("number_of_tenderers") > 1).alias("is_competitive"),
        one(F.col("buyer_id") % 5 != F.col("supplier_id") % 5).alias("is_cross_region"),
        one(F.col("buyer_id") == 7).alias("is_buyer_masked"),
        one((F.col("supplier_id") % 97 == 5) | (F.col("supplier_id") == 88888888)).alias("is_supplier_masked"),
        change.alias("price_change_pct"),
        change.alias("discount_percentage_avg"),
    )


def tenders(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "tenders", lambda: build_tenders(spark, folder))


def bids(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "bids", lambda: build_bids(spark, folder))
