"""Edges of the three networks: co-bidding, winner over loser, buyer and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tendersift.functions import expr as E

# A tender with more bidders than this is cut into cells before pairing, so that it becomes many tasks.
CELL = 256


def competitive_tenders(tenders: DataFrame) -> DataFrame:
    return tenders.where(E.competitive_method() & (F.col("number_of_tenderers") >= 2))


def competitive_bids(tenders: DataFrame, bids: DataFrame) -> DataFrame:
    keys = competitive_tenders(tenders).select("tender_id").distinct()
    return bids.join(keys, "tender_id", "left_semi")


def bidder_pairs(bids: DataFrame, min_co_bids: int = 3) -> DataFrame:
    """Undirected co-bidding edges (src < dst) with the number of shared tenders.

    A bidder with fewer tenders than ``min_co_bids`` cannot have an edge and is dropped before pairing.
    The bidders of a large tender are hashed into groups of about ``CELL``; each (group, group) cell of it
    is a join key of its own, so no task pairs a whole large tender. Every pair meets in exactly one cell.
    Pairs are counted on the map side before they are shuffled.
    """
    seen = bids.where(F.col("bidder_id").isNotNull()).select("tender_id", "bidder_id").distinct()
    if min_co_bids > 1:
        active = seen.groupBy("bidder_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_co_bids)
        seen = seen.join(active, "bidder_id", "left_semi")
    sizes = seen.groupBy("tender_id").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    groups = F.ceil(F.col("n") / CELL).cast("int")
    sized = seen.join(sizes, "tender_id").select(
        "tender_id", "bidder_id", groups.alias("g"),
        F.pmod(F.xxhash64("bidder_id"), groups).cast("int").alias("h"))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    left = sized.select("tender_id", F.col("bidder_id").alias("src"), F.col("h").alias("i"), every.alias("j"))
    right = sized.select("tender_id", F.col("bidder_id").alias("dst"), every.alias("i"), F.col("h").alias("j"))
    return (
        left.join(right, ["tender_id", "i", "j"]).where(F.col("src") < F.col("dst"))
        .groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_co_bids)
    )


def cobid_edges(tenders: DataFrame, bids: DataFrame, min_co_bids: int = 3) -> DataFrame:
    return bidder_pairs(competitive_bids(tenders, bids), min_co_bids)


def winner_loser_edges(bids: DataFrame, tenders: DataFrame, min_co_bids: int = 3) -> DataFrame:
    """Directed edges from the supplier of a tender to each other bidder of it."""
    winners = tenders.where(F.col("supplier_id").isNotNull()).select("tender_id", F.col("supplier_id").alias("winner_id"))
    losers = bids.where(F.col("bidder_id").isNotNull()).select("tender_id", F.col("bidder_id").alias("loser_id")).distinct()
    return (
        losers.join(winners, "tender_id").where(F.col("winner_id") != F.col("loser_id"))
        .groupBy("winner_id", "loser_id").agg(F.count("*").alias("weight"))
        .where(F.col("weight") >= min_co_bids)
    )


def winlose_edges(tenders: DataFrame, bids: DataFrame, min_co_bids: int = 3) -> DataFrame:
    fair = competitive_tenders(tenders)
    return winner_loser_edges(bids.join(fair.select("tender_id"), "tender_id", "left_semi"), fair, min_co_bids)


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs that beat each other, once per pair: both directions meet in one group."""
    low, high = F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")
    forward = F.max(F.when(F.col("winner_id") < F.col("loser_id"), F.col("weight")))
    backward = F.max(F.when(F.col("winner_id") > F.col("loser_id"), F.col("weight")))
    both = edges.groupBy(low.alias("bidder_1"), high.alias("bidder_2")).agg(
        forward.alias("wins_1_over_2"), backward.alias("wins_2_over_1"))
    a, b = F.col("wins_1_over_2"), F.col("wins_2_over_1")
    return both.where(a.isNotNull() & b.isNotNull()).select(
        "*", (a + b).alias("total_interactions"), (F.least(a, b) / F.greatest(a, b)).alias("rotation_ratio"))


def rotation_pairs(edges: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    return reciprocal(edges).where(F.col("rotation_ratio") >= min_ratio).orderBy(
        F.desc("rotation_ratio"), "bidder_1", "bidder_2")


def contract_pairs(tenders: DataFrame) -> DataFrame:
    return (
        tenders.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull())
        .groupBy("buyer_id", "supplier_id")
        .agg(F.count("tender_id").alias("contract_count"),
             F.coalesce(F.sum("award_value"), F.lit(0.0)).alias("total_value"))
    )


def buyer_supplier_edges(tenders: DataFrame, min_contracts: int = 3) -> DataFrame:
    return contract_pairs(tenders).where(F.col("contract_count") >= min_contracts).select(
        "buyer_id", "supplier_id", F.col("contract_count").alias("weight"), F.col("total_value").alias("value"))


def monopolistic_pairs(tenders: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Per buyer the supplier with most contracts (ties: smallest id) and its share of all the buyer's tenders.

    The totals count tenders without a supplier too, so they are a second sum over the same groups.
    """
    groups = tenders.where(F.col("buyer_id").isNotNull()).groupBy("buyer_id", "supplier_id").agg(
        F.count("tender_id").alias("contract_count"), F.coalesce(F.sum("award_value"), F.lit(0.0)).alias("total_value"))
    entry = F.when(F.col("supplier_id").isNotNull(), F.struct(
        (-F.col("contract_count")).alias("order"), "supplier_id", "contract_count", "total_value"))
    top = groups.groupBy("buyer_id").agg(F.min(entry).alias("t"), F.sum("contract_count").alias("total_contracts"))
    return (
        top.where(F.col("t").isNotNull())
        .select("buyer_id", "t.supplier_id", "t.contract_count", "t.total_value", "total_contracts",
                (F.col("t.contract_count") / F.col("total_contracts")).alias("dominance_ratio"))
        .where(F.col("dominance_ratio") >= min_ratio)
        .orderBy(F.desc("total_value"), "buyer_id")
    )


def collusion_edges(contracts: DataFrame, cobid: DataFrame, winlose: DataFrame) -> DataFrame:
    """Undirected union of the three networks. The first relation of an edge gives its type and weight,
    a later one of the same pair only adds its own weight column. Of two winner-loser directions the one
    from the smaller node comes first.
    """
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    columns = ("contract", "cobid", "forward", "backward", "value")

    def part(df: DataFrame, u, v, **given) -> DataFrame:
        kinds = {c: F.lit(None).cast("double" if c == "value" else "long") for c in columns} | given
        return df.select(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst"), *[kinds[c].alias(c) for c in columns])

    w, x = node("S_", "winner_id"), node("S_", "loser_id")
    weight = F.col("weight")
    parts = (
        part(contracts, node("B_", "buyer_id"), node("S_", "supplier_id"), contract=weight, value=F.col("value"))
        .unionByName(part(cobid, node("S_", "src"), node("S_", "dst"), cobid=weight))
        .unionByName(part(winlose, w, x, forward=F.when(w < x, weight), backward=F.when(w > x, weight)))
    )
    merged = parts.groupBy("src", "dst").agg(*[F.max(c).alias(c) for c in columns])
    has_contract, has_cobid = F.col("contract").isNotNull(), F.col("cobid").isNotNull()
    both = F.col("forward").isNotNull() & F.col("backward").isNotNull()
    return merged.select(
        "src", "dst",
        F.when(has_contract, "contract").when(has_cobid, "cobid").otherwise("winlose").alias("edge_type"),
        F.coalesce("contract", "cobid", "forward", "backward").alias("weight"),
        F.when(has_contract, F.col("cobid")).alias("cobid_weight"),
        F.when(has_contract | has_cobid, F.coalesce("backward", "forward"))
        .when(both, F.col("backward")).alias("winlose_weight"),
        "value")
