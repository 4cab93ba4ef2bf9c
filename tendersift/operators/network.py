"""Tender flags and reports out of the three networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tendersift.functions import expr as E
from tendersift.operators import edges as N, graph
from tendersift.operators.quantiles import exact_quantiles
from tendersift.session import cut_lineage


def suspicious_suppliers(metrics: DataFrame, min_degree: int = 10, min_clustering: float = 0.7) -> DataFrame:
    hit = (F.col("degree") >= min_degree) & (F.col("clustering") >= min_clustering)
    return metrics.where(hit).select(F.col("node").alias("supplier_id"))


def rotating_suppliers(rotation: DataFrame, min_ratio: float = 0.7, min_interactions: int = 5) -> DataFrame:
    strict = rotation.where((F.col("rotation_ratio") >= min_ratio) & (F.col("total_interactions") >= min_interactions))
    return strict.select(F.explode(F.array("bidder_1", "bidder_2")).alias("supplier_id")).distinct()


def strict_monopolies(pairs: DataFrame, min_ratio: float = 0.9, min_contracts: int = 20) -> DataFrame:
    strict = (F.col("dominance_ratio") >= min_ratio) & (F.col("total_contracts") >= min_contracts)
    return pairs.where(strict).select("buyer_id", "supplier_id")


def tender_flags(tenders: DataFrame, suspicious: DataFrame | None, monopolies: DataFrame,
                 rotating: DataFrame | None) -> DataFrame:
    """Three 0/1 flags per tender, their OR and their mean. Both supplier marks share one join."""
    marked = None
    for name, table in (("network_suspicious_supplier", suspicious), ("network_rotation", rotating)):
        if table is not None:
            one = table.select("supplier_id", F.lit(name).alias("k"))
            marked = one if marked is None else marked.unionByName(one)
    has = lambda name: F.max(F.when(F.col("k") == name, 1).otherwise(0)).alias(name)
    names = ["network_suspicious_supplier", "network_monopolistic", "network_rotation"]
    out = tenders.select("tender_id", "buyer_id", "supplier_id").join(
        monopolies.withColumn("network_monopolistic", F.lit(1)), ["buyer_id", "supplier_id"], "left")
    if marked is not None:
        out = out.join(marked.groupBy("supplier_id").agg(has(names[0]), has(names[2])), "supplier_id", "left")
    else:
        out = out.withColumns({names[0]: F.lit(0), names[2]: F.lit(0)})
    out = out.select("tender_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    total = F.col(names[0]) + F.col(names[1]) + F.col(names[2])
    return out.select("tender_id", *names, (total > 0).cast("int").alias("network_anomaly"),
                      (total / F.lit(3.0)).alias("network_score"))


def detect(
    tenders: DataFrame,
    bids: DataFrame | None = None,
    min_co_bids: int = 3,
    suspicious_min_degree: int = 10,
    suspicious_min_clustering: float = 0.7,
    rotation_min_ratio: float = 0.7,
    rotation_min_interactions: int = 5,
    monopoly_min_ratio: float = 0.9,
    monopoly_min_contracts: int = 20,
    cobid: DataFrame | None = None,
    winlose: DataFrame | None = None,
) -> DataFrame:
    """Network flags per tender; without bids only the buyer-supplier part is used. Edges that were written before may be given."""
    suspicious = rotating = None
    if bids is not None:
        # The edge tables are read several times below, so they are written once.
        metrics = graph.clustering(cut_lineage(N.cobid_edges(tenders, bids, min_co_bids)) if cobid is None else cobid)
        suspicious = suspicious_suppliers(metrics, suspicious_min_degree, suspicious_min_clustering)
        arcs = cut_lineage(N.winlose_edges(tenders, bids, min_co_bids)) if winlose is None else winlose
        rotating = rotating_suppliers(N.reciprocal(arcs), rotation_min_ratio, rotation_min_interactions)
    monopolies = strict_monopolies(N.monopolistic_pairs(tenders), monopoly_min_ratio, monopoly_min_contracts)
    return tender_flags(tenders, suspicious, monopolies, rotating)


def node_metrics(edges: DataFrame, communities: DataFrame, betweenness: DataFrame) -> DataFrame:
    out = graph.clustering(edges).join(communities, "node").join(betweenness, "node")
    return out.select(F.col("node").alias("bidder_id"), "community", "degree", "clustering", "betweenness")


def cartel_candidates(communities: DataFrame, min_size: int = 3) -> DataFrame:
    """Communities as (community, member) rows with their size: one row per member keeps a giant
    community spread over the cluster instead of in one array."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return communities.join(sizes, "community").select("community", "size", F.col("node").alias("member"))


def mixed_communities(communities: DataFrame, min_size: int = 3) -> DataFrame:
    """Communities of the union graph that hold both buyers and suppliers, with the sorted ids of both."""
    buyer = F.col("node").startswith("B_")
    own = F.substring("node", 3, 1_000_000)
    ids = lambda is_one: F.array_sort(F.collect_list(F.when(is_one, own)))
    sizes = communities.groupBy("community").agg(
        F.count("*").alias("total_nodes"), F.sum(buyer.cast("int")).alias("buyers"),
        F.sum((~buyer).cast("int")).alias("suppliers"), ids(buyer).alias("buyer_ids"), ids(~buyer).alias("supplier_ids"))
    return sizes.where(
        (F.col("buyers") > 0) & (F.col("suppliers") > 0) & (F.col("total_nodes") >= min_size)
    ).select(F.col("community").alias("community_id"), "total_nodes", "buyers", "suppliers", "buyer_ids", "supplier_ids").orderBy(
        F.desc("total_nodes"), "community_id")


def mixed_members(communities: DataFrame, mixed: DataFrame) -> DataFrame:
    """Member ids of the mixed communities without their prefix, one row each."""
    kind = F.when(F.col("node").startswith("B_"), "buyer").otherwise("supplier")
    return communities.join(mixed.select(F.col("community_id").alias("community"), "total_nodes"), "community").select(
        F.col("community").alias("community_id"), "total_nodes", kind.alias("kind"),
        F.substring("node", 3, 1_000_000).alias("member_id"))


def mixed_profile(edges: DataFrame, communities: DataFrame, mixed: DataFrame,
                  max_nodes: int = 50, min_value: float = 10_000_000) -> DataFrame:
    """Edges by type and contract value inside each mixed community."""
    side = lambda end, c: communities.select(F.col("node").alias(end), F.col("community").alias(c))
    inner = edges.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").where(F.col("cs") == F.col("cd"))
    of_type = lambda k: F.sum(E.flag(F.col("edge_type") == k)).alias(f"{k}_edges")
    sums = inner.groupBy(F.col("cs").alias("community_id")).agg(
        of_type("contract"), of_type("cobid"), of_type("winlose"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("contract_value"))
    zero = {c: 0 for c in ("contract_edges", "cobid_edges", "winlose_edges")} | {"contract_value": 0.0}
    out = mixed.select("community_id", "total_nodes", "buyers", "suppliers").join(sums, "community_id", "left").fillna(zero)
    return out.withColumns({
        "value_per_node": F.col("contract_value") / F.col("total_nodes"),
        "suspicious": E.flag((F.col("total_nodes") <= max_nodes) & (F.col("contract_value") > min_value)),
    })


def community_top(communities: DataFrame, top: int = 5) -> DataFrame:
    """Composition of the largest communities of the buyer-supplier graph."""
    buyer = F.col("node").startswith("B_").cast("int")
    return communities.groupBy("community").agg(
        F.count("*").alias("size"), F.sum(buyer).alias("buyers"), F.sum(1 - buyer).alias("suppliers")
    ).orderBy(F.desc("size"), "community").limit(top)


def suspicious_report(metrics: DataFrame, suppliers: DataFrame, min_degree: int = 5, min_clustering: float = 0.5) -> DataFrame:
    hit = (F.col("degree") >= min_degree) & (F.col("clustering") >= min_clustering)
    return metrics.where(hit).join(
        suppliers.select(F.col("supplier_id").alias("node"), "supplier_name"), "node", "left"
    ).select(F.col("node").alias("bidder_id"), "supplier_name", "degree", "clustering").orderBy(
        F.desc("clustering"), F.desc("degree"), "bidder_id")


def degree_stats(metrics: DataFrame) -> DataFrame:
    base = metrics.agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    middle = exact_quantiles(metrics, [], {"median_degree": (F.col("degree"), 0.5)})
    return base.withColumn("median_degree", middle.scalar())


def top_connected(metrics: DataFrame, suppliers: DataFrame, top: int = 10) -> DataFrame:
    best = metrics.orderBy(F.desc("degree"), "node").limit(top)
    return best.join(suppliers.select(F.col("supplier_id").alias("node"), "supplier_name"), "node", "left").select(
        F.col("node").alias("bidder_id"), "supplier_name", "degree")


def _metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")


def summary(cobid: DataFrame | None, communities: DataFrame | None, winlose: DataFrame | None,
            monopolies: DataFrame, results: DataFrame, collusion: DataFrame | None = None,
            collusion_communities: DataFrame | None = None, mixed: DataFrame | None = None) -> DataFrame:
    """Sizes of the graphs and numbers of findings as (metric, value) rows."""
    n = F.count("*")
    ends = lambda df, a, b: df.select(F.explode(F.array(a, b)).alias("node")).distinct()
    rows = []
    if cobid is not None:
        rows += [_metric(ends(cobid, "src", "dst"), "cobid_nodes", n), _metric(cobid, "cobid_edges", n)]
    if communities is not None:
        rows.append(_metric(communities, "communities", F.count_distinct("community")))
    if winlose is not None:
        rows += [
            _metric(ends(winlose, "winner_id", "loser_id"), "winlose_nodes", n), _metric(winlose, "winlose_edges", n),
            _metric(N.reciprocal(winlose).where(F.col("rotation_ratio") >= 0.5), "rotation_pairs", n),
        ]
    rows.append(_metric(monopolies, "monopolistic_pairs", n))
    if collusion is not None:
        rows += [_metric(ends(collusion, "src", "dst"), "full_collusion_nodes", n),
                 _metric(collusion, "full_collusion_edges", n)]
    if collusion_communities is not None:
        rows.append(_metric(collusion_communities, "full_collusion_communities", F.count_distinct("community")))
    if mixed is not None:
        rows.append(_metric(mixed, "mixed_communities", n))
    rows.append(_metric(results, "flagged_tenders", F.coalesce(F.sum("network_anomaly"), F.lit(0))))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
