"""Queries of the networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.operators import communities as C, edges as N, graph, network
from tendersift.plans.network_sql import BETWEENNESS, COLLUSION, EDGES, METRICS, NETWORKED, metrics
from tendersift.plans.registry import exact_round, exact_round_sql, query, rounded


@query("net_competitive", "SELECT b.bid_id FROM bids b JOIN tenders t USING (tender_id) WHERE procurement_method IN ('open', 'selective') AND number_of_tenderers >= 2")
def _(d):
    return N.competitive_bids(d.tenders, d.bids).select("bid_id")


@query("net_cobid_edges", EDGES + "SELECT src, dst, weight FROM cobid")
def _(d):
    return N.cobid_edges(d.tenders, d.bids, 3)


@query("net_degree", EDGES + metrics("cobid", "m") + "SELECT node, degree FROM m")
def _(d):
    return graph.degrees(d.cobid)


@query("net_clustering", EDGES + metrics("cobid", "m") + "SELECT node, degree, round(clustering, 6) AS clustering FROM m")
def _(d):
    return rounded(graph.clustering(d.cobid), clustering=6)


def _communities(d):
    return d.staged("cobid_communities", lambda: C.communities(d.cobid))


@query("net_communities")
def _(d):
    return _communities(d)


@query("net_components", EDGES + """, arcs AS (SELECT src, dst FROM cobid UNION SELECT dst, src FROM cobid)
, reach AS (SELECT src AS node, src AS seen FROM arcs UNION SELECT reach.node, arcs.dst FROM reach JOIN arcs ON reach.seen = arcs.src)
SELECT node, min(seen) AS component FROM reach GROUP BY 1""")
def _(d):
    return graph.components(d.cobid)


def _betweenness(d):
    return d.staged("betweenness", lambda: graph.betweenness(d.cobid))


@query("net_betweenness", BETWEENNESS + "SELECT node, round(coalesce(betweenness, 0), 8) AS betweenness FROM between")
def _(d):
    return rounded(_betweenness(d), betweenness=8)


@query("net_node_metrics")
def _(d):
    return network.node_metrics(d.cobid, _communities(d), _betweenness(d))


@query("net_winlose_edges", EDGES + "SELECT winner_id, loser_id, weight FROM winlose")
def _(d):
    return N.winlose_edges(d.tenders, d.bids, 3)


@query("net_rotation_pairs", EDGES + "SELECT bidder_1, bidder_2, wins_1_over_2, wins_2_over_1, total_interactions, round(rotation_ratio, 6) AS rotation_ratio FROM rotation WHERE rotation_ratio >= 0.5")
def _(d):
    return rounded(N.rotation_pairs(d.winlose, 0.5), rotation_ratio=6)


@query("net_rings", EDGES + """SELECT x.winner_id AS a, y.winner_id AS b, z.winner_id AS c FROM winlose x JOIN winlose y ON x.loser_id = y.winner_id
JOIN winlose z ON y.loser_id = z.winner_id AND z.loser_id = x.winner_id WHERE x.winner_id < y.winner_id AND x.winner_id < z.winner_id""")
def _(d):
    return graph.directed_rings(d.winlose)


@query("net_buyer_supplier_edges", EDGES + "SELECT buyer_id, supplier_id, contract_count AS weight, " + exact_round_sql("total_value", 3, "value") + " FROM contracts")
def _(d):
    return N.buyer_supplier_edges(d.tenders, 3).withColumn("value", exact_round("value", 3))


@query("net_monopolistic_pairs", EDGES + "SELECT buyer_id, supplier_id, contract_count, round(total_value, 2) AS total_value, total_contracts, round(dominance_ratio, 6) AS dominance_ratio FROM mono")
def _(d):
    return rounded(N.monopolistic_pairs(d.tenders), total_value=2, dominance_ratio=6)


@query("net_flags", NETWORKED + "SELECT tender_id, network_suspicious_supplier, network_monopolistic, network_rotation FROM networked")
def _(d):
    suspicious = network.suspicious_suppliers(d.metrics)
    rotating = network.rotating_suppliers(N.reciprocal(d.winlose))
    monopolies = network.strict_monopolies(N.monopolistic_pairs(d.tenders))
    return network.tender_flags(d.tenders, suspicious, monopolies, rotating).drop("network_anomaly", "network_score")


@query("net_detect", NETWORKED + "SELECT tender_id, network_suspicious_supplier, network_monopolistic, network_rotation, network_anomaly, round(network_score, 6) AS network_score FROM networked")
def _(d):
    return rounded(network.detect(d.tenders, d.bids), network_score=6)


@query("net_detect_without_bids", NETWORKED + "SELECT tender_id, network_monopolistic AS network_anomaly FROM networked")
def _(d):
    return network.detect(d.tenders).select("tender_id", "network_anomaly")


def _collusion(d):
    return d.staged("collusion", lambda: N.collusion_edges(d.contracts, d.cobid, d.winlose))


def _collusion_communities(d):
    return d.staged("collusion_communities", lambda: C.communities(_collusion(d)))


@query("net_collusion_edges", COLLUSION + "SELECT src, dst, edge_type, weight, cobid_weight, winlose_weight, " + exact_round_sql("value", 3) + " FROM collusion")
def _(d):
    return _collusion(d).withColumn("value", exact_round("value", 3))


@query("net_collusion_communities")
def _(d):
    return network.mixed_communities(_collusion_communities(d), 3)


@query("net_collusion_members")
def _(d):
    found = _collusion_communities(d)
    return network.mixed_members(found, network.mixed_communities(found, 3))


# The buyers' region is a known labelling, so the profile can be checked against SQL.
@query("net_mixed_profile", COLLUSION + """, lab AS (SELECT node, cast(substring(node, 3) AS BIGINT) % 7 AS community FROM (SELECT src AS node FROM collusion UNION SELECT dst FROM collusion))
, sz AS (SELECT community AS community_id, count(*) AS total_nodes, count(*) FILTER (node LIKE 'B\\_%' ESCAPE '\\') AS buyers, count(*) FILTER (node LIKE 'S\\_%' ESCAPE '\\') AS suppliers FROM lab GROUP BY 1)
, inn AS (SELECT a.community AS community_id, count(*) FILTER (edge_type = 'contract') AS contract_edges, count(*) FILTER (edge_type = 'cobid') AS cobid_edges,
  count(*) FILTER (edge_type = 'winlose') AS winlose_edges, coalesce(sum(value), 0) AS v FROM collusion c JOIN lab a ON a.node = src JOIN lab b ON b.node = dst AND a.community = b.community GROUP BY 1)
SELECT community_id, total_nodes, buyers, suppliers, coalesce(contract_edges, 0) AS contract_edges, coalesce(cobid_edges, 0) AS cobid_edges, coalesce(winlose_edges, 0) AS winlose_edges,
 round(coalesce(v, 0), 2) AS contract_value, round(coalesce(v, 0) / total_nodes, 2) AS value_per_node, cast(total_nodes <= 50 AND coalesce(v, 0) > 10000000 AS INT) AS suspicious
FROM sz LEFT JOIN inn USING (community_id) WHERE buyers > 0 AND suppliers > 0 AND total_nodes >= 3""")
def _(d):
    edges = _collusion(d)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = nodes.select("node", (F.substring("node", 3, 30).cast("long") % 7).alias("community"))
    out = network.mixed_profile(edges, labels, network.mixed_communities(labels, 3))
    return rounded(out, contract_value=2, value_per_node=2)


@query("net_mixed_profile_found")
def _(d):
    found = _collusion_communities(d)
    return network.mixed_profile(_collusion(d), found, network.mixed_communities(found, 3))


@query("net_cartel_candidates")
def _(d):
    return network.cartel_candidates(_communities(d), 3)


@query("net_bs_communities")
def _(d):
    edges = d.contracts.select(
        F.concat(F.lit("B_"), F.col("buyer_id").cast("string")).alias("src"),
        F.concat(F.lit("S_"), F.col("supplier_id").cast("string")).alias("dst"), "weight")
    return network.community_top(d.staged("bs_communities", lambda: C.communities(edges)), 5)


@query("net_suspicious_report", METRICS + """SELECT node AS bidder_id, CASE WHEN node IN (SELECT supplier_id FROM tenders WHERE supplier_id IS NOT NULL) THEN 'supplier ' || node END AS supplier_name,
degree, round(clustering, 6) AS clustering FROM metrics WHERE degree >= 5 AND clustering >= 0.5""")
def _(d):
    return rounded(network.suspicious_report(d.metrics, d.suppliers), clustering=6)


@query("net_degree_stats", METRICS + "SELECT max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, median(degree) AS median_degree FROM metrics")
def _(d):
    return rounded(network.degree_stats(d.metrics), mean_degree=6)


@query("net_top_connected", METRICS + """SELECT node AS bidder_id, CASE WHEN node IN (SELECT supplier_id FROM tenders WHERE supplier_id IS NOT NULL) THEN 'supplier ' || node END AS supplier_name,
degree FROM metrics ORDER BY degree DESC, node LIMIT 10""")
def _(d):
    return network.top_connected(d.metrics, d.suppliers)


@query("net_summary", NETWORKED + """SELECT 'cobid_nodes' AS metric, (SELECT count(*) FROM metrics) AS value
UNION ALL SELECT 'cobid_edges', (SELECT count(*) FROM cobid)
UNION ALL SELECT 'winlose_nodes', (SELECT count(*) FROM (SELECT winner_id FROM winlose UNION SELECT loser_id FROM winlose))
UNION ALL SELECT 'winlose_edges', (SELECT count(*) FROM winlose)
UNION ALL SELECT 'rotation_pairs', (SELECT count(*) FROM rotation WHERE rotation_ratio >= 0.5)
UNION ALL SELECT 'monopolistic_pairs', (SELECT count(*) FROM mono)
UNION ALL SELECT 'flagged_tenders', (SELECT cast(sum(network_anomaly) AS BIGINT) FROM networked)""")
def _(d):
    return network.summary(d.cobid, None, d.winlose, N.monopolistic_pairs(d.tenders), d.networked)


@query("net_summary_full")
def _(d):
    found = _collusion_communities(d)
    return network.summary(d.cobid, _communities(d), d.winlose, N.monopolistic_pairs(d.tenders), d.networked,
                           _collusion(d), found, network.mixed_communities(found, 3))
