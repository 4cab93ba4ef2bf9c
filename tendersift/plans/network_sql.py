"""The three networks and their flags as SQL."""

EDGES = """
, fair AS (SELECT tender_id, supplier_id FROM tenders WHERE procurement_method IN ('open', 'selective') AND number_of_tenderers >= 2)
, fb AS (SELECT DISTINCT b.tender_id, b.bidder_id FROM bids b WHERE b.tender_id IN (SELECT tender_id FROM fair))
, cobid AS (SELECT a.bidder_id AS src, b.bidder_id AS dst, count(*) AS weight FROM fb a JOIN fb b ON a.tender_id = b.tender_id AND a.bidder_id < b.bidder_id
            GROUP BY 1, 2 HAVING count(*) >= 3)
, winlose AS (SELECT supplier_id AS winner_id, bidder_id AS loser_id, count(*) AS weight FROM fb JOIN fair USING (tender_id)
              WHERE supplier_id <> bidder_id GROUP BY 1, 2 HAVING count(*) >= 3)
, rotation AS (SELECT a.winner_id AS bidder_1, a.loser_id AS bidder_2, a.weight AS wins_1_over_2, b.weight AS wins_2_over_1,
   a.weight + b.weight AS total_interactions, least(a.weight, b.weight)::DOUBLE / greatest(a.weight, b.weight) AS rotation_ratio
   FROM winlose a JOIN winlose b ON a.winner_id = b.loser_id AND a.loser_id = b.winner_id WHERE a.winner_id < a.loser_id)
, contract_all AS (SELECT buyer_id, supplier_id, count(*) AS contract_count, coalesce(sum(award_value), 0) AS total_value FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2)
, contracts AS (SELECT * FROM contract_all WHERE contract_count >= 3)
, buyer_n AS (SELECT buyer_id, count(*) AS total_contracts FROM tenders GROUP BY 1)
, mono AS (SELECT buyer_id, supplier_id, contract_count, total_value, total_contracts, contract_count::DOUBLE / total_contracts AS dominance_ratio
   FROM (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY contract_count DESC, supplier_id) AS rn FROM contract_all) JOIN buyer_n USING (buyer_id)
   WHERE rn = 1 AND contract_count::DOUBLE / total_contracts >= 0.5)
"""


def metrics(table: str, out: str) -> str:
    """Degree and clustering of an edge table as CTE ``out``."""
    return f"""
, {out}_arc AS (SELECT src, dst FROM {table} UNION ALL SELECT dst, src FROM {table})
, {out}_deg AS (SELECT src AS node, count(*) AS degree FROM {out}_arc GROUP BY 1)
, {out}_tri AS (SELECT a.src AS node, count(*) / 2 AS t FROM {out}_arc a JOIN {out}_arc b ON a.src = b.src AND a.dst <> b.dst
   WHERE (a.dst, b.dst) IN (SELECT (src, dst) FROM {out}_arc) GROUP BY 1)
, {out} AS (SELECT d.node, degree, CASE WHEN degree >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering
   FROM {out}_deg d LEFT JOIN {out}_tri t ON d.node = t.node)
"""


METRICS = EDGES + metrics("cobid", "metrics")
NETWORKED = METRICS + """
, net_0 AS (SELECT tender_id,
   cast(coalesce(supplier_id IN (SELECT node FROM metrics WHERE degree >= 10 AND clustering >= 0.7), false) AS INT) AS network_suspicious_supplier,
   cast(coalesce((buyer_id, supplier_id) IN (SELECT (buyer_id, supplier_id) FROM mono WHERE dominance_ratio >= 0.9 AND total_contracts >= 20), false) AS INT) AS network_monopolistic,
   cast(coalesce(supplier_id IN (SELECT unnest([bidder_1, bidder_2]) FROM rotation WHERE rotation_ratio >= 0.7 AND total_interactions >= 5), false) AS INT) AS network_rotation
   FROM tenders)
, networked AS (SELECT *, greatest(network_suspicious_supplier, network_monopolistic, network_rotation) AS network_anomaly,
   (network_suspicious_supplier + network_monopolistic + network_rotation) / 3.0::DOUBLE AS network_score FROM net_0)
"""
COLLUSION = EDGES + """
, rel AS (
  SELECT 'B_' || buyer_id AS u, 'S_' || supplier_id AS v, 1 AS pr, contract_count AS weight, total_value AS value FROM contracts
  UNION ALL SELECT 'S_' || src, 'S_' || dst, 2, weight, NULL FROM cobid
  UNION ALL SELECT 'S_' || winner_id, 'S_' || loser_id, CASE WHEN 'S_' || winner_id < 'S_' || loser_id THEN 3 ELSE 4 END, weight, NULL FROM winlose)
, col AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, min(pr) AS first, arg_min(weight, pr) AS weight, max(value) AS value,
   max(weight) FILTER (pr = 2) AS cw, max(weight) FILTER (pr = 3) AS f, max(weight) FILTER (pr = 4) AS b, count(*) FILTER (pr >= 3) AS nwl FROM rel GROUP BY 1, 2)
, collusion AS (SELECT src, dst, CASE first WHEN 1 THEN 'contract' WHEN 2 THEN 'cobid' ELSE 'winlose' END AS edge_type, weight,
   CASE WHEN first = 1 THEN cw END AS cobid_weight,
   CASE WHEN first <= 2 THEN coalesce(b, f) WHEN nwl = 2 THEN b END AS winlose_weight, value FROM col)
"""


def _betweenness(doublings: int = 5, steps: int = 24) -> str:
    """Shortest distances by squaring, numbers of paths step by step, then all triples."""
    out = METRICS + """, arc AS (SELECT src, dst, weight::DOUBLE AS w FROM cobid UNION ALL SELECT dst, src, weight FROM cobid)
, d0 AS MATERIALIZED (SELECT src AS s, dst AS t, w AS d FROM arc UNION ALL SELECT DISTINCT src, src, 0 FROM arc)
"""
    for i in range(doublings):
        out += f", d{i + 1} AS MATERIALIZED (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{i} a JOIN d{i} b ON a.t = b.s GROUP BY 1, 2)\n"
    far = f"d{doublings}"
    out += f""", tight AS MATERIALIZED (SELECT x.s, arc.src AS u, arc.dst AS v FROM {far} x JOIN arc ON x.t = arc.src JOIN {far} y ON y.s = x.s AND y.t = arc.dst AND y.d = x.d + w)
, g0 AS (SELECT DISTINCT src AS s, src AS v, 1::DOUBLE AS c FROM arc)
"""
    for i in range(steps):
        out += f", g{i + 1} AS MATERIALIZED (SELECT tight.s, tight.v, sum(c) AS c FROM g{i} JOIN tight ON tight.s = g{i}.s AND tight.u = g{i}.v GROUP BY 1, 2)\n"
    every = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(steps + 1))
    return out + f""", sigma AS MATERIALIZED (SELECT p.s, p.v, c, d FROM (SELECT s, v, sum(c) AS c FROM ({every}) GROUP BY 1, 2) p JOIN {far} f ON f.s = p.s AND f.t = p.v)
, owed AS (SELECT a.v AS node, sum(a.c * b.c / e.c) AS x FROM sigma a JOIN sigma b ON b.s = a.v AND b.v <> a.v AND a.s <> a.v JOIN sigma e ON e.s = a.s AND e.v = b.v AND e.d = a.d + b.d AND a.s <> b.v GROUP BY 1)
, between AS (SELECT metrics.node, coalesce(x, 0) / ((SELECT count(*) FROM metrics) - 1) / nullif((SELECT count(*) FROM metrics) - 2, 0) AS betweenness FROM metrics LEFT JOIN owed USING (node))
"""


BETWEENNESS = _betweenness()
