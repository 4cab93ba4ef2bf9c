"""The tender and bid mapping as SQL, used in front of every check query."""

MAPPING = """
WITH RECURSIVE t0 AS (
  SELECT o_orderkey, o_custkey % 40 AS b, o_orderstatus,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 2
              THEN date_trunc('year', o_orderdate) ELSE o_orderdate END AS pub,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS split_case,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'limited' WHEN '2-HIGH' THEN 'selective' ELSE 'open' END AS m,
         CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice * 60
              WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 2 THEN 40000.0::DOUBLE + o_orderkey % 9999
              WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 5
              WHEN o_orderkey % 9 = 0 THEN floor(o_totalprice / 1000) * 1000
              ELSE o_totalprice END AS tv
  FROM orders),
b0 AS (
  SELECT t0.*, l_linenumber, l_partkey, l_shipdate, l_quantity,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS bid_id,
         CASE WHEN o_orderkey % 500 = 1 THEN 100000 + o_orderkey
              WHEN l_suppkey = 13 THEN 200000 + b
              WHEN l_suppkey = 11 THEN 11
              WHEN l_suppkey % 100 < (b % 20) * 5 THEN b * 2
              ELSE l_suppkey END AS bidder_id,
         (CASE WHEN l_suppkey = 11 THEN 3 ELSE 1 END) *
         (CASE WHEN o_orderkey % 7 = 0 THEN l_extendedprice
               ELSE tv * (1 - l_discount + l_tax / 2) END) AS bid_amount,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'disqualified' ELSE 'active' END AS bid_status
  FROM lineitem JOIN t0 ON l_orderkey = o_orderkey),
w AS (
  SELECT * FROM (SELECT b0.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY bid_amount, bidder_id, bid_id) AS rn
                 FROM b0 WHERE bid_status = 'active') x WHERE rn = 1),
bids AS (
  SELECT b0.o_orderkey AS tender_id, b0.bid_id, b0.bidder_id, b0.bid_status, b0.bid_amount,
         b0.pub + to_minutes(cast(b0.l_linenumber * b0.l_quantity AS INT)) AS bid_date,
         CASE WHEN w.bid_id IS NOT NULL THEN 1 ELSE 0 END AS is_winner
  FROM b0 LEFT JOIN w ON b0.bid_id = w.bid_id),
c AS (
  SELECT o_orderkey AS k, count(*) AS n, count(DISTINCT bidder_id) AS nd,
         max(CASE WHEN bid_status = 'disqualified' THEN 1 ELSE 0 END) AS has_dq
  FROM b0 GROUP BY o_orderkey),
t1 AS (
  SELECT t0.o_orderkey AS tender_id, t0.b AS buyer_id,
         CASE WHEN t0.o_orderkey % 150 = 1 THEN 88888888
              WHEN t0.o_orderkey % 100 = 0 THEN 900000 + cast(floor(t0.o_orderkey / 100) AS BIGINT) % 3
              ELSE w.bidder_id END AS supplier_id,
         t0.m AS procurement_method,
         CASE t0.o_orderstatus WHEN 'F' THEN 'lowestCost' WHEN 'O' THEN 'ratedCriteria' END AS award_criteria,
         CASE WHEN t0.split_case = 1 THEN 45 WHEN t0.o_orderkey % 100 = 0 THEN 90 ELSE w.l_partkey % 25 END AS main_cpv_2_digit,
         t0.tv AS tender_value, w.bid_amount AS award_value,
         t0.pub AS published_date, w.l_shipdate AS award_date,
         cast(year(t0.pub) AS INT) AS year, cast(month(t0.pub) AS INT) AS month, cast(quarter(t0.pub) AS INT) AS quarter,
         cast(isodow(t0.pub) - 1 AS INT) AS day_of_week,
         CASE WHEN isodow(t0.pub) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN quarter(t0.pub) = 4 THEN 1 ELSE 0 END AS is_q4,
         CASE WHEN month(t0.pub) = 12 THEN 1 ELSE 0 END AS is_december,
         coalesce(c.n, 0) AS number_of_bids, coalesce(c.nd, 0) AS number_of_tenderers,
         coalesce(c.has_dq, 0) AS has_unsuccessful_awards,
         CASE WHEN t0.o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS has_cancelled_awards,
         CASE WHEN t0.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS has_enquiries,
         t0.o_orderkey % 11 AS number_of_documents
  FROM t0 LEFT JOIN w ON t0.o_orderkey = w.o_orderkey LEFT JOIN c ON c.k = t0.o_orderkey),
tenders AS (
  SELECT t1.*,
         CASE WHEN number_of_tenderers = 1 THEN 1 ELSE 0 END AS is_single_bidder,
         CASE WHEN number_of_tenderers > 1 THEN 1 ELSE 0 END AS is_competitive,
         CASE WHEN buyer_id % 5 <> supplier_id % 5 THEN 1 ELSE 0 END AS is_cross_region,
         CASE WHEN buyer_id = 7 THEN 1 ELSE 0 END AS is_buyer_masked,
         CASE WHEN supplier_id % 97 = 5 OR supplier_id = 88888888 THEN 1 ELSE 0 END AS is_supplier_masked,
         (tender_value - award_value) / tender_value * 100 AS price_change_pct,
         (tender_value - award_value) / tender_value * 100 AS discount_percentage_avg
  FROM t1)
"""
