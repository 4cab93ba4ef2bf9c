"""Edge cases on small literal tables, against brute force where SQL has no answer."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendersift import staging
from tendersift.functions import expr as E
from tendersift.operators import anomaly, communities, edges, ensemble, graph, iforest, lof, network, portraits, rules, scaling, screens
from tendersift.operators.quantiles import exact_quantiles
from tendersift.plans import registry
from tendersift.sources import mapping, readers


def test_exact_quantiles_by_group(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random() * 100, 5.0])) for k in ("a", "b") for _ in range(3000)] + [("c", 1.0), ("c", 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], {"q1": (F.col("v"), 0.25), "q2": (F.col("v"), 0.5), "q9": (F.col("v"), 0.9)}).collect()}
    for k in "abc":
        values = [v for kk, v in rows if kk == k and v is not None]
        for name, p in (("q1", 25), ("q2", 50), ("q9", 90)):
            assert math.isclose(got[k][name], np.percentile(values, p), rel_tol=1e-12)


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.5,), (0.00001,), (123.4,), (1e8,), (None,)], "x double")
    digits = [r.d for r in df.select(E.first_digit(F.col("x")).alias("d")).collect()]
    assert digits == [None, 5, None, 1, 1, None]
    levels = df.sparkSession.createDataFrame([(0.0,), (0.5,), (0.51,), (1.0,)], "s double").select(E.ml_level(F.col("s")).alias("l")).collect()
    assert [r.l for r in levels] == [None, "low", "medium", "critical"]
    days = spark.sql("select timestamp'2024-01-02 12:00:00' a, timestamp'2024-01-01 00:00:01' b").select(
        E.whole_days(F.col("b"), F.col("a")).alias("d"), E.whole_days(F.col("a"), F.col("b")).alias("n")).first()
    assert (days.d, days.n) == (1, -1)


def test_rules_on_ties_and_nulls(spark):
    tenders = spark.sql("""select * from values
      ('t1', 'b1', 's1', 'open', cast(null as string), 100.0D, timestamp'2024-01-01 00:00:00', 2),
      ('t2', 'b1', cast(null as string), 'limited', 'lowestCost', 0.0D, timestamp'2024-01-01 00:00:00', 1)
      as t(tender_id, buyer_id, supplier_id, procurement_method, award_criteria, tender_value, published_date, number_of_bids)""")
    bids = spark.sql("""select * from values
      ('t1', 'x1', 'a', 10.0D, 'disqualified', 0), ('t1', 'x2', 'c', 10.0D, 'active', 1), ('t2', 'x3', 'a', cast(null as double), 'active', 0)
      as b(tender_id, bid_id, bidder_id, bid_amount, bid_status, is_winner)""")
    out = {r.tender_id: r for r in rules.detect(tenders, bids, enabled=["R021", "R024", "R028", "R034", "R036"]).collect()}
    assert out["t1"].flag_discretionary_criteria == 1 and out["t2"].flag_discretionary_criteria == 0
    assert out["t1"].flag_close_to_winner == 1 and out["t1"].flag_identical_bids == 1
    assert out["t1"].flag_lowest_bid_disqualified == 1 and out["t2"].flag_lowest_bid_disqualified == 0
    assert out["t1"].flag_same_bid_order == 0  # no bid dates


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="missing columns"):
        rules.detect(spark.range(1))
    with pytest.raises(ValueError, match="No data found"):
        readers.load_tenders(spark, "/tmp/there-is-no-such-folder")


def test_award_gaps_cross_months(spark):
    days = ["2024-01-01", "2024-01-11", "2024-01-11", "2024-03-01", "2024-03-02"]
    df = spark.createDataFrame([("b", "s", d) for d in days], "buyer_id string, supplier_id string, d string").withColumn("award_date", F.to_timestamp("d"))
    got = portraits.award_gap_spread(df).first().temporal_concentration
    assert math.isclose(got, np.std([10, 0, 50, 1], ddof=1), rel_tol=1e-9)


def test_mixed_communities_name_their_buyers_and_suppliers(spark):
    found = spark.createDataFrame([("S_7", "c"), ("B_2", "c"), ("B_10", "c"), ("S_B_1", "c"), ("B_3", "d"), ("S_1", "d"), ("S_4", "e"), ("S_5", "e"), ("S_6", "e")],
                                  "node string, community string")
    mixed = network.mixed_communities(found, 3)
    assert [tuple(r) for r in mixed.collect()] == [("c", 4, 2, 2, ["10", "2"], ["7", "B_1"])]
    edges_ = spark.createDataFrame([("B_2", "S_7", "contract", 5.0)], "src string, dst string, edge_type string, value double")
    profile = network.mixed_profile(edges_, found, mixed)
    assert "buyer_ids" not in profile.columns and profile.first().contract_value == 5.0
    assert {(r.kind, r.member_id) for r in network.mixed_members(found, mixed).collect()} == {("buyer", "2"), ("buyer", "10"), ("supplier", "7"), ("supplier", "B_1")}


def test_large_tender_is_paired_once(spark, monkeypatch):
    monkeypatch.setattr(edges, "CELL", 3)
    bids = spark.createDataFrame([(t, b) for t in range(2) for b in range(11)], "tender_id int, bidder_id int")
    got = {(r.src, r.dst): r.weight for r in edges.bidder_pairs(bids, 2).collect()}
    assert got == {p: 2 for p in itertools.combinations(range(11), 2)}


def _edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 1) for p in pairs], "src long, dst long, weight long")


def test_betweenness_of_a_path(spark):
    got = {r.node: r.betweenness for r in graph.betweenness(_edges(spark, [(1, 2), (2, 3), (3, 4)])).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {1: 0.0, 2: round(2 / 3, 6), 3: round(2 / 3, 6), 4: 0.0}


def _slow_betweenness(arcs, cutoff):
    nodes = sorted({x for x, _ in arcs})
    far = {(a, b): 0 if a == b else arcs.get((a, b), math.inf) for a in nodes for b in nodes}
    for k, a, b in itertools.product(nodes, repeat=3):
        far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    paths = {}
    for s in nodes:
        for v in sorted((x for x in nodes if far[s, x] < math.inf), key=lambda x: far[s, x]):
            paths[s, v] = 1 if s == v else sum(paths[s, u] for u in nodes if (u, v) in arcs and far[s, u] + arcs[u, v] == far[s, v])
    ok = lambda a, b: far[a, b] <= cutoff
    n = len(nodes)
    return {v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and ok(s, t) and far[s, t] < math.inf
                   and far[s, v] + far[v, t] == far[s, t]) / ((n - 1) * (n - 2)) for v in nodes}


@pytest.mark.parametrize("cutoff, rows", [(None, 1 << 26), (6, 300)])
def test_weighted_betweenness_equals_brute_force(spark, cutoff, rows):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(16), 2))): rng.randrange(1, 5) for _ in range(34)} | {(20, 21): 2}
    edges_ = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight long")
    got = {r.node: r.betweenness for r in graph.betweenness(edges_, cutoff=cutoff, rows=rows).collect()}
    arcs = {**pairs, **{(b, a): w for (a, b), w in pairs.items()}}
    want = _slow_betweenness(arcs, math.inf if cutoff is None else cutoff)
    assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-12) for v in want)


def test_betweenness_batches_hold_source_and_node_rows_only(spark, monkeypatch):
    """Steps along arcs are summed up where the rows of their source are: only one row per (source, node) is written."""
    pairs = list(itertools.combinations(range(40), 2))
    written, calls = [], []
    keep, owed = graph.cut_lineage, graph._dependencies

    def kept(df):
        out = keep(df)
        if {"s", "node"} <= set(out.columns):
            written.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(node"), out.count()))
        return out

    monkeypatch.setattr(graph, "cut_lineage", kept)
    monkeypatch.setattr(graph, "_dependencies", lambda *a: calls.append(1) or owed(*a))
    got = graph.betweenness(_edges(spark, pairs), rows=40 * 40).collect()
    assert len(got) == 40 and all(r.betweenness == 0 for r in got)
    assert len(calls) == 1 and all(moved == 0 and n <= 40 * 40 for moved, n in written)


@pytest.mark.parametrize("sent, step, named", [(1 << 23, 1, False), (0, 1, False), (1 << 23, 0.25, True), (1 << 23, 2000, True)])
def test_betweenness_of_several_components_by_tasks_and_by_shuffles(spark, monkeypatch, sent, step, named):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(14), 2))): rng.randrange(1, 5) * step for _ in range(30)} | {(20, 21): 2 * step, (21, 22): 2 * step, (30, 31): step}
    name = (lambda x: f"n{x:02d}") if named else (lambda x: x)
    rows = [(name(a), name(b), float(w)) for (a, b), w in pairs.items()]
    monkeypatch.setattr(graph, "SENT", sent)
    monkeypatch.setattr(graph.paths, "BLOCK", 64)
    monkeypatch.setattr(graph.paths, "PACKED", 2)
    e = spark.createDataFrame([*rows, (rows[0][0], rows[0][1], 99.0 * step), (name(40), name(40), 1.0)], f"src {'string' if named else 'long'}, dst {'string' if named else 'long'}, weight double")
    got = {r.node: r.betweenness for r in graph.betweenness(e, rows=1 << 20).collect()}
    want = _slow_betweenness({**pairs, **{(b, a): w for (a, b), w in pairs.items()}, (40, 40): 0}, math.inf)
    assert len(got) == len(want) and all(math.isclose(got[name(v)], want[v], abs_tol=1e-12) for v in want)


def test_betweenness_counts_long_paths_in_large_graphs(spark):
    n = 10_050
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(3).cast("long").alias("weight"))
    got = {r.node: r.betweenness for r in graph.betweenness(star).collect()}
    assert len(got) == n and math.isclose(got[0], 1) and all(got[v] == 0 for v in range(1, n))


def test_communities_split_two_cliques(spark):
    a = list(itertools.combinations(range(5), 2))
    b = list(itertools.combinations(range(10, 15), 2))
    e = _edges(spark, [*a, *b, (4, 10)])
    found = communities.communities(e)
    labels = {r.node: r.community for r in found.collect()}
    # Communities stay inside components and beat the one-community labelling.
    assert len(set(labels.values())) >= 2
    one = found.select("node", F.lit(0).alias("community"))
    assert communities.modularity(e, found) > communities.modularity(e, one)


def test_communities_end_where_no_node_gains(spark):
    rng = random.Random(9)
    pairs = {}
    for _ in range(900):
        a = rng.randrange(150)
        b = (a // 15 * 15 + rng.randrange(15)) if rng.random() < 0.8 else rng.randrange(150)
        if a != b:
            pairs[min(a, b), max(a, b)] = rng.randrange(1, 4)
    for leaf in range(200, 320):  # a hub whose leaves all want one community
        pairs[0, leaf] = 1
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight long")
    found = communities.communities(e)
    label = {r.node: r.community for r in found.collect()}
    m2, k = 2 * sum(pairs.values()), {}
    link = {}
    for (a, b), w in pairs.items():
        for x, y in ((a, b), (b, a)):
            k[x] = k.get(x, 0) + w
            link[x, label[y]] = link.get((x, label[y]), 0) + w
    total = {}
    for x, c in label.items():
        total[c] = total.get(c, 0) + k[x]
    # Every label is the smallest member's, and merging two neighbouring communities never gains.
    assert all(min(x for x in label if label[x] == c) == c for c in set(label.values()))
    between = {}
    for (x, c), w in link.items():
        if c != label[x]:
            between[label[x], c] = between.get((label[x], c), 0) + w
    assert all(w - total[a] * total[b] / m2 <= 1e-6 for (a, b), w in between.items())
    assert communities.modularity(e, found) > 0.4


def test_communities_take_few_rounds(spark, monkeypatch):
    """A dense graph with hubs and no clear groups, on which moves that are safe by themselves take 87 rounds."""
    rng = random.Random(4)
    pairs = {(a, b): rng.randrange(3, 13) for a in range(400) for b in range(a + 1, 400) if rng.random() < (0.9 if a < 20 else 0.2)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight long")
    rounds, moves = [], communities._moves

    def counted(*args):
        rounds.append(1)
        assert len(rounds) <= 70
        return moves(*args)

    monkeypatch.setattr(communities, "_moves", counted)
    found = communities.communities(e)
    assert found.count() == 400 and communities.modularity(e, found) > 0.064


def test_communities_weigh_moves_made_together(spark):
    """The set that is chosen raises the modularity, and no tried set by more."""
    rng = random.Random(8)
    pairs = {(a, b): rng.randrange(1, 9) for a in range(60) for b in range(a, 60) if rng.random() < (0.4 if a // 20 == b // 20 else 0.1)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight long")
    arcs = communities._symmetric(e)
    strength = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    labels = strength.select("node", (F.col("node") % 7).alias("c"))
    m2 = arcs.agg(F.sum("weight")).first()[0]
    movers, totals = communities._movers(arcs, strength, labels, m2, 5)
    chosen = communities._best_set(arcs, movers, totals, m2)
    before, moving = communities._modularity(arcs, labels), {r.node: r for r in movers.collect()}
    start = {r.node: r.c for r in labels.collect()}
    after = {}
    for crossing in (False, True):
        for depth in range(4):
            made = {n: r.target for n, r in moving.items() if r.depth >= depth and (r.crossing or not crossing)}
            trial = spark.createDataFrame([(n, made.get(n, c)) for n, c in start.items()], "node long, c long")
            after[crossing, depth] = communities._modularity(arcs, trial)
    assert chosen in after and after[chosen] > before
    assert math.isclose(after[chosen], max(after.values()), rel_tol=1e-9)


def test_neighbours_split_both_sides(spark):
    """Twenty thousand points in twelve features; no group holds more than a block and a bit of either side."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 12)) * 3
    x = centres[rng.integers(0, 12, 20_000)] + rng.normal(size=(20_000, 12)) * rng.uniform(0.1, 1.5, size=(20_000, 1))
    points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, m long, features array<double>").repartition(16)
    near = lof.neighbours(points, 10)
    some = rng.choice(20_000, 60, replace=False).tolist()
    got = {}
    for r in near.where(F.col("id").isin(some)).collect():
        got.setdefault(r.id, []).append(r.distance)
    for i in some:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert np.allclose(sorted(got[i]), np.sort(np.delete(d, i))[:10])
    asked = spark.range(7 * lof.BLOCK).select("id", F.lit(0).alias("cell"))
    left, right = lof.dealt(asked, asked.where(f"id < {3 * lof.BLOCK}").toDF("id", "cell"))
    for side in (left, right):
        assert side.groupBy("cell", "a", "s").count().agg(F.max("count")).first()[0] <= 1.2 * lof.BLOCK
    assert left.select("a").distinct().count() == 7 and right.select("s").distinct().count() == 3


def test_lof_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(120, 3)), rng.normal(size=(30, 3)) * 0.1 + 6, np.repeat(rng.normal(size=(1, 3)), 4, axis=0)])
    k, n = 7, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kdist = d[np.arange(n), near[:, -1]]
    lrd = np.array([1 / (np.mean(np.maximum(d[i, near[i]], kdist[near[i]])) + 1e-10) for i in range(n)])
    want = np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    got = {r.id: r.raw_score for r in lof.lof_scores(df, ["id"], k).collect()}
    assert np.allclose([got[i] for i in range(n)], want, rtol=1e-6)


def test_iforest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(600, 3)), np.full((6, 3), 9.0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    scores = {r.id: r.raw_score for r in iforest.fit_score(df, ["id"], n_trees=30)[0].collect()}
    again = {r.id: r.raw_score for r in iforest.fit_score(df, ["id"], n_trees=30)[0].collect()}
    top = sorted(scores, key=scores.get, reverse=True)[:30]
    assert set(range(600, 606)) <= set(top)
    assert scores == again


def test_methods_meet_in_a_full_outer_join(spark):
    """Repeated tenders meet each other, rows without a tender stay apart, gaps and empty methods give 0."""
    row = lambda m, rows: spark.createDataFrame(rows, f"tender_id string, {m}_score double, {m}_anomaly int")
    frames = {"rule": row("rule", [("a", 0.5, 1), ("a", 0.25, 0), (None, 0.75, 1)]), "stat": row("stat", [("a", 1.0, 1), ("a", 0.0, None), ("b", None, 1), (None, 0.5, 0)]),
              "network": row("network", [("c", 1.0, 1)]), "lof": row("lof", [])}
    got = [tuple(r) for r in ensemble.union_methods(frames).collect()]
    zero = (0.0, 0)
    want = [("a", *r, *s, *zero, *zero) for r in ((0.5, 1), (0.25, 0)) for s in ((1.0, 1), (0.0, 0))]
    want += [("b", *zero, 0.0, 1, *zero, *zero), ("c", *zero, *zero, 1.0, 1, *zero), (None, 0.75, 1, *zero, *zero, *zero), (None, *zero, 0.5, 0, *zero, *zero)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tables_that_are_small_as_files_only_are_not_broadcast(spark, tmp_path):
    """A million rows in files of under 10 MB do not go through the driver; a table that is small does."""
    registry.Data(spark, str(tmp_path))
    for name, n in (("large", 1_000_000), ("small", 1000)):
        spark.range(n).select("id", F.lit("competitive procedure " * 5).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    assert sum(f.stat().st_size for f in (tmp_path / "large").iterdir()) < 10 << 20
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    plan = lambda name: read("large").join(read(name), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan("large") and "Broadcast" in plan("small")


def test_edges_and_lines_are_built_once(spark, monkeypatch, tmp_path):
    """Flags of the networks use the written edges; the winner of an order needs no second pass over its lines."""
    at = "timestamp'2024-03-04 10:00:00'"
    spark.range(60).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "'O' AS o_orderstatus", "100.0D + id AS o_totalprice", f"{at} AS o_orderdate",
                               "'3-MEDIUM' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(240).selectExpr("id DIV 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "id % 7 AS l_partkey", "96 + id % 4 AS l_suppkey", f"{at} AS l_shipdate",
                                "2.0D AS l_quantity", "50.0D AS l_extendedprice", "(id * 7 % 5) / 50D AS l_discount", "0.0D AS l_tax",
                                "if(id % 4 = 2, 'R', 'N') AS l_returnflag", "'F' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    calls, built = [], edges.cobid_edges
    monkeypatch.setattr(edges, "cobid_edges", lambda *a: calls.append(1) or built(*a))
    d = registry.Data(spark, str(tmp_path))
    assert d.cobid.count() == 6 and d.networked.count() == 60 and len(calls) == 1
    bids = d.bids.toPandas()
    for _, rows in bids.groupby("tender_id"):
        valid = rows[rows.bid_status == "active"].sort_values(["bid_amount", "bidder_id", "bid_id"])
        assert len(rows) == 4 and list(rows[rows.is_winner == 1].bid_id) == [valid.bid_id.iloc[0]]
    plan = mapping.build_bids(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_vote_fills_missing_methods(spark):
    rule = spark.createDataFrame([("a", 8), ("b", 1)], "tender_id string, rule_risk_score int")
    net = spark.createDataFrame([("a", 1.0, 1), ("c", 0.0, 0)], "tender_id string, network_score double, network_anomaly int")
    out = {r.tender_id: r for r in ensemble.combine({"rule": rule, "network": net}).collect()}
    assert out["a"].consensus_count == 2 and out["a"].ensemble_risk_level == "critical"
    assert out["c"].consensus_count == 0 and out["c"].rule_score == 0.0
    assert math.isclose(out["b"].ensemble_score, (1 / 8) / 2)


def test_quick_scan_needs_no_shuffle(spark):
    from tendersift.sources import mapping

    t = mapping.tenders(spark, "/root/testdata/sf0.001")
    plan = rules.quick_scan(t).select("tender_id", "rule_risk_score")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_tenders_are_not_shuffled_for_small_statistics(spark, tmp_path):
    """The tenders are larger than the broadcast limit, the statistics of forty buyers and 25 product groups are far below."""
    spark.range(20000).selectExpr(
        "id AS tender_id", "id % 40 AS buyer_id", "id % 25 AS main_cpv_2_digit", "id % 700 AS supplier_id", "rand(1) * 1e6 AS tender_value", "rand(2) * 1e6 AS award_value",
        "timestamp'2024-01-01' + make_dt_interval(int(id % 900)) AS published_date", "'open' AS procurement_method", "id % 9 AS number_of_tenderers",
    ).coalesce(1).write.parquet(f"{tmp_path}/tenders")
    tenders = spark.read.parquet(f"{tmp_path}/tenders")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    try:
        wide = rules.enrich(tenders, None, ["cpv", "market", "buyer", "dominance"])
        screened = screens.concentration(screens.value_outliers(tenders), source=tenders)
        for df, joins in ((wide, 4), (screened, 2), (scaling.value_vs_cpv_median(tenders), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= joins
            assert df.count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_reports_on_the_vote_of_five_methods(spark, monkeypatch):
    import __spark_entry__ as entry
    from tendersift.plans import q_ensemble

    votes = {1: "11110", 2: "00110", 3: "00100", 4: "11111", 5: "00000"}
    column = {"rule": "rule_risk_score double, rule_risk_level string"}
    frames = {}
    for k, m in enumerate(ensemble.METHODS):
        on = {t: int(v[k]) for t, v in votes.items()}
        rows = [(t, float(v), "high" if v else "low") if m == "rule" else (t, float(v), v) for t, v in on.items()]
        frames[m] = spark.createDataFrame(rows, "tender_id long, " + column.get(m, f"{m}_score double, {m}_anomaly int"))
    monkeypatch.setattr(q_ensemble, "combined", lambda d: ensemble.combine(frames))
    run = lambda name: entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    got = {r.metric: r.value for r in run("ens_summary_five")}
    want = {f"consensus_{i}_methods": sum(v.count("1") == i for v in votes.values()) for i in range(6)}
    assert {k: v for k, v in got.items() if k.startswith("consensus")} == want
    assert sorted(r.tender_id for r in run("ens_critical_five")) == [1, 4]
    assert sorted(r.tender_id for r in run("ens_consensus_filter_five")) == [1, 2, 4]
    assert {r.method: r.anomalies for r in run("ens_method_stats_five")} == {m: sum(int(v[k]) for v in votes.values()) for k, m in enumerate(ensemble.METHODS)}
    assert {r.consensus_count: r.tenders for r in run("rep_consensus_dist_five")} == {0: 1, 1: 1, 2: 1, 4: 1, 5: 1}


def test_exact_quantiles_share_a_column(spark):
    rng = random.Random(2)
    rows = [(rng.choice([rng.random(), 0.0, 0.5, 1.0, None]), rng.choice([0, 1]), None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "v double, w int, z double")
    v, w, z = (F.col(c) for c in "vwz")
    # Out of order, twice the same, close together, the ends, a column of ties and one without values.
    asked = {"b": (v, 0.75), "a": (v, 0.25), "a2": (v, 0.25), "near": (v, 0.2501), "lo": (v, 0.0), "hi": (v, 1.0), "m": (w, 0.5), "none": (z, 0.5)}
    out = exact_quantiles(df, [], asked)
    got = out.first()
    known = [r[0] for r in rows if r[0] is not None]
    for name in ("b", "a", "a2", "near", "lo", "hi"):
        assert math.isclose(got[name], np.percentile(known, asked[name][1] * 100), rel_tol=1e-12), name
    assert got["m"] == np.median([r[1] for r in rows]) and got["none"] is None
    assert exact_quantiles(df.limit(0), [], {"q": (v, 0.5)}).first()["q"] is None
    sketches = lambda wanted: exact_quantiles(df, [], wanted)._jdf.queryExecution().analyzed().toString().count("percentile_approx")
    assert sketches({"q1": (v, 0.25), "q2": (v, 0.5), "q3": (v, 0.75)}) == sketches({"q2": (v, 0.5)})


def test_models_score_rows_once(spark):
    rows = [(i, (i % 50) / 10.0, float(i % 7)) for i in range(300)] + [(300, 90.0, 90.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    scored = anomaly._detect(df, ["x", "y"], ["id"], "iforest", 0.05)
    assert "ArrowEvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.orderBy(F.desc("raw_score")).first().id == 300


def test_stages_are_not_fused_into_huge_methods(spark):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    staging.stage(spark, "short-methods", "seen", lambda: seen.append(spark.conf.get(name)) or spark.range(1))
    assert seen == ["8000"] and spark.conf.get(name) == before
