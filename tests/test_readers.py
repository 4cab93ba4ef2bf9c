"""Readers on small folders: column order, layouts side by side, absent years; communities to convergence."""

import logging

import pytest

from tendersift.operators import communities, graph
from tendersift.sources import readers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_columns_follow_each_header(spark, tmp_path):
    write(tmp_path / "bids_2022.csv", "tender_id,bid_id,bid_amount\nt1,b1,10.5\n")
    write(tmp_path / "bids_2023.csv", "bid_id,tender_id,extra\nb2,t2,x\n")
    rows = {r.bid_id: r for r in readers.load_bids(spark, str(tmp_path), years=[2022, 2023]).collect()}
    assert (rows["b1"].tender_id, rows["b1"].bid_amount, rows["b1"].extra) == ("t1", 10.5, None)
    assert (rows["b2"].tender_id, rows["b2"].bid_amount, rows["b2"].extra) == ("t2", None, "x")


def test_files_and_partitions_are_united(spark, tmp_path, caplog):
    write(tmp_path / "bids_2022.csv", "bid_id,tender_id\nb1,t1\n")
    write(tmp_path / "bids" / "year=2022" / "x.csv", "bid_id,tender_id\nold,t0\n")
    write(tmp_path / "bids" / "year=2024" / "x.csv", "tender_id,bid_id\nt3,b3\n")
    with caplog.at_level(logging.WARNING):
        got = readers.load_bids(spark, str(tmp_path), years=[2022, 2023, 2024]).select("bid_id", "tender_id").collect()
    assert sorted(map(tuple, got)) == [("b1", "t1"), ("b3", "t3")]
    assert "2023" in caplog.text and "2022" not in caplog.text
    with pytest.raises(ValueError):
        readers.load_bids(spark, str(tmp_path), years=[1990])


def test_communities_settle(spark):
    two = [(a, b, 1) for group in (range(0, 6), range(6, 12)) for a in group for b in group if a < b] + [(5, 6, 1)]
    edges = spark.createDataFrame(two, "src bigint, dst bigint, weight bigint")
    found = {r.node: r.community for r in communities.communities(edges).collect()}
    assert found == {n: 0 if n < 6 else 6 for n in range(12)}
    # No single node gains by another community.
    labels = spark.createDataFrame(list(found.items()), "node bigint, community bigint")
    best = communities.modularity(edges, labels)
    moved = spark.createDataFrame([(n, 0 if n == 6 else c) for n, c in found.items()], "node bigint, community bigint")
    assert communities.modularity(edges, moved) < best


def test_components_and_rings_are_complete(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src bigint, dst bigint")
    found = {r.node: r.component for r in graph.components(chain).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
    wins = spark.createDataFrame([(3 * k + i, 3 * k + (i + 1) % 3) for k in range(120) for i in range(3)], "winner_id bigint, loser_id bigint")
    assert graph.directed_rings(wins).count() == 120


def test_changed_inputs_are_staged_anew(spark, tmp_path):
    from tendersift.staging import stage

    folder = str(tmp_path / "in")
    def build():
        return spark.read.parquet(folder)

    spark.range(3).write.parquet(folder)
    assert stage(spark, folder, "t", build).count() == 3
    spark.range(2).write.mode("append").parquet(folder)
    assert stage(spark, folder, "t", build).count() == 5


def test_exact_samples_take_the_smallest_hashes(spark):
    rows = spark.range(30_000).selectExpr("id % 20000 AS id", "id AS other").repartition(6)
    hashes = sorted(r.h for r in rows.selectExpr("xxhash64(id, 42) AS h").collect())
    for n in (0, 1, 7, 12_345, 29_999, 30_000, 40_000):
        got = readers.sample_exact(rows, n, "id")
        assert got.columns == rows.columns
        assert sorted(r.h for r in got.selectExpr("xxhash64(id, 42) AS h").collect()) == hashes[: max(0, n)]
        assert got.distinct().count() == min(n, 30_000)
