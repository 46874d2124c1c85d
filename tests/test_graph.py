import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.operators import graph
from kerbline.sources import readers


def nearest(spark, edges, targets, nodes, default, **kwargs):
    found = graph.nearest_target(nodes, edges, targets, default, **kwargs)
    return {r.node: (r.target, r.hops) for r in found.collect()}


def test_fixed_roads(spark):
    edges, targets = readers.road_edges(spark), readers.hospitals(spark)
    got = nearest(spark, edges, targets, readers.road_nodes(spark), fixed.DEFAULT_HOSPITAL)
    assert got["King_Road_x_Palestine"] == ("King_Fahd_Hospital", 1)
    assert got["Haram_Road_x_Madinah"] == ("Al_Noor_Hospital", 1)
    assert got["Prince_Sultan_x_Sari"] == ("King_Fahd_Hospital", 3)
    assert got["Tahlia_x_MBS"] == ("Al_Noor_Hospital", None)
    assert got["Airport_Road_x_Asfan"] == ("Al_Noor_Hospital", None)
    assert got["King_Fahd_Hospital"] == ("King_Fahd_Hospital", 0)
    assert len(got) == 15


def test_successors_keep_insertion_order_and_hospitals(spark):
    lists = {r.node: r.neighbors for r in graph.successor_lists(readers.road_edges(spark)).collect()}
    assert lists["King_Road_x_Palestine"] == ["Haram_Road_x_Madinah", "King_Fahd_Hospital"]
    assert "Corniche_x_Andalus" not in lists


def random_graph(seed, nodes=30, edges=60):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


def hops_to(pairs, target):
    into = {}
    for src, dst in pairs:
        into.setdefault(dst, []).append(src)
    seen, queue = {target: 0}, deque([target])
    while queue:
        node = queue.popleft()
        for before in into.get(node, []):
            if before not in seen:
                seen[before] = seen[node] + 1
                queue.append(before)
    return seen


def check_random(spark, seed):
    pairs = random_graph(seed)
    hub = [(100 + i, 0) for i in range(40)]  # a node that most edges lead to
    pairs += hub
    edges = spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(pairs)], "src int, dst int, ord int")
    listed = [3, 0, 7]
    targets = spark.createDataFrame([(n, i) for i, n in enumerate(listed)], "node int, ord int")
    truth = {t: hops_to(pairs, t) for t in listed}
    hops = {(r.source, r.target): r.hops for r in graph.hop_counts(edges, targets).collect()}
    assert hops == {(s, t): h for t, seen in truth.items() for s, h in seen.items()}
    nodes = spark.createDataFrame([(n,) for n in sorted({n for pair in pairs for n in pair})], "node int")
    for node, (target, count) in nearest(spark, edges, targets, nodes, "-1").items():
        best = min(((truth[t][node], i) for i, t in enumerate(listed) if node in truth[t]), default=None)
        expected = ("-1", None) if best is None else (str(listed[best[1]]), best[0])
        assert (str(target), count) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_hops_and_nearest_match_a_plain_search(spark, seed):
    check_random(spark, seed)


def test_the_way_for_large_frontiers_is_the_same(spark, force_large):
    check_random(spark, 3)


def test_hop_limit(spark):
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(25)], "src int, dst int, ord int")
    targets = spark.createDataFrame([(25, 0)], "node int, ord int")
    assert graph.hop_counts(edges, targets, max_hops=3).count() == 4
    assert graph.hop_counts(edges, targets).count() == 26


def test_spillover_and_lists(spark):
    edges = readers.road_edges(spark)
    records = spark.createDataFrame(
        [("1", "King_Road_x_Palestine", 75.0), ("2", "King_Road_x_Palestine", 74.9), ("3", "nowhere", 90.0)],
        "event_id string, intersection_id string, risk_score double",
    )
    alerts = [(r.event_id, r.alert) for r in graph.spillover(records, edges).orderBy("edge_ord").collect()]
    assert alerts == [
        ("1", "[VA→Haram_Road_x_Madinah] High-risk spillover warning from King_Road_x_Palestine (risk=75.0)"),
        ("1", "[VA→King_Fahd_Hospital] High-risk spillover warning from King_Road_x_Palestine (risk=75.0)"),
    ]
    listed = {r.event_id: r.neighbors for r in graph.with_neighbors(records, edges).collect()}
    assert listed["3"] == []


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"nodes": [{"id": "A", "label": "a", "type": "road", "lanes": 2}, {"id": "B", "label": "b", "type": "hospital"}],'
        ' "edges": [{"from": "A", "to": "B", "relation": "NEAR"}]}'
    )
    nodes, edges = readers.read_graph_asset(spark, str(tmp_path / "g.json"))
    assert {r.id: r.lanes for r in nodes.collect()} == {"A": 2, "B": None}
    assert tuple(edges.select("src", "dst", "type", "ord").first()) == ("A", "B", "NEAR", 0)


def test_a_hub_is_listed_in_parts(spark):
    edges = spark.range(25_000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.col("id").alias("ord"))
    edges = edges.unionByName(spark.createDataFrame([("a", "hub", 25_000), ("a", "b", 25_001)], "src string, dst string, ord long"))
    records = spark.createDataFrame([("1", "hub"), ("2", "a"), ("3", "x")], "event_id string, intersection_id string")
    rows = graph.with_neighbors(records, edges).orderBy("event_id", "part").collect()
    at_hub = [r for r in rows if r.event_id == "1"]
    assert [r.part for r in at_hub] == [0, 1, 2]
    assert [n for r in at_hub for n in r.neighbors] == [f"n{i}" for i in range(25_000)]
    assert [(r.event_id, r.part, r.neighbors) for r in rows if r.event_id != "1"] == [("2", 0, ["hub", "b"]), ("3", 0, [])]
