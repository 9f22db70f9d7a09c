"""Components of hubs, paths and random graphs, with broadcast and with salted roots."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import graph, regions


def brute(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_random_graphs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "MAX_BROADCAST", broadcast)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 540)] + [(640, k) for k in range(600, 640)] + [(7, 7)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(999,), (7,)], "node long"))
    assert {r.node: r.root for r in found.collect()} == brute(edges, {n for e in edges for n in e} | {999})


@pytest.mark.parametrize("hot", [2, 100_000])
def test_many_moved_roots_are_never_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "MAX_BROADCAST", 0)
    monkeypatch.setattr(graph, "HOT", hot, raising=False)
    plans, with_cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), with_cut(df))[1])
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(500 + k % 2, k) for k in range(502, 560)] + [(k, k + 1) for k in range(700, 720)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == brute(edges, {n for e in edges for n in e})
    joins = sum("Join" in p for p in plans)
    assert joins > 3
    if hot > len(edges):  # by the sizes of their files, Spark would take them for small
        assert not any("BroadcastHashJoin" in p for p in plans)


def test_a_star_and_a_path(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(n // 2 + 0.5).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    path = spark.range(n).select((F.col("id") + 2 * n).cast("double").alias("a"), (F.col("id") + 2 * n + 1).cast("double").alias("b"))
    found = graph.components(star.unionByName(path)).groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in found} == {(1.0, n + 1), (2.0 * n, n + 1)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(none).collect() == []
    assert {tuple(r) for r in graph.components(none, spark.createDataFrame([(3,)], "node long")).collect()} == {(3, 3)}


@pytest.mark.parametrize(("tile", "block"), [(4, 8), (3, 512), (16, 4)])
def test_perimeters_count_neighbours_across_seams(spark, monkeypatch, tile, block):
    monkeypatch.setattr(regions, "BLOCK", block)
    rng = random.Random(tile)
    cells = {(y, x) for y in range(13) for x in range(17) if rng.random() < 0.75}
    pix = spark.createDataFrame([(1, y, x) for y, x in cells], "image_id long, y int, x int")
    labelled = regions.tile_regions(pix, tile, near=True)
    merged = regions.merged_regions(labelled, regions.seam_pairs(labelled, tile)).cache()
    group = {(r.y, r.x): r.global_region for r in merged.collect()}
    inner = {(y, x) for y, x in cells if all(group.get((y + dy, x + dx)) == group[y, x] for dy, dx in regions.EIGHT)}
    want = {}
    for c in cells - inner:
        want[group[c]] = want.get(group[c], 0) + 1
    assert {r.global_region: r.perimeter for r in regions.perimeters(merged, tile).collect()} == want
    tiles = {}
    for r in merged.collect():
        tiles.setdefault(r.global_region, (set(), set(), []))
        tiles[r.global_region][0].add((r.tile_row, r.tile_col))
        tiles[r.global_region][1].add(r.region)
        tiles[r.global_region][2].append(r.y)
    assert {r.global_region: (r.n_tiles, r.n_sources, r.area, round(r.cy, 9)) for r in regions.global_regions(merged, tile).collect()} == {g: (len(t), len(s), len(ys), round(sum(ys) / len(ys), 9)) for g, (t, s, ys) in tiles.items()}
