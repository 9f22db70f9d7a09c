"""Operators on hand-made rows, against plain Python where SQL does not reach."""

import random
from collections import Counter

import numpy as np
import pytest

from tilewright.operators import cells, geometry, graph, masks, pixels, ranking, regions
from tilewright.plans import registry


def flood(points: set, around) -> dict:
    root = {}
    for start in sorted(points):
        if start not in root:
            todo = [start]
            while todo:
                p = todo.pop()
                if p in points and p not in root:
                    root[p] = start
                    todo += [(p[0] + dy, p[1] + dx) for dy, dx in around]
    return root


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_equal_a_flood_fill(spark, diagonal):
    rng = random.Random(2)
    points = {(rng.randrange(40), rng.randrange(40)) for _ in range(700)}
    pix = spark.createDataFrame([(1, y, x) for y, x in points], "image_id long, y int, x int")
    got = {(r.y, r.x): (r.component // regions.SHIFT, r.component % regions.SHIFT) for r in regions.whole_image_components(pix, 16, diagonal).collect()}
    assert got == flood(points, regions.EIGHT if diagonal else regions.FOUR)


def test_flooded_background(spark):
    ring = {(y, x) for y in range(2, 7) for x in range(2, 7) if y in (2, 6) or x in (2, 6)}
    pix = spark.createDataFrame([(1, y, x) for y, x in ring], "image_id long, y int, x int")
    out = {(r.y, r.x): r.outside for r in cells.flooded_background(pix, 10, 4).collect()}
    assert len(out) == 100 - len(ring)
    assert {p for p, outside in out.items() if not outside} == {(y, x) for y in range(3, 6) for x in range(3, 6)}


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(1)
    path = list(range(300))
    rng.shuffle(path)
    edges = [(path[k], path[k + 1]) for k in range(299)] + [(1000, 1000 + k) for k in range(1, 200)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(5000,)], "node long")).collect()}
    assert out == {**{k: 0 for k in range(300)}, **{1000 + k: 1000 for k in range(200)}, 5000: 5000}


def test_overlaps_and_distances_equal_nested_loops(spark):
    rng = random.Random(4)
    boxes = [(k, 1, (x := rng.randint(-50, 90)), (y := rng.randint(-50, 90)), x + rng.randint(0, 60), y + rng.randint(0, 20)) for k in range(80)]
    df = spark.createDataFrame(boxes, "id long, grp long, x1 long, y1 long, x2 long, y2 long")
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    got = [(r.a, r.b) for r in geometry.overlapping(df, 16, ["grp"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    points = [(b[0], b[2], b[3]) for b in boxes]
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 400}
    assert {(r.a, r.b) for r in geometry.within_distance(spark.createDataFrame(points, "id long, x long, y long"), 20).collect()} == want


def test_suppression_is_greedy(spark):
    rng = random.Random(9)
    boxes = [(k, 1, (x := rng.randint(0, 60)), (y := rng.randint(0, 60)), x + 20, y + 20, rng.randint(0, 9)) for k in range(60)]
    df = spark.createDataFrame(boxes, "id long, grp long, x1 long, y1 long, x2 long, y2 long, score long")
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[0])):
        def iou(c):
            w, h = min(b[4], c[4]) - max(b[2], c[2]), min(b[5], c[5]) - max(b[3], c[3])
            i = max(w, 0) * max(h, 0)
            return i / (800 - i)
        if all(iou(c) <= 0.3 for c in kept):
            kept.append(b)
    assert {r.id for r in geometry.suppress(df, "grp", 0.3).collect()} == {b[0] for b in kept}


def test_suppression_takes_no_group_whole(spark, monkeypatch):
    boxes = [(k, 1, 10 * k, 0, 10 * k + 20, 10, 100 - k) for k in range(12)]  # a chain: each overlaps the next by a third
    boxes += [(100, 1, 500, 0, 520, 10, 5), (100, 1, 500, 0, 520, 10, 5), (101, None, 0, 0, 9, 9, 1), (102, None, 0, 0, 9, 9, 2), (103, 1, 700, 0, 700, 10, 1), (104, 1, 700, 0, 700, 10, 2)]
    df = spark.createDataFrame(boxes, "id long, grp long, x1 long, y1 long, x2 long, y2 long, score long")
    kept = geometry.suppress(df, "grp", 0.3)
    plan = kept._jdf.queryExecution().toString()
    assert "InPandas" not in plan
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8, 10, 100, 102, 103, 104]


def test_run_lengths_round_trip(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((9, 7)) < 0.5
    grid[0, 0] = grid[-1, -1] = True
    pix = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(grid))], "image_id long, y int, x int")
    coded = masks.encode_runs(pix, 9, 7, ["image_id"])
    counts = coded.first().counts
    flat, at, bit = grid.T.ravel(), 0, False
    for n in counts:
        assert (flat[at : at + n] == bit).all()
        at, bit = at + n, not bit
    assert at == 63 and counts[0] == 0
    assert {(r.y, r.x) for r in masks.decode_runs(coded, 9, ["image_id"]).collect()} == set(zip(*(k.tolist() for k in np.nonzero(grid))))


def test_islands_follow_the_closing_frame(spark):
    values = [1, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "video long, frame int, value int")
    out = sorted((r.start, r.end, r.width) for r in ranking.islands(df, ["video"], df.value > 0).collect())
    assert out == [(0, 2, 2), (3, 4, 1)]  # the run that begins on the last frame is not reported


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "image_id long, y int, x int")
    assert regions.whole_image_components(none, 8).count() == 0
    assert masks.encode_runs(none, 4, 4, ["image_id"]).count() == 0
    assert pixels.histogram(spark.createDataFrame([], "image_id long, v int"), ["image_id"]).count() == 0


def test_samples_are_whole_windows_and_repeat_by_their_factor(spark):
    sf = "/root/testdata/sf0.001"
    sample = registry.QUERIES["R01_window_sample"](spark, sf).groupBy("video").count().collect()
    assert sample and max(r["count"] for r in sample) <= 8
    copies = Counter(r.video for r in registry.QUERIES["R03_repeat_factors"](spark, sf).collect())
    sizes = {r.user_id: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}
    assert set(copies) == set(sizes) and all(max(1, sizes[v] // 60) <= n <= sizes[v] // 60 + 1 for v, n in copies.items())
