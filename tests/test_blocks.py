"""Neighbourhoods over blocks against plain Python, with blocks far smaller than the images."""

import random

import pytest

from tilewright.operators import blocks, masks, repairs

H, W = 23, 19
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


@pytest.fixture(params=[3, 7, 512])
def side(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)


def drawn(seed, share):
    rng = random.Random(seed)
    return {(y, x) for y in range(H) for x in range(W) if rng.random() < share}


def rows(spark, pixels, image=4):
    return spark.createDataFrame([(image, y, x) for y, x in pixels], "image_id long, y int, x int")


def edge(mask):
    out = set()
    for y in range(H):
        for x in range(W):
            at = lambda dy, dx: (y + dy, x + dx) in mask
            near = [] if (y, x) == (H - 1, W - 1) else [(0, 1)] if y == H - 1 else [(1, 0)] if x == W - 1 else [(0, 1), (1, 0), (1, 1)]
            if any(at(*n) != at(0, 0) for n in near):
                out.add((y, x))
    return out


def test_boundaries(spark, side):
    t, f = drawn(1, 0.3), drawn(2, 0.3)
    found = masks.boundary(rows(spark, t), ["image_id"], H, W)
    assert "Generate explode(array" not in found._jdf.queryExecution().optimizedPlan().toString()  # a pixel is not sent once for each neighbour
    assert sorted((r.y, r.x) for r in found.collect()) == sorted(edge(t))
    row = masks.boundary_score(rows(spark, t), rows(spark, f), rows(spark, t).select("image_id").distinct(), ["image_id"], H, W, 2).collect()
    et, ef = edge(t), edge(f)
    close = lambda a, others: any((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 4 for b in others)
    assert [(r.precision, r.recall) for r in row] == [(round(sum(close(a, et) for a in ef) / len(ef), 6), round(sum(close(a, ef) for a in et) / len(et), 6))]


def test_borders_and_their_widening(spark, side):
    cells = {p: (p[0] // 6) * 6 * repairs.SHIFT + p[1] // 6 * 6 for p in drawn(3, 0.2)}
    kinds = {c: "even" if c % 4 else "odd" for c in cells.values() if c % 5}
    labelled = spark.createDataFrame([(4, y, x, c) for (y, x), c in cells.items()], "image_id long, y int, x int, component long")
    classes = spark.createDataFrame([(4, c, k) for c, k in kinds.items()], "image_id long, component long, class string")
    free = [(y, x) for y in range(H) for x in range(W) if (y, x) not in cells]
    first = {}
    for y, x in free:
        near = [cells[p] for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if p in cells and cells[p] in kinds and p[0] * repairs.SHIFT + p[1] != cells[p]]
        if near:
            first[y, x] = kinds[min(near)]
    out = repairs.borders(labelled, classes, H, W)
    assert "Generate explode(array" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.y, r.x): r["class"] for r in out.collect()} == first
    second = dict(first)
    for y, x in free:
        near = [(y + dy, x + dx) for dy, dx in EIGHT if (y + dy, x + dx) in first]
        if (y, x) not in first and near:
            second[y, x] = first[min(near)]
    got = repairs.dilated(spark.createDataFrame([(4, *p, c) for p, c in first.items()], "image_id long, y int, x int, class string"), labelled, H, W).collect()
    assert len(got) == len(second) and {(r.y, r.x): r["class"] for r in got} == second


def test_widened_errors(spark, side):
    t, f = drawn(5, 0.02), drawn(6, 0.02)
    wide = spark.createDataFrame([(4, y, x, (y, x) in t, (y, x) in f) for y, x in t | f], "image_id long, y int, x int, t boolean, f boolean")
    grown = lambda m: {(y + dy, x + dx) for y, x in m for dy in range(-2, 3) for dx in range(-2, 3) if 0 <= y + dy < H and 0 <= x + dx < W}
    got = repairs.widened_errors(wide, 2, H, W).collect()
    assert sorted((r.y, r.x, r.missed) for r in got) == sorted((y, x, (y, x) in grown(t)) for y, x in grown(t) ^ grown(f))
