"""Clean-up of generated masks against a plain walk, and the small rules around it."""

import math
import random

from pyspark.sql import functions as F

from tilewright.operators import generator, masks
from tilewright.sources import sinks

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def parts_of(cells):
    left, out = set(cells), []
    for first in sorted(cells):
        if first not in left:
            continue
        part, open_ = set(), [first]
        while open_:
            p = open_.pop()
            if p in left:
                left.discard(p)
                part.add(p)
                open_ += [(p[0] + dy, p[1] + dx) for dy, dx in AROUND]
        out.append(part)
    return out


def brute(mask, size, least):
    holes = [h for h in parts_of({(y, x) for y in range(size) for x in range(size)} - mask) if len(h) < least]
    filled = mask.union(*holes)
    parts = parts_of(filled)
    big = [p for p in parts if len(p) >= least] or [max(parts, key=len)]
    return set().union(*big), not holes and all(len(p) >= least for p in parts)


def box_overlap(a, b):
    box = lambda m: (min(x for _, x in m), min(y for y, _ in m), max(x for _, x in m), max(y for y, _ in m))
    (ax, ay, bx, by), (cx, cy, dx, dy) = box(a), box(b)
    both = max(min(bx, dx) - max(ax, cx), 0) * max(min(by, dy) - max(ay, cy), 0)
    whole = (bx - ax) * (by - ay) + (dx - cx) * (dy - cy) - both
    return both / whole if whole else 0.0


def test_cleaned_masks(spark):
    rng, size, least, most = random.Random(7), 12, 4, 0.5
    found = {}
    for mask in range(24):
        y, x, h, w = rng.randrange(6), rng.randrange(6), rng.randint(3, 6), rng.randint(3, 6)
        found[mask] = {(y + a, x + b) for a in range(h) for b in range(w) if rng.random() < (1.0 if mask % 3 == 0 else 0.8)} or {(y, x)}
    found[24] = {(0, 0), (5, 5), (5, 6)}  # all parts are small
    found[25] = {(1, 1), (9, 9)}  # the first of equals
    want = {}
    for grp in (0, 1):
        done = {m: brute(c, size, least) for m, c in found.items() if m % 2 == grp}
        kept = []
        for m in sorted(done, key=lambda m: (not done[m][1], m)):
            if all(box_overlap(done[m][0], done[k][0]) <= most for k in kept):
                kept.append(m)
        want |= {m: done[m] for m in kept}
    rows = [(m % 2, m, y, x) for m, cells in found.items() for y, x in cells]
    got = {}
    for r in generator.cleaned(spark.createDataFrame(rows, "grp long, mask long, y int, x int"), size, size, least, most, 5).collect():
        got.setdefault(r.mask, (set(), r.unchanged))[0].add((r.y, r.x))
    assert got == want and 2 < len(got) < len(found)


def test_a_bound_of_zero_asks_for_nothing(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.9), (3, float("nan"), 0.95)], "id int, predicted_iou double, stability double")
    ids = lambda *bounds: {r.id for r in generator.good_masks(rows, *bounds).collect()}
    assert ids(0.0, 0.0) == {1, 2, 3} and ids(0.5, 0.0) == {2, 3} and ids(0.0, 0.9) == {2, 3} and ids(0.5, 0.5) == {2, 3}


def test_plain_stability_without_pixels(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, -9.0), (2, -9.0)], "m int, v double")
    got = {r.m: r.stability for r in masks.stability(rows, ["m"], 0, 1, plain=True).collect()}
    assert got[1] == 1.0 and math.isnan(got[2])
    assert {r.m: r.stability for r in masks.stability(rows, ["m"], 0, 1).collect()} == {1: 1.0, 2: 1.0}


def test_coordinates_there_and_back(spark):
    row = spark.createDataFrame([(30.0, 40.0)], "x double, y double")
    tx, ty = generator.model_coordinates(F.col("x"), F.col("y"), 1024, (F.lit(200), F.lit(100)))
    bx, by = generator.image_coordinates(tx, ty, 1024, (F.lit(200), F.lit(100)))
    assert tuple(row.select(tx, ty, bx, by).first()) == (307.2, 204.8, 30.0, 40.0)
    assert tuple(row.select(*generator.model_coordinates(F.col("x") / 100, F.col("y") / 200, 1024)).first()) == (307.2, 204.8)


def test_prompts_that_are_cleared(spark):
    rows = [(1, 1, 0, True, "a"), (1, 1, 0, False, "b"), (1, 1, 2, True, "c"), (1, 2, 0, True, "d"), (1, 1, 5, False, "e")]
    outputs = spark.createDataFrame(rows, "session long, obj long, frame long, is_prompted boolean, code string")
    cleared = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 1, 5), (2, 1, 2)], "session long, obj long, frame long")
    got = {(r.obj, r.frame, r.is_prompted, r.code) for r in generator.unprompted(outputs, cleared).collect()}
    assert got == {(1, 0, False, "a"), (1, 2, True, "c"), (2, 0, True, "d"), (1, 5, False, "e")}


def test_parts_are_repeated_by_their_factors(spark):
    rows = spark.range(1000)
    out = generator.concatenated([(rows, 2.0), (rows, 0.3), (rows, 0.0)], "id").groupBy("part").count().collect()
    n = {r["part"]: r["count"] for r in out}
    assert n[0] == 2000 and 2 not in n and abs(n[1] - 300) < 60


def test_merged_regions_as_exported(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 30, 0.123456, "4;7")], "image_id long, region_id long, pixel_count long, avg_score double, member_instances string")
    sinks.write_merged_regions(rows, str(tmp_path / "m"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "m")).first()
    assert (back.region_id, back.pixel_count, back.avg_score, back.member_instances) == ("2", "30", "0.1235", "4;7")
