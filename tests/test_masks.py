"""Hand-made masks, codes and scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import evaluation, geometry, regions, repairs, run_strings, sampling
from tilewright.streaming import prompts


def to_text(counts):
    """The text of a code, digit by digit."""
    out = ""
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            digit, x = x & 31, x >> 5
            more = x != (-1 if digit & 16 else 0)
            out += chr(48 + digit + 32 * more)
            if not more:
                break
    return out


def test_codes_as_text(spark):
    rng = random.Random(3)
    codes = [[0, 5, 3], [16384], [], [1] * 9] + [[rng.choice([0, 1, 15, 16, 31, 32, 511, 512, 40_000, 1 << 27]) for _ in range(rng.randint(1, 30))] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, counts array<long>")
    text = rows.select("id", run_strings.to_text().alias("code")).cache()
    assert {r.id: r.code for r in text.collect()} == {k: to_text(c) for k, c in enumerate(codes)}
    assert {r.id: r.counts for r in run_strings.from_text(text, ["id"]).collect()} == dict(enumerate(codes))


def test_labels_of_a_tile():
    rng = np.random.default_rng(5)
    for around in (regions.EIGHT, regions.FOUR):
        for density in (0.3, 0.6, 1.0):
            y, x = np.nonzero(rng.random((25, 31)) < density)
            there = {(a, b): k for k, (a, b) in enumerate(zip(y.tolist(), x.tolist()))}
            want, seen = {}, set()
            for cell in there:
                if cell not in seen:
                    todo, group = [cell], []
                    seen.add(cell)
                    while todo:
                        a, b = todo.pop()
                        group.append((a, b))
                        for dy, dx in around:
                            if (n := (a + dy, b + dx)) in there and n not in seen:
                                seen.add(n)
                                todo.append(n)
                    least = min(a * regions.SHIFT + b for a, b in group)
                    want |= dict.fromkeys(group, least)
            shuffled = rng.permutation(len(y))
            got = regions.label_tile(y[shuffled] + 7, x[shuffled] + 3, around)
            assert got.tolist() == [want[y[k], x[k]] + 7 * regions.SHIFT + 3 for k in shuffled]


def test_objects_of_the_prediction_alone_do_not_count(spark):
    square = lambda v, f, o, y: [(v, f, o, y + a, b) for a in range(3) for b in range(3)]
    columns = "video long, frame int, object int, y int, x int"
    truth = spark.createDataFrame(square(1, 0, 1, 0) + square(1, 2, 2, 0), columns)
    found = spark.createDataFrame(square(1, 0, 1, 0) + square(1, 1, 2, 0) + square(1, 2, 2, 0) + square(1, 0, 3, 4), columns)
    frames = spark.createDataFrame([(1, k) for k in range(3)], "video long, frame int")
    got = {r.object: (r.j, r.f) for r in evaluation.object_scores(truth, found, frames, 10, 10).collect()}
    assert got == {1: (100, 100), 2: (50, 50)}  # object 1 is rightly absent twice; object 2 begins in frame 1, where only the prediction has it
    report = evaluation.report(evaluation.object_scores(truth, found, frames, 10, 10))
    lines = [r.line for r in evaluation.report_lines(report).orderBy("at").collect()]
    assert lines == ["sequence    ,obj,  J&F,    J,    F", "Global score,   , 75.0, 75.0, 75.0", "1           ,001, 100.0, 100.0, 100.0", "1           ,002, 50.0, 50.0, 50.0"]


def test_a_missing_prediction_is_an_error(spark):
    size = "video long, frame int, height int, width int"
    truth, found = spark.createDataFrame([(1, 0, 5, 5), (1, 1, 5, 5)], size), spark.createDataFrame([(1, 0, 5, 5), (1, 7, 5, 5)], size)
    assert evaluation.matched_frames(truth.where("frame = 0"), found).count() == 1
    for other in (found, found.withColumn("frame", F.lit(1)).withColumn("width", F.lit(6))):
        with pytest.raises(Exception):
            evaluation.matched_frames(truth, other).collect()


def test_a_hole_is_filled_and_the_outside_is_not(spark):
    ring = [(1, y, x) for y in range(2, 6) for x in range(2, 6) if (y, x) not in ((3, 3), (4, 4))]
    found = repairs.holes(spark.createDataFrame(ring, "image_id long, y int, x int"), 8, 8, 5, 4)
    assert {(r.y, r.x, r.area) for r in found.collect()} == {(3, 3, 2), (4, 4, 2)}  # they touch by a corner


def test_centre_of_errors(spark):
    missed = [(1, y, x, True) for y in range(5) for x in range(5)]
    false = [(1, y, x, False) for y in range(6, 9) for x in range(3)] + [(2, 9, 9, False)]
    keys = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    got = repairs.error_centres(spark.createDataFrame(missed + false, "image_id long, y int, x int, missed boolean"), keys, 10, 10)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 2, True), (2, 9, 9, False), (3, 0, 0, False)}


def test_few_points_are_one_cluster(spark):
    points = spark.createDataFrame([(4, 0, 0), (9, 1000, 0)], "id long, x long, y long")
    assert {tuple(r) for r in geometry.density_clusters(points, 5, 3).collect()} == {(4, 4), (9, 4)}


def test_numbers_and_shards(spark):
    rows = spark.range(103).withColumn("k", (F.col("id") * 37) % 103)
    assert {r.k: r.number for r in sampling.numbered(rows, ["k"]).collect()} == {k: k for k in range(103)}
    sizes = sampling.shards(rows, ["k"], 10).groupBy("shard").count().collect()
    assert sorted((r.shard, r["count"]) for r in sizes) == [(k, 11 if k < 3 else 10) for k in range(10)]
    epochs = [{r.id for r in sampling.epoch_phase(rows, "id", e, 4).collect()} for e in range(4)]
    assert set.union(*epochs) == set(range(103)) and sum(map(len, epochs)) == 103


def test_tracking_needs_a_prompt(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "session long, obj long, frame long, value long")
    out = prompts.consolidated(rows((1, 1, 0, 5)), rows((1, 1, 0, 6), (1, 1, 1, 7)))
    assert {tuple(r) for r in out.select("session", "frame", "value", "is_prompted").collect()} == {(1, 0, 5, True), (1, 1, 7, False)}
    with pytest.raises(Exception):
        prompts.consolidated(rows((1, 1, 0, 5)), rows((2, 1, 1, 7))).collect()
