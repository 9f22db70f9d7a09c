"""Distances, inverse maps and prompt plans against plain computations."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import depths, lookups, resampling, sampling


def brute_depth(inside):
    h, w = inside.shape
    outside = [(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and inside[y, x])]
    return {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in outside) for y, x in np.argwhere(inside).tolist()}


@pytest.mark.parametrize("strip", [40, 1 << 21])
def test_depths(spark, monkeypatch, strip):
    monkeypatch.setattr(depths, "STRIP", strip)
    rng = np.random.default_rng(5)
    masks = {1: rng.random((17, 23)) < 0.8, 2: np.ones((17, 23), bool), 3: rng.random((17, 23)) < 0.1, 4: rng.random((17, 23)) < 0.97}
    masks[4][:, 11] = True
    rows = [(k, y, x) for k, m in masks.items() for y, x in np.argwhere(m).tolist()]
    pix = spark.createDataFrame(rows, "image_id long, y int, x int")
    want = {(k, y, x): d for k, m in masks.items() for (y, x), d in brute_depth(m).items()}
    assert {(r.image_id, r.y, r.x): r.depth for r in depths.depths(pix, ["image_id"], 17, 23).collect()} == want
    best = {k: min((-d, y, x) for (i, y, x), d in want.items() if i == k) for k in masks}
    assert {r.image_id: (-r.depth, r.y, r.x) for r in depths.deepest(pix, ["image_id"], 17, 23).collect()} == best


def test_a_large_disc_takes_seconds():
    y, x = np.ogrid[:4096, :4096]
    inside = (y - 2000) ** 2 + (x - 2100) ** 2 <= 1900**2
    began = time.process_time()
    out = depths.along_rows(depths.along_columns(inside))
    assert time.process_time() - began < 60
    assert np.unravel_index(out.argmax(), out.shape) == (2000, 2100) and abs(math.sqrt(out.max()) - 1900) < 1.5


def brute_sample(image, sx, sy, clamp):
    h, w = image.shape
    x0, y0 = math.floor(sx), math.floor(sy)
    total = 0.0
    for py, wy in ((y0, 1 - (sy - y0)), (y0 + 1, sy - y0)):
        for px, wx in ((x0, 1 - (sx - x0)), (x0 + 1, sx - x0)):
            if clamp:
                total += wy * wx * image[min(max(py, 0), h - 1), min(max(px, 0), w - 1)]
            elif 0 <= py < h and 0 <= px < w:
                total += wy * wx * image[py, px]
    return total


def as_rows(spark, image):
    return spark.createDataFrame([(1, y, x, float(image[y, x])) for y, x in np.argwhere(image > -1).tolist()], "image_id long, y int, x int, v double")


def test_affine_and_resize(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 12)).astype(float)
    inverse = resampling.inverse_affine(20.0, (1.5, -0.5), 0.8, (5.0, 3.0), 9, 12)
    a, b, c, d, e, f = inverse
    got = {(r.y, r.x): r.v for r in resampling.affine(as_rows(spark, image), ["v"], 9, 12, inverse).collect()}
    for y in range(9):
        for x in range(12):
            assert got.get((y, x), 0.0) == pytest.approx(brute_sample(image, a * x + b * y + c, d * x + e * y + f, False), abs=1e-5)
    for size in ((5, 7), (18, 24)):
        got = {(r.y, r.x): r.v for r in resampling.resized(as_rows(spark, image), ["v"], (9, 12), size).collect()}
        want = {(y, x): brute_sample(image, (x + 0.5) * 12 / size[1] - 0.5, (y + 0.5) * 9 / size[0] - 0.5, True) for y in range(size[0]) for x in range(size[1])}
        assert got == pytest.approx(want, abs=1e-5)


def test_maps_of_simple_turns(spark):
    image = np.arange(12.0).reshape(3, 4) + 1
    rows = as_rows(spark, image)
    back = lambda inverse, how="nearest": {(r.y, r.x): r.v for r in resampling.affine(rows, ["v"], 3, 4, inverse, how).collect()}
    same = {(y, x): image[y, x] for y in range(3) for x in range(4)}
    assert back(resampling.inverse_affine(0, (0, 0), 1, (0, 0), 3, 4)) == same
    assert back(resampling.inverse_affine(180, (0, 0), 1, (0, 0), 3, 4)) == {(2 - y, 3 - x): v for (y, x), v in same.items()}
    assert back(resampling.inverse_affine(0, (1, 2), 1, (0, 0), 3, 4)) == {(y + 2, x + 1): v for (y, x), v in same.items() if y + 2 < 3 and x + 1 < 4}
    assert back(resampling.inverse_affine(0, (0, 0), 1, (0, 0), 3, 4), "linear") == same


def test_prompt_plans_keep_their_bounds_and_shares(spark):
    videos = spark.range(4000).select(F.col("id").alias("video"), (F.col("id") % 2).cast("int").alias("start"), F.lit(12).alias("n_frames"))
    rows = sampling.prompt_plans(videos, 0.7, 0.5, 3, 7, True, True, seed=1).groupBy("video").agg(
        F.count_if("is_init").alias("n_init"), F.count_if("corrects").alias("n_correct"), F.min(F.when(F.col("is_init"), F.col("frame"))).alias("first"), F.bool_or(F.col("prompt") == "mask").alias("by_mask"),
        F.bool_and(~F.col("is_init") | F.col("corrects")).alias("init_corrected"), F.count_if(F.col("prompt") == "box").alias("boxes"), F.countDistinct("frame").alias("frames"), F.count("*").alias("rows"), F.min("frame").alias("least"),
    ).collect()
    assert len(rows) == 4000
    for r in rows:
        assert 1 <= r.n_init <= 3 and r.first == r.video % 2 == r.least and r.frames == r.rows
        assert (r.n_correct == 0) if r.by_mask else (r.n_init <= r.n_correct <= 7 and r.init_corrected)
    points = [r for r in rows if not r.by_mask]
    share = lambda n, of: n / of
    assert abs(share(len(points), 4000) - 0.7) < 0.03
    assert abs(share(sum(r.boxes for r in points), sum(r.n_init for r in points)) - 0.5) < 0.03
    assert all(abs(share(sum(r.n_init == k for r in rows), 4000) - 1 / 3) < 0.03 for k in (1, 2, 3))
    assert {r.n_correct for r in points if r.n_init == 3} == {3, 4, 5, 6, 7}


def test_prompt_plans_of_images_and_short_videos(spark):
    videos = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 1, 2)], "video long, start int, n_frames int")
    out = {}
    for r in sampling.prompt_plans(videos, 0.0, 1.0, 3, 7, False, False).collect():
        out.setdefault(r.video, []).append((r.frame, r.is_init, r.prompt, r.corrects))
    assert out == {1: [(0, True, "box", True)], 2: [(0, True, "mask", False), (1, True, "mask", False)], 3: [(1, True, "mask", False)]}


def test_losses_of_an_absent_object_are_zero(spark):
    values = spark.createDataFrame([(1, 0, 0.9, 0), (1, 0, 0.2, 0), (2, 0, 0.9, 1), (2, 0, 0.2, 0), (2, 1, 0.9, 1), (2, 1, 0.2, 0)], "object int, candidate int, p double, t int")
    ious = spark.createDataFrame([(1, 0, 0.3), (2, 0, 0.25), (2, 1, 1.0)], "object int, candidate int, iou double")
    got = {r.object: r for r in lookups.candidate_losses(values, ious, ["object"], {"mask": 2.0, "dice": 3.0, "iou": 1.0}).collect()}
    assert got[1].loss == 0 and (got[2].candidate, got[2].loss_iou) == (0, 0.5625)  # the first on ties
    assert got[2].loss == pytest.approx(2 * got[2].loss_mask + 3 * got[2].loss_dice + got[2].loss_iou, abs=1e-5)


def test_jitter(spark):
    rng = np.random.default_rng(8)
    images = {k: rng.integers(0, 256, (5, 7, 3)) for k in (1, 2)}
    images[3] = np.full((1, 1, 3), 255)
    rows = [(k, y, x, *map(int, im[y, x])) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    pix = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    limits = {"brightness": 0.4, "contrast": 1.5, "saturation": 0.6}
    drawn = spark.createDataFrame([(k,) for k in images], "image_id long").select("image_id", *(sampling.uniform(F.lit(w), F.col("image_id"), seed=9).alias(w) for w in limits)).collect()
    luma = np.array([0.299, 0.587, 0.114])
    want = {}
    for d in drawn:
        light, contrast, saturation = (max(0, 1 - v) + d[w] * (1 + v - max(0, 1 - v)) for w, v in limits.items())
        im = np.clip(images[d.image_id] * light, 0, 255)
        mean = (im @ luma).mean()
        im = np.clip(mean + (im - mean) * contrast, 0, 255)
        gray = (im @ luma)[..., None]
        im = np.clip(gray + (im - gray) * saturation, 0, 255)
        want |= {(d.image_id, y, x): im[y, x] for y in range(im.shape[0]) for x in range(im.shape[1])}
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in resampling.jittered(pix, limits, ["image_id"], seed=9).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    # without limits nothing changes, and an empty table stays empty
    assert sorted(map(tuple, resampling.jittered(pix, {}, ["image_id"]).collect())) == sorted(map(tuple, pix.collect()))
    assert resampling.jittered(pix.limit(0), limits, ["image_id"]).count() == 0


@pytest.mark.parametrize("how", ["nearest", "linear"])
def test_the_map_is_made_once_for_all_images(spark, how):
    rows = spark.createDataFrame([(i, y, x, i + y * x) for i in range(3) for y in range(3) for x in range(4)], "image_id long, y int, x int, v int")
    out = resampling.affine(rows, ["v"], 3, 4, resampling.inverse_affine(10, (1, 0), 1, (0, 0), 3, 4), how)
    # a grid for each image would be taken for small, whatever it unfolds to, and be broadcast
    steps = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line]
    assert steps and not any("image_id" in line for line in steps)
