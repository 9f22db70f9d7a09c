"""Many small groups, and groups larger than a batch, in one call."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks, contours, regions


def test_many_images_are_labelled_in_few_calls(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(y), int(x)) for i in range(300) for y, x in zip(*np.nonzero(rng.random((9, 9)) < 0.5))]
    whole, folder = regions.label_tiles, str(tmp_path)

    def counted(*args):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return whole(*args)

    monkeypatch.setattr(regions, "label_tiles", counted)
    pix = spark.createDataFrame(rows, "image_id long, y int, x int")
    got = {(r.image_id, r.y, r.x): (r.region, r.near) for r in regions.tile_regions(pix, 4, near=True).collect()}
    assert 0 < len(list(tmp_path.iterdir())) <= 8  # not one for each image
    for i in range(0, 300, 37):
        for row in range(3):
            for col in range(3):
                mine = [(y, x) for k, y, x in rows if k == i and y // 4 == row and x // 4 == col]
                for y, x in mine:
                    part, open_ = set(), [(y, x)]
                    while open_:
                        p = open_.pop()
                        if p not in part:
                            part.add(p)
                            open_ += [q for q in mine if max(abs(q[0] - p[0]), abs(q[1] - p[1])) == 1]
                    near = sum(max(abs(q[0] - y), abs(q[1] - x)) == 1 for q in mine)
                    first = min(part)
                    assert got[i, y, x] == (first[0] * regions.SHIFT + first[1], near)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_groups_come_whole(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "ROWS", rows)

    def sums(part: pa.Table, group: np.ndarray) -> pa.Table:
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        n = np.diff(np.append(begin, len(group)))
        return pa.table({"a": part["a"].take(pa.array(begin)), "b": part["b"].take(pa.array(begin)), "n": pa.array(n)})

    table = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("a"), F.concat(F.lit("k"), F.floor(F.sqrt("id")).cast("string")).alias("b"))
    want = {(r.a, r.b): r["count"] for r in table.groupBy("a", "b").count().collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = blocks.on_groups(table, ["a", "b"], sums, "a long, b string, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == want


def test_borders_of_many_tiles_are_walked_in_few_calls(spark, tmp_path, monkeypatch):
    rows = [(i, y, x, 1 + (x > 8)) for i in range(200) for y in range(3) for x in (*range(2 + i % 3), *range(10, 13)) if (y, x) != (1, 11)]
    whole, folder = contours.tile_chains, str(tmp_path)

    def counted(*args):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return whole(*args)

    monkeypatch.setattr(contours, "tile_chains", counted)
    got = contours.contours(spark.createDataFrame(rows, "image_id long, y int, x int, inst long"), 6, 0.01).collect()
    assert 0 < len(list(tmp_path.iterdir())) <= 8  # not one for each tile
    want = {(i, 1): {(0, 0), (0, 2), (1 + i % 3, 0), (1 + i % 3, 2)} for i in range(200)} | {(i, 2): {(10, 0), (10, 2), (12, 0), (12, 2)} for i in range(200)}
    assert len(got) == len(want) and {(r.image_id, r.inst): {(p.x, p.y) for p in r.points} for r in got} == want


def test_rings_are_simplified_together_as_one_by_one():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 40, 2, 9, 200]
    y, x = (rng.integers(0, 30, sum(sizes)) for _ in range(2))
    begin, epsilon = np.cumsum([0, *sizes[:-1]]), np.array([1.0, 0.5, 3.0, 50.0, 2.0, 4.0])
    want = [b + k for b, n, e in zip(begin, sizes, epsilon) for k in contours.simplified(y[b : b + n], x[b : b + n], e)]
    assert contours.simplified_rings(y, x, begin, epsilon).tolist() == want
