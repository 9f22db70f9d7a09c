"""Steps whose rows stay together: they are not unfolded, sorted and folded again."""

import random

from pyspark.sql import functions as F

from tilewright.operators import geometry, pixels, run_strings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_close_points_meet_once_with_few_copies(spark):
    rng = random.Random(6)
    points = [(k, rng.randint(-70, 70), rng.randint(-70, 70)) for k in range(400)] + [(400, -20, 0), (401, 0, 0), (402, 20, 0), (403, 0, 20), (404, 0, 0)]
    df = spark.createDataFrame(points, "id long, x long, y long")
    for inclusive in (False, True):
        want = {(a[0], b[0], d) for a in points for b in points if a[0] < b[0] and ((d := (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) < 400 or inclusive and d == 400)}
        found = geometry.within_distance(df, 20, inclusive)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # a point meets those of its cell and of up to three after it: rows of the join's larger side
    near, sent = spark.range(10_000).select("id", (F.col("id") * 7 % 5000).alias("x"), (F.col("id") * 13 % 7001).alias("y")), []
    with_hint = geometry.shuffled
    try:
        geometry.shuffled = lambda side: (sent.append(side.count()), with_hint(side))[1]
        geometry.within_distance(near, 20)
    finally:
        geometry.shuffled = with_hint
    assert sent[0] < 3 * 10_000  # it was nine times


def test_density_clusters_of_cores_borders_and_noise(spark):
    rng = random.Random(8)
    points = [(k, rng.randint(0, 60), rng.randint(0, 60)) for k in range(120)]
    close = {a[0]: [b[0] for b in points if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 25] for a in points}
    for least in (1, 2, 4):
        cores, root = {k for k in close if len(close[k]) + 1 >= least}, {}
        for k in sorted(cores):
            open_ = [k]
            while open_:
                if (p := open_.pop()) not in root:
                    root[p] = k
                    open_ += [q for q in close[p] if q in cores]
        want = dict(root)
        want |= {k: min(root[q] for q in close[k] if q in cores) for k in close if k not in cores and cores & set(close[k])}
        got = geometry.density_clusters(spark.createDataFrame(points, "id long, x long, y long"), 5, least).collect()
        assert len(got) == len(want) and {r.id: r.cluster for r in got} == want


def test_weights_need_no_window(spark):
    planes = spark.createDataFrame([(1, 1, 10), (1, 3, 20), (2, 2, 4), (2, 3, None), (2, 5, 8), (2, 7, 100), (3, 1, None)], "k int, plane int, v int")
    out = pixels.weighted_planes(planes, [0.5, 0.25, 2.0], ["k"])
    assert {r.k: r.v for r in out.collect()} == {1: 10.0, 2: 18.0, 3: None}
    assert "Window" not in plan(out)


def test_texts_are_read_within_their_rows(spark):
    codes = [[0, 5, 3, 9, 1, 2**30, 4, 7], [16384], [], [1, 1, 1, 1, 1, 2000, 1, 1, 60]]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, counts array<long>")
    back = run_strings.from_text(df.select("id", run_strings.to_text().alias("code")), ["id"])
    assert {r.id: r.counts for r in back.collect()} == dict(enumerate(codes))
    assert "Window" not in plan(back) and "Exchange" not in plan(back)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "P")], "id int, code string")
    assert {r.id: r.counts for r in run_strings.from_text(odd, ["id"]).collect()} == {1: [], 2: [], 3: [0]}
