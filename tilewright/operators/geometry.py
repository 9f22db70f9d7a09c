"""Joins on boxes and points: overlap, distance, density clusters, suppression.

Pairs meet through a grid: each side goes to the cells it reaches, an equi-join
on the cell brings candidates together, and the exact predicate decides.  A pair
is kept only in the first cell that both reach, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, cut, shuffled


def overlapping(boxes: DataFrame, cell: int, by: list[str]) -> DataFrame:
    """Pairs of boxes of a group that overlap or touch: a < b."""
    low = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.select(*by, "id", "x1", "y1", "x2", "y2", F.explode(F.sequence(low("x1"), low("x2"))).alias("cx")).select("*", F.explode(F.sequence(low("y1"), low("y2"))).alias("cy"))
    b = cells.select(*by, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")))
    met = cells.join(shuffled(b), [*by, "cx", "cy"]).where("id < b_id AND x1 <= b_x2 AND b_x1 <= x2 AND y1 <= b_y2 AND b_y1 <= y2")
    first = (F.col("cx") == F.floor(F.greatest("x1", "b_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("y1", "b_y1") / cell))
    return met.where(first).select(*by, F.col("id").alias("a"), F.col("b_id").alias("b"), *(F.col(c) for c in ("x1", "y1", "x2", "y2", "b_x1", "b_y1", "b_x2", "b_y2")))


def within_distance(points: DataFrame, distance: int, inclusive: bool = False) -> DataFrame:
    """Pairs of points closer than ``distance`` (or as close): a < b, and the squared distance.

    Cells are two distances wide.  A point looks for others in its own cell and in those after it that it reaches, so
    two points meet once, in the cell of the later one.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * distance))
    side = lambda c: F.when(F.pmod(F.col(c), F.lit(2 * distance)) < distance, -1).otherwise(1)
    here = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    # a disk reaches the cells on one side of each axis only (the middle of a cell counts to the side after it)
    steps = F.array(*(F.struct(dx.alias("dx"), dy.alias("dy")) for dx in (F.lit(0), side("x")) for dy in (F.lit(0), side("y"))))
    after = F.filter(steps, lambda s: (s["dx"] > 0) | ((s["dx"] == 0) & (s["dy"] >= 0)))
    near = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"), F.explode(after).alias("s"))
    near = near.select("id", "x", "y", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("same"))
    squared = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    close = squared <= distance * distance if inclusive else squared < distance * distance
    met = here.join(shuffled(near), ["cx", "cy"]).where(F.when(F.col("same"), F.col("id") < F.col("b")).otherwise(F.col("id") != F.col("b")) & close)
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), squared.alias("squared"))


def matching_boxes(one: DataFrame, two: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """Pairs (a, b) of boxes of two tables that overlap and none of whose edges differ by more than ``most``.

    The left edges bring them together, in bands as wide as they may differ.
    """
    band = lambda c: F.floor(F.col(c) / (most + 1))
    edges = ("x1", "y1", "x2", "y2")
    left = one.select(*by, F.col("id").alias("a"), *edges, F.explode(F.sequence(band("x1") - 1, band("x1") + 1)).alias("_band"))
    right = two.select(*by, F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in edges), band("x1").alias("_band"))
    near = left.join(shuffled(right), [*by, "_band"]).where("x1 <= b_x2 AND b_x1 <= x2 AND y1 <= b_y2 AND b_y1 <= y2")
    for c in edges:
        near = near.where(F.abs(F.col(c) - F.col(f"b_{c}")) <= most)
    return near.select(*by, "a", "b")


def grouped(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``items`` with the least id of the group that ``pairs`` connect them to."""
    roots = components(pairs).select(F.col("node").alias("of"), "root")
    return items.join(shuffled(roots), F.col("id") == F.col("of"), "left").withColumn("grp_id", F.coalesce("root", "id")).drop("of", "root")


def group_rollup(members: DataFrame) -> DataFrame:
    """Per group: members, sizes and the centroid."""
    return members.groupBy("grp_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda c: c.cast("string")), ";").alias("members"))


def group_distances(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per group: the distances of its close pairs as ``a-b:d``, or ``single_cell``."""
    labelled = pairs.join(members.select(F.col("id").alias("a"), "grp_id"), "a")
    text = F.concat_ws("", F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(":"), F.format_string("%.1f", F.round(F.sqrt("squared"), 1)))
    lists = labelled.groupBy("grp_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", text.alias("t")))), lambda p: p["t"]), ";").alias("distances"))
    return members.select("grp_id").distinct().join(lists, "grp_id", "left").select("grp_id", F.coalesce("distances", F.lit("single_cell")).alias("distances"))


def box_union(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def density_clusters(points: DataFrame, eps: int, least: int) -> DataFrame:
    """Density clusters: id and cluster; noise is dropped.

    A point with at least ``least`` points (itself included) within ``eps`` is a
    core point; cores within ``eps`` are one cluster, named after its least core.
    A border point goes to the least cluster it is near to.  Fewer points than
    ``least`` are one cluster, named after the least point.
    """
    if points.limit(least).count() < least:
        return points.select("id", F.expr("min(id) OVER ()").alias("cluster"))  # fewer than ``least`` rows
    pairs = cut(within_distance(points, eps, inclusive=True).select("a", "b"))  # met once, read for each use
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = both.groupBy("a").count()
    if least > 1:  # a core has neighbours, so points without any need not be looked up
        cores = cut(n.where(F.col("count") + 1 >= least).select(F.col("a").alias("core")))
    else:
        cores = points.select(F.col("id").alias("core"))
    of_cores = pairs.join(cores, F.col("a") == F.col("core"), "left_semi").join(cores, F.col("b") == F.col("core"), "left_semi")
    named = components(of_cores, cores.select(F.col("core").alias("node")))
    border = both.join(named, F.col("b") == F.col("node")).join(cores, F.col("a") == F.col("core"), "left_anti").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("cluster"))
    return named.select(F.col("node").alias("id"), F.col("root").alias("cluster")).unionByName(border)


def suppress(boxes: DataFrame, by: str, most: float, cell: int = 64) -> DataFrame:
    """Greedy suppression in each group: by score, a box goes if it overlaps a kept one by more than ``most``.

    Pairs over ``most`` come from the grid.  Each round keeps every open box that no
    better open box suppresses and drops its neighbours, until none is open; so the
    result is that of the greedy order, and rounds grow with the longest chain of
    ever worse neighbours, not with the boxes.
    """
    # rows of a group with the same id are boxes of their own
    named = cut(boxes.select(by, "id", "x1", "y1", "x2", "y2", "score").withColumn("box", F.monotonically_increasing_id()))
    group = F.struct(F.col(by).isNull().alias("none"), F.coalesce(F.col(by), F.lit(0)).alias("of")).alias("group")  # null is a group like others
    met = overlapping(named.select(group, F.col("box").alias("id"), "x1", "y1", "x2", "y2").where("x1 < x2 AND y1 < y2"), cell, ["group"])
    size = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")).cast("double") * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    common = (F.least("x2", "b_x2") - F.greatest("x1", "b_x1")).cast("double") * (F.least("y2", "b_y2") - F.greatest("y1", "b_y1"))
    over = met.where(common > most * (size("") + size("b_") - common)).select("a", "b")
    ranks = named.select("box", F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), F.col("id").isNull().alias("m"), "id", "box").alias("rank"))
    sides = over.join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b")
    worse = F.col("ra") < F.col("rb")
    edges = cut(sides.select(F.when(worse, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(worse, F.col("b")).otherwise(F.col("a")).alias("worse")))
    dropped = None
    while not edges.isEmpty():
        # edges join open boxes only; the best of each chain is kept, its neighbours go with all their edges
        top = edges.select("better").distinct().join(edges.select(F.col("worse").alias("better")).distinct(), "better", "left_anti")
        out = cut(edges.join(top, "better", "left_semi").select(F.col("worse").alias("box")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        edges = cut(edges.join(out, F.col("better") == F.col("box"), "left_anti").join(out, F.col("worse") == F.col("box"), "left_anti"))
    return (named if dropped is None else named.join(dropped, "box", "left_anti")).select(F.col(by).cast("long").alias(by), F.col("id").cast("long").alias("id"))
