"""Masks: run-length codes, boxes, overlap measures and boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Area, moved, on_blocks


def encode_runs(pix: DataFrame, height: int, width: int, of: list[str]) -> DataFrame:
    """Column-major runs of each mask: ``counts``, beginning with the run of zeros.

    Only pixels that are set are read: gaps between their positions are the zero runs.
    """
    keys = ", ".join(of)
    at = pix.select(*of, (F.col("x") * height + F.col("y")).cast("long").alias("at"))
    # one pass in order: where a run begins, and where the run before it ended
    marks = at.select(*of, "at", F.expr(f"lag(at) OVER (PARTITION BY {keys} ORDER BY at)").alias("before"), F.expr(f"lead(at) OVER (PARTITION BY {keys} ORDER BY at)").isNull().alias("is_last"))
    begins = F.col("before").isNull() | (F.col("at") > F.col("before") + 1)
    begun = F.struct(F.col("at").alias("start"), F.coalesce("before", F.lit(-1).cast("long")).alias("before"))
    whole = marks.where(begins | F.col("is_last")).groupBy(*of).agg(F.sort_array(F.collect_list(F.when(begins, begun))).alias("runs"), F.max("at").alias("end"))
    tail = height * width - 1 - F.col("end")
    ends = lambda i: F.coalesce(F.get("runs", i + 1)["before"], F.col("end"))
    counts = F.flatten(F.transform("runs", lambda r, i: F.array(r["start"] - r["before"] - 1, ends(i) - r["start"] + 1)))
    return whole.select(*of, F.when(tail > 0, F.concat(counts, F.array(tail))).otherwise(counts).alias("counts"))


def decode_runs(coded: DataFrame, height: int, of: list[str]) -> DataFrame:
    """The pixels that are set."""
    keys = ", ".join(of)
    rows = coded.select(*of, F.posexplode("counts").alias("i", "n"))
    rows = rows.withColumn("end", F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY i)")).where("i % 2 = 1 AND n > 0")
    at = rows.select(*of, F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("at"))
    return at.select(*of, (F.col("at") % height).cast("int").alias("y"), F.floor(F.col("at") / height).cast("int").alias("x"))


def area_of_runs(counts: str = "counts") -> Column:
    return F.expr(f"aggregate(filter({counts}, (c, i) -> i % 2 = 1), 0L, (a, b) -> a + b)")


def box_of_runs(coded: DataFrame, height: int, of: list[str]) -> DataFrame:
    """The box of each code without its pixels; a run over a column's end covers whole columns."""
    rows = coded.select(*of, F.posexplode("counts").alias("i", "n"))
    keys = ", ".join(of)
    rows = rows.withColumn("end", F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY i)")).where("i % 2 = 1 AND n > 0")
    first, last = F.col("end") - F.col("n"), F.col("end") - 1
    wide = F.floor(first / height) != F.floor(last / height)
    rows = rows.select(*of, F.floor(first / height).alias("x1"), F.floor(last / height).alias("x2"), F.when(wide, 0).otherwise(first % height).alias("y1"), F.when(wide, height - 1).otherwise(last % height).alias("y2"))
    return rows.groupBy(*of).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def boxes(pix: DataFrame, keys: DataFrame, of: list[str], empty: tuple[int, int, int, int]) -> DataFrame:
    """The tight box of each mask in ``keys``; ``empty`` for those without pixels."""
    tight = pix.groupBy(*of).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return keys.join(tight, of, "left").select(*of, *(F.coalesce(c, F.lit(e)).alias(c) for c, e in zip(("x1", "y1", "x2", "y2"), empty)))


def overlap(truth: DataFrame, found: DataFrame, keys: DataFrame, of: list[str]) -> DataFrame:
    """Intersection and union of the two masks of each key, and both readings of an empty union."""
    at = [*of, "y", "x"]
    both = truth.select(*at, F.lit(1).alias("t")).join(found.select(*at, F.lit(1).alias("f")), at, "full")
    sums = both.groupBy(*of).agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("common"), F.count("*").alias("either"))
    out = keys.join(sums, of, "left").select(*of, F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("either", F.lit(0)).alias("either"))
    return out.withColumns({
        "iou_empty_one": F.when(F.col("either") == 0, 1.0).otherwise(F.round(F.col("common") / F.col("either"), 6)),
        "iou_empty_zero": F.round(F.col("common") / F.greatest("either", F.lit(1)), 6),
    })


def stability(values: DataFrame, of: list[str], threshold: float, offset: float, plain: bool = False) -> DataFrame:
    """Pixels above the threshold plus the offset, over those above it minus the offset.

    Without any of the latter it is 1, or not a number where the ``plain`` quotient is wanted.
    """
    high, low = F.count_if(F.col("v") > threshold + offset), F.count_if(F.col("v") > threshold - offset)
    return values.groupBy(*of).agg(F.when(low == 0, float("nan") if plain else 1.0).otherwise(F.round(F.try_divide(high, low), 6)).alias("stability"))


def _edges(mask: np.ndarray, area: Area, height: int, width: int) -> np.ndarray:
    """Where a dense mask differs from its east, south or south-east neighbour."""
    e, s, se = moved(mask, 0, 1), moved(mask, 1, 0), moved(mask, 1, 1)
    last_row, last_col = area.rows == height - 1, area.cols == width - 1
    differs = np.where(last_row, mask != e, np.where(last_col, mask != s, (mask != e) | (mask != s) | (mask != se)))
    return differs & ~(last_row & last_col) & area.inside(height, width)


def boundary(pix: DataFrame, of: list[str], height: int, width: int) -> DataFrame:
    """Pixels where the mask differs from its east, south or south-east neighbour.

    In the last row and column only neighbours along it count, and the last pixel never does.
    """
    def run(part: pd.DataFrame, area: Area) -> pd.DataFrame:
        y, x = np.nonzero(_edges(area.dense(True, False, bool), area, height, width) & area.mine)
        return pd.DataFrame({"y": y + area.top, "x": x + area.left})

    # a boundary pixel is set itself or has a set neighbour to the east, south or south-east
    return on_blocks(pix, of, [], 1, run, "y int, x int")


def boundary_score(truth: DataFrame, found: DataFrame, keys: DataFrame, of: list[str], height: int, width: int, radius: int) -> DataFrame:
    """Precision, recall and F of boundaries that match within ``radius`` pixels."""
    both = truth.select(*of, "y", "x", F.lit(True).alias("real")).unionByName(found.select(*of, "y", "x", F.lit(False).alias("real")))
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]

    def run(part: pd.DataFrame, area: Area) -> pd.DataFrame:
        real = part["real"].to_numpy()
        t, f = (_edges(area.dense(True, False, bool, np.flatnonzero(which)), area, height, width) for which in (real, ~real))
        near_t, near_f = (np.logical_or.reduce([moved(m, dy, dx) for dy, dx in disk]) for m in (t, f))
        n = lambda m: [int((m & area.mine).sum())]
        return pd.DataFrame({"n_truth": n(t), "n_found": n(f), "hit_found": n(f & near_t), "hit_truth": n(t & near_f)})

    counts = ("n_truth", "n_found", "hit_found", "hit_truth")
    # a block, with both masks around it, sends its four counts only
    each = on_blocks(both, of, ["real"], radius + 1, run, ", ".join(f"{c} long" for c in counts))
    sums = each.groupBy(*of).agg(*(F.sum(c).alias(c) for c in counts))
    out = keys.join(sums, of, "left").na.fill(0, ["n_truth", "n_found", "hit_found", "hit_truth"])
    t, f = F.col("n_truth"), F.col("n_found")
    precision = F.when((f == 0) & (t > 0), 1.0).when((f > 0) & (t == 0), 0.0).when((f == 0) & (t == 0), 1.0).otherwise(F.col("hit_found") / f)
    recall = F.when((f == 0) & (t > 0), 0.0).when((f > 0) & (t == 0), 1.0).when((f == 0) & (t == 0), 1.0).otherwise(F.col("hit_truth") / t)
    out = out.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    score = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return out.select(*of, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(score, 6).alias("f"))
