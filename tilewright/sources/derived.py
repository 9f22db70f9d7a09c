"""Rasters, tracks and points derived from the relational tables.

The tables hold no images, so queries run over long tables of pixels, boxes and
frames made from ``lineitem``, ``events`` and ``orders``.  Number of images and
tracks grows with the data; an image is SIDE x SIDE pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, TILE = 128, 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place() -> list[Column]:
    """The image and the pixel of a row of ``lineitem``."""
    return [
        (F.col("l_linenumber") + 10 * F.floor(F.col("l_orderkey") / 16384)).cast("long").alias("image_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % SIDE).cast("int").alias("y"),
        (F.col("l_partkey") % SIDE).cast("int").alias("x"),
    ]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x and the channels r, g, b; background pixels are absent."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(*place())
        .agg(
            F.max((F.col("l_quantity") * 5).cast("int")).alias("r"),
            F.max(F.round(F.col("l_discount") * 1000).cast("int")).alias("g"),
            F.max(F.round(F.col("l_tax") * 3000).cast("int")).alias("b"),
        )
    )


PIXELS_SQL = f"""pix AS (
  SELECT CAST(l_linenumber + 10 * floor(l_orderkey / 16384) AS BIGINT) AS image_id,
         CAST((l_orderkey * 7 + l_suppkey) % {SIDE} AS INT) AS y, CAST(l_partkey % {SIDE} AS INT) AS x,
         max(CAST(trunc(l_quantity * 5) AS INT)) AS r, max(CAST(round(l_discount * 1000) AS INT)) AS g, max(CAST(round(l_tax * 3000) AS INT)) AS b
  FROM lineitem GROUP BY 1, 2, 3)"""


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels with r + b > 120 and g <= 80."""
    return pixels(spark, sf_dir).where("r + b > 120 AND g <= 80")


FOREGROUND_SQL = PIXELS_SQL + ", fg AS (SELECT * FROM pix WHERE r + b > 120 AND g <= 80)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video frame: video, frame, object, value (null where not annotated)."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"),
        F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT)").alias("frame"),
        F.col("event_type").alias("object"),
        F.floor("value").cast("long").alias("value"),
        "event_id",
        "ts",
    )


FRAMES_SQL = """frames AS (
  SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
         event_type AS object, CAST(floor(value) AS BIGINT) AS value, event_id, ts FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and integer coordinates of orders, and a size."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") * 3 + F.floor(F.col("o_orderkey") / 16384) * 100_000).cast("long").alias("x"),
        F.floor(F.col("o_totalprice") / 50).cast("long").alias("y"),
        (F.col("o_custkey") % 7 + 1).cast("long").alias("size"),
    )


POINTS_SQL = """pts AS (
  SELECT o_orderkey AS id, CAST(o_custkey * 3 + floor(o_orderkey / 16384) * 100000 AS BIGINT) AS x,
         CAST(floor(o_totalprice / 50) AS BIGINT) AS y, CAST(o_custkey % 7 + 1 AS BIGINT) AS size FROM orders)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the points: id, group, x1, y1, x2, y2, score."""
    return points(spark, sf_dir).select("id", (F.col("id") % 16).alias("grp"), (F.col("x") - F.col("size")).alias("x1"), (F.col("y") - 2 * F.col("size")).alias("y1"), (F.col("x") + F.col("size")).alias("x2"), (F.col("y") + 2 * F.col("size")).alias("y2"), (F.col("y") % 1000).alias("score"))


BOXES_SQL = POINTS_SQL + ", box AS (SELECT id, id % 16 AS grp, x - size AS x1, y - 2 * size AS y1, x + size AS x2, y + 2 * size AS y2, y % 1000 AS score FROM pts)"
