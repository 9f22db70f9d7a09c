"""Formats written and read again over the tables, with SQL for what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import derived, png
from ..sources.derived import PIXELS_SQL, SIDE
from ..streaming import multipart

#: Bytes of a chunk; a frame's message takes several.
CHUNK = 97


def k14_k15_multipart(spark, sf):
    """Each user's events as a stream of parts, cut into chunks, and read back."""
    e = derived.read(spark, sf, "events")
    body = F.concat(F.lit('{"frame_index": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "größe": '), F.floor("value").cast("long").cast("string"), F.lit("}"))
    sent = e.select(F.col("user_id").cast("string").alias("stream"), "event_id", multipart.message(body).alias("m"))
    cut_up = sent.select("stream", "event_id", "m", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("m") - 1) / CHUNK))).alias("k"))
    chunks = cut_up.select("stream", (F.col("event_id") * 1000 + F.col("k")).alias("seq"), F.expr(f"substring(m, CAST(k * {CHUNK} + 1 AS INT), {CHUNK})").alias("data"))
    found, _ = multipart.parts(chunks)
    return found.select(F.col("stream").cast("long").alias("session"), F.col("part").cast("long").alias("part"), F.col("headers")["Content-Length"].cast("long").alias("n_bytes"), F.sha2("body", 256).alias("body_sha256"))


def s02_k10_images(spark, sf):
    """The rasters as PNG files in colour, decoded again; black pixels are left out on both sides."""
    pix = derived.pixels(spark, sf).select(F.col("image_id").cast("string").alias("name"), "y", "x", "r", "g", "b")
    sizes = pix.select("name").distinct().select("name", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    files = png.encoded(pix, ["name"], sizes, ["r", "g", "b"]).select(F.col("name").alias("path"), "content")
    return png.rgb_pixels(png.decoded(files)).where("r + g + b > 0").select(F.col("path").cast("long").alias("image_id"), "y", "x", "r", "g", "b")


def s08_masks(spark, sf):
    """Masks of the rasters: pixels whose luma, as a decoded file in colour tells it, is over 50."""
    pix = derived.pixels(spark, sf).select(F.col("image_id").cast("string").alias("name"), "y", "x", "r", "g", "b")
    sizes = pix.select("name").distinct().select("name", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    files = png.encoded(pix, ["name"], sizes, ["r", "g", "b"]).select(F.col("name").alias("path"), "content")
    return png.mask_pixels(png.decoded(files), 50).select(F.col("path").cast("long").alias("image_id"), "y", "x")


QUERIES = {
    "K14_K15_multipart": (k14_k15_multipart, """WITH b AS (SELECT user_id AS session, event_id, '{"frame_index": ' || event_id || ', "type": "' || event_type || '", "größe": ' || CAST(floor(value) AS BIGINT) || '}' AS body FROM events)
        SELECT session, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS part, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS body_sha256 FROM b"""),
    "S02_K10_images": (s02_k10_images, f"WITH {PIXELS_SQL} SELECT image_id, y, x, r, g, b FROM pix WHERE r + g + b > 0"),
    "S08_masks": (s08_masks, f"WITH {PIXELS_SQL} SELECT image_id, y, x FROM pix WHERE (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 > 50"),
}
