"""Sinks: tables as CSV with a header, figures as JSON lines, reports as text, masks by video and object.

Tables go to folders of part files, written by Spark's own writers; images, arrays and documents
that others open by name go through ``named_files``.  Both survive lost tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import named_files, png


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header: cells, merged regions, groups, or classifications, as their operators give them."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_merged_regions(regions: DataFrame, path: str) -> None:
    """Merged regions (image_id, region_id, pixel_count, avg_score, member_instances) as CSV, scores with four places."""
    write_csv(regions.select("image_id", "region_id", "pixel_count", F.format_string("%.4f", "avg_score").alias("avg_score"), "member_instances"), path)


def append_stats(rows: DataFrame, path: str) -> None:
    """One JSON object for each row, after those that are there."""
    rows.write.mode("append").json(path)


def report_text(summary: DataFrame) -> DataFrame:
    """Lines of a report on each image's regions: image_id, at, line."""
    number = lambda c, form: F.format_string(form, F.col(c))
    lines = [
        F.concat(F.lit("image "), F.col("image_id").cast("string")),
        F.concat(F.lit("regions: "), F.col("n").cast("string")),
        F.concat(F.lit("area: total "), F.col("total_area").cast("string"), F.lit(", mean "), number("mean_area", "%.2f"), F.lit(", median "), number("median_area", "%.2f"), F.lit(", deviation "), number("std_area", "%.2f")),
        F.concat(F.lit("size: small "), F.col("small").cast("string"), F.lit(", medium "), F.col("medium").cast("string"), F.lit(", large "), F.col("large").cast("string")),
        F.concat(F.lit("of several sources: "), F.col("merged").cast("string"), F.lit(" ("), number("merged_percent", "%.1f"), F.lit(" %)")),
    ]
    return summary.select("image_id", F.posexplode(F.array(*lines)).alias("at", "line"))


def write_regions(regions: DataFrame, summary: DataFrame, path: str) -> None:
    """Merged regions as ``regions.csv``, their summary as ``statistics.json`` and as ``report.txt``."""
    write_csv(regions, f"{path}/regions.csv")
    summary.write.mode("overwrite").json(f"{path}/statistics.json")
    report_text(summary).orderBy("image_id", "at").select("line").write.mode("overwrite").text(f"{path}/report.txt")


def write_masks(codes: DataFrame, path: str, per_object: bool) -> None:
    """Coded masks (video, frame, object, ...) in a folder for each video, or for each of its objects."""
    by = ["video", "object"] if per_object else ["video"]
    codes.repartition(*by).sortWithinPartitions("frame").write.mode("overwrite").partitionBy(*by).parquet(path)


def write_annotations(documents: DataFrame, path: str) -> None:
    """One JSON file for each image (name, json): the image's name with its ending replaced."""
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    named_files.write(documents.select(F.concat(stem, F.lit(".json")).alias("name"), F.encode("json", "UTF-8").alias("content")), path)


def write_images(pix: DataFrame, sizes: DataFrame, path: str) -> None:
    """Images in colour (base, key, y, x, r, g, b; sizes: base, key, height, width) as ``<base>/<key>.png``."""
    found = png.encoded(pix, ["base", "key"], sizes, ["r", "g", "b"])
    named_files.write(found.select(F.format_string("%s/%s.png", "base", "key").alias("name"), "content"), path)


def write_frame_masks(pix: DataFrame, sizes: DataFrame, path: str, per_object: bool, palette: bytes | None = None) -> None:
    """Masks of frames (video, frame, object, y, x) as PNG.

    Packed, ``<video>/<frame>.png`` holds objects by number (up to 255), the lowest on top, in a palette (by
    default shades of gray); each row of ``sizes`` (video, frame, height, width) is a file, without pixels an empty one.
    Per object, ``<video>/<object>/<frame>.png`` is 1 where the object is; ``sizes`` has the column object then.
    """
    palette = palette or bytes(v for k in range(256) for v in (k, k, k))
    if per_object:
        found = png.encoded(pix.withColumn("value", F.lit(1)), ["video", "object", "frame"], sizes, ["value"], palette)
        name = F.format_string("%s/%03d/%05d.png", F.col("video").cast("string"), F.col("object").cast("long"), F.col("frame").cast("long"))
    else:
        top = pix.groupBy("video", "frame", "y", "x").agg(F.min("object").alias("value"))
        found = png.encoded(top, ["video", "frame"], sizes, ["value"], palette)
        name = F.format_string("%s/%05d.png", F.col("video").cast("string"), F.col("frame").cast("long"))
    named_files.write(found.select(name.alias("name"), "content"), path)


def _array_files(pix: DataFrame, sizes: DataFrame, channels: list[str], wide: bool) -> DataFrame:
    """name and content of ``.npy`` files: unsigned numbers as wide as the largest value needs (or bytes)."""
    rows = sizes.select("name", "height", "width", *(F.lit(None).cast("long").alias(c) for c in ("y", "x", *channels)))
    both = rows.unionByName(pix.select("name", *(F.lit(None).cast("int").alias(c) for c in ("height", "width")), *(F.col(c).cast("long") for c in ("y", "x", *channels))))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        size = part.loc[part["height"].notna()]
        if not len(size):
            return pd.DataFrame({"name": [], "content": []})
        array = np.zeros((int(size["height"].iloc[0]), int(size["width"].iloc[0]), len(channels)), dtype=np.int64)
        at = part.loc[part["y"].notna()]
        array[at["y"].astype(int), at["x"].astype(int)] = at[channels].to_numpy(dtype=np.int64)
        most = array.max(initial=0)
        kind = np.uint8 if most <= 255 or not wide else np.uint16 if most <= 65_535 else np.uint32
        out = io.BytesIO()
        np.save(out, (array[..., 0] if wide else array).astype(kind))
        return pd.DataFrame({"name": [f"{part['name'].iloc[0]}.npy"], "content": [out.getvalue()]})

    return both.groupBy("name").applyInPandas(pack, "name string, content binary")


def _sidecar_files(metadata: DataFrame) -> DataFrame:
    """name and content of ``_meta.json`` files from (name, metadata: a map of JSON values); none for a null map."""
    key = lambda e: F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", "")
    listed = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(key(e), F.lit(": "), e["value"]))
    text = F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}"))
    return metadata.where("metadata IS NOT NULL").select(F.concat("name", F.lit("_meta.json")).alias("name"), F.encode(text, "UTF-8").alias("content"))


def write_instance_arrays(pix: DataFrame, sizes: DataFrame, path: str) -> None:
    """Instance masks (name, y, x, inst) as ``<name>.npy``; ``sizes`` has name, height, width and metadata (a map of JSON values, or null for no sidecar)."""
    named_files.write(_array_files(pix, sizes, ["inst"], wide=True).unionByName(_sidecar_files(sizes.select("name", "metadata"))), path)


def write_probability_arrays(pix: DataFrame, sizes: DataFrame, path: str) -> None:
    """Class probabilities (name, y, x, r, g, b) as ``<name>.npy`` of bytes, with a sidecar that tells channels, type and shape unless ``metadata`` says otherwise."""
    told = {"channels": '{"R (channel 0)": "positive_probability", "G (channel 1)": "background_probability", "B (channel 2)": "negative_probability"}', "dtype": '"uint8"', "usage": '"R + B > threshold && G <= 80 -> cell; R >= B -> positive, R < B -> negative"'}
    shape = F.format_string("[%d, %d, 3]", F.col("height").cast("long"), F.col("width").cast("long"))
    defaults = F.create_map(*(F.lit(v) for pair in told.items() for v in pair), F.lit("shape"), shape)
    metadata = sizes.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    all_ = metadata.select("name", F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys("metadata"), k)), "metadata").alias("metadata"))
    named_files.write(_array_files(pix, sizes, ["r", "g", "b"], wide=False).unionByName(_sidecar_files(all_)), path)


def write_summaries(steps: DataFrame, path: str) -> None:
    """Summaries of steps (name, at, and figures) as ``<name>.json``: a list of objects in the order of ``at``."""
    figures = [c for c in steps.columns if c not in ("name", "at")]
    listed = steps.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", F.to_json(F.struct(*figures)).alias("j")))).alias("found"))
    text = F.concat(F.lit("["), F.array_join(F.col("found.j"), ", "), F.lit("]"))
    named_files.write(listed.select(F.concat("name", F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content")), path)
