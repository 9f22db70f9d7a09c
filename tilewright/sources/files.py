"""File sources: image listings, coordinates, run-length annotations."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numbered

#: Extensions of images.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff")
RLE = "struct<size: array<int>, counts: array<int>>"


def images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The images below a folder, by name: path, name, stem, bytes; decoding is up to the caller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    return wanted.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("length").alias("n_bytes"), *([F.col("content")] if content else []))


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a folder in the order of their numeric stems; a folder without frames is an error."""
    found = images(spark, path).where(F.col("stem").rlike(r"^\d+$")).withColumn("number", F.col("stem").cast("long"))
    if found.isEmpty():
        raise ValueError(f"no frames in {path}")
    return numbered(found, ["number", "path"], "frame")


def tile_files(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """The paths of a folder's files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """What the JSON files beside tiles tell: path, image_name, num_instances (0 if not told), tile_size."""
    schema = "image_name string, num_instances long, tile_size long"
    raw = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*_meta.json").json(path)
    return raw.select(F.input_file_name().alias("path"), "image_name", F.coalesce("num_instances", F.lit(0)).alias("num_instances"), "tile_size")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """Integer arrays of ``.npy`` files: path, height, width and values in reading order; a task holds one file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                values = pa.ListArray.from_arrays(pa.array([0, found.size], pa.int32()), pa.array(found.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([found.shape[0]]), pa.array([found.shape[1]]), values], names=["path", "height", "width", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, height long, width long, values array<long>")


def array_pixels(found: DataFrame) -> DataFrame:
    """The pixels of arrays that are not background: path, y, x, inst."""
    rows = found.select("path", "width", F.posexplode("values").alias("at", "inst")).where("inst > 0")
    return rows.select("path", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "inst")


def masklets_at(found: DataFrame, frames: DataFrame, every: int, objects: DataFrame | None = None) -> DataFrame:
    """The codes that hold at each frame (video, frame): those of the annotated frame ``frame // every``.

    ``found`` is what ``masklets`` gives; only ids in ``objects`` (video, object) count, if given.  A
    null code stays: the object is not annotated there.
    """
    wanted = frames.select(F.col("video").alias("_v"), F.col("frame").alias("at_frame"), F.floor(F.col("frame") / every).alias("_k"))
    out = found.join(wanted, (F.col("video") == F.col("_v")) & (F.col("annotated") == F.col("_k"))).select("video", F.col("at_frame").alias("frame"), "object", "code")
    return out if objects is None else out.join(objects.select("video", "object").distinct(), ["video", "object"], "left_semi").select("video", "frame", "object", "code")


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """Videos below a folder by code (the stem); of equal codes the last path counts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(path)
    code = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.mp4$", "")
    return found.groupBy(code.alias("code")).agg(F.max("path").alias("path"))


def with_annotations(frames: DataFrame, manual: DataFrame, auto: DataFrame) -> DataFrame:
    """Each video's frames with its manual and automatic annotations, null where a video has none of a kind."""
    one = lambda df, name: df.select("video", F.col("annotation").alias(name))
    return frames.join(one(manual, "manual"), "video", "left").join(one(auto, "auto"), "video", "left")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a CSV with a header, as integers."""
    raw = spark.read.option("header", "true").csv(path)
    first, second = raw.columns[:2]
    return raw.select(F.col(f"`{first}`").cast("double").cast("long").alias("y"), F.col(f"`{second}`").cast("double").cast("long").alias("x"))


def masklets(spark: SparkSession, path: str, frames_fps: int, annotations_fps: int) -> DataFrame:
    """Run-length masks of JSON annotations: video, annotated frame, frame, object, code (null: not annotated)."""
    if frames_fps % annotations_fps:
        raise ValueError("frames_fps must be a multiple of annotations_fps")
    every = frames_fps // annotations_fps
    schema = f"video_id string, masklet array<array<{RLE}>>, masklet_id array<int>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    frames = raw.select(F.col("video_id").alias("video"), "masklet_id", F.posexplode("masklet").alias("annotated", "objects"))
    objects = frames.select("video", "annotated", "masklet_id", F.posexplode_outer("objects").alias("at", "code"))
    return objects.select("video", "annotated", (F.col("annotated") * every).alias("frame"), F.element_at("masklet_id", F.col("at") + 1).alias("object"), "code")


def filtered_annotations(rows: DataFrame, least_iou: float, most_share: float, height: int, width: int) -> DataFrame:
    """Image annotations worth keeping, numbered from 0: some area, not uncertain, not nearly the whole image."""
    share = F.col("area") / float(height * width)
    keep = (F.col("area") > 0) & (F.col("uncertain_iou").isNull() | (F.col("uncertain_iou") >= least_iou)) & (F.lit(most_share > 1.0) | (share < most_share))
    return rows.where(keep).withColumn("object", F.expr("row_number() OVER (PARTITION BY image_id ORDER BY position) - 1"))
