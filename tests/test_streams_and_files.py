"""Streams give what batches give; file sources read what was written."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import tiling
from tilewright.sources import files
from tilewright.streaming import prompts


def test_stream_of_sessions_ends_in_the_batch_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").toPandas()
    for k in range(3):
        part = events.iloc[k * len(events) // 3 : (k + 1) * len(events) // 3]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict[int, set] = {}

    def take(batch, _):
        rows = batch.collect()
        for session in {r.session for r in rows}:
            seen[session] = {tuple(r) for r in rows if r.session == session and r.kind != "gone"}

    prompts.follow(prompts.requests_of(source)).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in prompts.final_state(prompts.requests_of(spark.createDataFrame(events))).collect()}
    assert set().union(*seen.values()) == want


def test_a_session_without_state_says_so(spark, tmp_path):
    for k, action in enumerate(("points", "reset")):
        spark.createDataFrame([(1, k, action, 2, 3)], "session long, at long, action string, obj long, frame long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session long, at long, action string, obj long, frame long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    prompts.follow(source).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert (1, None, None, "gone", 0) in got and len(got) == 2


def test_windows_of_a_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(path).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(str(tmp_path / "in"))
    got = []
    prompts.windowed(source).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert set(got) == set(map(tuple, prompts.windowed(spark.read.parquet(path)).collect()))


def test_requests_one_by_one():
    state = {}
    for action, obj, frame in [("points", 1, 0), ("points", 1, 0), ("mask", 2, 0), ("points", 2, 0), ("mask", 1, 1), ("clear", 1, 0), ("remove", 2, 0), ("points", 3, 3)]:
        prompts.apply(state, action, obj, frame)
    assert state == {(1, 1): 0, (3, 3): 1}


def test_images_and_frames(spark, tmp_path):
    for name in ("10.png", "9.PNG", "2.jpg", "notes.txt", "a.tiff"):
        (tmp_path / name).write_bytes(b"x" * 3)
    assert {r.name for r in files.images(spark, str(tmp_path)).collect()} == {"10.png", "9.PNG", "2.jpg", "a.tiff"}
    assert [r.stem for r in files.frame_files(spark, str(tmp_path)).orderBy("frame").collect()] == ["2", "9", "10"]


def test_no_frames_is_an_error(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        files.frame_files(spark, str(tmp_path))


def test_arrays_and_sidecars(spark, tmp_path):
    grid = np.zeros((3, 4), dtype=np.uint16)
    grid[1, 2], grid[2, 3] = 7, 300
    np.save(tmp_path / "tile_1_2_0_4.npy", grid)
    np.save(tmp_path / "tile_1_1_0_0.npy", grid)
    (tmp_path / "tile_1_2_0_4_meta.json").write_text(json.dumps({"image_name": "a", "num_instances": 2, "tile_size": 4}))
    tiles = tiling.with_sidecars(files.tile_files(spark, str(tmp_path)), files.sidecars(spark, str(tmp_path)))
    assert {(r.tile_col, r.offset_x, r.num_instances) for r in tiles.collect()} == {(2, 4, 2), (1, 0, 0)}
    pixels = files.array_pixels(files.arrays(spark, str(tmp_path))).where(F.col("path").contains("tile_1_2"))
    assert {(r.y, r.x, r.inst) for r in pixels.collect()} == {(1, 2, 7), (2, 3, 300)}


def test_gallery_and_annotations(spark, tmp_path):
    for name in ("a/one.mp4", "b/one.mp4", "two.mp4", "b/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"v")
    found = {r.code: r.path for r in files.gallery(spark, str(tmp_path)).collect()}
    assert set(found) == {"one", "two"} and found["one"].endswith("b/one.mp4")
    frames = spark.createDataFrame([("one",), ("two",)], "video string")
    one = lambda v, a: spark.createDataFrame([(v, a)], "video string, annotation string")
    assert {tuple(r) for r in files.with_annotations(frames, one("one", "m"), one("two", "u")).collect()} == {("one", "m", None), ("two", None, "u")}


def test_coordinates(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Row,Col,More\n3,4,x\n5,6,y\n")
    assert [tuple(r) for r in files.coordinates(spark, str(tmp_path / "c.csv")).collect()] == [(3, 4), (5, 6)]


def test_masklets(spark, tmp_path):
    code = {"size": [2, 2], "counts": [0, 4]}
    (tmp_path / "v.json").write_text(json.dumps({"video_id": "v", "masklet_id": [7, 9], "masklet": [[code, None], [None, code]]}))
    out = files.masklets(spark, str(tmp_path / "v.json"), 24, 6)
    assert {(r.frame, r.object, r.code is None) for r in out.collect()} == {(0, 7, False), (0, 9, True), (4, 7, True), (4, 9, False)}


def test_filtered_annotations(spark):
    rows = spark.createDataFrame([(1, 0, 0, None), (1, 1, 5, 0.2), (1, 2, 5, 0.9), (1, 3, 99, None), (1, 4, 7, None)], "image_id long, position int, area long, uncertain_iou double")
    out = files.filtered_annotations(rows, 0.5, 0.9, 10, 10).orderBy("object").select("position", F.col("object").cast("int")).collect()
    assert [tuple(r) for r in out] == [(2, 0), (4, 1)]
