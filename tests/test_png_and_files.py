"""Images that others have written, images of our own, and files that take their names only when all is well."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import contours
from tilewright.sources import files, named_files, png, sinks


def filtered(samples, kinds, palette=None, kind=None, depth=8):
    """A PNG whose lines use the given filters, written plainly, byte by byte."""
    height, width, n = samples.shape
    lines, before = b"", [0] * (width * n)
    for k in range(height):
        line = [int(v) for v in samples[k].ravel()]
        f = kinds[k % len(kinds)]
        out = []
        for i, v in enumerate(line):
            a, b, c = (line[i - n] if i >= n else 0), before[i], (before[i - n] if i >= n else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, nearest][f]) % 256)
        lines += bytes([f, *out])
        before = line
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    data = zlib.compress(lines)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)), chunk(b"tEXt", b"a\0b")]
    parts += [chunk(b"PLTE", palette)] if palette else []
    return png.SIGNATURE + b"".join(parts + [chunk(b"IDAT", data[:7]), chunk(b"IDAT", data[7:]), chunk(b"IEND", b"")])


@pytest.mark.parametrize("kind", [png.GRAY, png.RGB, png.PALETTE, png.GRAY_ALPHA, png.RGB_ALPHA])
@pytest.mark.parametrize("kinds", [(0,), (1, 2), (3,), (4,), (4, 0, 3, 2, 1)])
def test_every_filter_and_colour_type(kind, kinds):
    rng = np.random.default_rng(kind)
    for height, width in ((1, 1), (5, 9), (13, 4)):
        samples = rng.integers(0, 256, (height, width, png.SAMPLES[kind])).astype(np.uint8)
        palette = bytes(rng.integers(0, 256, 30).tolist()) if kind == png.PALETTE else None
        got, found, colours = png.decode(filtered(samples, kinds, palette, kind))
        assert (got == samples).all() and found == kind and colours == palette
        back, _, _ = png.decode(png.encode(samples, palette))
        assert (back == samples).all()


def test_few_bits():
    bits = np.array([[1, 0, 1, 1, 0, 0, 1, 0, 1], [0, 1, 1, 0, 0, 1, 0, 1, 1]], dtype=np.uint8)
    packed = np.packbits(bits, axis=1)[:, :, None]
    data = filtered(packed, (0,), None, png.GRAY, 1)
    data = data.replace(struct.pack(">II", 2, 2), struct.pack(">II", 9, 2))
    head = data[16:29]
    data = data[:29] + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + data[33:]
    got, _, _ = png.decode(data)
    assert (got[..., 0] == bits * 255).all()


def test_damaged_files_have_a_problem(spark, tmp_path):
    good = png.encode(np.arange(12, dtype=np.uint8).reshape(3, 4))
    bad = {"a.png": good, "b.png": good[:-20], "c.png": b"GIF89a", "d.PNG": b"x", "e.png": good[:50] + b"\0" + good[51:], "f.jpg": good}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in png.read(spark, str(tmp_path)).collect()}
    assert {k: v.problem for k, v in got.items()} == {"a.png": None, "b.png": "cut short", "c.png": "not a PNG", "d.PNG": "not a PNG", "e.png": "bad checksum"}
    assert (got["a.png"].height, got["a.png"].width, bytes(got["a.png"].pixels)) == (3, 4, bytes(range(12)))
    assert png.rgb_pixels(png.read(spark, str(tmp_path))).count() == 12


def test_masks_by_alpha_luma_or_value(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour = rng.integers(0, 256, (6, 7, 4)).astype(np.uint8)
    gray = rng.integers(0, 256, (6, 7)).astype(np.uint8)
    for name, data in (("rgba", png.encode(colour)), ("rgb", png.encode(colour[..., :3])), ("gray", png.encode(gray)), ("palette", png.encode(gray, bytes(range(256)) * 3))):
        (tmp_path / f"{name}.png").write_bytes(data)
    luma = np.round(colour[..., :3].astype(float) @ [0.299, 0.587, 0.114])
    want = {"rgba": colour[..., 3], "rgb": luma, "gray": gray, "palette": gray}
    got = {(r.path.rsplit("/", 1)[1][:-4], r.y, r.x) for r in png.mask_pixels(png.read(spark, str(tmp_path))).collect()}
    assert got == {(name, y, x) for name, value in want.items() for y, x in np.argwhere(value > 127).tolist()}
    rgb = {(r.y, r.x): (r.r, r.g, r.b) for r in png.rgb_pixels(png.read(spark, str(tmp_path / "rgba.png"))).collect()}
    assert rgb == {(y, x): tuple(colour[y, x, :3].tolist()) for y in range(6) for x in range(7)}


def test_frame_masks_round_trip(spark, tmp_path):
    pix = spark.createDataFrame([("v", 3, 2, 0, 0), ("v", 3, 1, 0, 0), ("v", 3, 2, 1, 4), ("w", 0, 200, 2, 2)], "video string, frame int, object int, y int, x int")
    sizes = spark.createDataFrame([("v", 3, 4, 5), ("v", 4, 4, 5), ("w", 0, 3, 3)], "video string, frame int, height int, width int")
    sinks.write_frame_masks(pix, sizes, str(tmp_path / "packed"), per_object=False)
    back = png.object_pixels(png.read(spark, str(tmp_path / "packed")))
    assert {(*r.path.split("/")[-2:], r.y, r.x, r.object) for r in back.collect()} == {("v", "00003.png", 0, 0, 1), ("v", "00003.png", 1, 4, 2), ("w", "00000.png", 2, 2, 200)}
    assert (tmp_path / "packed" / "v" / "00004.png").exists()
    each = sizes.crossJoin(spark.createDataFrame([(1,), (2,)], "object int")).where("video = 'v'")
    sinks.write_frame_masks(pix.where("video = 'v'"), each, str(tmp_path / "each"), per_object=True)
    back = png.object_pixels(png.read(spark, str(tmp_path / "each")))
    assert {(*r.path.split("/")[-3:], r.y, r.x, r.object) for r in back.collect()} == {("v", "001", "00003.png", 0, 0, 1), ("v", "002", "00003.png", 0, 0, 1), ("v", "002", "00003.png", 1, 4, 1)}


def test_arrays_with_sidecars(spark, tmp_path):
    pix = spark.createDataFrame([("a", 0, 1, 7), ("b", 2, 2, 70_000), ("b", 0, 0, 1)], "name string, y int, x int, inst long")
    sizes = spark.createDataFrame([("a", 2, 3, {"image_name": '"a.png"', "num_instances": "1"}), ("b", 3, 3, None)], "name string, height int, width int, metadata map<string,string>")
    sinks.write_instance_arrays(pix, sizes, str(tmp_path))
    a, b = np.load(tmp_path / "a.npy"), np.load(tmp_path / "b.npy")
    assert a.dtype == np.uint8 and a.tolist() == [[0, 7, 0], [0, 0, 0]] and b.dtype == np.uint32 and b[2, 2] == 70_000
    assert json.loads((tmp_path / "a_meta.json").read_text()) == {"image_name": "a.png", "num_instances": 1} and not (tmp_path / "b_meta.json").exists()
    assert {(r.y, r.x, r.inst) for r in files.array_pixels(files.arrays(spark, str(tmp_path))).collect()} == {(0, 1, 7), (2, 2, 70_000), (0, 0, 1)}
    rgb = pix.select("name", "y", "x", F.lit(200).alias("r"), F.lit(3).alias("g"), F.lit(9).alias("b"))
    sinks.write_probability_arrays(rgb, sizes.withColumn("metadata", F.when(F.col("name") == "a", F.create_map(F.lit("dtype"), F.lit('"own"')))), str(tmp_path / "p"))
    p = np.load(tmp_path / "p" / "a.npy")
    assert p.shape == (2, 3, 3) and p.dtype == np.uint8 and p[0, 1].tolist() == [200, 3, 9]
    told = json.loads((tmp_path / "p" / "a_meta.json").read_text())
    assert told["dtype"] == "own" and told["shape"] == [2, 3, 3] and len(told["channels"]) == 3
    assert json.loads((tmp_path / "p" / "b_meta.json").read_text())["dtype"] == "uint8"


def test_summaries_and_annotations(spark, tmp_path):
    steps = spark.createDataFrame([("a", 2, 0.5, "x"), ("a", 1, 0.25, None), ("b", 1, 1.0, "é")], "name string, at int, loss double, note string")
    sinks.write_summaries(steps, str(tmp_path))
    assert json.loads((tmp_path / "a.json").read_text()) == [{"loss": 0.25}, {"loss": 0.5, "note": "x"}]
    pix = spark.createDataFrame([(1, y, x, 3) for y in range(4) for x in range(5)], "image_id long, y int, x int, inst long")
    images = spark.createDataFrame([(1, "slide.tile.tif", 9, 9)], "image_id long, name string, height int, width int")
    sinks.write_annotations(contours.annotations(contours.shapes(contours.contours(pix, 3)), images), str(tmp_path / "json"))
    assert len(json.loads((tmp_path / "json" / "slide.tile.json").read_text())["shapes"]) == 1
    sinks.write_images(spark.createDataFrame([("s", "Seg", 1, 1, 9, 8, 7)], "base string, key string, y int, x int, r int, g int, b int"), spark.createDataFrame([("s", "Seg", 2, 2), ("s", "DAPI", 1, 1)], "base string, key string, height int, width int"), str(tmp_path / "img"))
    assert png.decode((tmp_path / "img" / "s" / "Seg.png").read_bytes())[0].tolist() == [[[0, 0, 0], [0, 0, 0]], [[0, 0, 0], [9, 8, 7]]]
    assert png.decode((tmp_path / "img" / "s" / "DAPI.png").read_bytes())[0].shape == (1, 1, 3)


def test_files_of_a_failed_job_are_not_there(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", b"one", 1), ("a/x.txt", b" two", 2), ("y.txt", None, 1)], "name string, content binary, at int")
    named_files.write(rows, str(tmp_path), order=["at"])
    assert (tmp_path / "a" / "x.txt").read_bytes() == b"one two" and (tmp_path / "y.txt").read_bytes() == b""
    for bad in ("../z", "/z", "", "a/../z"):
        with pytest.raises(Exception, match="not a name"):
            named_files.write(spark.createDataFrame([("ok.txt", b"1"), (bad, b"2")], "name string, content binary"), str(tmp_path))
    twice = spark.createDataFrame([("t.txt", b"1"), ("t.txt", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="lie apart"):
        named_files.write(twice, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "y.txt"]
    named_files.write(spark.createDataFrame([("new.txt", b"3")], "name string, content binary"), str(tmp_path), mode="overwrite")
    assert [p.name for p in tmp_path.iterdir()] == ["new.txt"]


def test_a_large_image_takes_seconds():
    rng = np.random.default_rng(0)
    samples = (np.add.outer(np.arange(700), np.arange(900)) % 256).astype(np.uint8)[:, :, None]
    raw = rng.integers(0, 256, (700, 900)).astype(np.uint8)
    assert png.unfiltered(raw, np.full(700, 4), 1).shape == (700, 900)
    assert (png.decode(png.encode(samples))[0] == samples).all()
    assert io.BytesIO(png.encode(samples)).read(8) == png.SIGNATURE
