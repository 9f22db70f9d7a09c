"""What sinks write can be read again."""

from pyspark.sql import functions as F

from tilewright.operators import regions
from tilewright.sources import sinks


def test_region_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 90, 1), (1, 8, 200, 2), (2, 9, 600, 1)], "image_id long, global_region long, area long, n_sources long")
    summary = regions.area_summary(rows, ["image_id"])
    sinks.write_regions(rows, summary, str(tmp_path))
    back = spark.read.option("header", "true").csv(str(tmp_path / "regions.csv"))
    assert {tuple(map(int, r)) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    assert {(r.image_id, r.n, r.total_area) for r in spark.read.json(str(tmp_path / "statistics.json")).collect()} == {(1, 2, 290), (2, 1, 600)}
    lines = [r.line for r in sinks.report_text(summary).orderBy("image_id", "at").collect()]
    assert lines[:5] == ["image 1", "regions: 2", "area: total 290, mean 145.00, median 145.00, deviation 55.00", "size: small 1, medium 1, large 0", "of several sources: 1 (50.0 %)"]
    assert {r.value for r in spark.read.text(str(tmp_path / "report.txt")).collect()} == set(lines)


def test_stats_are_appended(spark, tmp_path):
    for k in range(3):
        sinks.append_stats(spark.range(k, k + 1).withColumn("loss", F.col("id") / 2), str(tmp_path / "stats"))
    assert {(r.id, r.loss) for r in spark.read.json(str(tmp_path / "stats")).collect()} == {(0, 0.0), (1, 0.5), (2, 1.0)}


def test_masks_by_video_and_object(spark, tmp_path):
    codes = spark.createDataFrame([(v, f, o, f"{v}{f}{o}") for v in (1, 2) for f in range(3) for o in (5, 6)], "video long, frame int, object int, code string")
    for per_object in (False, True):
        sinks.write_masks(codes, str(tmp_path / str(per_object)), per_object)
        back = spark.read.parquet(str(tmp_path / str(per_object))).select("video", "frame", "object", "code")
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in codes.collect()}
    assert (tmp_path / "True" / "video=1" / "object=5").is_dir()
