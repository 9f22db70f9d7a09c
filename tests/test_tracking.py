"""Streams of tracked masks: equal to the batch, across restarts, replays and timers, with bounded state."""

import glob

import pytest
from pyspark.sql import functions as F

from tilewright.operators import ranking
from tilewright.plans import session_queries
from tilewright.streaming import tracking

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def rocks(spark):
    """The state store that keeps lists and values, for these tests only."""
    before = {k: spark.conf.get(k, None) for k in tracking.STORE}
    for k, v in tracking.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_in_parts(rows, order, parts, path):
    frame = rows.orderBy(order).toPandas()
    for k in range(parts):
        rows.sparkSession.createDataFrame(frame.iloc[k * len(frame) // parts : (k + 1) * len(frame) // parts], rows.schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, take, tmp_path, mode="update"):
    stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_states_of_a_stream_are_those_of_the_table(spark, tmp_path, rocks):
    messages = session_queries.messages(spark, SF).where("session % 5 = 0").drop("ts")
    write_in_parts(messages, "at", 2, str(tmp_path / "in"))
    got = []
    take = lambda b, _: got.extend(map(tuple, b.collect()))
    run(tracking.deliver(source(spark, messages.schema, str(tmp_path / "in"))), take, tmp_path)
    begun = len(got)
    later = messages.withColumn("at", F.col("at") + 100_000)
    write_in_parts(later, "at", 1, str(tmp_path / "in"))
    run(tracking.deliver(source(spark, messages.schema, str(tmp_path / "in"))), take, tmp_path)  # goes on from the checkpoint
    want = sorted(map(str, map(tuple, tracking.delivered(messages.unionByName(later)).collect())))
    assert sorted(map(str, got)) == want and 0 < begun < len(got)
    assert {"none", "required", "requesting", "partial", "full", "aborting", "aborted"} == {r[3] for r in got} - {None}


def test_the_same_messages_one_by_one():
    said = "open prompt stream frame frame abort frame cancelled frame stream frame end frame clear".split()
    now, heard, sent = ("none", False, False), [], 0
    for kind in said:
        *now, out = tracking.step(*now, kind)
        heard.append(now[0])
        sent += out
    assert heard == "none required requesting partial partial aborting aborting aborted aborted requesting partial full full none".split() and sent == 3
    assert tracking.step("partial", True, False, "cancelled")[0] == "partial" and tracking.step("none", False, False, "abort")[0] == "none"


def test_an_abort_without_answer_ends_by_the_timer(spark, tmp_path, rocks):
    for k, (session, kind, second) in enumerate([(1, "stream", 0), (1, "abort", 1), (2, "stream", 2), (2, "abort", 3), (2, "cancelled", 4), (3, "open", 500), (3, "prompt", 501)]):
        spark.sql(f"SELECT {session}L AS session, {k}L AS at, '{kind}' AS kind, CAST(NULL AS BIGINT) AS frame, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {second}) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = []
    stream = tracking.deliver(source(spark, schema, str(tmp_path / "in")).withWatermark("ts", "0 seconds"), 60_000)
    run(stream, lambda b, _: got.extend((r.session, r.state) for r in b.collect()), tmp_path)
    assert [s for i, s in got if i == 1] == ["requesting", "aborting", "aborted"]
    assert [s for i, s in got if i == 2] == ["requesting", "aborting", "aborted"]
    assert [s for i, s in got if i == 3] == ["none", "required"]


@pytest.mark.parametrize("reverse", [False, True])
def test_memory_is_bounded_and_equal_to_the_batch(spark, tmp_path, rocks, reverse):
    frames = spark.range(600).select((F.col("id") % 2).alias("session"), F.floor(F.col("id") / 2).alias("frame"), (F.col("id") * 7 % 101).alias("value")).where("frame % 11 <> 4")
    rows = frames.withColumn("direction", F.lit("backward" if reverse else "forward")).select("session", "direction", "frame", "value")
    write_in_parts(rows, F.desc("frame") if reverse else F.asc("frame"), 5, str(tmp_path / "in"))
    # files are taken by their time; give them distinct ones
    got = []
    run(tracking.remember(source(spark, rows.schema, str(tmp_path / "in")), 7, 3), lambda b, _: got.extend(map(tuple, b.collect())), tmp_path, "append")
    want = ranking.look_back(frames.withColumnRenamed("session", "video"), 7, 3, reverse).select("video", "frame", "pos", "memory", "memory_value")
    assert sorted((s, f, p, m, v) for s, _, f, p, m, v, _ in got) == sorted(map(tuple, want.collect()))
    assert max(r[-1] for r in got) <= 7


def test_latest_masks_survive_replays_and_compaction(spark, tmp_path):
    path = str(tmp_path / "masks")
    schema = "session long, object long, frame long, at long, code string"
    batches = [
        [(1, 1, 0, 1, "a"), (1, 1, 0, 2, "b"), (1, 2, 0, 3, "P1"), (2, 1, 5, 4, "z")],
        [(1, 1, 0, 5, "c"), (1, 2, 1, 6, "d"), (2, 1, 5, 7, None)],
        [(1, 2, 0, 8, "e")],
    ]
    state = lambda: sorted(map(tuple, tracking.masks(spark, path, "P1").collect()))
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        tracking.upsert(batch, k, path)
        once = state()
        tracking.upsert(batch, k, path)  # the same batch again
        assert state() == once
        if k == 0:
            assert once == [(1, 1, 0, 2, "b", False), (1, 2, 0, 3, "P1", True), (2, 1, 5, 4, "z", False)]
        if k == 1:
            tracking.compact(spark, path, "P1")
            assert state() == once
    assert state() == [(1, 1, 0, 5, "c", False), (1, 2, 0, 8, "e", False), (1, 2, 1, 6, "d", False)]
    assert len(glob.glob(f"{path}/kind=base/upto=1")) == 1


def test_a_stream_into_the_table_of_masks(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("session"), (F.col("event_id") % 2).alias("object"), (F.col("event_id") % 3).alias("frame"), F.col("event_id").alias("at"), F.col("event_type").alias("code"))
    write_in_parts(rows, "at", 3, str(tmp_path / "in"))
    path = str(tmp_path / "masks")
    run(source(spark, rows.schema, str(tmp_path / "in")), lambda b, i: tracking.upsert(b, i, path), tmp_path, "append")
    assert sorted(map(tuple, tracking.masks(spark, path, "view").collect())) == sorted(map(tuple, tracking.latest(rows, "view", ["at"]).collect()))
