"""Multipart streams cut anywhere give the parts that were written."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.streaming import multipart, tracking

BODIES = ['{"a": 1}', "", "naïve 日本 \U0001f600", "--frame\r\nContent-Length: 3\r\n\r\nabc", "\r\n\r\n", "x" * 700, "--frame\r\n", "--frame\r\nbroken\r\n\r\n", "{}"]


def stream_of(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "at int, body string")
    return b"".join(bytes(r.m) for r in rows.select("at", multipart.message(F.col("body")).alias("m")).orderBy("at").collect())


def cut_up(data, rng, most):
    out = []
    while data:
        n = rng.randint(1, most)
        out.append(data[:n])
        data = data[n:]
    return out


def test_a_message_tells_its_length_in_bytes(spark):
    data = stream_of(spark, ["é"])
    assert data == b"--frame\r\nContent-Type: application/json; charset=utf-8\r\nFrame-Current: -1\r\nFrame-Total: -1\r\nMask-Type: RLE[]\r\nContent-Length: 2\r\n\r\n\xc3\xa9"


def test_any_cut_gives_the_same_parts(spark, monkeypatch):
    rng, data = random.Random(2), stream_of(spark, BODIES)
    for most in (1, 2, 7, 10_000):
        parser, got = multipart.Parser(), []
        for chunk in cut_up(b"\r\n" + data + b"\r\n\r\n", rng, most):
            got += parser.feed(chunk)
        parser.close()
        assert [b.decode() for _, b in got] == BODIES and got[2][0]["Content-Length"] == str(len(BODIES[2].encode()))


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_tables_of_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(multipart, "BLOCK", block)
    monkeypatch.setattr(multipart, "MOST_HEADERS", 256)
    rng, good = random.Random(3), stream_of(spark, BODIES)
    streams = {
        "tiny": (cut_up(good, rng, 3), BODIES, None), "whole": ([good], BODIES, None), "blank": (cut_up(b"\r\n" * 3 + good + b"\r\n" * 40, rng, 90), BODIES, None),
        "short": (cut_up(good[:-1], rng, 50), BODIES[:-1], "multipart stream ended mid-part"), "head": ([good, b"--frame\r\nContent-Le"], BODIES, "multipart stream ended mid-part"),
        "bad": (cut_up(good + b"oops--frame\r\n", rng, 20), BODIES, "bad part boundary"), "none": ([b"", None], [], None),
        "line": ([good, b"--frame\r\nContent-Length 3\r\n\r\nabc"], BODIES, 'bad part header line (no ": ")'), "size": ([good, b"--frame\r\nA: b\r\n\r\nabc"], BODIES, "missing/invalid part Content-Length"),
        "cr": ([good, b"--frame\r\nA\rb"], BODIES, "bad part header line (CR without NL)"),
    }
    rows = [(name, k, None if c is None else bytearray(c)) for name, (chunks, _, _) in streams.items() for k, c in enumerate(chunks)]
    found, damaged = multipart.parts(spark.createDataFrame(rows, "stream string, seq long, data binary"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.stream, r.part)):
        got.setdefault(r.stream, []).append(bytes(r.body).decode())
        assert r.headers["Content-Length"] == str(len(r.body))
    assert got == {name: bodies for name, (_, bodies, _) in streams.items() if bodies}
    assert {r.stream: r.problem for r in damaged.collect()} == {name: p for name, (_, _, p) in streams.items() if p}


def test_few_rows_are_written_between_steps(spark, monkeypatch):
    written, cut = [], multipart.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(multipart, "cut", counted)
    data, n = stream_of(spark, BODIES), 60
    rows = [(name, k, bytearray(c)) for name in "abcdef" for k, c in enumerate(cut_up(data * 10, random.Random(7), 90))]
    found, damaged = multipart.parts(spark.createDataFrame(rows, "stream string, seq long, data binary"))
    assert found.count() == n * len(BODIES) and damaged.isEmpty()
    # not a row for each place of each stream, of which a part has several
    assert sum(written) < 2 * n * len(BODIES)


@pytest.mark.parametrize("most", [0, 100_000])
def test_long_chunks_and_bodies_over_many_blocks(spark, monkeypatch, most):
    for name, value in (("BLOCK", 300), ("MOST_HEADERS", 200), ("PIECE", 64), ("MAX_BROADCAST", most)):
        monkeypatch.setattr(multipart, name, value)
    bodies = {"long": ["y" * 2500, "", "--frame\r\n" * 200, "z"], "one": ["w" * 100], "many": [f"{k}" * 40 for k in range(12)]}
    rows = [(name, k, bytearray(c)) for name, b in bodies.items() for k, c in enumerate(cut_up(stream_of(spark, b), random.Random(5), 700))]
    rows += [("wordy", 0, bytearray(b"--frame\r\nA: " + b"a" * 900 + b"\r\nContent-Length: 1\r\n\r\nx"))]
    random.Random(6).shuffle(rows)
    found, damaged = multipart.parts(spark.createDataFrame(rows, "stream string, seq long, data binary"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.stream, r.part)):
        assert r.part == len(got.setdefault(r.stream, []))
        got[r.stream].append(bytes(r.body).decode())
    assert got == bodies
    assert [(r.stream, r.problem) for r in damaged.collect()] == [("wordy", "headers too long")]


def test_files_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(s, k, f"{s} {b}") for s in (1, 2) for k, b in enumerate(BODIES)], "session long, at long, body string")
    multipart.write(frames, str(tmp_path))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("stream"), F.lit(0).cast("long").alias("seq"), F.col("content").alias("data"))
    found, damaged = multipart.parts(files)
    assert sorted((r.stream.rsplit("/", 1)[1], r.part, bytes(r.body).decode()) for r in found.collect()) == [(f"{s}.multipart", k, f"{s} {b}") for s in (1, 2) for k, b in enumerate(BODIES)]
    assert damaged.isEmpty()


def test_streams_as_their_chunks_arrive(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in tracking.STORE}
    for k, v in tracking.STORE.items():
        spark.conf.set(k, v)
    try:
        rng, good = random.Random(4), stream_of(spark, BODIES)
        chunks = {"a": cut_up(good, rng, 400), "b": cut_up(good[:-1], rng, 400)}
        for part in range(3):
            rows = [(s, k, bytearray(c), k == len(cs) - 1) for s, cs in chunks.items() for k, c in enumerate(cs) if k * 3 // len(cs) == part]
            spark.createDataFrame(rows, "stream string, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("stream string, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = []
        query = multipart.follow(source).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [bytes(r.body).decode() for r in sorted(got, key=lambda r: r.part) if r.stream == "a"] == BODIES
    b = sorted((r for r in got if r.stream == "b"), key=lambda r: r.part)
    assert [r.problem for r in b] == [None] * (len(BODIES) - 1) + ["multipart stream ended mid-part"]
