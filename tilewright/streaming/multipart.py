"""Multipart streams: one part a frame, written as messages, read back from chunks that are cut anywhere.

A message is ``--<boundary>``, header lines, ``Content-Length``, an empty line and the body.
Bodies may hold anything, the boundary too, so where a part begins is known only from the part before.

``parts`` reads whole streams from a table of chunks without following long ones in one task.  Chunks are
sorted into ranges, and a stream of at most a block that lies in one range is read where it lies.  In the blocks of other streams every
place that looks like a boundary is read as if a part began there, and followed until its parts
leave the block.  Only the places where they enter other blocks meet in joins; their steps are composed by doubling, as
a prefix scan does: after k rounds the places within 2**k blocks of the
beginning are known.  ``follow`` reads streams as their chunks arrive, with the bytes of an
unfinished part as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.blocks import group_numbers
from ..operators.graph import cut, shuffled
from ..sources import named_files

BOUNDARY = "frame"
#: The headers of a part of masks, before its length.
HEADERS = {"Content-Type": "application/json; charset=utf-8", "Frame-Current": "-1", "Frame-Total": "-1", "Mask-Type": "RLE[]"}
#: Bytes of a stream that a task looks at, and the most that a part's headers may take.
BLOCK, MOST_HEADERS = 1 << 20, 1 << 14
#: Bytes of a chunk that travel in a row, and rows of a side of a join that are broadcast at most.
PIECE, MAX_BROADCAST = 1 << 16, 100_000


def message(body: Column, boundary: str = BOUNDARY, headers: dict[str, str] = HEADERS) -> Column:
    """The bytes of a part with this body (a string)."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    data = F.encode(body, "UTF-8")
    return F.concat(F.lit(f"--{boundary}\r\n{lines}Content-Length: ".encode()), F.encode(F.octet_length(data).cast("string"), "UTF-8"), F.lit(b"\r\n\r\n"), data)


def write(frames: DataFrame, path: str, boundary: str = BOUNDARY) -> None:
    """The stream of each session (session, at, body) as a file ``<session>.multipart``, parts in the order of ``at``."""
    files = frames.select(F.concat(F.col("session").cast("string"), F.lit(".multipart")).alias("name"), "at", message(F.col("body"), boundary).alias("content"))
    named_files.write(files, path, order=["at"])


class Parser:
    """Reads parts from pieces of a stream; what is left between pieces is at most one unfinished part."""

    def __init__(self, boundary: str = BOUNDARY, rest: bytes = b""):
        self.start, self.rest = f"--{boundary}\r\n".encode(), rest

    def feed(self, data: bytes) -> list[tuple[dict[str, str], bytes]]:
        self.rest += data
        out, at = [], 0
        while (found := self._part(at)) is not None:
            out.append(found[:2])
            at = found[2]
        while self.rest[at : at + 2] == b"\r\n":
            at += 2
        self.rest = self.rest[at:]
        return out

    def _part(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        while self.rest[at : at + 2] == b"\r\n":
            at += 2
        begun = self.rest[at : at + len(self.start)]
        if not (self.start.startswith(begun) or begun == b"\r"):
            raise ValueError("bad part boundary")
        if len(begun) < len(self.start):
            return None
        read = headers_at(self.rest, at + len(self.start))
        if read is None:
            return None
        headers, body, size = read
        return (headers, self.rest[body : body + size], body + size) if len(self.rest) >= body + size else None

    def close(self) -> None:
        if self.rest:
            raise ValueError("multipart stream ended mid-part")


def headers_at(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """The headers from here on, where the body begins, and its length; None if they do not end."""
    headers: dict[str, str] = {}
    while True:
        end = data.find(b"\r", at)
        if end < 0 or end + 1 >= len(data):
            return None
        if data[end + 1] != 10:
            raise ValueError("bad part header line (CR without NL)")
        line, at = data[at:end].decode("utf-8", "replace"), end + 2
        if not line:
            length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
            if not length.strip().isdecimal():
                raise ValueError("missing/invalid part Content-Length")
            return headers, at, int(length)
        name, colon, value = line.partition(": ")
        if not colon:
            raise ValueError('bad part header line (no ": ")')
        headers[name] = f"{headers[name]}, {value}" if name in headers else value


def _few(df: DataFrame) -> DataFrame:
    """A side of a join that is broadcast only while it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else shuffled(df)


def _fragments(chunks: DataFrame) -> DataFrame:
    """What lies together of a stream in a task's range of chunks: stream, task, seq (of the first chunk), at (from the range's beginning), size, alone (not the only fragment here if false), data (at most BLOCK bytes)."""
    most = BLOCK
    size = F.octet_length("data")
    rows = chunks.where("octet_length(data) > 0 AND stream IS NOT NULL AND seq IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int"))))
    rows = rows.withColumn("data", F.when(size > PIECE, F.expr(f"substring(data, k * {PIECE} + 1, {PIECE})")).otherwise(F.col("data")))
    gives = StructType([rows.schema["stream"], StructField("task", IntegerType()), rows.schema["seq"], *StructType.fromDDL("at long, size int, alone boolean, data binary").fields])
    schema = pa.schema([("stream", pa.string()), ("task", pa.int32()), ("seq", to_arrow_type(rows.schema["seq"].dataType)), ("at", pa.int64()), ("size", pa.int32()), ("alone", pa.bool_()), ("data", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stream, seq, at, held, n = TaskContext.get().partitionId(), None, None, 0, [], 0

        def fragments() -> Iterator[tuple]:
            nonlocal stream, seq, at, held, n
            for batch in batches:
                column = batch.column("data").cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = memoryview(column.buffers()[2])
                begin = np.flatnonzero(np.diff(group_numbers(pa.Table.from_batches([batch]), ["stream"]), prepend=-1))
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(column)]):
                    name, here, end = batch.column("stream")[a].as_py(), int(offsets[a]), int(offsets[b])
                    if name != stream:
                        if n:
                            yield stream, task, seq, at, n, at == 0, b"".join(held)
                        stream, seq, at, held, n = name, batch.column("seq")[a].as_py(), 0, [], 0
                    while here < end:
                        if n == most:
                            yield stream, task, seq, at, n, False, b"".join(held)
                            at, held, n = at + n, [], 0
                        to = min(end, here + most - n)
                        held.append(bytes(data[here:to]))
                        n, here = n + to - here, to
            if n:
                yield stream, task, seq, at, n, at == 0, b"".join(held)

        yield from _batches(fragments(), schema, 4)

    ranged = rows.repartitionByRange("stream", "seq", "k").sortWithinPartitions("stream", "seq", "k")
    return ranged.select("stream", "seq", "data").mapInArrow(gather, gives)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Batches of few rows or bytes; ``sized`` is the field of a row's bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += row[sized]
        if len(held) == 10_000 or n >= 4 * (1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _blocks(chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Streams that lie together in one fragment (stream, length, data), and the blocks of all others.

    These have stream, block, length and data: BLOCK bytes and those after it that headers may take.
    """
    fragments = cut(_fragments(chunks))
    runs = fragments.groupBy("stream", "task").agg(F.min("seq").alias("seq"), F.sum("size").alias("size"), F.min("alone").alias("alone"))
    of = Window.partitionBy("stream")
    runs = runs.select("stream", "task", "alone", F.count("*").over(of).alias("n"), F.sum("size").over(of).alias("length"), (F.sum("size").over(of.orderBy("seq", "task")) - F.col("size")).alias("before"))
    spread = cut(runs.where("n > 1 OR NOT alone").select("stream", "task", "length", "before"))
    if spread.isEmpty():
        return fragments.select("stream", F.col("size").cast("long").alias("length"), "data"), None
    few, on = _few(spread), ["stream", "task"]
    whole = fragments.join(few, on, "left_anti").select("stream", F.col("size").cast("long").alias("length"), "data")
    found = fragments.join(few, on).withColumn("at", F.col("at") + F.col("before"))
    # a piece for each block that a fragment reaches, and for the block before where it lies in its margin
    first, last = F.greatest(F.floor((F.col("at") - MOST_HEADERS) / BLOCK), F.lit(0)), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    dealt = found.withColumn("block", F.explode(F.sequence(first, last)))
    begin, end = F.greatest("at", F.col("block") * BLOCK), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK + MOST_HEADERS)
    piece = dealt.select("stream", "block", "length", begin.alias("from"), "data", "at", end.alias("to")).where("to > `from`")
    piece = piece.select("stream", "block", "length", "from", F.expr("substring(data, CAST(`from` - at + 1 AS INT), CAST(to - `from` AS INT))").alias("data"))
    joined = piece.groupBy("stream", "block", "length").agg(F.sort_array(F.collect_list(F.struct("from", "data"))).alias("p"))
    data = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))  # BLOCK + MOST_HEADERS bytes at most
    return whole, cut(joined.select("stream", "block", "length", data.alias("data")))


class _Reader:
    """Reads parts of the bytes ``data`` of a stream of ``length`` bytes that begin at ``offset``; headers met before are not read again.

    ``full`` are the bytes of a block that ends before its stream does.
    """

    def __init__(self, boundary: str, full: int):
        self.start, self.full, self.known = f"--{boundary}\r\n".encode(), full, {}

    def part(self, data: bytes, at: int, offset: int, length: int) -> tuple[list | None, int, int]:
        """The part at a place of ``data`` (headers, where its body begins and ends in the stream), without headers for an empty line."""
        if data.startswith(b"\r\n", at):
            return None, offset + at + 2, offset + at + 2
        if not data.startswith(self.start, at):
            raise ValueError("bad part boundary")
        begin = at + len(self.start)
        end = data.find(b"\r\n\r\n", begin, begin + 1024) + 4
        text = data[begin:end] if end > 3 else None
        read = self.known.get(text)
        if read is None:
            read = headers_at(data, begin)
            if read is None:
                raise ValueError("headers too long" if len(data) >= self.full else "multipart stream ended mid-part")
            read = list(read[0].items()), read[1] - begin, read[2]
            if text is not None and len(text) == read[1]:
                if len(self.known) >= 4096:
                    self.known.clear()
                self.known[text] = read
        headers, skip, size = read
        body = offset + begin + skip
        if body + size > length:
            raise ValueError("multipart stream ended mid-part")
        return headers, body, body + size


def _ways(blocks: DataFrame, boundary: str) -> DataFrame:
    """For each place of a block where a part could begin, and empty lines: where the parts from there on lead beyond the block (next, null if to no place of the stream), and how many they are.

    A place that leads nowhere and has no part is left out.
    """
    schema, side = pa.schema([("stream", pa.string()), ("place", pa.int64()), ("next", pa.int64()), ("n", pa.int64()), ("bytes", pa.int32())]), BLOCK
    full = BLOCK + MOST_HEADERS

    def follow_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(boundary, full)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for stream, block, length, data in zip(*batch.columns):
                    stream, offset, length, data, places = stream.as_py(), block.as_py() * side, length.as_py(), data.as_py(), []
                    for mark in (b"\r\n", reader.start):
                        at = data.find(mark)
                        while 0 <= at < side:
                            places.append(at)
                            at = data.find(mark, at + 1)
                    leads: dict[int, tuple[int | None, int]] = {}
                    for at in sorted(places, reverse=True):
                        try:
                            headers, _, to = reader.part(data, at, offset, length)
                        except ValueError:
                            continue
                        on, n = (None if to >= length else to, 0) if to >= min(length, offset + side) else leads.get(to - offset, (None, 0))
                        n += headers is not None
                        if n or on is not None:
                            leads[at] = on, n
                            yield stream, offset + at, on, n, 0

        yield from _batches(rows(), schema, 4)

    return blocks.select("stream", "block", "length", "data").mapInArrow(follow_all, "stream string, place long, next long, n long, bytes int").drop("bytes")


def _read(sources: DataFrame, boundary: str, what: str) -> DataFrame:
    """Follows parts from ``place`` on in ``data``, from ``offset`` on in the stream, until they leave the block; ``first`` is the number of the first.

    Gives parts whose bodies lie in the data (``whole``), the places of bodies that do not (``long``), or problems (``damaged``).
    """
    side, full = BLOCK, BLOCK + MOST_HEADERS
    wanted = {"whole": "stream string, part long, headers map<string,string>, body binary, bytes int", "long": "stream string, part long, headers map<string,string>, from long, to long, bytes int", "damaged": "stream string, problem string, bytes int"}[what]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in wanted.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(boundary, full)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for stream, length, offset, place, first, data in zip(*batch.columns):
                    stream, length, offset, place, part, data = (v.as_py() for v in (stream, length, offset, place, first, data))
                    try:
                        while place < min(length, offset + side):
                            headers, body, place = reader.part(data, place - offset, offset, length)
                            if headers is None:
                                continue
                            inside = place <= offset + len(data)
                            if what == "whole" and inside:
                                yield stream, part, headers, data[body - offset : place - offset], place - body
                            elif what == "long" and not inside:
                                yield stream, part, headers, body, place, 0
                            part += 1
                    except ValueError as e:
                        if what == "damaged":
                            yield stream, str(e), 0

        yield from _batches(rows(), schema, len(schema) - 1)

    return sources.select("stream", "length", "offset", "place", "first", "data").mapInArrow(read, wanted).drop("bytes")


def _entered(blocks: DataFrame, boundary: str) -> DataFrame:
    """Where the parts of each stream enter its blocks, and the number of the first part from there on: stream, block, place, first."""
    ways = cut(_ways(blocks, boundary))
    starts = blocks.where("block = 0").select("stream", F.lit(0).cast("long").alias("place"))
    # only these places are met from other blocks
    entries = cut(ways.where("next IS NOT NULL").select("stream", F.col("next").alias("place")).unionByName(starts).distinct())
    leads = cut(ways.join(_few(entries), ["stream", "place"]))
    # reach: places known to lie on the way from the beginning; jump: where 2**k steps lead
    jump, reach = leads.select("stream", "place", "next"), cut(starts)
    while True:
        further = reach.join(shuffled(jump), ["stream", "place"]).where("next IS NOT NULL").select("stream", F.col("next").alias("place"))
        if further.join(shuffled(reach), ["stream", "place"], "left_anti").isEmpty():
            break
        reach = cut(reach.unionByName(further).distinct())
        on = jump.select(F.col("stream").alias("s"), F.col("place").alias("p"), F.col("next").alias("after"))
        moving = jump.where("next IS NOT NULL")  # ends are not joined, so no key is common
        jump = cut(moving.join(shuffled(on), (F.col("stream") == F.col("s")) & (F.col("next") == F.col("p")), "left").select("stream", "place", F.col("after").alias("next")).unionByName(jump.where("next IS NULL")))
    n = F.coalesce("n", F.lit(0))
    way = reach.join(shuffled(leads), ["stream", "place"], "left").withColumn("first", F.sum(n).over(Window.partitionBy("stream").orderBy("place")) - n)
    return cut(way.select("stream", F.floor(F.col("place") / BLOCK).alias("block"), "place", "first"))


def parts(chunks: DataFrame, boundary: str = BOUNDARY) -> tuple[DataFrame, DataFrame]:
    """From chunks (stream, seq, data): the parts (stream, part, headers, body), and each damaged stream's problem (stream, problem).

    Parts are numbered in their order.  A stream that ends within a part, or where no boundary is where one has to be,
    has a problem; the parts before it are there all the same.  A null or empty chunk adds nothing.
    """
    zero = lambda name: F.lit(0).cast("long").alias(name)
    whole, blocks = _blocks(chunks.select(F.col("stream").cast("string").alias("stream"), "seq", "data"))
    sources, long_ = whole.select("stream", "length", zero("offset"), zero("place"), zero("first"), "data"), None
    if blocks is not None:
        entered = blocks.join(_few(_entered(blocks, boundary)), ["stream", "block"]).select("stream", "length", (F.col("block") * BLOCK).alias("offset"), "place", "first", "data")
        sources = sources.unionByName(entered)
        long_ = cut(_read(entered, boundary, "long"))
    found, damaged = _read(sources, boundary, "whole"), _read(sources, boundary, "damaged")
    if long_ is None or long_.isEmpty():
        return found, damaged
    covered = long_.select("stream", "part", "headers", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("to") - 1) / BLOCK))).alias("block"))
    from_, to = F.greatest("from", F.col("block") * BLOCK), F.least("to", (F.col("block") + 1) * BLOCK)
    pieces = blocks.join(_few(covered.select("stream", "part", "headers", "block", from_.alias("from"), to.alias("to"))), ["stream", "block"])
    cut_out = F.expr(f"substring(data, CAST(`from` - block * {BLOCK}L + 1 AS INT), CAST(to - `from` AS INT))")
    joined = pieces.groupBy("stream", "part").agg(F.first("headers").alias("headers"), F.sort_array(F.collect_list(F.struct("block", cut_out.alias("data")))).alias("p"))
    return found.unionByName(joined.select("stream", "part", "headers", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["data"])).alias("body"))), damaged


class Follow(StatefulProcessor):
    """Keyed by stream; emits parts as they become whole, and the problem of a stream, after which it is deaf."""

    def __init__(self, boundary: str = BOUNDARY):
        self.boundary = boundary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rest binary, n long, problem string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, n, problem = self.held.get() if self.held.exists() else (b"", 0, None)
        chunks = pd.concat(list(rows)).sort_values("seq")
        parser, found = Parser(self.boundary, bytes(rest)), []
        for data, last in zip(chunks["data"], chunks["last"]):
            if problem is None:
                try:
                    found += parser.feed(bytes(data or b""))
                    if last:
                        parser.close()
                except ValueError as e:
                    problem = str(e)
                    found.append((None, None))
        self.held.update((parser.rest if problem is None else b"", n + len(found), problem))
        if found:
            yield pd.DataFrame([(key[0], n + k, list(h.values())[-1] if h else None, b, None if h else problem) for k, (h, b) in enumerate(found)], columns=["stream", "part", "length", "body", "problem"])

    def close(self) -> None:
        pass


def follow(chunks: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """The stream of parts (stream, part, length, body, problem) from chunks (stream, seq, data, last) that come in order."""
    return chunks.groupBy("stream").transformWithStateInPandas(Follow(boundary), "stream string, part long, length string, body binary, problem string", "Append", "None")
