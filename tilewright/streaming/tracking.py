"""Tracked masks as they arrive: the state of a session's stream, bounded memory, and the table of latest masks.

Messages (session, at, kind, frame) come in the order of ``at`` within a session.
``open`` begins with nothing (state none); ``prompt`` means that tracking is required; ``clear``
drops all prompts (none); ``stream`` requests tracking; each ``frame`` is a result
(partial); ``end`` completes it (full).  ``abort`` while a stream runs sets its cancel flag: the state is aborting,
and frames that still come are dropped; ``cancelled``, the end of the stream, or no
such message for ``patience`` of event time make it aborted.

``delivered`` does this for a table with windows; ``Delivery`` for a stream, with state
kept by ``transformWithStateInPandas`` (the session needs the RocksDB state store).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session long, at long, what string, state string, frame long"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def step(state: str, streaming: bool, aborted: bool, kind: str) -> tuple[str, bool, bool, bool]:
    """One message: the new state, whether a stream runs, its cancel flag, and whether a frame is delivered."""
    if kind == "open":
        return "none", False, False, False
    if kind == "prompt":
        return "required", streaming, aborted, False
    if kind == "clear":
        return "none", streaming, aborted, False
    if kind == "stream":
        return "requesting", True, False, False
    if kind == "frame" and streaming and not aborted:
        return "partial", True, False, True
    if kind == "abort" and streaming and not aborted:
        return "aborting", True, True, False
    if kind == "end" and streaming:
        return ("aborted" if aborted else "full"), False, False, False
    if kind in ("cancelled", "patience") and streaming and aborted:
        return "aborted", False, False, False
    return state, streaming, aborted, False


class Delivery(StatefulProcessor):
    """Keyed by session; emits a row for each change of state (``open`` always) and for each frame delivered."""

    def __init__(self, patience_ms: int | None = None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, streaming boolean, aborted boolean, at long")

    def _take(self, key: tuple, kinds: Iterator[tuple[str, int, int | None]]) -> Iterator[pd.DataFrame]:
        state, streaming, aborted, last = self.held.get() if self.held.exists() else ("none", False, False, -1)
        rows = []
        for kind, at, frame in kinds:
            new, streaming, aborted, sent = step(state, streaming, aborted, kind)
            if new != state or kind == "open":
                rows.append((key[0], at, "state", new, None))
            if sent:
                rows.append((key[0], at, "frame", None, frame))
            state, last = new, at
        self.held.update((state, streaming, aborted, last))
        if rows:
            yield pd.DataFrame(rows, columns=["session", "at", "what", "state", "frame"]).astype({"frame": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("at")
        yield from self._take(key, ((k, int(a), None if pd.isna(f) else int(f)) for k, a, f in zip(part["kind"], part["at"], part["frame"])))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.held.get()[0] == "aborting":
                self.handle.registerTimer(int(part["ts"].max().timestamp() * 1000) + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield from self._take(key, iter([("patience", self.held.get()[3], None)]))

    def close(self) -> None:
        pass


def deliver(messages: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """The stream of state changes and delivered frames.

    With ``patience_ms`` the messages need a column ``ts`` with a watermark.
    """
    return messages.groupBy("session").transformWithStateInPandas(Delivery(patience_ms), OUTPUT, "Update", "None" if patience_ms is None else "EventTime")


def delivered(messages: DataFrame) -> DataFrame:
    """The same rows for a whole table, without the timer."""
    # a run begins with a stream or with an open, and ends at the first end, or at the first cancelled after its abort
    run = F.count(F.when(F.col("kind").isin("stream", "open"), 1)).over(Window.partitionBy("session").orderBy("at"))
    within = Window.partitionBy("session", "run")
    first = lambda kind, when=F.lit(True): F.min(F.when((F.col("kind") == kind) & when, F.col("at"))).over(within)
    never = F.lit((1 << 62) + 1)
    rows = messages.select("session", "at", "kind", "frame").withColumn("run", run)
    rows = rows.withColumn("is_run", F.coalesce(F.max(F.col("kind") == "stream").over(within), F.lit(False))).withColumn("end_at", F.coalesce(first("end"), never))
    rows = rows.withColumn("abort_at", F.coalesce(first("abort", F.col("at") < F.col("end_at")), never))
    rows = rows.withColumn("stop_at", F.least("end_at", F.coalesce(first("cancelled", F.col("at") > F.col("abort_at")), never)))
    at, kind, runs = F.col("at"), F.col("kind"), F.col("is_run")
    new = (
        F.when(kind.isin("open", "clear"), "none")
        .when(kind == "prompt", "required")
        .when(kind == "stream", "requesting")
        .when(runs & (kind == "frame") & (at < F.col("abort_at")) & (at < F.col("stop_at")), "partial")
        .when(runs & (kind == "abort") & (at == F.col("abort_at")), "aborting")
        .when(runs & (at == F.col("stop_at")), F.when(at > F.col("abort_at"), "aborted").otherwise("full"))
    )
    changes = rows.withColumn("new", new).where("new IS NOT NULL")
    before = F.coalesce(F.lag("new").over(Window.partitionBy("session").orderBy("at")), F.lit("none"))
    states = changes.withColumn("before", before).where("kind = 'open' OR new <> before").select("session", "at", F.lit("state").alias("what"), F.col("new").alias("state"), F.lit(None).cast("long").alias("frame"))
    frames = changes.where("new = 'partial'").select("session", "at", F.lit("frame").alias("what"), F.lit(None).cast("string").alias("state"), F.col("frame").cast("long").alias("frame"))
    return states.unionByName(frames)


class Memory(StatefulProcessor):
    """Keyed by session and direction: each frame with the remembered frames it looks back to.

    The list holds the last frame and those at multiples of the stride that a later frame can still
    need: at most ``n`` values, however long the stream is.
    """

    def __init__(self, n: int, stride: int):
        self.n, self.stride = n, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "frame long, value long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sign = 1 if key[1] == "forward" else -1
        part = pd.concat(list(rows))
        part = part.iloc[(sign * part["frame"]).argsort(kind="stable")]
        held = dict(self.ring.get())
        out = []
        for frame, value in zip(part["frame"].tolist(), part["value"].tolist()):
            found = [(pos, at) for pos, at in wanted(frame, self.n, self.stride, sign) if at in held]
            out += [(*key, frame, pos, at, held[at], len(held)) for pos, at in found]
            held[frame] = value
            # what the next frame may still look back to
            least = min([sign * at for _, at in wanted(frame + sign, self.n, self.stride, sign)])
            held = {f: v for f, v in held.items() if f == frame or f % self.stride == 0 and sign * f >= least}
        self.ring.put(list(held.items()))
        if out:
            yield pd.DataFrame(out, columns=["session", "direction", "frame", "pos", "memory", "memory_value", "n_held"])

    def close(self) -> None:
        pass


def wanted(frame: int, n: int, stride: int, sign: int) -> list[tuple[int, int]]:
    """Where a frame looks back: position 1 is the frame tracked before, the others lie at multiples of the stride beyond it."""
    begin = (frame - 2) // stride * stride if sign > 0 else -(-(frame + 2) // stride) * stride
    return [(1, frame - sign), *((k, begin - sign * (k - 2) * stride) for k in range(2, n))]


def remember(frames: DataFrame, n: int, stride: int) -> DataFrame:
    """The stream of look-backs for frames (session, direction, frame, value) that come in tracking order."""
    return frames.groupBy("session", "direction").transformWithStateInPandas(Memory(n, stride), "session long, direction string, frame long, pos int, memory long, memory_value long, n_held int", "Append", "None")


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """For ``foreachBatch``: adds a batch of masks (session, object, frame, at, code) to the table of changes at ``path``.

    Only a batch's last row of each key is kept; a null code drops the mask.  A batch that is replayed overwrites
    what it has written, so the table is the same after it.
    """
    key = ["session", "object", "frame"]
    last = batch.groupBy(*key).agg(F.max_by(F.struct("at", "code"), "at").alias("m")).select(*key, "m.at", "m.code")
    last.write.mode("overwrite").parquet(f"{path}/kind=change/upto={batch_id}")


def _changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session long, object long, frame long, at long, code string, kind string, upto long").option("basePath", path).parquet(path)


def latest(changes: DataFrame, empty_code: str, order: list[str]) -> DataFrame:
    """The last mask of each key, and whether it is the code of an empty mask; dropped ones are left out."""
    last = changes.groupBy("session", "object", "frame").agg(F.max_by(F.struct("at", "code"), F.struct(*order)).alias("m"))
    return last.select("session", "object", "frame", "m.at", "m.code", (F.col("m.code") == empty_code).alias("is_empty")).where("code IS NOT NULL")


def masks(spark: SparkSession, path: str, empty_code: str) -> DataFrame:
    """The table as it is: the newest base and the changes after it, the last one of each key."""
    rows = _changes(spark, path)
    base = rows.where("kind = 'base'").agg(F.max("upto")).first()[0]
    since = -1 if base is None else base
    return latest(rows.where((F.col("upto") > since) | (F.col("kind") == "base") & (F.col("upto") == since)), empty_code, ["upto", "at"])


def compact(spark: SparkSession, path: str, empty_code: str) -> None:
    """Writes the table as it is as a new base, so that older changes need not be read again."""
    newest = _changes(spark, path).agg(F.max("upto")).first()[0]
    if newest is not None:
        masks(spark, path, empty_code).drop("is_empty").write.mode("overwrite").parquet(f"{path}/kind=base/upto={newest}")
