"""Prompt sessions: the state that a sequence of requests leaves behind.

A request names a session, an object and a frame.  ``points`` adds a point and
supersedes a mask on that frame; ``mask`` supersedes the points; ``clear`` empties the
frame; ``remove`` drops the object; ``reset`` drops everything of the session.

``final_state`` computes the outcome for a table of requests with windows and sums.
``follow`` keeps it for a stream, keyed by session, and emits a session's state
whenever requests for it came in; a session without any is one row of kind ``gone``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "session long, obj long, frame long, kind string, n_points long"


def final_state(requests: DataFrame) -> DataFrame:
    """What is left per session, object and frame after all requests (session, at, action, obj, frame)."""
    when = lambda *a: F.when(F.col("action").isin(*a), F.col("at"))
    resets = requests.groupBy("session").agg(F.max(when("reset")).alias("reset_at"))
    removed = requests.groupBy("session", "obj").agg(F.max(when("remove")).alias("remove_at"))
    frame = requests.groupBy("session", "obj", "frame").agg(F.max(when("clear")).alias("clear_at"), F.max(when("mask")).alias("mask_at"), F.max(when("points")).alias("points_at"))
    cut = F.greatest(F.coalesce("reset_at", F.lit(-1)), F.coalesce("remove_at", F.lit(-1)), F.coalesce("clear_at", F.lit(-1)))
    ends = frame.join(removed, ["session", "obj"]).join(resets, "session").withColumn("cut", cut)
    ends = ends.select("session", "obj", "frame", "cut", F.when(F.col("mask_at") > F.col("cut"), F.col("mask_at")).alias("mask_at"))
    points = requests.where("action = 'points'").join(ends, ["session", "obj", "frame"]).where(F.col("at") > F.greatest("cut", F.coalesce("mask_at", F.lit(-1))))
    counted = points.groupBy("session", "obj", "frame").agg(F.count("*").alias("n_points"))
    out = ends.join(counted, ["session", "obj", "frame"], "left").where("mask_at IS NOT NULL OR n_points IS NOT NULL")
    return out.select("session", "obj", "frame", F.when(F.col("n_points").isNotNull(), "points").otherwise("mask").alias("kind"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def apply(state: dict[tuple[int, int], int], action: str, obj: int, frame: int) -> None:
    """One request; a frame holds its number of points, or 0 for a mask."""
    if action == "reset":
        state.clear()
    elif action == "remove":
        for key in [k for k in state if k[0] == obj]:
            del state[key]
    elif action == "clear":
        state.pop((obj, frame), None)
    elif action == "mask":
        state[obj, frame] = 0
    elif action == "points":
        state[obj, frame] = state.get((obj, frame), 0) + 1


def _session(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state = {(o, f): n for o, f, n in zip(*held.get)} if held.exists else {}
    for row in pd.concat(list(parts)).sort_values("at").itertuples():
        apply(state, row.action, row.obj, row.frame)
    objs, frames, counts = ([k[0] for k in state], [k[1] for k in state], list(state.values()))
    if not state:  # consumers must hear that nothing is left
        if held.exists:
            held.remove()
        yield pd.DataFrame({"session": [key[0]], "obj": [None], "frame": [None], "kind": ["gone"], "n_points": [0]}).astype({"obj": "Int64", "frame": "Int64"})
        return
    held.update((objs, frames, counts))
    yield pd.DataFrame({"session": key[0], "obj": objs, "frame": frames, "kind": ["points" if n else "mask" for n in counts], "n_points": counts})


def follow(requests: DataFrame) -> DataFrame:
    """A stream of the sessions' states; requests of a session have to arrive in order."""
    return requests.groupBy("session").applyInPandasWithState(_session, STATE, "objs array<long>, frames array<long>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def session_states(requests: DataFrame) -> DataFrame:
    """Per session whether it is open after all requests, and how many requests came while it was not.

    ``requests`` has session, at, action; ``start`` opens a session, ``close`` ends it with all that it holds.
    """
    last = "max(IF(action IN ({}), at, NULL)) OVER (PARTITION BY session ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = requests.withColumns({"_turn": F.expr(last.format("'start', 'close'")), "_start": F.expr(last.format("'start'"))})
    refused = ~F.col("action").isin("start") & ~F.coalesce(F.col("_turn") == F.col("_start"), F.lit(False))
    ends = [F.max(F.when(F.col("action") == a, F.col("at"))) for a in ("start", "close")]
    is_open = F.coalesce(ends[0] > F.coalesce(ends[1], F.lit(-1)), F.lit(False))
    return placed.groupBy("session").agg(is_open.alias("is_open"), F.count_if(refused).alias("n_refused"), F.count_if(F.col("action") == "start").alias("n_starts"))


def without_object(state: DataFrame, gone: DataFrame) -> DataFrame:
    """The state (session, obj, frame, ...) after one object of each session (session, obj) is removed.

    The other objects get dense numbers (idx); ``affected`` lists the removed object's frames, null if it was not there.
    """
    named = gone.select("session", F.col("obj").alias("_gone"))
    affected = state.join(named, "session").where("obj = _gone").groupBy("session").agg(F.sort_array(F.collect_set("frame")).alias("affected"))
    left = state.join(named, "session", "left").where("_gone IS NULL OR obj <> _gone").drop("_gone")
    return left.withColumn("idx", F.expr("dense_rank() OVER (PARTITION BY session ORDER BY obj) - 1")).join(affected, "session", "left")


def consolidated(prompted: DataFrame, tracked: DataFrame) -> DataFrame:
    """Outputs before tracking starts, by (session, obj, frame): those of prompted frames, and others where there are none.

    A session without a prompted frame is an error.
    """
    key = ["session", "obj", "frame"]
    rest = tracked.join(prompted.select(*key), key, "left_anti").withColumn("is_prompted", F.lit(False))
    has = prompted.select("session").distinct().withColumn("_has", F.lit(True))
    checked = rest.join(has, "session", "left").withColumn("session", F.when(F.col("_has"), F.col("session")).otherwise(F.raise_error(F.concat(F.lit("no prompts in session "), F.col("session").cast("string"))).cast("long")))
    return prompted.withColumn("is_prompted", F.lit(True)).unionByName(checked.drop("_has"))


def propagation(starts: DataFrame, most: int | None = None) -> DataFrame:
    """The order in which frames are tracked: session, direction, step, frame.

    ``starts`` has session, start (the first prompted frame) and n_frames.  Forwards goes from the start
    to the last frame, backwards from the start to the first, where there is one before it; each
    goes at most ``most`` frames beyond the start.
    """
    far = F.lit(most if most is not None else 1 << 30)
    last, first = F.least(F.col("start") + far, F.col("n_frames") - 1), F.greatest(F.col("start") - far, F.lit(0))
    runs = F.array(F.struct(F.lit("forward").alias("direction"), F.sequence("start", last).alias("frames")), F.struct(F.lit("backward").alias("direction"), F.when(F.col("start") > 0, F.sequence(F.col("start"), first)).alias("frames")))
    each = starts.select("session", F.explode(runs).alias("r"))
    return each.select("session", F.col("r.direction").alias("direction"), F.posexplode("r.frames").alias("step", "frame"))


def requests_of(events: DataFrame) -> DataFrame:
    """Requests made from the events table."""
    action = F.when(F.col("event_type") == "view", "mask").when(F.col("event_type").isin("click", "purchase"), "points").when(F.col("event_type") == "signup", "clear").when(F.col("value") > 100, "reset").otherwise("remove")
    whole = F.floor(F.col("value") * 100).cast("long")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), action.alias("action"), (F.floor(whole / 7) % 4).alias("obj"), (whole % 3).alias("frame"))


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition of our own: event counts in tumbling windows, closed by a watermark where it streams."""
    # event time has to be a timestamp with a zone
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
