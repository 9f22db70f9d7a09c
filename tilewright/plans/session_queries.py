"""Queries over sessions and evaluations, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..operators.graph import cut
from ..sources import derived
from ..streaming import prompts, tracking


def final_state(spark, sf):
    return prompts.final_state(prompts.requests_of(derived.read(spark, sf, "events")))


def windows(spark, sf):
    return prompts.windowed(derived.read(spark, sf, "events"))


def opened(spark, sf):
    """Sessions that sign-ups open and errors close."""
    e = derived.read(spark, sf, "events")
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "close").otherwise("points")
    return prompts.session_states(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), action.alias("action")))


def removed(spark, sf):
    """The prompt state without each session's second object; in odd sessions an object that is not there."""
    state = final_state(spark, sf)
    gone = state.select("session").distinct().select("session", F.when(F.col("session") % 2 == 0, 1).otherwise(9).alias("obj"))
    out = prompts.without_object(state, gone)
    return out.select("session", "obj", "frame", F.col("idx").cast("long").alias("idx"), F.array_join(F.transform("affected", lambda f: f.cast("string")), ";").alias("affected"))


def consolidated(spark, sf):
    d = derived.frames(spark, sf).select(F.col("video").alias("session"), F.col("object").alias("obj"), "frame", "value")
    return prompts.consolidated(d.where("value > 15").withColumn("value", F.col("value") * 10), d.where("frame % 2 = 0"))


def propagated(spark, sf):
    d = derived.frames(spark, sf)
    starts = d.groupBy(F.col("video").alias("session")).agg(F.min(F.when(F.col("value") > 15, F.col("frame"))).alias("start"), (F.max("frame") + 1).alias("n_frames")).where("start IS NOT NULL")
    return prompts.propagation(starts, 12)


FRAME, WIDTH = 32, 128


def _objects(pix):
    """Objects of the frames 0 to 3 of a video: every image is one, cut into strips."""
    at = pix.select(F.col("image_id").alias("video"), F.floor(F.col("y") / FRAME).cast("int").alias("frame"), F.floor(F.col("x") / 43).cast("int").alias("object"), (F.col("y") % FRAME).alias("y"), "x", "r", "g", "b")
    return at.where("object <> 1 OR frame > video % 3")


def _evaluated(spark, sf):
    """Truth, in which some videos lack object 2, and prediction."""
    pix = cut(_objects(derived.pixels(spark, sf)))
    truth = pix.where("r + b > 120 AND g <= 80 AND (object <> 2 OR video % 3 > 0)").select(*evaluation.OF, "y", "x")
    found = pix.where("r + b > 150 AND g <= 60").select(*evaluation.OF, "y", "x")
    size = lambda df: df.select("video", F.explode(F.array(*(F.lit(k) for k in range(WIDTH // FRAME)))).alias("frame"), F.lit(FRAME).alias("height"), F.lit(WIDTH).alias("width"))
    return truth, found, evaluation.matched_frames(size(truth.select("video").distinct()), size(found.select("video").distinct()))


def evaluated(spark, sf):
    """Per object of the truth and over all: overlap and boundary measure."""
    return evaluation.report(evaluation.object_scores(*_evaluated(spark, sf), FRAME, WIDTH))


def strict_match(spark, sf):
    """Keys on one side only, by a full join."""
    a = derived.frames(spark, sf).where("value > 30").select("video", "object").distinct().withColumn("truth", F.lit(True))
    b = derived.frames(spark, sf).where("frame > 20").select("video", "object").distinct().withColumn("found", F.lit(True))
    return a.join(b, ["video", "object"], "full").select("video", "object", F.coalesce("truth", F.lit(False)).alias("truth"), F.coalesce("found", F.lit(False)).alias("found"))


def messages(spark, sf):
    """Messages of tracking streams: views are frames, clicks prompts or requests, and so on."""
    e, whole = derived.read(spark, sf, "events"), F.floor(F.col("value") * 100).cast("long")
    kind = (
        F.when(F.col("event_type") == "view", "frame")
        .when(F.col("event_type") == "click", F.when(whole % 2 == 0, "stream").otherwise("frame"))
        .when(F.col("event_type") == "purchase", F.when(whole % 3 == 0, "prompt").otherwise("abort"))
        .when(F.col("event_type") == "signup", F.when(whole % 4 == 0, "end").otherwise("cancelled"))
        .otherwise(F.when(whole % 5 == 0, "open").when(whole % 5 == 1, "clear").otherwise("end"))
    )
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), kind.alias("kind"), (whole % 50).alias("frame"), "ts")


EMPTY = "P1"


def latest_masks(spark, sf):
    """The last mask of each session, object and frame; some are empty, some dropped."""
    e, whole = derived.read(spark, sf, "events"), F.floor(F.col("value") * 100).cast("long")
    code = F.when(whole % 7 == 0, F.lit(None)).when(whole % 5 == 0, EMPTY).otherwise(F.concat(F.lit("c"), whole.cast("string")))
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), (whole % 3).alias("object"), (whole % 10).alias("frame"), code.alias("code"))
    return tracking.latest(rows, EMPTY, ["at"])


REQUESTS = """req AS (SELECT user_id AS session, event_id AS at_, CASE WHEN event_type = 'view' THEN 'mask' WHEN event_type IN ('click', 'purchase') THEN 'points' WHEN event_type = 'signup' THEN 'clear' WHEN value > 100 THEN 'reset' ELSE 'remove' END AS action,
  CAST(floor(floor(value * 100) / 7) AS BIGINT) % 4 AS obj, CAST(floor(value * 100) AS BIGINT) % 3 AS frame FROM events)"""

def _edge_sql(name: str) -> str:
    near = lambda dy, dx: f"bool_or(dy = {dy} AND dx = {dx})"
    return f"""e{name} AS (SELECT video, frame, object, y - dy AS y, x - dx AS x, {near(0, 0)} AS m, {near(0, 1)} AS e, {near(1, 0)} AS s, {near(1, 1)} AS se
      FROM {name}, (VALUES (0,0),(0,1),(1,0),(1,1)) d(dy, dx) WHERE y >= dy AND x >= dx GROUP BY 1, 2, 3, 4, 5),
    b{name} AS (SELECT video, frame, object, y, x FROM e{name} WHERE CASE WHEN y = {FRAME - 1} AND x = {WIDTH - 1} THEN false WHEN y = {FRAME - 1} THEN m <> e WHEN x = {WIDTH - 1} THEN m <> s ELSE m <> e OR m <> s OR m <> se END)"""


def _near_sql(one: str, other: str, name: str) -> str:
    return f"""{name} AS (SELECT video, frame, object, count(*) AS hits FROM b{one} p WHERE EXISTS (SELECT 1 FROM b{other} q, (VALUES (0,0),(0,1),(0,2),(1,0),(1,1),(2,0),(0,-1),(0,-2),(-1,0),(-1,-1),(-2,0),(1,-1),(-1,1)) d(dy, dx)
      WHERE q.video = p.video AND q.frame = p.frame AND q.object = p.object AND q.y = p.y + dy AND q.x = p.x + dx) GROUP BY 1, 2, 3)"""


#: Samples of an object begin where truth or prediction first has it; objects that only the prediction has are left out.
EVALUATED_SQL = derived.PIXELS_SQL + f""", o AS (SELECT image_id AS video, y // {FRAME} AS frame, x // 43 AS object, y % {FRAME} AS y, x, r, g, b FROM pix),
t AS (SELECT * FROM o WHERE (object <> 1 OR frame > video % 3) AND r + b > 120 AND g <= 80 AND (object <> 2 OR video % 3 > 0)), p AS (SELECT * FROM o WHERE (object <> 1 OR frame > video % 3) AND r + b > 150 AND g <= 60),
first AS (SELECT video, object, min(frame) AS frame FROM (SELECT video, object, frame FROM t UNION ALL SELECT video, object, frame FROM p) GROUP BY 1, 2),
keys AS (SELECT video, object, k::INT AS frame FROM first, range(4) r(k) WHERE k >= frame AND (video, object) IN (SELECT (video, object) FROM t)),
u AS (SELECT video, frame, object, count(*) FILTER (t.r IS NOT NULL AND p.r IS NOT NULL) / count(*) AS iou FROM t FULL JOIN p USING (video, frame, object, y, x) GROUP BY 1, 2, 3),
{_edge_sql("t")}, {_edge_sql("p")}, {_near_sql("p", "t", "hp")}, {_near_sql("t", "p", "ht")},
nt AS (SELECT video, frame, object, count(*) AS n_t FROM bt GROUP BY 1, 2, 3), np AS (SELECT video, frame, object, count(*) AS n_p FROM bp GROUP BY 1, 2, 3),
m AS (SELECT keys.*, coalesce(iou, 1) AS iou, CASE WHEN n_p IS NULL THEN 1.0 WHEN n_t IS NULL THEN 0 ELSE coalesce(hp.hits, 0) / n_p END AS prec, CASE WHEN n_t IS NULL THEN 1.0 WHEN n_p IS NULL THEN 0 ELSE coalesce(ht.hits, 0) / n_t END AS rec
  FROM keys LEFT JOIN u USING (video, frame, object) LEFT JOIN nt USING (video, frame, object) LEFT JOIN np USING (video, frame, object) LEFT JOIN hp USING (video, frame, object) LEFT JOIN ht USING (video, frame, object)),
per AS (SELECT video, object, 100 * avg(round(iou, 6)) AS j, 100 * avg(round(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END, 6)) AS f FROM m GROUP BY 1, 2)"""

STREAM_SQL = """WITH m AS (
  SELECT user_id AS session, event_id AS at_, w % 50 AS frame, CASE event_type WHEN 'view' THEN 'frame' WHEN 'click' THEN CASE WHEN w % 2 = 0 THEN 'stream' ELSE 'frame' END
    WHEN 'purchase' THEN CASE WHEN w % 3 = 0 THEN 'prompt' ELSE 'abort' END WHEN 'signup' THEN CASE WHEN w % 4 = 0 THEN 'end' ELSE 'cancelled' END
    ELSE CASE w % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'clear' ELSE 'end' END END AS kind
  FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS w FROM events)
), r AS (SELECT *, (SELECT max(p.at_) FROM m p WHERE p.session = m.session AND p.at_ <= m.at_ AND p.kind IN ('stream', 'open')) AS began FROM m
), b AS (SELECT r.*, k.kind = 'stream' AS is_run FROM r LEFT JOIN m k ON k.session = r.session AND k.at_ = r.began
), e AS (SELECT *, (SELECT min(q.at_) FROM m q WHERE q.session = b.session AND q.at_ > b.began AND q.kind = 'end') AS next_end FROM b
), a AS (SELECT *, (SELECT min(q.at_) FROM r q WHERE q.session = e.session AND q.began = e.began AND q.kind = 'abort' AND (next_end IS NULL OR q.at_ < next_end)) AS abort_at FROM e
), c AS (SELECT *, (SELECT min(q.at_) FROM r q WHERE q.session = a.session AND q.began = a.began AND (q.kind = 'end' OR q.kind = 'cancelled' AND q.at_ > abort_at)) AS stop_at FROM a
), n AS (SELECT session, at_, kind, frame, CASE WHEN kind IN ('open', 'clear') THEN 'none' WHEN kind = 'prompt' THEN 'required' WHEN kind = 'stream' THEN 'requesting' WHEN NOT coalesce(is_run, false) THEN NULL
    WHEN kind = 'frame' AND NOT coalesce(at_ > abort_at, false) AND NOT coalesce(at_ > stop_at, false) THEN 'partial' WHEN kind = 'abort' AND at_ = abort_at THEN 'aborting'
    WHEN at_ = stop_at THEN CASE WHEN abort_at IS NOT NULL THEN 'aborted' ELSE 'full' END END AS new FROM c
), s AS (SELECT *, coalesce(lag(new) OVER (PARTITION BY session ORDER BY at_), 'none') AS before FROM n WHERE new IS NOT NULL)
SELECT session, at_ AS at, 'state' AS what, new AS state, NULL::BIGINT AS frame FROM s WHERE kind = 'open' OR new <> before UNION ALL SELECT session, at_, 'frame', NULL, frame FROM s WHERE new = 'partial'"""

QUERIES = {
    "Z09_Z12_stream_states": (lambda s, f: tracking.delivered(messages(s, f)), STREAM_SQL),
    "Z11_latest_masks": (latest_masks, """WITH m AS (SELECT user_id AS session, event_id AS at_, w % 3 AS object, w % 10 AS frame, CASE WHEN w % 7 = 0 THEN NULL WHEN w % 5 = 0 THEN 'P1' ELSE 'c' || w END AS code FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS w FROM events))
        SELECT session, object, frame, at_ AS at, code, code = 'P1' AS is_empty FROM (SELECT *, row_number() OVER (PARTITION BY session, object, frame ORDER BY at_ DESC) AS k FROM m) WHERE k = 1 AND code IS NOT NULL"""),
    "Z02_Z06_prompt_sessions": (final_state, "WITH " + REQUESTS + """, m AS (SELECT q.*, (SELECT coalesce(max(at_), -1) FROM req r WHERE r.session = q.session AND (r.action = 'reset' OR r.action = 'remove' AND r.obj = q.obj OR r.action = 'clear' AND r.obj = q.obj AND r.frame = q.frame)) AS cut FROM (SELECT DISTINCT session, obj, frame FROM req) q),
        n AS (SELECT session, obj, frame, cut, max(at_) FILTER (action = 'mask' AND at_ > cut) AS mask_at FROM m JOIN req USING (session, obj, frame) GROUP BY 1, 2, 3, 4),
        p AS (SELECT session, obj, frame, mask_at, count(*) FILTER (action = 'points' AND at_ > greatest(cut, coalesce(mask_at, -1))) AS n_points FROM n JOIN req USING (session, obj, frame) GROUP BY 1, 2, 3, 4)
        SELECT session, obj, frame, CASE WHEN n_points > 0 THEN 'points' ELSE 'mask' END AS kind, n_points FROM p WHERE n_points > 0 OR mask_at IS NOT NULL"""),
    "addition_tumbling_windows": (windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2"),
    "J09_A27_A28_A29_K12_evaluation": (evaluated, "WITH " + EVALUATED_SQL + """ SELECT 'Global score' AS sequence, '' AS obj, round((avg(j) + avg(f)) / 2 + 1e-9::DOUBLE, 6) AS jf, round(avg(j), 6) AS j, round(avg(f), 6) AS f FROM per
        UNION ALL SELECT video::VARCHAR, lpad(object::VARCHAR, 3, '0'), round((j + f) / 2 + 1e-9::DOUBLE, 6), round(j, 6), round(f, 6) FROM per"""),
    "Z01_sessions": (opened, """WITH r AS (SELECT user_id AS session, event_id AS at_, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'close' ELSE 'points' END AS action FROM events),
        p AS (SELECT *, max(at_) FILTER (action = 'start') OVER w AS s, max(at_) FILTER (action <> 'points') OVER w AS t FROM r WINDOW w AS (PARTITION BY session ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT session, coalesce(max(at_) FILTER (action = 'start') > coalesce(max(at_) FILTER (action = 'close'), -1), false) AS is_open, count(*) FILTER (action <> 'start' AND NOT coalesce(s = t, false)) AS n_refused, count(*) FILTER (action = 'start') AS n_starts FROM p GROUP BY 1"""),
    "Z06_removed_objects": (removed, "WITH st AS (" + "{STATE}" + """), a AS (SELECT session, array_to_string(list_sort(list(DISTINCT frame)), ';') AS affected FROM st WHERE session % 2 = 0 AND obj = 1 GROUP BY 1), l AS (SELECT * FROM st WHERE NOT (session % 2 = 0 AND obj = 1))
        SELECT session, obj, frame, dense_rank() OVER (PARTITION BY session ORDER BY obj) - 1 AS idx, affected FROM l LEFT JOIN a USING (session)"""),
    "Z07_consolidated": (consolidated, "WITH " + derived.FRAMES_SQL + " SELECT video AS session, object AS obj, frame, value * 10 AS value, true AS is_prompted FROM frames WHERE value > 15 UNION ALL SELECT video, object, frame, value, false FROM frames WHERE frame % 2 = 0 AND NOT value > 15"),
    "Z08_Z09_propagation": (propagated, "WITH " + derived.FRAMES_SQL + """, s AS (SELECT video AS session, min(frame) FILTER (value > 15) AS start, max(frame) + 1 AS n FROM frames GROUP BY 1)
        SELECT session, 'forward' AS direction, k::INT AS step, (start + k)::INT AS frame FROM s, range(13) r(k) WHERE start + k <= n - 1 UNION ALL SELECT session, 'backward', k::INT, (start - k)::INT FROM s, range(13) r(k) WHERE start > 0 AND start - k >= 0"""),
    "J10_strict_match": (strict_match, "WITH " + derived.FRAMES_SQL + ", a AS (SELECT DISTINCT video, object, true AS truth FROM frames WHERE value > 30), b AS (SELECT DISTINCT video, object, true AS found FROM frames WHERE frame > 20) SELECT video, object, coalesce(truth, false) AS truth, coalesce(found, false) AS found FROM a FULL JOIN b USING (video, object)"),
}
QUERIES["Z06_removed_objects"] = (removed, QUERIES["Z06_removed_objects"][1].replace("{STATE}", QUERIES["Z02_Z06_prompt_sessions"][1]))
