"""Queries over lookups, row filters, layouts and losses, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lookups, ranking
from ..sources import derived
from ..sources.derived import BOXES_SQL, FOREGROUND_SQL, FRAMES_SQL, PIXELS_SQL

FR = "WITH " + FRAMES_SQL
CANDS_SQL = "WITH c AS (SELECT l_orderkey AS key, l_linenumber % 3 AS cand, round(max(l_discount) * 100)::BIGINT AS score, round(max(l_tax) * 100)::BIGINT AS stability FROM lineitem GROUP BY 1, 2)"


def bands(spark, sf):
    p = derived.read(spark, sf, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    return p.select("p_partkey", (size >= 10).alias("large_enough"), scalars.between_strictly(size, 4, None).alias("no_noise"), scalars.between_strictly(size, 4, 40).alias("in_band"), ((price > 1000) & (size >= 5)).alias("kept"))


def uncropped(spark, sf):
    b = derived.boxes(spark, sf)
    return b.select("id", (F.col("x1") + F.col("grp") * 100).alias("x1"), (F.col("y1") + F.col("grp") * 50).alias("y1"), F.round((F.col("x2") - F.col("x1")) / 256, 6).alias("w"), F.round((F.col("y2") - F.col("y1")) / 128, 6).alias("h"), (F.col("x2") - F.col("x1") < 4).alias("degenerate"))


def layouts(spark, sf):
    w = F.col("p_size") * 43 + 300
    return derived.read(spark, sf, "part").select("p_partkey", (F.bround(w / 4, 0) * 4).cast("long").alias("by_four"), (w - 1 - F.col("p_partkey") % 300).cast("long").alias("flipped"), F.floor(F.lit(3) * w / 7).cast("long").alias("mosaic_start"))


def downsampled(spark, sf):
    fg = derived.foreground(spark, sf)
    return fg.groupBy("image_id", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x")).agg((F.count("*") / 16).alias("share"))


def members(spark, sf):
    p = derived.pixels(spark, sf)
    a = p.where("r > 150").select("image_id", "y", "x", (F.floor(F.col("y") / 16) * 8 + F.floor(F.col("x") / 16)).alias("label"))
    b = p.where("b > 100").select("image_id", "y", "x", (F.floor((F.col("y") + 8) / 16) * 9 + F.floor((F.col("x") + 8) / 16)).alias("other"))
    return lookups.memberships(a, b, ["image_id", "y", "x"])


def merged_cells(spark, sf):
    o = derived.read(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("long")
    cells = o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), (price > 200_000).alias("is_positive"), price.alias("marker"), (price % 251).alias("mean"), (F.col("o_orderkey") % 97).alias("centre"))
    scores = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), (price % 11).alias("score"))
    return lookups.merged_cells(derived.read(spark, sf, "customer").select(F.col("c_custkey").alias("grp")), cells, scores)


def resolved(spark, sf):
    c = derived.read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 2).alias("n_nationkey"))
    return c.join(derived.read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").select("c_custkey", "n_name", F.col("n_name").isNotNull().alias("found"))


def compatible(spark, sf):
    p = derived.read(spark, sf, "part")
    return lookups.compatible(p.select(F.col("p_brand").alias("a"), "p_size").distinct(), p.select(F.col("p_type").alias("b"), "p_size").distinct(), "p_size")


def masklets(spark, sf):
    d = derived.frames(spark, sf).select("video", "object", "frame", F.when(F.col("value") % 5 == 0, 0).otherwise(F.col("value") * F.col("value")).alias("area"))
    return lookups.masklets(d, ["video", "object"])


def losses(spark, sf):
    d = derived.frames(spark, sf).select("video", ((F.col("value") % 97 + 1) / 100).alias("p"), (F.col("object") == "click").cast("int").alias("t"))
    return lookups.losses(d, ["video"])


def errors(spark, sf):
    d = derived.frames(spark, sf).select("video", "object", (F.col("value") > 20).alias("found"), (F.col("value") % 3 > 0).alias("truth"))
    return lookups.errors(d, ["video", "object"])


def pyramid(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40 + 300).alias("w"), (F.col("p_size") * 30 + 401).alias("h"))
    return lookups.crop_pyramid(p, 2, 512 / 1500).withColumns({c: F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")})


def summaries(spark, sf):
    o = derived.read(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("n")).alias("e"))
    return o.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list("e"))).alias("summary"))


def metadata(spark, sf):
    c = derived.read(spark, sf, "customer")
    text = lambda col: F.col(col).cast("string")
    merged = lookups.overridden(F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("1")), F.create_map(F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("c"), text("c_nationkey")))
    return c.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("entries"), F.when(F.col("c_custkey") <= 255, 8).when(F.col("c_custkey") <= 65_535, 16).otherwise(32).alias("bits"))


def sequences(spark, sf):
    n = derived.read(spark, sf, "customer").select("c_custkey", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k"))
    angle = F.col("c_custkey") / F.pow(F.lit(10_000.0), F.col("k") / 4)
    start, length = scalars.clip_window(F.when(F.col("k") > 1, F.col("k").cast("double")), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("double")), 10.0)
    return n.select("c_custkey", "k", F.round(F.sin(angle), 6).alias("sine"), F.round(F.cos(angle), 6).alias("cosine"), start.alias("start"), length.alias("length"))


def patterns(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return p.where(F.col("p_type").rlike(scalars.glob_pattern("*S*")) & ~F.col("p_brand").rlike(scalars.glob_pattern("Brand#1?"))).select("p_partkey")


def annotations(spark, sf):
    d = derived.frames(spark, sf)
    kinds = {"manual": d.where("object = 'click'"), "auto": d.where("object = 'view' AND value > 10")}
    return kinds["manual"].select("video", "frame", F.lit("manual").alias("kind")).unionByName(kinds["auto"].select("video", "frame", F.lit("auto").alias("kind")))


def pages(spark, sf):
    c = derived.read(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 300).alias("folder"), "c_custkey", F.col("c_custkey").cast("string").alias("stem"))
    both = ranking.ranked(ranking.ranked(c, ["folder"], "stem", "lexical"), ["folder"], "c_custkey", "numeric")
    return both.select("c_custkey", F.col("lexical").cast("long").alias("lexical"), F.col("numeric").cast("long").alias("numeric"), F.floor((F.col("numeric") - 1) / 10).cast("long").alias("page"))


def object_masks(spark, sf):
    """Every object of a video in each of its frames; where it has no mask, an empty one."""
    d = derived.frames(spark, sf)
    every = d.select("video", "frame").join(d.select("video", "object").distinct(), "video")
    return every.join(d.select("video", "frame", "object", "value"), ["video", "frame", "object"], "left").select("video", "frame", "object", F.coalesce("value", F.lit(0)).alias("area"))


def mixture(spark, sf):
    n = derived.frames(spark, sf).groupBy("video").agg(F.ceil(F.count("*") / 8).alias("batches"))
    total = n.agg(F.sum("batches").alias("total"))  # one row
    return n.join(F.broadcast(total)).select("video", "batches", F.round(F.col("batches") / F.col("total"), 6).alias("share"))


def probes(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 4 * 90).alias("turn"))
    swap = F.col("turn").isin(90, 270)
    w, h = F.col("p_size") + 100, F.col("p_size") + 200
    return p.select("p_partkey", F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"), F.greatest(F.col("p_size").cast("long"), F.col("p_partkey") % 40).alias("duration"))


def partition_errors(spark, sf):
    line = derived.read(spark, sf, "lineitem")
    groups = line.where("l_quantity > 10").select("l_partkey", (F.col("l_linenumber") % 2).alias("grp"))
    return lookups.partition_errors(groups, derived.read(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")


def pointers(spark, sf):
    d = derived.frames(spark, sf)
    return lookups.pointers(d, d.where("value > 10"), 5)


def stable_choice(spark, sf):
    line = derived.read(spark, sf, "lineitem")
    hundred = lambda c: F.round(F.max(c) * 100).cast("long")
    c = line.groupBy(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 3).alias("cand")).agg(hundred("l_discount").alias("score"), hundred("l_tax").alias("stability"))
    return lookups.dynamic_choice(c, ["key"], 5).select("key", "cand")


def area_order(spark, sf):
    d = derived.frames(spark, sf).groupBy("video", "object").agg(F.sum("value").alias("area"))
    return ranking.ranked(d, ["video"], "area DESC, object").select("video", "object", F.col("place").cast("long").alias("place"))


def default_frames(spark, sf):
    d = derived.frames(spark, sf).withColumn("match", (F.col("object") == "click").cast("int"))
    return ranking.first_best(d, ["video"], "match DESC, frame").select("video", "frame", "object")


def grid_sizes(spark, sf):
    fg = derived.foreground(spark, sf)
    return fg.groupBy("image_id").agg((F.max(F.floor(F.col("y") / 32)) + 1).alias("n_rows"), (F.max(F.floor(F.col("x") / 32)) + 1).alias("n_cols"))


def fanned(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", "p_size")
    return lookups.fanned_back(p, "p_size", F.col("p_size") * F.col("p_size") + 1, "result").select("p_partkey", "result")


QUERIES = {
    "F06_F08_F13_bands": (bands, "SELECT p_partkey, p_size >= 10 AS large_enough, p_size > 4 AS no_noise, p_size > 4 AND p_size < 40 AS in_band, p_retailprice > 1000 AND p_size >= 5 AS kept FROM part"),
    "F15_F17_F28_uncrop": (uncropped, "WITH " + BOXES_SQL + " SELECT id, x1 + grp * 100 AS x1, y1 + grp * 50 AS y1, round((x2 - x1) / 256, 6) AS w, round((y2 - y1) / 128, 6) AS h, x2 - x1 < 4 AS degenerate FROM box"),
    "F24_X20_X21_layouts": (layouts, "SELECT p_partkey, CAST(round_even((p_size * 43 + 300) / 4, 0) * 4 AS BIGINT) AS by_four, (p_size * 43 + 299 - p_partkey % 300)::BIGINT AS flipped, (3 * (p_size * 43 + 300) // 7)::BIGINT AS mosaic_start FROM part"),
    "F26_downsampled": (downsampled, "WITH " + FOREGROUND_SQL + " SELECT image_id, (y // 4)::INT AS y, (x // 4)::INT AS x, count(*) / 16 AS share FROM fg GROUP BY 1, 2, 3"),
    "J05_J06_memberships": (members, "WITH " + PIXELS_SQL + """, a AS (SELECT image_id, y, x, y // 16 * 8 + x // 16 AS label FROM pix WHERE r > 150), b AS (SELECT image_id, y, x, (y + 8) // 16 * 9 + (x + 8) // 16 AS other FROM pix WHERE b > 100)
        SELECT image_id, label::BIGINT AS label, min(other)::BIGINT AS least, array_to_string(list_sort(list(DISTINCT other)), ';') AS members, count(*) AS shared FROM a JOIN b USING (image_id, y, x) GROUP BY 1, 2"""),
    "J08_A13_A14_merged_cells": (merged_cells, """WITH m AS (SELECT o_custkey AS grp, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderstatus FROM orders),
        s AS (SELECT grp, bool_or(price > 200000) AS is_positive, sum(price)::BIGINT AS marker, round(avg(price % 251), 6) AS mean, max(price % 251) AS most, min(price % 251) AS least, min_by(id % 97, id) AS centre, round(avg(CASE WHEN o_orderstatus <> 'F' THEN price % 11 ELSE 0 END), 6) AS score, count(*) AS n FROM m GROUP BY 1)
        SELECT c_custkey AS grp, coalesce(is_positive, false) AS is_positive, coalesce(marker, 0) AS marker, coalesce(mean, 0) AS mean, coalesce(most, 0) AS most, coalesce(least, 0) AS least, coalesce(centre, 0) AS centre, coalesce(score, 0) AS score, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON grp = c_custkey"""),
    "J14_resolved": (resolved, "SELECT c_custkey, n_name, n_name IS NOT NULL AS found FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2"),
    "J17_compatible": (compatible, "SELECT p.p_brand AS a, q.p_type AS b, count(DISTINCT p.p_size) AS n_common, min(p.p_size) AS first_common FROM (SELECT DISTINCT p_brand, p_size FROM part) p JOIN (SELECT DISTINCT p_type, p_size FROM part) q USING (p_size) GROUP BY 1, 2"),
    "J18_fanned_back": (fanned, "SELECT p_partkey, p_size * p_size + 1 AS result FROM part"),
    "W10_pointers": (pointers, FR + " SELECT a.video, a.frame, b.frame AS memory, a.frame - b.frame AS gap FROM frames a JOIN frames b ON a.video = b.video AND b.frame < a.frame AND b.frame > a.frame - 5 WHERE b.value > 10"),
    "W16_area_order": (area_order, FR + ", t AS (SELECT video, object, sum(value) AS area FROM frames GROUP BY 1, 2) SELECT video, object, row_number() OVER (PARTITION BY video ORDER BY area DESC, object) AS place FROM t"),
    "W17_stable_choice": (stable_choice, CANDS_SQL + " SELECT key, cand FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN cand = 0 AND stability >= 5 THEN 0 WHEN cand > 0 THEN 1 ELSE 2 END, score DESC, cand) AS k FROM c) WHERE k = 1"),
    "W20_default": (default_frames, FR + " SELECT video, frame, object FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY object = 'click' DESC, frame) AS k FROM frames) WHERE k = 1"),
    "A32_grid_sizes": (grid_sizes, "WITH " + FOREGROUND_SQL + " SELECT image_id, (max(y // 32) + 1)::BIGINT AS n_rows, (max(x // 32) + 1)::BIGINT AS n_cols FROM fg GROUP BY 1"),
    "A36_losses": (losses, FR + ", v AS (SELECT video, (value % 97 + 1) / 100 AS p, CASE WHEN object = 'click' THEN 1 ELSE 0 END AS t FROM frames), r AS (SELECT *, CASE WHEN t = 1 THEN p ELSE 1 - p END AS q FROM v) SELECT video, round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) AS dice, round(avg(CASE WHEN t = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * (1 - q) * (1 - q) * -ln(q)), 6) AS focal FROM r GROUP BY 1"),
    "A38_masklets": (masklets, FR + """, f AS (SELECT video, object, frame, CASE WHEN value % 5 = 0 THEN 0 ELSE value * value END AS area FROM frames), l AS (SELECT *, lag(area > 0) OVER (PARTITION BY video, object ORDER BY frame) AS before FROM f),
        g AS (SELECT video, object, avg(area) FILTER (area > 0) AS m, min(frame) FILTER (area > 0) AS first_frame, count(*) AS n_frames, count(*) FILTER (before <> (area > 0)) AS changes FROM l GROUP BY 1, 2)
        SELECT video, object, round(m, 6) AS mean_area, CASE WHEN m < 1024 THEN 'small' WHEN m < 9216 THEN 'medium' WHEN m IS NOT NULL THEN 'large' END AS size, first_frame, n_frames, changes FROM g"""),
    "A40_errors": (errors, FR + ", e AS (SELECT video, object, value > 20 AS found, value % 3 > 0 AS truth FROM frames) SELECT video, object, count(*) FILTER (found AND NOT truth) AS n_fp, count(*) FILTER (NOT found AND truth) AS n_fn, bool_and(found = truth) AS all_right FROM e GROUP BY 1, 2"),
    "A41_partition_errors": (partition_errors, "SELECT p_partkey AS l_partkey, count(DISTINCT grp) AS n_groups FROM part LEFT JOIN (SELECT l_partkey, l_linenumber % 2 AS grp FROM lineitem WHERE l_quantity > 10) ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT grp) <> 1"),
    "K07_K08_metadata": (metadata, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a=0;b=' || c_nationkey ELSE 'a=0;b=1;c=' || c_nationkey END AS entries, CASE WHEN c_custkey <= 255 THEN 8 WHEN c_custkey <= 65535 THEN 16 ELSE 32 END AS bits FROM customer"),
    "K18_summaries": (summaries, "SELECT o_custkey, '[' || string_agg('{\"k\":' || o_orderkey || ',\"n\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS summary FROM orders GROUP BY 1"),
    "X09_crop_pyramid": (pyramid, f"""WITH p AS (SELECT p_partkey, p_size * 40 + 300 AS w, p_size * 30 + 401 AS h FROM part), l AS (SELECT *, (1 << layer)::INT AS side FROM p, (VALUES (0), (1), (2)) v(layer)),
        o AS (SELECT *, CASE WHEN layer = 0 THEN 0 ELSE CAST(trunc({512 / 1500}::DOUBLE * least(w, h) * 2 / side) AS INT) END AS overlap FROM l),
        c AS (SELECT *, ceil((overlap * (side - 1) + w) / side)::BIGINT AS cw, ceil((overlap * (side - 1) + h) / side)::BIGINT AS ch FROM o)
        SELECT p_partkey, w, h, layer, ((cw - overlap) * i)::BIGINT AS x1, ((ch - overlap) * j)::BIGINT AS y1, least((cw - overlap) * i + cw, w)::BIGINT AS x2, least((ch - overlap) * j + ch, h)::BIGINT AS y2 FROM c JOIN range(4) a(i) ON i < side JOIN range(4) b(j) ON j < side"""),
    "X18_X19_sequences": (sequences, """SELECT c_custkey, k, round(sin(c_custkey / pow(10000.0, k / 4)), 6) AS sine, round(cos(c_custkey / pow(10000.0, k / 4)), 6) AS cosine, CASE WHEN k > 1 THEN k ELSE 0 END::DOUBLE AS start, CASE WHEN c_custkey % 3 > 0 THEN least(c_custkey, 10) ELSE 10 END::DOUBLE AS length
        FROM customer, (VALUES (0), (1), (2), (3)) v(k)"""),
    "U06_patterns": (patterns, "SELECT p_partkey FROM part WHERE p_type GLOB '*S*' AND NOT p_brand GLOB 'Brand#1?'"),
    "U07_annotations": (annotations, FR + " SELECT video, frame, 'manual' AS kind FROM frames WHERE object = 'click' UNION ALL SELECT video, frame, 'auto' FROM frames WHERE object = 'view' AND value > 10"),
    "T01_T06_pages": (pages, "SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey // 300 ORDER BY c_custkey::VARCHAR) AS lexical, row_number() OVER (PARTITION BY c_custkey // 300 ORDER BY c_custkey) AS numeric, (row_number() OVER (PARTITION BY c_custkey // 300 ORDER BY c_custkey) - 1) // 10 AS page FROM customer"),
    "S13_S14_object_masks": (object_masks, FR + " SELECT a.video, a.frame, o.object, CASE WHEN a.object = o.object THEN a.value ELSE 0 END AS area FROM frames a JOIN (SELECT DISTINCT video, object FROM frames) o ON o.video = a.video"),
    "S27_probes": (probes, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_size + 200 ELSE p_size + 100 END AS w, CASE WHEN p_partkey % 2 = 1 THEN p_size + 100 ELSE p_size + 200 END AS h, greatest(p_size, p_partkey % 40)::BIGINT AS duration FROM part"),
    "R05_mixture": (mixture, FR + ", n AS (SELECT video, ceil(count(*) / 8)::BIGINT AS batches FROM frames GROUP BY 1) SELECT video, batches, round(batches / sum(batches) OVER (), 6) AS share FROM n"),
}
