"""Plausibility gates, clocks and light, and geometry."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import clock, media, numbers
from ridgeline.operators import gates
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, r6_binary, read
from ridgeline.sources import payloads

_FIX = m.SAMPLES + ", fixes AS (SELECT asset, event_id, t, value, CASE WHEN asset % 3 = 0 THEN NULL WHEN asset % 3 = 1 THEN k % 2 * 1.0 ELSE k % 4 * 1.0 END AS fix, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 12 * 1.0 END AS dop FROM samples)"


def _fixes(spark, d):
    k, a = F.col("k"), F.col("asset")
    return m.samples(spark, d).select("asset", "event_id", "t", "value", F.when(a % 3 == 1, k % 2 * 1.0).when(a % 3 == 2, k % 4 * 1.0).alias("fix"), F.when(k % 5 != 0, k % 12 * 1.0).alias("dop"))


@query("lock_gate", f"WITH {_FIX} SELECT event_id, CASE WHEN max(fix) OVER w >= 2 THEN CASE WHEN fix >= 1.5 THEN value END WHEN max(fix) OVER w IS NOT NULL THEN NULL ELSE value END AS value FROM fixes WINDOW w AS (PARTITION BY asset)")
def lock_gate(spark, d):
    return gates.lock_gate(_fixes(spark, d), "asset", "value", "fix").select("event_id", "value")


@query("dop_gate", f"WITH {_FIX} SELECT event_id, CASE WHEN coalesce(dop <= 6, true) AND coalesce(fix >= 1.5, true) THEN value END AS altitude, CASE WHEN coalesce(dop <= 6, true) AND value / 10 < 30 THEN value / 10 END AS speed FROM fixes")
def dop_gate(spark, d):
    speed = gates.plausible_speed(F.col("value") / 10)
    return _fixes(spark, d).select("event_id", gates.dop_gate(F.col("value"), F.col("dop"), F.col("fix")).alias("altitude"), gates.dop_gate(speed, F.col("dop")).alias("speed"))


@query("bound_by_speed", f"WITH {_FIX}, g AS (SELECT asset, (value - 245) / 60 AS grade, dop AS speed FROM fixes), b AS (SELECT asset, grade, CASE WHEN abs(grade) <= greatest(0.35, coalesce(abs(speed) * 0.6, 3.0)) THEN grade END AS kept FROM g) SELECT asset, count(kept) AS kept, round(sum(kept), 6) AS total, round(count(*) FILTER (grade IS NOT NULL AND kept IS NULL) / count(grade), 6) AS rejected FROM b GROUP BY asset")
def bound_by_speed(spark, d):
    g = _fixes(spark, d).select("asset", ((F.col("value") - 245) / 60).alias("grade"), F.col("dop").cast("decimal(21,1)").alias("speed"))
    b = g.withColumn("kept", gates.bound_by_speed(F.col("grade"), F.col("speed")))
    share = F.coalesce(gates.rejected_share(F.col("grade"), F.col("kept")), F.lit(math.nan))  # the SQL's 0 / 0
    return b.groupBy("asset").agg(F.count("kept").alias("n"), r6_binary(F.sum("kept")).alias("total"), r6_binary(share).alias("rejected")).withColumnRenamed("n", "kept")


@query(
    "detection_priors",
    """WITH b AS (SELECT l_orderkey AS frame, CASE WHEN l_linenumber = 7 THEN 0 ELSE 18 END AS class_id, l_discount * 10 AS score, l_partkey % 97 / 100.0 AS x0, l_suppkey % 89 / 100.0 AS y0, l_partkey % 97 / 100.0 + l_quantity / 300 AS x1, l_suppkey % 89 / 100.0 + l_tax AS y1 FROM lineitem),
    o AS (SELECT frame, score >= 0.10 AND (x1 - x0) * (y1 - y0) BETWEEN 0.0015 AND 0.030 AND NOT ((x0 < 0.02 OR x1 > 0.98) AND x1 - x0 > 0.12) AS ok FROM b WHERE class_id = 18) SELECT frame, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS n_rejected FROM o GROUP BY frame""",
)
def detection_priors(spark, d):
    x0, y0 = F.col("l_partkey") % 97 / 100.0, F.col("l_suppkey") % 89 / 100.0
    boxes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.when(F.col("l_linenumber") == 7, 0).otherwise(18).alias("class_id"), (F.col("l_discount") * 10).alias("score"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") / 300).alias("x1"), (y0 + F.col("l_tax")).alias("y1"))
    return gates.detection_priors(boxes, ["frame"])


@query("framing_gate", f"WITH {m.SAMPLES}, c AS (SELECT asset, CAST(floor(t / 12) AS BIGINT) AS clip, count(*) AS n, count(*) FILTER (value < 40) AS hits FROM samples GROUP BY 1, 2) SELECT asset, clip, n, hits, coalesce(CASE WHEN n = 0 THEN 'not covered' WHEN hits / n < 0.15 THEN 'too few hits' END, 'follow') AS framing FROM c")
def framing_gate(spark, d):
    c = m.samples(spark, d).groupBy("asset", F.floor(F.col("t") / 12).alias("clip")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 40).alias("hits"))
    return c.withColumn("framing", F.coalesce(gates.framing_gate(F.col("hits"), F.col("n")), F.lit("follow")))


_LOCKED = m.SAMPLES + ", locked AS (SELECT asset, t, 8766.0 + floor(epoch(ts) / 86400) - 19723 AS days, epoch(ts) - floor(epoch(ts) / 86400) * 86400 AS secs, k % 4 AS fix FROM samples)"


@query("gps_start", f"WITH {_LOCKED} SELECT asset, count(*) AS n, round(quantile_cont(946684800 + days * 86400 + (secs - t), 0.5), 3) AS started FROM locked WHERE fix >= 2 AND days > 3650 GROUP BY asset HAVING count(*) >= 10")
def gps_start(spark, d):
    e = clock.epoch(F.col("ts"))
    day = F.floor(e / 86400)
    own = m.samples(spark, d).select("asset", "t", (8766.0 + day - 19723).alias("days"), (e - day * 86400).alias("secs"), (F.col("k") % 4).alias("fix")).where("fix >= 2 and days > 3650")
    out = own.groupBy("asset").agg(F.count("*").alias("n"), F.round(F.percentile(clock.gps_epoch(F.col("days"), F.col("secs"), F.col("t")), F.lit(0.5)), 3).alias("started"))
    return out.where("n >= 10")


@query("clock_drift", "WITH c AS (SELECT o_orderkey AS id, epoch(o_orderdate) AS container, epoch(o_orderdate) + o_custkey % 700 - 350 AS gps FROM orders) SELECT id, gps - container AS drift_s, CASE WHEN abs(gps - container) > 300 THEN gps ELSE container END AS recorded FROM c")
def clock_drift(spark, d):
    container = clock.epoch(F.col("o_orderdate"))
    gps = container + F.col("o_custkey") % 700 - 350
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (gps - container).alias("drift_s"), F.when(F.abs(gps - container) > 300, gps).otherwise(container).alias("recorded"))


@query(
    "lighting_label",
    f"""WITH {m.ASSETS}, x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal / 100 - 40 END AS elevation, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 10 END AS iso, c_custkey % 4 AS k FROM customer)
    SELECT id, CASE WHEN elevation IS NULL THEN 'unknown' WHEN elevation > 0 THEN 'day' WHEN elevation > -6 THEN 'twilight' ELSE 'night' END AS by_sun, CASE WHEN iso IS NULL THEN NULL WHEN iso < 400 THEN 'day' ELSE 'unknown' END AS by_exposure,
      CASE WHEN k = 0 THEN 'hand' WHEN k = 1 THEN '-' WHEN elevation IS NOT NULL THEN 'sun' ELSE 'exposure' END AS source FROM x""",
)
def lighting_label(spark, d):
    k = F.col("c_custkey")
    x = read(spark, d, "customer").select(k.alias("id"), F.when(k % 6 > 0, F.col("c_acctbal") / 100 - 40).alias("elevation"), F.when(k % 5 > 0, F.col("c_acctbal") / 10).alias("iso"), (k % 4).alias("k"))
    source = clock.lighting_source(F.when(F.col("k") == 0, "hand"), F.when(F.col("k") != 1, "day"), F.col("elevation"))
    return x.select("id", clock.lighting_label(F.col("elevation")).alias("by_sun"), clock.exposure_label(F.col("iso")).alias("by_exposure"), source.alias("source"))


def _vector(i):
    return F.get("embedding", F.lit(i - 1)).cast("double")


@query("upright_from_mean", "WITH g AS (SELECT label, vec_id % 20 AS part, avg(embedding[1]::DOUBLE) * 6 AS g0, avg(embedding[2]::DOUBLE) * 6 AS g1 FROM embeddings GROUP BY 1, 2) SELECT label, part, CASE WHEN greatest(abs(g0), abs(g1)) < 0.3 OR abs(g0) > abs(g1) THEN NULL WHEN g1 > 0 THEN 0 ELSE 180 END AS turn FROM g")
def upright_from_mean(spark, d):
    g = read(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 20).alias("part")).agg((F.avg(_vector(1)) * 6).alias("g0"), (F.avg(_vector(2)) * 6).alias("g1"))
    return g.select("label", "part", gates.upright(F.col("g0"), F.col("g1"), F.lit(0.0)).alias("turn"))


_SIZE = "sizes AS (SELECT p_partkey AS id, CAST(p_size * 40 + 640 + p_partkey % 7 AS BIGINT) AS w, CAST(p_size * 20 + 481 + p_partkey % 11 * 100 AS BIGINT) AS h, CAST(p_partkey % 30 AS DOUBLE) AS deg FROM part)"
_CROP = _SIZE + """, raw AS (SELECT *, CASE WHEN w * 1920 > h * 1080 THEN CAST(round_even(h * 1080 / 1920.0, 0) AS BIGINT) ELSE w END AS c0, CASE WHEN w * 1920 > h * 1080 THEN h ELSE CAST(round_even(w * 1920 / 1080.0, 0) AS BIGINT) END AS c1 FROM sizes),
crops AS (SELECT id, w, h, deg, least(w, c0 - c0 % 2) AS cw, least(h, c1 - c1 % 2) AS ch FROM raw)"""


def _sizes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(k.alias("id"), (s * 40 + 640 + k % 7).cast("long").alias("w"), (s * 20 + 481 + k % 11 * 100).cast("long").alias("h"), (k % 30).cast("double").alias("deg"))


def _crops(spark, d):
    return _sizes(spark, d).withColumn("c", media.crop_box(F.col("w"), F.col("h"))).select("id", "w", "h", "deg", "c.*")


@query("aspect_label", f"WITH {_SIZE} SELECT id, CASE WHEN abs(w / h - 8.0 / 7) < 0.02 THEN '8:7' WHEN abs(w / h - 16.0 / 9) < 0.02 THEN '16:9' WHEN abs(w / h - 4.0 / 3) < 0.02 THEN '4:3' WHEN abs(w / h - 9.0 / 16) < 0.02 THEN '9:16' ELSE CAST(CAST(round(w / h, 2) AS DECIMAL(10, 2)) AS VARCHAR) || ':1' END AS aspect FROM sizes")
def aspect_label(spark, d):
    return _sizes(spark, d).select("id", media.aspect_label(F.col("w"), F.col("h")).alias("aspect"))


@query("crop_box", f"WITH {_CROP} SELECT id, cw, ch, (w - cw) // 2 AS x, (h - ch) // 2 AS y FROM crops")
def crop_box(spark, d):
    return _crops(spark, d).select("id", "cw", "ch", "x", "y")


_SCALE = "CASE WHEN {a} <= 0.01 THEN 1.0 ELSE least(1.0, h / 2 / (cw / 2 * sin(radians(least(abs({a}), 25))) + ch / 2 * cos(radians(least(abs({a}), 25)))), w / 2 / (cw / 2 * cos(radians(least(abs({a}), 25))) + ch / 2 * sin(radians(least(abs({a}), 25))))) END"


@query("safe_scale", f"WITH {_CROP} SELECT id, round({_SCALE.format(a='deg')}, 6) AS scale FROM crops")
def safe_scale(spark, d):
    return _crops(spark, d).select("id", r6(media.safe_scale(*[F.col(c) for c in ("cw", "ch", "w", "h", "deg")]), "scale"))


@query(
    "rotation_budget",
    f"""WITH RECURSIVE {_CROP}, b AS (SELECT id, w, h, cw, ch, 0.0::DOUBLE AS lo, 25.0::DOUBLE AS hi, 0 AS n FROM crops UNION ALL
      SELECT id, w, h, cw, ch, CASE WHEN floor(cw * {_SCALE.format(a='((lo + hi) / 2)')}) >= 1080 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN floor(cw * {_SCALE.format(a='((lo + hi) / 2)')}) >= 1080 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM b WHERE n < 24)
    SELECT id, round(lo, 3) AS budget FROM b WHERE n = 24""",
)
def rotation_budget(spark, d):
    return _crops(spark, d).select("id", F.round(media.rotation_budget(*[F.col(c) for c in ("cw", "ch", "w", "h")]), 3).alias("budget"))


_RATES = "WITH r AS (SELECT l_orderkey AS cut, CASE l_suppkey % 5 WHEN 0 THEN 29.97 WHEN 1 THEN 59.94 WHEN 2 THEN 119.88 WHEN 3 THEN 0 ELSE 29.97 END AS rate FROM lineitem), g AS (SELECT cut, count(DISTINCT rate) FILTER (rate > 0) AS n, max(rate) AS hi, min(rate) FILTER (rate > 0) AS lo FROM r GROUP BY cut)"


@query("plan_fps", f"{_RATES} SELECT cut, CASE WHEN n >= 2 THEN least(hi, 60) END::DOUBLE AS fastest, CASE WHEN n >= 2 THEN lo END::DOUBLE AS slowest FROM g")
def plan_fps(spark, d):
    s = F.col("l_suppkey") % 5
    rate = F.when(s == 1, 59.94).when(s == 2, 119.88).when(s == 3, 0.0).otherwise(29.97)
    cuts = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cut")).agg(F.collect_list(rate).alias("rates"))
    return cuts.select("cut", media.plan_fps(F.col("rates")).alias("fastest"), media.plan_fps(F.col("rates"), slowest=True).alias("slowest"))


@query("roll_angle", "SELECT vec_id, round(degrees(atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE)), 6) AS roll FROM embeddings")
def roll_angle(spark, d):
    return read(spark, d, "embeddings").select("vec_id", r6(numbers.roll_angle(_vector(1), _vector(2)), "roll"))


_Q = "q AS (SELECT vec_id, label, embedding[1]::DOUBLE / n AS w, embedding[2]::DOUBLE / n AS a, embedding[3]::DOUBLE / n AS b, embedding[4]::DOUBLE / n AS c, embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y, embedding[7]::DOUBLE AS z FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) AS n FROM embeddings))"


@query("quat_rotate", f"WITH {_Q} SELECT vec_id, round((w*w+a*a-b*b-c*c)*x + 2*(a*b-w*c)*y + 2*(a*c+w*b)*z, 6) AS rx, round(2*(a*b+w*c)*x + (w*w-a*a+b*b-c*c)*y + 2*(b*c-w*a)*z, 6) AS ry, round(2*(a*c-w*b)*x + 2*(b*c+w*a)*y + (w*w-a*a-b*b+c*c)*z, 6) AS rz FROM q")
def quat_rotate(spark, d):
    q = numbers.normalised([_vector(i) for i in range(1, 5)])
    own = read(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(q, "wabc", strict=True)], *[_vector(i).alias(n) for i, n in zip((5, 6, 7), "xyz", strict=True)])
    out = numbers.quat_rotate([F.col(c) for c in "wabc"], [F.col(c) for c in "xyz"])
    return own.select("vec_id", *[r6(c, n) for c, n in zip(out, ("rx", "ry", "rz"), strict=True)])


@query(
    "vector_spread",
    """WITH u AS (SELECT label, embedding[1]::DOUBLE / n AS x, embedding[2]::DOUBLE / n AS y, embedding[3]::DOUBLE / n AS z FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS n FROM embeddings)), m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM u GROUP BY label)
    SELECT label, round(avg(degrees(acos(greatest(-1, least(1, (x * mx + y * my + z * mz) / sqrt(mx * mx + my * my + mz * mz)))))), 6) AS spread FROM u JOIN m USING (label) GROUP BY label""",
)
def vector_spread(spark, d):
    u = numbers.normalised([_vector(i) for i in (1, 2, 3)])
    units = read(spark, d, "embeddings").select("label", *[c.alias(n) for c, n in zip(u, "xyz", strict=True)])
    means = units.groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    mean = numbers.normalised([F.col(f"m{c}") for c in "xyz"])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), numbers.dot([F.col(c) for c in "xyz"], mean)))
    return units.join(means, "label").groupBy("label").agg(F.round(F.avg(F.degrees(F.acos(cosine))), 6).alias("spread"))


@query(
    "circular_mean4",
    """WITH g AS (SELECT label, atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS a, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2) AS m FROM embeddings), q AS (SELECT label, quantile_cont(m, 0.8) AS lim FROM g GROUP BY label), s AS (SELECT label, sum(m * sin(4 * a)) AS s, sum(m * cos(4 * a)) AS c, sum(m) AS m FROM g JOIN q USING (label) WHERE m >= lim GROUP BY label)
    SELECT label, round(degrees(atan2(s, c)) / 4, 6) AS tilt, round(sqrt(s * s + c * c) / m, 6) AS strength FROM s""",
)
def circular_mean4(spark, d):
    g = read(spark, d, "embeddings").select("label", F.atan2(_vector(1), _vector(2)).alias("a"), F.sqrt(_vector(1) ** 2 + _vector(2) ** 2).alias("m"))
    lim = g.groupBy("label").agg(F.percentile("m", F.lit(0.8)).alias("lim"))
    s = g.join(lim, "label").where("m >= lim").groupBy("label").agg(F.sum(F.col("m") * F.sin(4 * F.col("a"))).alias("s"), F.sum(F.col("m") * F.cos(4 * F.col("a"))).alias("c"), F.sum("m").alias("m"))
    return s.select("label", r6(F.degrees(F.atan2("s", "c")) / 4, "tilt"), r6(F.sqrt(F.col("s") ** 2 + F.col("c") ** 2) / F.col("m"), "strength"))


@query(
    "axis_fit",
    """WITH p AS (SELECT label, embedding[1]::DOUBLE AS tilt, abs(embedding[2]::DOUBLE) AS conf, unnest([0, 1, 2]) AS axis, unnest([embedding[1]::DOUBLE * 0.5 + embedding[3]::DOUBLE, embedding[4]::DOUBLE, embedding[5]::DOUBLE - embedding[1]::DOUBLE]) AS roll FROM embeddings),
    f AS (SELECT label, axis, corr(tilt, roll) AS r, regr_slope(tilt, roll) AS gain, quantile_cont(roll, 0.95) - quantile_cont(roll, 0.05) AS swing, sum(conf * tilt) / sum(conf) AS base, row_number() OVER (PARTITION BY label ORDER BY abs(corr(tilt, roll)) DESC) AS n FROM p GROUP BY label, axis)
    SELECT label, axis, round(r, 6) AS corr, round(gain, 6) AS gain, round(swing, 6) AS swing, round(base, 6) AS base, abs(r) >= 0.35 AND abs(gain) BETWEEN 0.08 AND 1.5 AS usable FROM f WHERE n = 1""",
)
def axis_fit(spark, d):
    rolls = F.array(*[F.struct(F.lit(i).alias("axis"), c.alias("roll")) for i, c in enumerate((_vector(1) * 0.5 + _vector(3), _vector(4), _vector(5) - _vector(1)))])
    p = read(spark, d, "embeddings").select("label", _vector(1).alias("tilt"), F.abs(_vector(2)).alias("conf"), F.inline(rolls))
    pct = F.percentile("roll", F.array(F.lit(0.05), F.lit(0.95)))
    f = p.groupBy("label", "axis").agg(F.corr("tilt", "roll").alias("r"), F.regr_slope("tilt", "roll").alias("gain"), pct.alias("p"), (F.sum(F.col("conf") * F.col("tilt")) / F.sum("conf")).alias("base"))
    best = f.groupBy("label").agg(F.max_by(F.struct("axis", "r", "gain", "p", "base"), F.abs("r")).alias("b")).select("label", "b.*")
    return best.select("label", "axis", r6("r", "corr"), r6("gain"), r6(F.get("p", F.lit(1)) - F.get("p", F.lit(0)), "swing"), r6("base"), ((F.abs("r") >= 0.35) & F.abs("gain").between(0.08, 1.5)).alias("usable"))


@query("series_compare", f"WITH {m.SAMPLES}, p AS (SELECT asset, value AS a, lag(value) OVER (PARTITION BY asset ORDER BY t) AS b FROM samples) SELECT asset, round(corr(a, b), 6) AS corr, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(quantile_cont(a - b, 0.5), 6) AS p50, round(quantile_cont(a - b, 0.95), 6) AS p95 FROM p WHERE b IS NOT NULL GROUP BY asset")
def series_compare(spark, d):
    p = m.samples(spark, d).select("asset", F.col("value").alias("a"), F.lag("value").over(W.partitionBy("asset").orderBy("t")).alias("b")).where("b is not null")
    gap = F.col("a") - F.col("b")
    return p.groupBy("asset").agg(F.round(F.corr("a", "b"), 6).alias("corr"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.percentile(gap, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(gap, F.lit(0.95)), 6).alias("p95"))


@query("box_remap", "SELECT vec_id, round(0.25 * (vec_id % 3) + embedding[1]::DOUBLE * 0.5, 6) AS x0, round(0.5 * (vec_id % 2) + embedding[2]::DOUBLE * 0.5, 6) AS y0, round(0.25 * (vec_id % 3) + embedding[3]::DOUBLE * 0.5, 6) AS x1, round(0.5 * (vec_id % 2) + embedding[4]::DOUBLE * 0.5, 6) AS y1 FROM embeddings")
def box_remap(spark, d):
    box = {n: _vector(i) for i, n in enumerate(("x0", "y0", "x1", "y1"), 1)}
    b = media.box_remap(box, F.lit(0.25) * (F.col("vec_id") % 3), F.lit(0.5) * (F.col("vec_id") % 2), F.lit(0.5), F.lit(0.5))
    return read(spark, d, "embeddings").select("vec_id", b.alias("b")).select("vec_id", *[r6(f"b.{n}", n) for n in ("x0", "y0", "x1", "y1")])


@query("slugify", "SELECT p_partkey AS id, coalesce(nullif(left(trim(regexp_replace(p_name || ' / best! ' || p_brand || '..' || repeat('é', CAST(p_partkey % 3 AS INTEGER)), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 60), ''), 'cut') AS slug FROM part")
def slugify(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" / best! "), F.col("p_brand"), F.lit(".."), F.expr("repeat('é', int(p_partkey % 3))"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), media.slugify(name).alias("slug"))


@query("json_features", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS high FROM events GROUP BY event_type")
def json_features(spark, d):
    f = F.from_json("props", "map<string,double>", {"allowNonNumericNumbers": "true"})
    k = F.try_element_at(f, F.lit("k"))
    own = read(spark, d, "events").select("event_type", k.alias("k"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("total"), F.count_if(F.col("k") > 50).alias("high"))


@query("command_script", f"WITH {m.SAMPLES}, s AS (SELECT asset, t, CAST(floor(value) AS BIGINT) - CAST(floor(value) AS BIGINT) % 2 AS x FROM samples) SELECT asset, string_agg(format('{{:d}}.0 crop x {{:d}};', CAST(t AS BIGINT), x), chr(10) ORDER BY t) AS script FROM s GROUP BY asset")
def command_script(spark, d):
    s = m.samples(spark, d).select("asset", "t", numbers.even(F.floor("value")).alias("x"))
    lines = F.sort_array(F.collect_list(F.struct("t", F.format_string("%d.0 crop x %d;", F.col("t").cast("long"), F.col("x").cast("long")).alias("line"))))
    return s.groupBy("asset").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("script"))


@query("scaled_decode", "SELECT vec_id, " + ", ".join(f"round(round(embedding[{i}]::DOUBLE * {k}) / {k}, 6) AS {n}" for i, (n, k) in enumerate({"lat": "1e7", "lon": "1e7", "alt": "1000", "speed2d": "1000", "speed3d": "100"}.items(), 1)) + " FROM embeddings")
def scaled_decode(spark, d):
    """Samples packed as a position stream packs them, in a payload that does not say its divisors."""
    scales = [1e7, 1e7, 1000.0, 1000.0, 100.0]
    whole = F.transform(F.array(*[_vector(i + 1) * k for i, k in enumerate(scales)]), lambda x: F.round(x).cast("int"))
    fields = payloads.FIELDS["GPS5"]

    @F.pandas_udf("array<double>")
    def unpacked(batches: pd.Series) -> pd.Series:
        layout, by = payloads.struct_format("?", 20, None, "GPS5"), payloads.divisors([], 5, "GPS5")
        return pd.Series([payloads.decode(struct.pack(layout, *map(int, x)), layout, by)[0].tolist() for x in batches])

    found = read(spark, d, "embeddings").select("vec_id", unpacked(whole).alias("v"))
    return found.select("vec_id", *[r6(F.get("v", F.lit(i)), n) for i, n in enumerate(fields)])
