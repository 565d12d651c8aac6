"""Grids, interpolation, windows and islands over the samples of each asset."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import clock, numbers
from ridgeline.operators import intervals, series
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, read

_GRID = "grid AS (SELECT asset, unnest(range(0, CAST(max(t) AS BIGINT) * 2 + 1)) * 0.5 AS t FROM gappy GROUP BY asset)"
_BRACKET = f"""{m.GAPPY}, {_GRID}, pts AS (SELECT asset, t, NULL AS st, NULL AS v, 1 AS p FROM grid UNION ALL SELECT asset, t, t, v, 0 FROM gappy WHERE v IS NOT NULL),
br AS (SELECT asset, t, p, last_value(st IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(st IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM pts
  WINDOW b AS (PARTITION BY asset ORDER BY t, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY t, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _half_grid(spark, d):
    g = m.gappy(spark, d)
    ends = g.groupBy("asset").agg((F.max("t") + 0.5).alias("end"))
    return g, series.grid(ends, "asset", "end", 0.5)


@query("grid_build", f"WITH {m.SECONDS}, e AS (SELECT asset, max(t) + 0.4 AS dur FROM seconds GROUP BY asset) SELECT asset, CAST(unnest(range(0, CAST(ceil(greatest(dur, 1)) AS BIGINT))) AS DOUBLE) AS t FROM e")
def grid_build(spark, d):
    ends = m.seconds(spark, d).groupBy("asset").agg((F.max("t") + 0.4).alias("dur"))
    return series.grid(ends, "asset", "dur")


@query("asof_interp", f"WITH {_BRACKET} SELECT asset, t, round(CASE WHEN t0 = t THEN v0 WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM br WHERE p = 1")
def asof_interp(spark, d):
    g, points = _half_grid(spark, d)
    return series.interpolate(points, g, "asset", "v").withColumn("v", F.round("v", 6))


@query("gap_interp", f"WITH {_BRACKET} SELECT asset, t, round(CASE WHEN t0 = t THEN v0 WHEN t1 - t0 <= 5 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM br WHERE p = 1")
def gap_interp(spark, d):
    g, points = _half_grid(spark, d)
    return series.interpolate(points, g, "asset", "v", max_gap=5.0, clamp=False).withColumn("v", F.round("v", 6))


@query("asof_nearest", f"WITH {_BRACKET} SELECT asset, t, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN CASE WHEN t - t0 <= 1.5 THEN v0 END WHEN t1 - t <= 1.5 THEN v1 END AS v FROM br WHERE p = 1")
def asof_nearest(spark, d):
    g, points = _half_grid(spark, d)
    return series.nearest(points, g, "asset", "v", 1.5)


_CLOCK = m.SAMPLES + ", clock AS (SELECT asset, event_id, value, t / 10 AS t FROM samples)"


def _clock(spark, d):
    return m.samples(spark, d).withColumn("t", F.col("t") / 10)


@query("rms_per_bucket", f"WITH {_CLOCK} SELECT asset, CAST(floor(t) AS BIGINT) AS second, round(sqrt(avg(value * value)), 6) AS rms FROM clock GROUP BY 1, 2 HAVING count(*) > 8")
def rms_per_bucket(spark, d):
    return series.by_second(_clock(spark, d), "asset", {"rms": F.round(series.rms("value"), 6)}, least=9)


@query("mean_abs_per_bucket", f"WITH {_CLOCK} SELECT asset, CAST(floor(t) AS BIGINT) AS second, round(avg(abs(value - 245)), 6) AS mean_abs FROM clock GROUP BY 1, 2")
def mean_abs_per_bucket(spark, d):
    return series.by_second(_clock(spark, d), "asset", {"mean_abs": F.round(F.avg(F.abs(F.col("value") - 245)), 6)})


@query("islands", f"WITH {m.SAMPLES}, f AS (SELECT *, value < 120 AS f, row_number() OVER (PARTITION BY asset ORDER BY t) AS n, lead(t) OVER (PARTITION BY asset ORDER BY t) AS nx FROM samples), g AS (SELECT *, n - row_number() OVER (PARTITION BY asset ORDER BY t) AS g FROM f WHERE f) SELECT asset, min(t) AS first, max(t) AS last, count(*) AS n, arg_max(coalesce(nx, -1), t) AS stop FROM g GROUP BY asset, g")
def islands(spark, d):
    out = series.islands(m.samples(spark, d), "asset", "t", F.col("value") < 120)
    return out.select("asset", "first", "last", "n", F.coalesce("end", F.lit(-1.0)).alias("stop"))


_FALL = f"""{m.SAMPLES}, s AS (SELECT asset, t / 10 AS t, value / 20 AS mag, CAST(t AS BIGINT) + 1 AS i, count(*) OVER (PARTITION BY asset) AS n, CAST(floor(round(count(*) OVER (PARTITION BY asset) / greatest((max(t) OVER (PARTITION BY asset) - min(t) OVER (PARTITION BY asset)) / 10, 1e-6) * 0.6, 9)) AS BIGINT) AS ahead FROM samples),
r AS (SELECT *, i - row_number() OVER (PARTITION BY asset ORDER BY i) AS g FROM s WHERE n >= 10 AND mag < 3.5), runs AS (SELECT asset, min(i) AS i0, max(i) AS i1, any_value(n) AS n, any_value(ahead) AS ahead FROM r GROUP BY asset, g),
e AS (SELECT r.asset, a.t AS t_start, b.t AS t_end, coalesce((SELECT max(mag) FROM s WHERE s.asset = r.asset AND s.i > r.i1 AND s.i <= r.i1 + r.ahead), 0) AS landing FROM runs r JOIN s a ON a.asset = r.asset AND a.i = r.i0 JOIN s b ON b.asset = r.asset AND b.i = least(r.i1 + 1, r.n))"""


@query("freefall_events", f"WITH {_FALL} SELECT asset, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(t_end - t_start, 6) AS duration, round(landing, 6) AS landing FROM e WHERE t_end - t_start >= 0.10 AND landing >= 18")
def freefall_events(spark, d):
    own = m.samples(spark, d).select("asset", (F.col("t") / 10).alias("t"), (F.col("value") / 20).alias("mag"))
    out = series.freefall(own, "asset", "t", "mag")
    return out.select("asset", r6("t_start"), r6("t_end"), r6("duration"), r6("landing"))


_PAD = "p AS (SELECT a.asset, a.t, z.kk AS k, b.value AS y FROM samples a, (SELECT unnest(range({lo}, {hi})) AS kk) z, samples b, (SELECT asset, max(t) AS m FROM samples GROUP BY asset) x WHERE x.asset = a.asset AND b.asset = a.asset AND b.t = greatest(0, least(x.m, a.t + z.kk)))"


@query("windowed_slope", f"WITH {m.SAMPLES}, {_PAD.format(lo=-10, hi=11)} SELECT asset, t, round(sum(k * y) / 770, 6) AS slope FROM p GROUP BY asset, t")
def windowed_slope(spark, d):
    return m.samples(spark, d).select("asset", "t", r6(series.windowed_slope("asset", "t", "value"), "slope"))


@query("median_filter", f"WITH {m.SAMPLES}, {_PAD.format(lo=-4, hi=5)} SELECT asset, t, round(quantile_cont(y, 0.5), 6) AS median FROM p GROUP BY asset, t")
def median_filter(spark, d):
    return m.samples(spark, d).select("asset", "t", r6(series.median_filter("asset", "t", "value"), "median"))


@query("rolling_median", f"WITH {m.SAMPLES} SELECT asset, t, round(quantile_cont(value, 0.5) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS median FROM samples")
def rolling_median(spark, d):
    return m.samples(spark, d).select("asset", "t", r6(series.rolling_median("asset", "t", "value", 7), "median"))


@query("local_peaks", f"WITH {m.SAMPLES}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM samples WINDOW w AS (PARTITION BY asset ORDER BY t)) SELECT asset, t, value FROM n WHERE value >= 300 AND CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL THEN value > b WHEN b IS NULL THEN value > a ELSE value > a AND value >= b END")
def local_peaks(spark, d):
    return series.peaks(m.samples(spark, d).select("asset", "t", "value"), "asset", "t", "value", F.lit(300.0))


@query("step_stats", f"WITH {m.SAMPLES}, x AS (SELECT asset, epoch(ts) - lag(epoch(ts)) OVER w AS dt, abs(value - lag(value) OVER w) AS dv FROM samples WINDOW w AS (PARTITION BY asset ORDER BY t)) SELECT asset, round(quantile_cont(dt, 0.5), 3) AS step, round(quantile_cont(dv, 0.5), 6) AS move_p50, round(quantile_cont(dv, 0.95), 6) AS move_p95 FROM x GROUP BY asset")
def step_stats(spark, d):
    by = W.partitionBy("asset").orderBy("t")
    epoch = clock.epoch(F.col("ts"))
    x = m.samples(spark, d).select("asset", (epoch - F.lag(epoch).over(by)).alias("dt"), F.abs(F.col("value") - F.lag("value").over(by)).alias("dv"))
    return x.groupBy("asset").agg(F.round(F.percentile("dt", F.lit(0.5)), 3).alias("step"), F.round(F.percentile("dv", F.lit(0.5)), 6).alias("move_p50"), F.round(F.percentile("dv", F.lit(0.95)), 6).alias("move_p95"))


@query(
    "chapter_time_carry",
    """WITH c AS (SELECT l_orderkey AS ride, l_linenumber * 1000000 + l_partkey AS chapter, l_quantity AS dur, CASE WHEN l_partkey % 3 = 0 THEN epoch(l_shipdate) END AS anchor FROM lineitem), u AS (SELECT ride, chapter, max(dur) AS dur, max(anchor) AS anchor FROM c GROUP BY 1, 2),
    b AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY ride ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) SELECT ride, chapter, last_value(anchor - before IGNORE NULLS) OVER (PARTITION BY ride ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + before AS start FROM b""",
)
def chapter_time_carry(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("chapter"), F.col("l_quantity").alias("dur"), F.when(F.col("l_partkey") % 3 == 0, clock.epoch(F.col("l_shipdate"))).alias("anchor"))
    own = c.groupBy("ride", "chapter").agg(F.max("dur").alias("dur"), F.max("anchor").alias("anchor"))
    return series.with_carried_time(own, "ride", "chapter", "anchor", "dur").select("ride", "chapter", "start")


@query("payload_time_spread", f"WITH {m.SAMPLES}, w AS (SELECT asset, event_id, epoch(ts) AS st, CAST(k % 4 AS INTEGER) AS n, lead(epoch(ts)) OVER (PARTITION BY asset ORDER BY t) - epoch(ts) AS w, t FROM samples), s AS (SELECT *, CASE WHEN n > 0 THEN w / n END AS own FROM w), f AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0 / nullif(n, 0)) AS step FROM s) SELECT asset, event_id, j, round(st + j * step, 3) AS at FROM (SELECT *, unnest(range(0, n)) AS j FROM f WHERE n > 0)")
def payload_time_spread(spark, d):
    own = m.samples(spark, d).select("asset", "event_id", F.col("t").alias("o"), (clock.epoch(F.col("ts"))).alias("st"), (F.col("k") % 4).cast("int").alias("n"))
    out = series.payload_times(own, "asset", "o", "st", "n")
    return out.select("asset", "event_id", F.col("j").cast("long").alias("j"), F.round("t", 3).alias("at"))


@query("arc_length", f"WITH {m.SAMPLES}, s AS (SELECT asset, t, coalesce(value - lag(value) OVER w, 0) AS dx, coalesce(k - lag(k) OVER w, 0) AS dy FROM samples WINDOW w AS (PARTITION BY asset ORDER BY t)) SELECT asset, t, round(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS way FROM s")
def arc_length(spark, d):
    own = series.steps(m.samples(spark, d).withColumn("k", F.col("k").cast("double")), "asset", "t", "value", "k")
    return own.select("asset", "t", F.round(series.arc_length("asset", "t", "value", "k"), 4).alias("way"))


@query(
    "hold_then_ease",
    f"""WITH {m.GAPPY}, h AS (SELECT asset, t / 3 AS t, v / 500 AS z FROM gappy), w AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(z IGNORE NULLS) OVER b AS z0, first_value(z IGNORE NULLS) OVER a AS z1 FROM h
      WINDOW b AS (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    x AS (SELECT *, t - t0 AS age, 0.5 * (1 - cos(pi() * (t - t0 - 1) / 2)) AS bl FROM w)
    SELECT asset, round(t, 6) AS t, round(CASE WHEN z IS NOT NULL THEN z WHEN age IS NULL THEN coalesce(z1, 0.5) WHEN age <= 1 THEN z0 WHEN age <= 3 THEN z0 + (0.5 - z0) * bl ELSE 0.5 END, 6) AS target,
      round(CASE WHEN z IS NOT NULL THEN 1.0 WHEN age IS NULL THEN CASE WHEN z1 IS NOT NULL THEN 0.8 ELSE 0.6 END WHEN age <= 1 THEN 0.8 WHEN age <= 3 THEN 0.2 + 0.4 * bl ELSE 0.6 END, 6) AS weight FROM x""",
)
def hold_then_ease(spark, d):
    own = m.gappy(spark, d).select("asset", (F.col("t") / 3).alias("t"), (F.col("v") / 500).alias("z"))
    return series.hold_then_ease(own, "asset", "t", "z", 0.5).select("asset", r6("t"), r6("target"), r6("weight"))


_AIR = "air AS (SELECT o_custkey AS asset, o_orderkey AS event, CAST(o_orderkey % 500 AS DOUBLE) AS a, o_orderkey % 500 + 1.0 + (o_orderkey % 7) / 4.0 AS b FROM orders WHERE o_orderstatus = 'F'), edges AS (SELECT o_custkey AS asset, o_orderkey AS id, (o_orderkey * 37 % 5000) / 10.0 AS t FROM orders)"


@query("edge_in_event", f"WITH {_AIR} SELECT e.id, air.event, e.t, round(a, 6) AS a, round(b, 6) AS b FROM edges e JOIN air ON e.asset = air.asset AND a < e.t AND e.t < b")
def edge_in_event(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    air = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("asset"), k.alias("event"), (k % 500).cast("double").alias("a"), (k % 500 + 1.0 + (k % 7) / 4.0).alias("b"))
    edges = o.select(F.col("o_custkey").alias("asset"), k.alias("id"), (k * 37 % 5000 / 10.0).alias("t"))
    return intervals.points_inside(edges, air, "asset", "t", "a", "b").select("id", "event", "t", r6("a"), r6("b"))


@query("overlap_pairs", f"WITH {m.SEGMENTS} SELECT a.content_hash, a.id AS a, b.id AS b FROM segments a JOIN segments b ON a.content_hash = b.content_hash AND a.id < b.id AND a.t_in < b.t_out + 9 AND b.t_in - 9 < a.t_out")
def overlap_pairs(spark, d):
    return intervals.overlaps(m.segments(spark, d), "content_hash", "id", "t_in", "t_out", gap=9.0)


_XY = "SELECT {k} AS id, CAST((({k}) * 7919 % 2003) AS DOUBLE) AS x, CAST((({k}) * 104729 % 1009) AS DOUBLE) AS y FROM {t}"


@query("spatial_nearest", f"WITH p AS ({_XY.format(k='c_custkey', t='customer')}), q AS ({_XY.format(k='p_partkey + 3', t='part')}), j AS (SELECT p.id, q.id AS target, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM p, q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, target) AS n FROM j WHERE d <= 20) SELECT id, target, round(d, 6) AS distance FROM r WHERE n = 1")
def spatial_nearest(spark, d):
    xy = lambda k: ((k * 7919 % 2003).cast("double").alias("x"), (k * 104729 % 1009).cast("double").alias("y"))
    points = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *xy(F.col("c_custkey")))
    k = F.col("p_partkey") + 3
    targets = read(spark, d, "part").select(k.alias("target"), *xy(k))
    return intervals.spatial_nearest(points, targets, "id", 20.0).select("id", "target", r6("distance"))


@query("to_metres", f"WITH {m.SAMPLES}, s AS (SELECT asset, t, 51 + value / 1e5 AS lat, k / 1e4 AS lon FROM samples), o AS (SELECT asset, arg_min(lat, t) AS lat0, arg_min(lon, t) AS lon0 FROM s GROUP BY asset) SELECT asset, t, round((lon - lon0) * 111320 * cos(radians(lat0)), 4) AS x, round((lat - lat0) * 111132, 4) AS y FROM s JOIN o USING (asset)")
def to_metres(spark, d):
    s = m.samples(spark, d).select("asset", "t", (51 + F.col("value") / 1e5).alias("lat"), (F.col("k") / 1e4).alias("lon"))
    every = W.partitionBy("asset").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("p", numbers.to_metres(F.col("lat"), F.col("lon"), F.first("lat").over(every), F.first("lon").over(every)))
    return s.select("asset", "t", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))
