"""Calibration to composite: percentile tables, ranks, levels by availability, smoothing, top seconds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators import calibration as cal
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6
from ridgeline.session import saved

_FEATURES = list(m.FEATURES)
_SUBS = [f"s_{f}" for f in _FEATURES]
_WEIGHTS = [1.0, 2.0, 3.0, 0.0]

_LONG = m.SECONDS + """, long AS (SELECT asset, t, unnest(['speed', 'turn', 'rough', 'descent']) AS feature, unnest([speed, turn, rough, descent]) AS value FROM seconds),
breaks AS (SELECT feature, count(value) AS n, quantile_cont(value, [i / 100.0 for i in range(0, 101)]) AS b FROM long WHERE value IS NOT NULL GROUP BY feature),
usable AS (SELECT f.feature, coalesce(n, 0) AS n, b, CASE WHEN coalesce(n, 0) = 0 THEN 'absent' WHEN n < 100 THEN 'too few' WHEN b[100] - b[2] <= 1e-9 THEN 'no spread' END AS reason
  FROM (VALUES ('speed'), ('turn'), ('rough'), ('descent')) f(feature) LEFT JOIN breaks USING (feature))"""
_RANK = "CASE WHEN {v} IS NULL OR {b} IS NULL THEN NULL WHEN {v} < {b}[1] THEN 0.0 WHEN {v} >= {b}[101] THEN 1.0 ELSE (len(list_filter({b}, lambda e: e <= {v})) - 1 + ({v} - {b}[len(list_filter({b}, lambda e: e <= {v}))]) / ({b}[len(list_filter({b}, lambda e: e <= {v})) + 1] - {b}[len(list_filter({b}, lambda e: e <= {v}))])) / 100 END"
_RANKED = _LONG + ", ranked AS (SELECT s.*, " + ", ".join(_RANK.format(v=f"s.{f}", b=f"b_{f}.b") + f" AS s_{f}" for f in _FEATURES) + " FROM seconds s " + " ".join(f"LEFT JOIN (SELECT b FROM usable WHERE feature = '{f}' AND reason IS NULL) b_{f} ON true" for f in _FEATURES) + ")"
_SUM = "(CASE WHEN s_speed IS NOT NULL THEN 1.0 ELSE 0 END + CASE WHEN s_turn IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN s_rough IS NOT NULL THEN 3.0 ELSE 0 END)"
_LEVELS = _RANKED + f""", levels AS (SELECT *, CASE WHEN {_SUM} > 0 THEN sqrt((coalesce(s_speed * s_speed, 0) + 2 * coalesce(s_turn * s_turn, 0) + 3 * coalesce(s_rough * s_rough, 0)) / {_SUM}) END AS level_raw,
  (s_speed IS NOT NULL)::INT + 2 * (s_turn IS NOT NULL)::INT + 4 * (s_rough IS NOT NULL)::INT AS key FROM ranked)"""
_BUCKETS = _LEVELS + """, buckets AS (SELECT key, count(level_raw) AS n, quantile_cont(level_raw, [i / 100.0 for i in range(0, 101)]) AS b FROM levels WHERE level_raw IS NOT NULL GROUP BY key HAVING count(*) >= 200
  UNION ALL SELECT NULL, count(level_raw), quantile_cont(level_raw, [i / 100.0 for i in range(0, 101)]) FROM levels WHERE level_raw IS NOT NULL)"""
#: Common table expressions up to composed(asset, t, composite, s_*).
APPLIED = _BUCKETS + ", picked AS (SELECT l.*, coalesce(o.b, e.b) AS pb FROM levels l LEFT JOIN (SELECT * FROM buckets WHERE key IS NOT NULL) o ON l.key = o.key LEFT JOIN (SELECT b FROM buckets WHERE key IS NULL) e ON true), applied AS (SELECT *, " + _RANK.format(v="level_raw", b="pb") + """ AS level,
  CASE WHEN air_s IS NOT NULL THEN greatest(0.0, least(1.0, air_s / 0.8)) END AS s_air FROM picked),
smoothed AS (SELECT *, avg(level) OVER w AS level_s, coalesce(max(coalesce(s_air, 0.0)) OVER w, 0.0) AS s_air_d FROM applied WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
composed AS (SELECT *, 1 - (1 - coalesce(level_s, 0.0)) * (1 - 0.75 * s_air_d) AS composite FROM smoothed)"""


def _breaks(spark, d):
    return cal.corpus_breaks(m.seconds(spark, d), _FEATURES)


def _ranked(spark, d):
    seconds = saved(m.seconds(spark, d))  # the percentile tables and the ranks both read it
    return cal.ranked(seconds, cal.corpus_breaks(seconds, _FEATURES), _FEATURES)


def _levels(spark, d):
    return cal.leveled(_ranked(spark, d), _SUBS, _WEIGHTS)


def composed(spark, d):
    levels = saved(_levels(spark, d))
    applied = cal.level_ranks(levels, cal.level_breaks(levels)).withColumn("s_air", cal.air_score(F.col("air_s")))
    return cal.composite(applied, "asset", ["day"])


@query("corpus_breaks", f"WITH {_LONG} SELECT feature, n, unnest(range(0, 101)) AS pct, round(unnest(b), 6) AS break_value FROM usable WHERE reason IS NULL")
def corpus_breaks(spark, d):
    found = _breaks(spark, d).where("reason is null")
    return found.select("feature", "n", F.posexplode("breaks").alias("pct", "b")).select("feature", "n", F.col("pct").cast("long").alias("pct"), r6("b", "break_value"))


@query("feature_usability", f"WITH {_LONG} SELECT feature, n, coalesce(reason, 'usable') AS reason FROM usable")
def feature_usability(spark, d):
    return _breaks(spark, d).select("feature", "n", F.coalesce("reason", F.lit("usable")).alias("reason"))


@query("availability_key", f"WITH {_LEVELS} SELECT key, count(*) AS n FROM levels GROUP BY key")
def availability_key(spark, d):
    return _levels(spark, d).groupBy("key").agg(F.count("*").alias("n"))


@query("rank_interp", f"WITH {_RANKED} SELECT asset, t, round(s_speed, 6) AS s_speed, round(s_turn, 6) AS s_turn, round(s_rough, 6) AS s_rough, round(s_descent, 6) AS s_descent FROM ranked")
def rank_interp(spark, d):
    return _ranked(spark, d).select("asset", "t", *[r6(s) for s in _SUBS])


@query("power_mean", f"WITH {_LEVELS} SELECT asset, t, key, round(level_raw, 6) AS level_raw FROM levels")
def power_mean(spark, d):
    return _levels(spark, d).select("asset", "t", "key", r6("level_raw"))


@query("level_breaks", f"WITH {_BUCKETS} SELECT key, n, unnest(range(0, 101)) AS pct, round(unnest(b), 6) AS break_value FROM buckets")
def level_breaks(spark, d):
    found = cal.level_breaks(_levels(spark, d))
    return found.select("key", "n", F.posexplode("breaks").alias("pct", "b")).select("key", "n", F.col("pct").cast("long").alias("pct"), r6("b", "break_value"))


@query("smooth3", f"WITH {m.GAPPY} SELECT event_id, round(avg(v) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM gappy")
def smooth3(spark, d):
    return m.gappy(spark, d).select("event_id", r6(cal.smooth("v", "asset", ["t"]), "smooth"))


@query("dilate3", f"WITH {m.GAPPY} SELECT event_id, max(v) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM gappy")
def dilate3(spark, d):
    return m.gappy(spark, d).select("event_id", cal.dilate("v", "asset", ["t"]).alias("dilated"))


@query("composite", f"WITH {APPLIED} SELECT asset, t, round(level, 6) AS level, round(s_air_d, 6) AS s_air_d, round(composite, 6) AS composite FROM composed")
def composite(spark, d):
    return composed(spark, d).select("asset", "t", r6("level"), r6("s_air_d"), r6("composite"))


@query(
    "top_seconds",
    f"""WITH {APPLIED}, best AS (SELECT asset, t, composite, s_speed, s_turn, s_rough, row_number() OVER (PARTITION BY asset ORDER BY round(composite, 6) DESC, t) AS rank FROM composed)
    SELECT asset, t, rank, round(composite, 6) AS composite,
      array_to_string(list_transform(list_reverse_sort([x for x in [{{'v': round(s_speed, 6), 'n': 'speed'}}, {{'v': round(s_turn, 6), 'n': 'turn'}}, {{'v': round(s_rough, 6), 'n': 'rough'}}] if x.v IS NOT NULL])[1:2], lambda x: x.n), ',') AS drivers FROM best WHERE rank <= 5""",
)
def top_seconds(spark, d):
    rank = F.row_number().over(W.partitionBy("asset").orderBy(F.round("composite", 6).desc(), "t"))
    best = composed(spark, d).withColumn("rank", rank).where("rank <= 5")
    pairs = F.array(*[F.struct(F.round(f"s_{f}", 6).alias("v"), F.lit(f).alias("n")) for f in ("speed", "turn", "rough")])
    drivers = F.slice(F.sort_array(F.filter(pairs, lambda p: p["v"].isNotNull()), asc=False), 1, 2)
    return best.select("asset", "t", F.col("rank").cast("long").alias("rank"), r6("composite"), F.array_join(F.transform(drivers, lambda p: p["n"]), ",").alias("drivers"))
