"""Reports over decisions, stages, inventory and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators import decisions, series
from ridgeline.plans import flagship
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, read

_DECIDED = f"WITH {m.SEGMENTS}, {m.ASSETS}, decided AS (SELECT s.*, a.ride_id, a.aspect, a.lighting, a.gps_lat, a.filename FROM segments s JOIN assets a USING (content_hash) WHERE status IN ('approved', 'rejected'))"


def decided(spark, d):
    return m.segments(spark, d).where("status <> 'candidate'").join(m.assets(spark, d), "content_hash").withColumn("approved", F.col("status") == "approved")


@query("group_rates", f"{_DECIDED} SELECT ride_id, count(*) AS n, count(*) FILTER (status = 'approved') AS ok, bool_or(gps_lat IS NOT NULL) AS has_gps, arg_min(lighting, id) AS lighting, round(count(*) FILTER (status = 'approved') / count(*), 6) AS rate FROM decided GROUP BY ride_id")
def group_rates(spark, d):
    out = decided(spark, d).groupBy("ride_id").agg(F.count("*").alias("n"), F.count_if("approved").alias("ok"), F.bool_or(F.col("gps_lat").isNotNull()).alias("has_gps"), F.min_by("lighting", F.when(F.col("lighting").isNotNull(), F.col("id"))).alias("lighting"))
    return out.withColumn("rate", F.round(F.col("ok") / F.col("n"), 6))


_ATTRIBUTES = {
    "aspect": lambda: F.col("aspect"),
    "gps": lambda: F.when(F.col("gps_lat").isNull(), "no").otherwise("yes"),
    "gps again": lambda: F.when(F.col("gps_lat") > 0, "1").otherwise("0"),
    "lang": lambda: F.col("lang"),
    "lighting": lambda: F.col("lighting"),
}
_ATTRIBUTE_SQL = "attrs AS (SELECT ride_id, content_hash, status, unnest(['aspect', 'gps', 'gps again', 'lang', 'lighting']) AS attribute, unnest([aspect, CASE WHEN gps_lat IS NULL THEN 'no' ELSE 'yes' END, CASE WHEN gps_lat > 0 THEN '1' ELSE '0' END, lang, lighting]) AS value FROM decided)"


@query("attribute_rates", f"{_DECIDED}, {_ATTRIBUTE_SQL}, rates AS (SELECT attribute, value, count(*) FILTER (status = 'approved') AS ok, count(*) AS n, count(DISTINCT ride_id) AS groups FROM attrs GROUP BY 1, 2) SELECT *, round(ok / n, 6) AS rate FROM rates WHERE attribute IN (SELECT attribute FROM rates GROUP BY 1 HAVING count(*) > 1)")
def attribute_rates(spark, d):
    out = decisions.attribute_rates(decided(spark, d), {k: c() for k, c in _ATTRIBUTES.items()}, "ride_id")
    return out.withColumn("rate", F.round("rate", 6))


@query("confounded_groups", f"{_DECIDED}, {_ATTRIBUTE_SQL}, b AS (SELECT attribute, value, array_to_string(list_sort(list(DISTINCT content_hash)), '|') AS mem FROM attrs GROUP BY 1, 2), p AS (SELECT attribute, array_to_string(list_sort(list(DISTINCT mem)), ';') AS sig, count(DISTINCT mem) AS buckets FROM b GROUP BY 1 HAVING count(DISTINCT mem) > 1) SELECT array_to_string(list_sort(list(attribute)), ',') AS attributes, any_value(buckets) AS buckets FROM p GROUP BY sig HAVING count(*) > 1")
def confounded_groups(spark, d):
    return decisions.confounded(decided(spark, d), {k: c() for k, c in _ATTRIBUTES.items()}, "content_hash")


@query("reject_reasons", f"WITH {m.SEGMENTS} SELECT coalesce(reason, '(no reason)') AS reason, count(*) AS n FROM segments WHERE status = 'rejected' GROUP BY 1")
def reject_reasons(spark, d):
    return m.segments(spark, d).where("status = 'rejected'").groupBy(F.coalesce("reason", F.lit("(no reason)")).alias("reason")).agg(F.count("*").alias("n"))


@query("rate_by_type", f"{_DECIDED} SELECT lang AS kind, count(*) FILTER (status = 'approved') AS ok, count(*) AS n, round(count(*) FILTER (status = 'approved') / count(*), 6) AS rate FROM decided GROUP BY lang")
def rate_by_type(spark, d):
    out = decided(spark, d).groupBy(F.col("lang").alias("kind")).agg(F.count_if("approved").alias("ok"), F.count("*").alias("n"))
    return out.withColumn("rate", F.round(F.col("ok") / F.col("n"), 6))


@query("cap_binding", f"WITH {m.SEGMENTS} SELECT count(*) AS n, count(*) FILTER (abs(t_out - t_in - 30) <= 0.05) AS at_cap, count(*) FILTER (t_in_user IS NOT NULL) AS moved_in, count(*) FILTER (t_out_user IS NOT NULL) AS moved_out FROM segments WHERE status = 'approved'")
def cap_binding(spark, d):
    return m.segments(spark, d).where("status = 'approved'").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("t_out") - F.col("t_in") - 30) <= 0.05).alias("at_cap"), F.count("t_in_user").alias("moved_in"), F.count("t_out_user").alias("moved_out"))


@query(
    "boundary_shift",
    f"""WITH {m.SEGMENTS}, s AS (SELECT avg(t_in_user - t_in) AS a, count(t_in_user) AS na, avg(t_out_user - t_out) AS b, count(t_out_user) AS nb, count(*) FILTER (status <> 'candidate') AS decided, least(count(*) FILTER (status = 'approved'), count(*) FILTER (status = 'rejected')) AS minority FROM segments)
    SELECT round(a, 6) AS shift_in, na AS n_in, round(b, 6) AS shift_out, nb AS n_out, na >= 8 AND abs(a) > 0.4 AS advise_in, nb >= 8 AND abs(b) > 0.4 AS advise_out, decided >= 25 AS enough_decisions, na + nb >= 8 AS enough_moves, minority >= 40 AS enough_minority, greatest(0, 40 - minority) AS missing_minority FROM s""",
)
def boundary_shift(spark, d):
    ok, no = F.count_if(F.col("status") == "approved"), F.count_if(F.col("status") == "rejected")
    s = m.segments(spark, d).agg(F.avg(F.col("t_in_user") - F.col("t_in")).alias("a"), F.count("t_in_user").alias("na"), F.avg(F.col("t_out_user") - F.col("t_out")).alias("b"), F.count("t_out_user").alias("nb"), F.count_if(F.col("status") != "candidate").alias("decided"), F.least(ok, no).alias("minority"))
    advise = lambda n, x: (F.col(n) >= 8) & (F.abs(x) > 0.4)
    return s.select(r6("a", "shift_in"), F.col("na").alias("n_in"), r6("b", "shift_out"), F.col("nb").alias("n_out"), advise("na", "a").alias("advise_in"), advise("nb", "b").alias("advise_out"), (F.col("decided") >= 25).alias("enough_decisions"), (F.col("na") + F.col("nb") >= 8).alias("enough_moves"), (F.col("minority") >= 40).alias("enough_minority"), F.greatest(F.lit(0), 40 - F.col("minority")).alias("missing_minority"))


@query("stage_timing", f"WITH {m.RUNS}, s AS (SELECT stage, count(*) AS runs, sum(finished - started) AS total_s FROM runs WHERE status = 'ok' GROUP BY stage) SELECT stage, runs, round(total_s, 6) AS total_s, round(total_s / runs, 6) AS mean_s, round(total_s / sum(total_s) OVER (), 6) AS share FROM s")
def stage_timing(spark, d):
    s = m.runs(spark, d).where("status = 'ok'").groupBy("stage").agg(F.count("*").alias("runs"), F.sum(F.col("finished") - F.col("started")).alias("total_s"))
    return s.select("stage", "runs", r6("total_s"), r6(F.col("total_s") / F.col("runs"), "mean_s"), r6(F.col("total_s") / F.sum("total_s").over(W.partitionBy()), "share")).orderBy(F.desc("total_s"))


@query("inventory_totals", f"WITH {m.ASSETS} SELECT aspect, count(*) AS files, round(sum(duration_s), 3) AS total_s, count(DISTINCT coalesce(ride_id, content_hash)) AS rides, count(*) FILTER (gps_lat IS NULL) AS no_gps, count(*) FILTER (duration_s < 100) AS short, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM assets GROUP BY aspect")
def inventory_totals(spark, d):
    out = m.assets(spark, d).groupBy("aspect").agg(F.count("*").alias("files"), F.round(F.sum("duration_s"), 3).alias("total_s"), F.countDistinct(F.coalesce("ride_id", "content_hash")).alias("rides"), F.count_if(F.col("gps_lat").isNull()).alias("no_gps"), F.count_if(F.col("duration_s") < 100).alias("short"))
    return out.withColumn("share", F.round(F.col("files") / F.sum("files").over(W.partitionBy()), 6))


@query("inventory_rides", f"WITH {m.ASSETS} SELECT ride_id, count(*) AS chapters, round(sum(duration_s), 3) AS total_s, bool_and(gps_lat IS NOT NULL) AS all_gps, CASE WHEN count(DISTINCT coalesce(lighting, '-')) = 1 THEN min(coalesce(lighting, '-')) ELSE 'mixed' END AS lighting, arg_min(aspect, chapter) AS aspect FROM assets GROUP BY ride_id")
def inventory_rides(spark, d):
    light = F.coalesce("lighting", F.lit("-"))
    return m.assets(spark, d).groupBy("ride_id").agg(F.count("*").alias("chapters"), F.round(F.sum("duration_s"), 3).alias("total_s"), F.bool_and(F.col("gps_lat").isNotNull()).alias("all_gps"), F.when(F.countDistinct(light) == 1, F.min(light)).otherwise("mixed").alias("lighting"), F.min_by("aspect", "chapter").alias("aspect"))


@query("score_summary", f"WITH {m.SECONDS} SELECT asset, count(*) AS n, round(quantile_cont(rough, 0.5), 6) AS rough_p50, round(quantile_cont(rough, 0.95), 6) AS rough_p95, round(sum(air_s), 6) AS air_total, round(max(air_s), 6) AS air_longest, count(air_s) AS air_events, bool_or(speed IS NOT NULL) AS has_speed FROM seconds GROUP BY asset")
def score_summary(spark, d):
    return m.seconds(spark, d).groupBy("asset").agg(F.count("*").alias("n"), F.round(F.percentile("rough", F.lit(0.5)), 6).alias("rough_p50"), F.round(F.percentile("rough", F.lit(0.95)), 6).alias("rough_p95"), F.round(F.sum("air_s"), 6).alias("air_total"), F.round(F.max("air_s"), 6).alias("air_longest"), F.count("air_s").alias("air_events"), F.bool_or(F.col("speed").isNotNull()).alias("has_speed"))


@query(
    "telemetry_diagnostics",
    """WITH v AS (SELECT label, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) AS a, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2) AS g, embedding[7]::DOUBLE AS fix, embedding[8]::DOUBLE AS lat, abs(embedding[9]::DOUBLE) AS speed FROM embeddings)
    SELECT label, round(avg(a), 6) AS mean_a, round(avg(g), 6) AS mean_g, round(avg((fix > 0)::INT), 6) AS fix_share, round(quantile_cont(lat, 0.5), 6) AS median_lat, round(quantile_cont(speed, 0.5), 6) AS speed_p50, round(quantile_cont(speed, 0.95), 6) AS speed_p95, avg(a) BETWEEN 0.15 AND 0.25 AND avg((fix > 0)::INT) > 0.4 AS ok FROM v GROUP BY label""",
)
def telemetry_diagnostics(spark, d):
    x = lambda i: F.get("embedding", F.lit(i - 1)).cast("double")
    v = read(spark, d, "embeddings").select("label", F.sqrt(x(1) ** 2 + x(2) ** 2 + x(3) ** 2).alias("a"), F.sqrt(x(4) ** 2 + x(5) ** 2 + x(6) ** 2).alias("g"), (x(7) > 0).cast("int").alias("fix"), x(8).alias("lat"), F.abs(x(9)).alias("speed"))
    out = v.groupBy("label").agg(F.avg("a").alias("a"), F.avg("g").alias("g"), F.avg("fix").alias("fix"), F.percentile("lat", F.lit(0.5)).alias("lat"), F.percentile("speed", F.array(F.lit(0.5), F.lit(0.95))).alias("s"))
    return out.select("label", r6("a", "mean_a"), r6("g", "mean_g"), r6("fix", "fix_share"), r6("lat", "median_lat"), r6(F.get("s", F.lit(0)), "speed_p50"), r6(F.get("s", F.lit(1)), "speed_p95"), (F.col("a").between(0.15, 0.25) & (F.col("fix") > 0.4)).alias("ok"))


_RANK_SQL = """rolled AS (SELECT asset, composite, CASE WHEN count(composite) OVER w = 12 THEN avg(composite) OVER w END AS roll FROM composed WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("ride_rank", f"WITH {flagship.APPLIED}, {_RANK_SQL}, r AS (SELECT asset, max(roll) AS clip, list_avg(list_reverse_sort(list(composite))[1:30]) AS top30, quantile_cont(composite, 0.5) AS floor, max(composite) AS peak FROM rolled GROUP BY asset) SELECT asset, round(clip, 6) AS clip, round(top30, 6) AS top30, round(floor, 6) AS floor, round(peak, 6) AS peak FROM r")
def ride_rank(spark, d):
    own = flagship.composed(spark, d).withColumn("roll", series.full_trailing_mean("asset", ["day"], "composite"))
    # no list of an asset's seconds: only its 30 best are averaged
    ranked = own.withColumn("__n", F.row_number().over(W.partitionBy("asset").orderBy(F.desc("composite"))))
    top = F.avg(F.when(F.col("__n") <= 30, F.col("composite")))
    out = ranked.groupBy("asset").agg(F.max("roll").alias("clip"), top.alias("top30"), F.percentile("composite", F.lit(0.5)).alias("floor"), F.max("composite").alias("peak"))
    return out.select("asset", r6("clip"), r6("top30"), r6("floor"), r6("peak")).orderBy(F.desc_nulls_last("clip"), "asset")


@query("best_contiguous", f"WITH {m.SAMPLES}, r AS (SELECT asset, CASE WHEN count(value) OVER w = 12 THEN avg(value) OVER w END AS roll FROM samples WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT asset, round(max(roll), 6) AS best FROM r GROUP BY asset")
def best_contiguous(spark, d):
    own = m.samples(spark, d).withColumn("roll", series.full_trailing_mean("asset", ["t"], "value"))
    return own.groupBy("asset").agg(F.round(F.max("roll"), 6).alias("best"))
