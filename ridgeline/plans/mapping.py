"""The engine's tables made from the driver's: an asset is a user or a source, a sample is an event, a decision is a label.

Each view is a function for Spark and a common table expression for DuckDB that say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import clock
from ridgeline.plans.registry import read

FEATURES = {"speed": "view", "turn": "click", "rough": "purchase", "descent": "signup"}

SAMPLES = """samples AS (SELECT user_id AS asset, event_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS t FROM events)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    t = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("double")
    return e.select(F.col("user_id").alias("asset"), "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), t.alias("t"))


#: Rows 5 to 11 of every 17 have no value: gaps of 8 steps.
GAPPY = SAMPLES + ", gappy AS (SELECT *, CASE WHEN CAST(t AS BIGINT) % 17 BETWEEN 5 AND 11 THEN NULL ELSE value END AS v FROM samples)"


def gappy(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumn("v", F.when(~(F.col("t").cast("long") % 17).between(5, 11), F.col("value")))


SECONDS = """days AS (SELECT user_id AS asset, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'view' THEN value END) AS speed,
  max(CASE WHEN event_type = 'click' THEN value END) AS turn, max(CASE WHEN event_type = 'purchase' THEN value END) AS rough,
  max(CASE WHEN event_type = 'signup' THEN value END) AS descent, max(CASE WHEN event_type = 'error' THEN value END) / 700 AS air_s
  FROM events GROUP BY 1, 2),
seconds AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY day) - 1 AS DOUBLE) AS t FROM days)"""


def seconds(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    days = e.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("day")).agg(*[of(k).alias(f) for f, k in FEATURES.items()], (of("error") / 700).alias("air_s"))
    return days.withColumn("t", (F.row_number().over(W.partitionBy("asset").orderBy("day")) - 1).cast("double"))


SEGMENTS = """segments AS (SELECT d.doc_id AS id, d.source AS content_hash, d.lang, d.doc_id % 50 AS slot, CAST(d.doc_id % 400 AS DOUBLE) AS t_in,
  CAST(d.doc_id % 400 + 10 + d.n_chars % 21 AS DOUBLE) AS t_out, d.n_chars / 1009.0 AS score, d.n_chars,
  CASE WHEN l.quality IS NULL THEN 'candidate' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN d.doc_id % 2 = 0 THEN 'dull' END AS reason,
  CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 400 + (d.doc_id % 7 - 3) * 0.25 END AS t_in_user,
  CASE WHEN d.doc_id % 5 = 0 THEN d.doc_id % 400 + 10 + d.n_chars % 21 + (d.doc_id % 9 - 2) * 0.5 END AS t_out_user
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), read(spark, d, "labels")
    i, n = F.col("doc_id"), F.col("n_chars")
    status = F.when(F.col("quality").isNull(), "candidate").when(F.col("quality") == 1, "approved").otherwise("rejected")
    t_in, t_out = i % 400, i % 400 + 10 + n % 21
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"), F.col("source").alias("content_hash"), "lang", (i % 50).alias("slot"), t_in.cast("double").alias("t_in"), t_out.cast("double").alias("t_out"),
        (n / 1009.0).alias("score"), n, status.alias("status"), F.when(F.col("toxic") == 1, "toxic").when(i % 2 == 0, "dull").alias("reason"),
        F.when(i % 3 == 0, t_in + (i % 7 - 3) * 0.25).alias("t_in_user"), F.when(i % 5 == 0, t_out + (i % 9 - 2) * 0.5).alias("t_out_user"),
    )


ASSETS = """assets AS (SELECT source AS content_hash, 'GX' || lpad(CAST(CAST(substr(source, 4) AS INTEGER) % 4 + 1 AS VARCHAR), 2, '0') || lpad(CAST(CAST(substr(source, 4) AS INTEGER) // 4 AS VARCHAR), 4, '0') || '.MP4' AS filename,
  lpad(CAST(CAST(substr(source, 4) AS INTEGER) // 4 AS VARCHAR), 4, '0') AS ride_id, CAST(substr(source, 4) AS INTEGER) % 4 + 1 AS chapter,
  sum(n_chars) / 1000.0 AS duration_s, count(*) AS n, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN NULL ELSE 51.0 + CAST(substr(source, 4) AS INTEGER) / 10.0 END AS gps_lat,
  CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'night' WHEN 2 THEN 'twilight' ELSE 'day' END AS lighting,
  CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN '8:7' ELSE '16:9' END AS aspect FROM documents GROUP BY source)"""


def assets(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    ride = F.lpad(F.floor(n / 4).cast("string"), 4, "0")
    docs = read(spark, d, "documents").select("source", "n_chars")
    own = docs.groupBy(F.col("source").alias("source")).agg((F.sum("n_chars") / 1000.0).alias("duration_s"), F.count("*").alias("n"))
    return own.select(
        F.col("source").alias("content_hash"), F.concat(F.lit("GX"), F.lpad((n % 4 + 1).cast("string"), 2, "0"), ride, F.lit(".MP4")).alias("filename"), ride.alias("ride_id"), (n % 4 + 1).alias("chapter"),
        "duration_s", "n", F.when(n % 3 != 0, 51.0 + n / 10.0).alias("gps_lat"), F.when(n % 5 == 1, "night").when(n % 5 == 2, "twilight").when(n % 5 > 2, "day").alias("lighting"),
        F.when(n % 2 == 0, "8:7").otherwise("16:9").alias("aspect"),
    )


RUNS = """runs AS (SELECT o_custkey AS content_hash, o_orderkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'probe' WHEN '2-HIGH' THEN 'telemetry' WHEN '3-MEDIUM' THEN 'proxy' WHEN '5-LOW' THEN 'score' ELSE 'select' END AS stage,
  CAST(o_orderkey % 6 AS INTEGER) AS stage_version, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, epoch(o_orderdate) AS started, epoch(o_orderdate) + o_orderkey % 600 AS finished FROM orders)"""
VERSIONS = "versions(stage, current) AS (VALUES ('probe', 1), ('telemetry', 4), ('proxy', 1), ('score', 3), ('select', 1))"


def runs(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    stage = F.when(p == "1-URGENT", "probe").when(p == "2-HIGH", "telemetry").when(p == "3-MEDIUM", "proxy").when(p == "5-LOW", "score").otherwise("select")
    start = clock.epoch(F.col("o_orderdate"))
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("content_hash"), F.col("o_orderkey").alias("run"), stage.alias("stage"), (F.col("o_orderkey") % 6).cast("int").alias("stage_version"),
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), start.alias("started"), (start + F.col("o_orderkey") % 600).alias("finished"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS id, 'job ' || o_orderkey AS name, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_totalprice AS total_s FROM orders)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("job "), F.col("o_orderkey").cast("string")).alias("name"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("done").alias("status"), F.col("o_totalprice").alias("total_s"))
