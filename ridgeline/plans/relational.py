"""Catalogue queries: lookups, filters, joins, snapshots, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import media
from ridgeline.operators import catalogue as cat
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, read


@query(
    "ride_chapter_parse",
    """WITH names AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'GX' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '.MP4'
      WHEN 1 THEN 'gopr' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '.mp4' WHEN 2 THEN 'GH' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE c_name END AS name FROM customer)
    SELECT id, name, CASE WHEN regexp_matches(name, '(?i)^G[XHP]\\d{6}(\\.[^.]*)?$') THEN substr(name, 5, 4) WHEN regexp_matches(name, '(?i)^GOPR\\d{4}(\\.[^.]*)?$') THEN substr(name, 5, 4) END AS ride,
      CASE WHEN regexp_matches(name, '(?i)^G[XHP]\\d{6}(\\.[^.]*)?$') THEN CAST(substr(name, 3, 2) AS INTEGER) WHEN regexp_matches(name, '(?i)^GOPR\\d{4}(\\.[^.]*)?$') THEN 1 END AS chapter FROM names""",
)
def ride_chapter_parse(spark, d):
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.when(k % 4 == 0, F.concat(F.lit("GX"), pad(k % 100, 2), pad(k % 10000, 4), F.lit(".MP4"))).when(k % 4 == 1, F.concat(F.lit("gopr"), pad(k % 10000, 4), F.lit(".mp4"))).when(k % 4 == 2, F.concat(F.lit("GH"), pad(k % 100, 2), pad(k % 10000, 4))).otherwise(F.col("c_name"))
    return read(spark, d, "customer").select(k.alias("id"), name.alias("name")).select("id", "name", media.ride_chapter(F.col("name")).alias("p")).select("id", "name", "p.*")


@query("asset_find", f"WITH {m.ASSETS} SELECT content_hash, filename, ride_id FROM assets WHERE starts_with(content_hash, '0003') OR contains(lower(filename), '0003') OR ride_id = '0003'")
def asset_find(spark, d):
    return cat.find(m.assets(spark, d), "0003").select("content_hash", "filename", "ride_id")


@query("segments_filtered", f"WITH {m.SEGMENTS} SELECT id, content_hash, status, t_in, row_number() OVER (ORDER BY content_hash, score DESC, t_in, id) AS pos FROM segments WHERE status = 'rejected' AND content_hash < 'src5'")
def segments_filtered(spark, d):
    from pyspark.sql import Window as W

    # each asset is numbered on its own and moved by the rows of the assets before it: no window over all rows
    own = m.segments(spark, d).where((F.col("status") == "rejected") & (F.col("content_hash") < "src5"))
    sizes = own.groupBy("content_hash").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("content_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("content_hash").orderBy(F.desc("score"), "t_in", "id"))
    return own.withColumn("__r", nth).join(before, "content_hash").select("id", "content_hash", "status", "t_in", (F.col("__r") + F.col("__before")).cast("long").alias("pos"))


@query("effective_bounds", f"WITH {m.SEGMENTS} SELECT id, round(coalesce(t_in_user, t_in), 6) AS t_in, round(coalesce(t_out_user, t_out), 6) AS t_out FROM segments")
def effective_bounds(spark, d):
    return m.segments(spark, d).select("id", r6(F.coalesce("t_in_user", "t_in"), "t_in"), r6(F.coalesce("t_out_user", "t_out"), "t_out"))


@query("segment_asset_join", f"WITH {m.SEGMENTS}, {m.ASSETS} SELECT s.id, s.status, a.ride_id, a.chapter, a.aspect, a.lighting FROM segments s JOIN assets a ON s.content_hash = a.content_hash WHERE s.status <> 'candidate'")
def segment_asset_join(spark, d):
    return m.segments(spark, d).where("status <> 'candidate'").join(m.assets(spark, d), "content_hash").select("id", "status", "ride_id", "chapter", "aspect", "lighting")


@query("approved_clips", f"WITH {m.SEGMENTS}, {m.ASSETS} SELECT s.id, a.ride_id, a.chapter, round(coalesce(t_in_user, t_in), 6) AS t_in, CASE WHEN a.aspect = '16:9' THEN 'wide' ELSE 'tall' END AS shape FROM segments s JOIN assets a USING (content_hash) WHERE s.status = 'approved' AND a.gps_lat IS NOT NULL")
def approved_clips(spark, d):
    both = m.segments(spark, d).where("status = 'approved'").join(m.assets(spark, d).where("gps_lat is not null"), "content_hash")
    return both.select("id", "ride_id", "chapter", r6(F.coalesce("t_in_user", "t_in"), "t_in"), F.when(F.col("aspect") == "16:9", "wide").otherwise("tall").alias("shape"))


@query("decision_rows", f"WITH {m.SEGMENTS}, {m.ASSETS} SELECT s.id, s.status, s.reason, s.lang, a.filename, a.lighting, round(s.score, 6) AS score FROM segments s LEFT JOIN (SELECT * FROM assets WHERE gps_lat IS NOT NULL) a USING (content_hash) WHERE s.status <> 'candidate'")
def decision_rows(spark, d):
    decided = m.segments(spark, d).where("status <> 'candidate'")
    return decided.join(m.assets(spark, d).where("gps_lat is not null"), "content_hash", "left").select("id", "status", "reason", "lang", "filename", "lighting", r6("score"))


@query("ordered_edit_list", "WITH lists AS (SELECT l_orderkey AS job, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey), items AS (SELECT job, unnest(ids) AS segment_id, unnest(range(0, len(ids))) AS pos FROM lists) SELECT job, CAST(pos AS INTEGER) AS pos, segment_id, p_name AS name FROM items JOIN part ON segment_id = p_partkey")
def ordered_edit_list(spark, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    jobs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(ids.alias("segment_ids"))
    segments = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return cat.ordered_edit(jobs, segments).select("job", "pos", "segment_id", "name")


_FRESH = "fresh AS (SELECT id + 1000000 AS id, content_hash, t_in + (id % 2) AS t_in, 'candidate' AS status FROM segments WHERE lang = 'de')"


@query("replace_candidates", f"WITH {m.SEGMENTS}, {_FRESH}, kept AS (SELECT id, content_hash, t_in, status FROM segments WHERE status <> 'candidate') SELECT * FROM kept UNION ALL SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.content_hash = f.content_hash AND k.t_in = f.t_in)")
def replace_candidates(spark, d):
    all_ = m.segments(spark, d)
    own = all_.select("id", "content_hash", "t_in", "status")
    fresh = all_.where("lang = 'de'").select((F.col("id") + 1000000).alias("id"), "content_hash", (F.col("t_in") + F.col("id") % 2).alias("t_in"), F.lit("candidate").alias("status"))
    return cat.replace_candidates(own, fresh)


@query("relink_sets", "SELECT coalesce(w.k, f.k) AS content_hash, CASE WHEN w.k IS NULL THEN 'unknown' WHEN f.k IS NULL THEN 'missing' ELSE 'found' END AS state FROM (SELECT DISTINCT c_custkey AS k FROM customer) w FULL JOIN (SELECT DISTINCT o_custkey + 20 AS k FROM orders) f ON w.k = f.k")
def relink_sets(spark, d):
    wanted = read(spark, d, "customer").select(F.col("c_custkey").alias("content_hash"))
    return cat.relink(wanted, read(spark, d, "orders").select((F.col("o_custkey") + 20).alias("content_hash")))


@query("stage_done", f"WITH {m.RUNS}, {m.VERSIONS} SELECT run, stage, coalesce(status = 'ok' AND stage_version >= current, false) AS done FROM runs LEFT JOIN versions USING (stage)")
def stage_done(spark, d):
    runs = m.runs(spark, d)
    return cat.stage_done(runs, cat.stage_versions(runs)).select("run", "stage", "done")


@query("stale_stage", f"WITH {m.RUNS}, {m.VERSIONS} SELECT stage, count(*) AS n, count(DISTINCT content_hash) AS assets FROM runs JOIN versions USING (stage) WHERE stage_version < current GROUP BY stage")
def stale_stage(spark, d):
    runs = m.runs(spark, d)
    return cat.stale(runs, cat.stage_versions(runs)).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("assets"))


@query("status_counts", f"WITH {m.JOBS}, {m.SEGMENTS} SELECT 'job' AS kind, status, count(*) AS n FROM jobs GROUP BY status UNION ALL SELECT 'segment', status, count(*) FROM segments GROUP BY status")
def status_counts(spark, d):
    count = lambda df, kind: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    return count(m.jobs(spark, d), "job").unionByName(count(m.segments(spark, d), "segment"))


@query("next_job", f"WITH {m.JOBS} SELECT 'next' AS what, id, name FROM (SELECT * FROM jobs WHERE status = 'queued' ORDER BY id LIMIT 1) UNION ALL SELECT 'newest', id, name FROM (SELECT * FROM jobs ORDER BY id DESC LIMIT 60)")
def next_job(spark, d):
    jobs = m.jobs(spark, d)
    return cat.next_job(jobs).select(F.lit("next").alias("what"), "id", "name").union(cat.newest_jobs(jobs).select(F.lit("newest").alias("what"), "id", "name"))


@query("concat_chapters", "WITH parts AS (SELECT l_orderkey AS ride, l_linenumber AS chapter, l_partkey AS part, l_quantity AS n, NULL AS price FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, l_extendedprice FROM lineitem WHERE l_linenumber > 3) SELECT ride, chapter, part, n, price, row_number() OVER (PARTITION BY ride ORDER BY chapter, part, n, price) AS pos FROM parts")
def concat_chapters(spark, d):
    from pyspark.sql import Window as W

    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride"), F.col("l_linenumber").alias("chapter"), F.col("l_partkey").alias("part"), "l_quantity", "l_extendedprice")
    early = own.where("chapter <= 3").select("ride", "chapter", "part", F.col("l_quantity").alias("n"))
    late = own.where("chapter > 3").select("ride", "chapter", "part", F.col("l_extendedprice").alias("price"))
    both = early.unionByName(late, allowMissingColumns=True)
    return both.withColumn("pos", F.row_number().over(W.partitionBy("ride").orderBy("chapter", "part", F.asc_nulls_last("n"), F.asc_nulls_last("price"))).cast("long"))


@query("shelf_listing", f"WITH {m.JOBS}, files AS (SELECT p_partkey AS file, 'cut_' || p_partkey || '.mp4' AS path, p_retailprice * 1000 AS bytes, p_size AS age FROM part) SELECT f.path, f.age, j.name AS job, j.status FROM files f LEFT JOIN (SELECT * FROM jobs WHERE status = 'done') j ON j.id = f.file")
def shelf_listing(spark, d):
    files = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("cut_"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"), F.col("p_size").alias("age"))
    return files.join(m.jobs(spark, d).where("status = 'done'"), "id", "left").select("path", "age", F.col("name").alias("job"), "status").orderBy("age", "path")


@query(
    "upsert_snapshot",
    "WITH delta AS (SELECT o_custkey AS k, o_totalprice AS bal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT k + 200 AS k, bal FROM delta WHERE n = 1) SELECT coalesce(c_custkey, k) AS id, c_name AS name, CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS balance FROM customer FULL JOIN d ON c_custkey = k",
)
def upsert_snapshot(spark, d):
    snapshot = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    delta = read(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") + 200).alias("id"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return cat.upsert(snapshot, delta, ["id"], order="o_orderkey")
