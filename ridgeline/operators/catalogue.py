"""Catalogue tables as snapshots: every change is a function of a snapshot and a delta, and a swap of directories."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.media import ride_chapter
from ridgeline.operators import ordering
from ridgeline.session import saved

STAGES = {"probe": 1, "telemetry": 4, "proxy": 1, "thumbs": 1, "score": 3, "archive": 1, "select": 1, "track": 1}

#: Jobs that have a task each; of more than these some share one.
MOST_TASKS = 10_000


def upsert(snapshot: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The snapshot with delta's rows: only columns that delta has change, of several rows for a key the last by order counts."""
    if order:
        last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        delta = delta.withColumn("__n", last).where("__n = 1").drop("__n")
    own = delta.select(*keys, *[F.col(c).alias(f"__d_{c}") for c in delta.columns if c not in keys and c in snapshot.columns], F.lit(True).alias("__new"))
    both = snapshot.withColumn("__old", F.lit(True)).join(own, keys, "full_outer")

    def value(c: str) -> Column:
        return F.when(F.col("__new").isNotNull(), F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c) if f"__d_{c}" in own.columns else F.col(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in snapshot.columns])


def record_stage(runs: DataFrame, delta: DataFrame) -> DataFrame:
    """Stage runs with the newest result of each (content_hash, stage)."""
    return upsert(runs, delta, ["content_hash", "stage"], order="finished_at")


def stage_versions(df: DataFrame, versions: dict[str, int] | None = None) -> DataFrame:
    rows = [(k, v) for k, v in (versions or STAGES).items()]
    return df.sparkSession.createDataFrame(rows, "stage string, current int")


def stage_done(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """runs with done: it went well with the current version or a later one. versions is one row a stage."""
    ok = (F.col("status") == "ok") & (F.col("stage_version") >= F.col("current"))
    return runs.join(F.broadcast(versions), "stage", "left").withColumn("done", F.coalesce(ok, F.lit(False)))


def stale(runs: DataFrame, versions: DataFrame) -> DataFrame:
    return runs.join(F.broadcast(versions), "stage").where("stage_version < current")


def find(assets: DataFrame, text: str) -> DataFrame:
    """Assets by a hash's start, a part of a file name in either case, or an exact ride."""
    return assets.where(F.startswith("content_hash", F.lit(text)) | F.contains(F.lower("filename"), F.lit(text.lower())) | (F.col("ride_id") == text))


def find_one(assets: DataFrame, text: str):
    """The one asset that find() gives, as a row; raises if there is none or several."""
    rows = find(assets, text).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'more than one'} asset matches {text!r}")
    return rows[0]


def replace_candidates(segments: DataFrame, fresh: DataFrame, decided: Column | None = None) -> DataFrame:
    """Segments with their undecided rows replaced by the fresh ones, but for those whose (content_hash, t_in) is decided."""
    decided = F.col("status") != "candidate" if decided is None else decided
    kept = segments.where(decided)
    new = fresh.join(kept.select("content_hash", "t_in"), ["content_hash", "t_in"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def decide(segments: DataFrame, delta: DataFrame) -> DataFrame:
    """Decisions delta(id, status, reason, t_in_user, t_out_user, at); back to candidate clears the time."""
    delta = delta.withColumn("decided_at", F.when(F.col("status") != "candidate", F.col("at"))).drop("at")
    return upsert(segments, delta, ["id"])


def set_ride(assets: DataFrame, ride: str, lighting: str | None = None, mount: str | None = None) -> DataFrame:
    """Hand-set context for all chapters of a ride."""
    own = F.coalesce("ride_id", "content_hash") == ride
    out = assets
    if lighting is not None:
        out = out.withColumn("lighting", F.when(own, F.lit(lighting)).otherwise(F.col("lighting"))).withColumn("lighting_source", F.when(own, F.lit("hand")).otherwise(F.col("lighting_source")))
    return out.withColumn("mount", F.when(own, F.lit(mount)).otherwise(F.col("mount"))) if mount is not None else out


def label(assets: DataFrame, text: str | None, style: str | None = None, mount: str | None = None) -> tuple[DataFrame, int]:
    """(assets, how many changed): style and mount set by hand on those that a part of a ride or file name or a hash's start
    picks, or on all. Those that have the values already are no change."""
    given = {k: v for k, v in (("style", style), ("mount", mount)) if v}
    mine = F.lit(True)
    if text:
        mine = F.contains(F.coalesce("ride_id", F.lit("")), F.lit(text)) | F.contains(F.coalesce("filename", F.lit("")), F.lit(text)) | F.startswith("content_hash", F.lit(text))
    other = F.lit(False)
    for k, v in given.items():
        other = other | ~F.col(k).eqNullSafe(F.lit(v))
    changed = assets.where(mine & other).count() if given else 0
    return assets.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in given.items()}) if given else assets, changed


def label_counts(assets: DataFrame) -> DataFrame:
    """(style, mount, files); what is not set is a dash."""
    return assets.groupBy(F.coalesce("style", F.lit("-")).alias("style"), F.coalesce("mount", F.lit("-")).alias("mount")).agg(F.count("*").alias("files"))


def by_id(segments: DataFrame, assets: DataFrame, segment: int):
    """One segment with its asset, as a row; None if it is not there."""
    return segments.where(F.col("id") == segment).join(assets, "content_hash").first()


def known_queued(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, segment_id): what queued jobs ask for, of the segments that are approved."""
    asked = jobs.where("status = 'queued'").select("id", F.explode("segment_ids").alias("segment_id"))
    approved = segments.where("status = 'approved'").select(F.col("id").alias("segment_id"))
    return asked.join(approved, "segment_id", "left_semi").select("id", "segment_id")


def work(path: str, spark, do: Callable, clean: Callable | None = None, most: int | None = None) -> int:
    """Do the queued jobs of the snapshot at the path, the oldest first and one at a time; returns how many were done.

    do(row) makes a job's output and returns its path. If it raises, the job ends in an error with the message, clean(row) takes
    away what was half made, and the next job is tried. Every change of status is a new snapshot, so a restart sees it; jobs that
    an earlier worker left running end in an error first.
    """
    jobs = fail_orphans(spark.read.parquet(path))
    save_snapshot(jobs, path)
    done = 0
    while most is None or done < most:
        jobs = spark.read.parquet(path)
        job = next_job(jobs).first()
        if job is None:
            break
        mine = F.col("id") == job["id"]
        save_snapshot(jobs.withColumn("status", F.when(mine, F.lit("running")).otherwise(F.col("status"))), path)
        try:
            result = {"status": "done", "out_path": do(job), "error": None}
        except Exception as e:
            if clean:
                clean(job)
            result = {"status": "error", "out_path": None, "error": str(e)[:500]}
        jobs = spark.read.parquet(path)
        save_snapshot(jobs.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)).cast("string") for k, v in result.items()}), path)
        done += 1
    return done


def work_in_tasks(path: str, spark, do: Callable, clean: Callable | None = None, most: int | None = None) -> int:
    """Do the queued jobs of the snapshot at the path at once, each in a task of its own, or the oldest most of them; returns how many were tried.

    do(row) runs on an executor and returns the path of a job's output; if it raises, the job ends in an error with the message
    after clean(row). The snapshot is written twice in all: with the jobs running, and with their results. A lost executor's jobs
    are done again, so do() must replace what it left; jobs that an earlier worker left running end in an error first.
    """
    jobs = saved(fail_orphans(spark.read.parquet(path)))
    queued = jobs.where("status = 'queued'")
    chosen = saved(queued.orderBy("id").limit(most) if most is not None else queued)
    n = chosen.count()
    started = chosen.select("id", F.lit("running").alias("status"))
    save_snapshot(upsert(jobs, started, ["id"]), path)
    if not n:
        return 0
    columns = chosen.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                job = Row(*columns)(*[own[c] for c in columns])
                try:
                    result = ("done", do(job), None)
                except Exception as e:
                    if clean:
                        clean(job)
                    result = ("error", None, str(e)[:500])
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "status", "out_path", "error"), (own["id"], *result), strict=True))], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("status", pa.string()), ("out_path", pa.string()), ("error", pa.string())])
    results = saved(chosen.repartition(min(n, MOST_TASKS)).mapInArrow(run, "id bigint, status string, out_path string, error string"))
    save_snapshot(upsert(saved(spark.read.parquet(path)), results, ["id"]), path)
    return n


def in_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema: those that it lacks are null, those of another type are cast, others are left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def backfill_rides(assets: DataFrame) -> DataFrame:
    """assets with the ride and chapter that their file names tell where there is no ride yet; no file is read."""
    told = ride_chapter(F.col("filename"))
    new = F.col("ride_id").isNull() & told["ride"].isNotNull()
    return assets.withColumn("__new", new).withColumns({"ride_id": F.when(F.col("__new"), told["ride"]).otherwise(F.col("ride_id")), "chapter": F.when(F.col("__new"), told["chapter"]).otherwise(F.col("chapter"))}).drop("__new")


def enqueue(jobs: DataFrame, delta: DataFrame) -> DataFrame:
    """Jobs with new queued ones, numbered after the last."""
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    new = ordering.numbered(delta, ["created_at", "name"], "__n").join(F.broadcast(last))
    new = new.withColumn("id", (F.col("__last") + F.col("__n") + 1).cast("long")).withColumn("status", F.lit("queued")).drop("__last", "__n")
    return jobs.unionByName(new, allowMissingColumns=True)


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("id").limit(1)


def newest_jobs(jobs: DataFrame, n: int = 60) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def fail_orphans(jobs: DataFrame) -> DataFrame:
    """Jobs that a stopped worker left running end in an error."""
    lost = F.col("status") == "running"
    return jobs.withColumn("error", F.when(lost, F.lit("interrupted")).otherwise(F.col("error"))).withColumn("status", F.when(lost, F.lit("error")).otherwise(F.col("status")))


def cancel(jobs: DataFrame, job: int) -> DataFrame:
    mine = (F.col("id") == job) & (F.col("status") == "queued")
    return jobs.withColumn("status", F.when(mine, F.lit("cancelled")).otherwise(F.col("status")))


def relink(wanted: DataFrame, found: DataFrame, key: str = "content_hash") -> DataFrame:
    """(key, state): found, missing (wanted and not found) or unknown (found and not wanted)."""
    a, b = wanted.select(key).distinct().withColumn("__w", F.lit(1)), found.select(key).distinct().withColumn("__f", F.lit(1))
    state = F.when(F.col("__w").isNull(), "unknown").when(F.col("__f").isNull(), "missing").otherwise("found")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def ordered_edit(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """(job, pos, segment_id, *segment): the segments of each job in the order of its list. A segment that is not there is an
    error when the rows are read: an edit that silently lost a part would be another edit."""
    items = jobs.select(F.col("id").alias("job"), F.posexplode("segment_ids").alias("pos", "segment_id"))
    both = items.join(segments.withColumnRenamed("id", "segment_id").withColumn("__there", F.lit(True)), "segment_id", "left")
    message = F.concat(F.lit("no segment "), F.col("segment_id").cast("string"), F.lit(" for job "), F.col("job").cast("string"))
    checked = F.when(F.col("__there"), F.col("pos")).otherwise(F.raise_error(message).cast("int"))
    return both.withColumn("pos", checked).drop("__there")


def save_snapshot(df: DataFrame, path: str) -> None:
    """Replace a snapshot directory: written beside, then renamed, through the path's own file system.

    A rename that fails is an error, after which the old snapshot stands at the path as before; the old one is deleted only
    when the new one has taken its place.
    """
    save_snapshots({"": df}, path)


def save_snapshots(tables: dict[str, DataFrame], path: str) -> None:
    """save_snapshot() of a folder with several tables, by name: all of them take their places at once, or none does."""
    spark = next(iter(tables.values())).sparkSession
    aside, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{aside}/{name}".rstrip("/"))
    jvm = spark.sparkContext._jvm
    target, fresh, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, old))
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    swap(system, target, fresh, gone)


def swap(system, target, fresh, gone) -> None:
    """Put fresh in the place of target on a Hadoop file system, whose rename() tells failure by false."""
    had = system.exists(target)
    if had and not system.rename(target, gone):
        system.delete(fresh, True)
        raise OSError(f"{target} could not be set aside; it is unchanged")
    if not system.rename(fresh, target):
        if had and not system.rename(gone, target):
            raise OSError(f"{target} could not be replaced; its rows are in {gone}")
        system.delete(fresh, True)
        raise OSError(f"{target} could not be replaced; it is unchanged")
    if had:
        system.delete(gone, True)
