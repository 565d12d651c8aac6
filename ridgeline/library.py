"""A library of recordings as a folder of tables, and the stages that fill it: one pass of each over all that is new.

    assets  runs  telemetry  imu  scores  air  calibration  segments  jobs  version

Series are partitioned by asset, so a stage that runs again replaces only the assets it was given; the catalogue's tables are
snapshots that are replaced as a whole.
"""

from __future__ import annotations

import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline import schema
from ridgeline.operators import calibration as cal
from ridgeline.operators import catalogue, checks, clips, decisions, extraction, features, gates, series
from ridgeline.session import saved
from ridgeline.sources import files

ASSET = "content_hash"
AIR = "content_hash string, t_start double, t_end double, duration double, landing double"
CATALOGUE = {"assets": schema.asset, "runs": schema.stage_run, "segments": schema.segment, "jobs": schema.render_job}


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(conf).exists(at)

    def table(self, name: str) -> DataFrame:
        """A table; one of the catalogue that was not written yet is empty."""
        if not self.has(name) and name in CATALOGUE:
            return self.spark.createDataFrame([], CATALOGUE[name]())
        read = self.spark.read.schema(AIR) if name == "air" else self.spark.read  # there may be no row to tell its columns
        return read.parquet(self.path(name))

    def replace(self, name: str, df: DataFrame) -> None:
        catalogue.save_snapshot(df, self.path(name))

    def record(self, stage: str, assets: DataFrame, failed: DataFrame | None = None) -> None:
        """Note that a stage went well for assets(content_hash), and why it did not for failed(content_hash, error)."""
        now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        none = F.lit(None).cast("string")
        ended = assets.select(ASSET, F.lit("ok").alias("status"), none.alias("error"))
        if failed is not None:
            ended = ended.unionByName(failed.select(ASSET, F.lit("error").alias("status"), "error"))
        done = ended.select(ASSET, F.lit(stage).alias("stage"), F.lit(catalogue.STAGES[stage]).alias("stage_version"), "status", now.alias("started_at"), now.alias("finished_at"), "error")
        self.replace("runs", catalogue.record_stage(self.table("runs"), done))

    def pending(self, stage: str) -> DataFrame:
        """The assets that a stage has not been done for in its present version: also those for which it failed."""
        runs = catalogue.stage_done(self.table("runs"), catalogue.stage_versions(self.table("runs"))).where((F.col("stage") == stage) & F.col("done"))
        return self.table("assets").join(runs.select(ASSET), ASSET, "left_anti")

    def errors(self) -> DataFrame:
        """(content_hash, filename, stage, error) of the last runs that failed."""
        return self.table("runs").where("status = 'error'").join(self.table("assets").select(ASSET, "filename"), ASSET, "left").select(ASSET, "filename", "stage", "error").orderBy("filename", "stage")

    def migrate(self) -> int:
        """Bring the catalogue up to the present version, step by step; returns the version it had. A step that failed is done again."""
        had = self.spark.read.parquet(self.path("version")).first()["version"] if self.has("version") else 0
        for version in range(had + 1, len(STEPS) + 1):
            STEPS[version - 1](self)
            self.replace("version", self.spark.createDataFrame([(version,)], "version int"))
        return had

    def add_columns(self) -> None:
        """The catalogue's tables get the columns and types of their schemas."""
        for name, of in CATALOGUE.items():
            if self.has(name) and self.table(name).dtypes != (empty := self.spark.createDataFrame([], of())).dtypes:
                self.replace(name, catalogue.in_schema(self.table(name), empty.schema))

    def fill_rides(self) -> None:
        """Recordings from before rides were known get theirs from their names."""
        if self.has("assets"):
            self.replace("assets", catalogue.backfill_rides(self.table("assets")))

    def ingest(self, folder: str) -> int:
        """Find the videos of a folder, and read the telemetry of those that are new; returns how many were read.

        A file that cannot be read fails alone: its run ends in an error with the message, and it is tried again next time.
        """
        self.migrate()
        found = saved(files.probed(files.with_content_hash(files.find_videos(self.spark, folder)).dropDuplicates([ASSET])))
        delta = found.select(ASSET, F.col("name").alias("filename"), F.col("path").alias("source_path"), "ride_id", "chapter", "bytes")
        self.replace("assets", catalogue.upsert(self.table("assets"), delta, [ASSET]))
        todo = saved(self.pending("telemetry").select(ASSET, "source_path", "bytes").join(found.select(ASSET, "container_s", "error"), ASSET))
        readable = todo.where("error is null").select("source_path", "bytes").collect()  # names and sizes of files: what the reader plans its tasks from
        broken = todo.where("error is not null").select(ASSET, "error")
        if not readable:
            self.record("telemetry", todo.limit(0), broken)
            return 0
        payloads = extraction.read_payloads(self.spark, [r["source_path"] for r in readable], sizes=[r["bytes"] for r in readable], errors=True).withColumnRenamed(ASSET, "source_path")
        payloads = saved(payloads.join(todo.select("source_path", ASSET), "source_path").drop("source_path"))
        failed = payloads.where("error is not null").groupBy(ASSET).agg(F.min("error").alias("error"))
        broken = saved(broken.unionByName(failed))
        fresh = saved(todo.join(broken.select(ASSET), ASSET, "left_anti"))
        hashed = payloads.drop("error").join(broken.select(ASSET), ASSET, "left_anti")
        telemetry, imu, streams = extraction.extract(hashed, [f.name for f in schema.telemetry().fields if f.name not in (ASSET, "t")])
        files.write_series(telemetry, self.path("telemetry"))
        files.write_series(imu, self.path("imu"))
        odd = extraction.unknown_layouts(hashed).select(ASSET, F.concat_ws(" ", "key", F.lit("has"), F.col("n").cast("string"), F.lit("fields")).alias("__odd"))
        for r in odd.groupBy("__odd").agg(F.count("*").alias("n")).orderBy("__odd").collect():  # a row a kind of stream
            warnings.warn(f"{r['__odd']} in {r['n']} file(s): its columns get numbers for names", stacklevel=2)
        listed = streams.groupBy(ASSET).agg(F.sort_array(F.collect_set("key")).alias("streams"))
        ends = self.table("telemetry").groupBy(ASSET).agg((F.max("t") + 0.1).alias("__end"))
        known = fresh.select(ASSET, "container_s").join(listed, ASSET, "left").join(ends, ASSET, "left")
        known = known.select(ASSET, "streams", F.coalesce("container_s", "__end").alias("duration_s"), F.col("streams").isNotNull().alias("has_gpmd"))
        self.replace("assets", catalogue.upsert(self.table("assets"), known, [ASSET]))
        self.record("telemetry", fresh, broken)
        return fresh.count()

    def verify(self, text: str | None = None) -> DataFrame:
        """(filename, metric, value, verdict) of the recordings that a text picks, or of all."""
        assets = self.table("assets")
        own = catalogue.find(assets, text) if text else assets
        return checks.verify(self.table("telemetry"), own).join(own.select(ASSET, "filename"), ASSET).select("filename", "metric", "value", "verdict").orderBy("filename", "metric")

    def timing(self) -> DataFrame:
        """(stage, runs, failed, seconds, share) of the runs noted."""
        took = F.col("finished_at").cast("double") - F.col("started_at").cast("double")
        own = self.table("runs").groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "error").alias("failed"), F.sum(took).alias("seconds"))
        return own.withColumn("share", F.try_divide("seconds", F.sum("seconds").over(W.partitionBy()))).orderBy("stage")  # a row a stage

    def relink(self, folder: str) -> DataFrame:
        """(content_hash, state, path): recordings that moved get the path at which a folder has them; found, missing or unknown."""
        found = saved(files.index_archive(files.find_videos(self.spark, folder).select("path")))
        moved = found.join(self.table("assets").select(ASSET), ASSET, "left_semi").select(ASSET, F.col("path").alias("source_path"))
        self.replace("assets", catalogue.upsert(self.table("assets"), moved, [ASSET]))
        return catalogue.relink(self.table("assets"), found).join(found, ASSET, "left")

    def retime(self) -> DataFrame:
        """(filename, recorded_at_gps, clock_drift_s, lighting): starts by position, saved; those without one follow their ride's chapters."""
        assets, telemetry = self.table("assets"), self.table("telemetry")
        place = telemetry.groupBy(ASSET).agg(F.percentile("gps_lat", F.lit(0.5)).alias("__lat"), F.percentile("gps_lon", F.lit(0.5)).alias("__lon"), F.percentile("isoe", F.lit(0.5)).alias("iso"))
        own = assets.drop("gps_lat", "gps_lon").join(place, ASSET, "left").withColumnsRenamed({"__lat": "gps_lat", "__lon": "gps_lon"})
        timed = saved(features.retime(own, features.gps_start(telemetry)))
        delta = timed.select(ASSET, F.timestamp_seconds("started").alias("recorded_at_gps"), F.col("drift_s").alias("clock_drift_s"), "lighting", "lighting_source", "gps_lat", "gps_lon")
        self.replace("assets", catalogue.upsert(assets, delta, [ASSET]))
        return self.table("assets").select("filename", "recorded_at_gps", "clock_drift_s", "lighting").orderBy("filename")

    def orient(self) -> DataFrame:
        """(filename, degrees): which way up each recording was taken, by its mean gravity, saved as its rotation; null where that doesn't tell."""
        g = [F.avg(F.when(F.abs(f"grav_{i}") < float("inf"), F.col(f"grav_{i}"))).alias(f"g{i}") for i in range(3)]
        ways = saved(self.table("telemetry").groupBy(ASSET).agg(*g).select(ASSET, gates.upright(F.col("g0"), F.col("g1"), F.col("g2")).alias("degrees")))
        self.replace("assets", catalogue.upsert(self.table("assets"), ways.where("degrees is not null").select(ASSET, F.col("degrees").alias("rotation")), [ASSET]))
        return self.table("assets").select(ASSET, "filename").join(ways, ASSET).drop(ASSET).orderBy("filename")

    def recordings(self) -> DataFrame:
        """The assets by the time they were taken, those without one last, and their names."""
        return self.table("assets").orderBy(F.coalesce("recorded_at_gps", "recorded_at").asc_nulls_last(), "filename")

    def listed(self) -> DataFrame:
        """(id, ride, chapter, filename, t_in, t_out, score, dominant, status) of the segments in the order they were ridden in."""
        own = self.table("segments").join(self.table("assets").select(ASSET, "filename", F.coalesce("ride_id", ASSET).alias("ride"), F.coalesce("chapter", F.lit(0)).alias("chapter")), ASSET)
        edges = [F.coalesce(f"{t}_user", t).alias(t) for t in ("t_in", "t_out")]
        return own.select("id", "ride", "chapter", "filename", *edges, "score", "dominant", "status").orderBy("ride", "chapter", "t_in", "id")

    def fit(self, kinds: tuple[str, ...] = ("turn", "rough", "jump"), seed: int = 0, spread: float = 0.05) -> tuple[DataFrame, DataFrame]:
        """What the decisions say about the scores: (one row of held-out AUCs and a verdict, weights by feature).

        The model is a ridge regression over the features of decided segments, judged on folds that it hasn't seen, pooled and
        within rides, beside the score that chose them. Raises if there are fewer than two of each decision.
        """
        rides = self.table("assets").select(ASSET, F.coalesce("ride_id", ASSET).alias("ride"))
        decided = self.table("segments").where("status in ('approved', 'rejected')").join(rides, ASSET)
        matrix = decisions.fit_matrix(decided.withColumn("label", (F.col("status") == "approved").cast("int")), list(kinds))
        matrix = saved(matrix.select("id", "ride", "label", "score", "usable", *kinds))
        had = {r["label"]: r["n"] for r in matrix.where("usable").groupBy("label").agg(F.count("*").alias("n")).collect()}
        if min(had.get(0, 0), had.get(1, 0)) < 2:
            raise ValueError(f"{had.get(1, 0)} approved and {had.get(0, 0)} rejected segments with these features are too few")
        scored, weights = decisions.out_of_fold(matrix, list(kinds), "label", "id", k=min(5, had[0], had[1]), seed=seed)
        scored = saved(scored)
        parts = [decisions.auc_pooled(scored, "p", "label").select(F.col("auc").alias("fit")), decisions.auc_within(scored, "ride", "p", "label").select(F.col("auc").alias("within"), "pairs")]
        parts += [decisions.auc_pooled(scored, "score", "label").select(F.col("auc").alias("incumbent")), decisions.auc_within(scored, "ride", "score", "label").select(F.col("auc").alias("incumbent_within"))]
        row = scored.agg(F.count("*").alias("n"), F.sum("label").alias("approved"))
        for one in parts:  # a row each
            row = row.join(F.broadcast(one))
        row = row.withColumn("verdict", decisions.verdict(*[F.col(c) for c in ("fit", "within", "pairs", "incumbent", "incumbent_within")], F.lit(spread)))
        stability = decisions.weight_stability(weights)
        return row, stability.join(decisions.suggested_weights(stability), "feature").orderBy("feature")

    def level(self) -> DataFrame:
        """(filename, spread, image_spread, suppression, locked): how steady gravity is in the body and in the picture; locked is saved."""
        steady = saved(features.roll_suppression(self.table("telemetry")))
        self.replace("assets", catalogue.upsert(self.table("assets"), steady.select(ASSET, F.col("locked").alias("horizon_locked")), [ASSET]))
        return self.table("assets").select(ASSET, "filename").join(steady, ASSET).drop(ASSET).orderBy("filename")

    def score(self) -> None:
        """A row of features for every second of the assets that have telemetry and no scores yet."""
        todo = saved(self.pending("score").where("has_gpmd").select(ASSET, "duration_s"))
        own = lambda name: self.table(name).join(todo.select(ASSET), ASSET, "left_semi")
        scores, air = features.compute(todo, own("telemetry"), own("imu"))
        files.write_series(scores, self.path("scores"))
        air.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ASSET).parquet(self.path("air"))
        self.record("score", todo)

    def calibrate(self, weights: dict[str, float] | None = None, approximate: bool = False) -> DataFrame:
        """Percentile tables over the whole library, saved together; returns what each feature offers. Exact ones are made
        in several passes of counts, approximate ones in one of sketches."""
        scores = self.table("scores")
        breaks = saved(cal.score_breaks(scores, approximate))
        levels = saved(self._levels(scores, breaks, weights))
        files.save_calibration(breaks, cal.level_breaks(levels, approximate), self.path("calibration"))
        return breaks.select("feature", "n", F.coalesce("reason", F.lit("usable")).alias("reason"))

    @staticmethod
    def _levels(scores: DataFrame, breaks: DataFrame, weights: dict[str, float] | None) -> DataFrame:
        weights = weights or cal.WEIGHTS
        return cal.leveled(cal.sub_scores(scores, breaks), [f"s_{k}" for k in cal.SOURCES], [weights[k] for k in cal.SOURCES])

    def composed(self, weights: dict[str, float] | None = None) -> DataFrame:
        """Every second with its sub-scores, level and composite, by the saved calibration."""
        breaks, levels = files.load_calibration(self.spark, self.path("calibration"))
        return cal.composite(cal.level_ranks(self._levels(self.table("scores"), breaks, weights), levels), ASSET, ["t"])

    def clips(self, weights: dict[str, float] | None = None) -> int:
        """New candidates of all recordings that are long enough; decided ones stay. Returns how many segments there are."""
        long = self.table("assets").where(gates.long_enough(F.col("duration_s"))).select(ASSET)
        scored = self.composed(weights).join(long, ASSET)
        found = clips.clip_candidates(scored, self.table("air") if self.has("air") else None)
        old = self.table("segments")
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        names = [f.name for f in schema.segment().fields]
        fresh = found.select(ASSET, "t_in", "t_out", "rank", "score", "dominant", "features", F.lit("candidate").alias("status"), F.lit(catalogue.STAGES["select"]).alias("stage_version"))
        order = F.row_number().over(W.partitionBy(ASSET).orderBy("rank"))
        # numbered after the last id, by recording and rank: a recording has a few clips at most
        starts = saved(fresh.withColumn("__r", order))
        numbered = catalogue.ordering.numbered(starts, [ASSET, "__r"], "__n").withColumn("id", F.col("__n") + last + 1).drop("__n", "__r")
        whole = old.limit(0).unionByName(numbered, allowMissingColumns=True).select(*names)
        self.replace("segments", catalogue.replace_candidates(old, whole).select(*names))
        return self.table("segments").count()

    def rank(self, by: str = "clip", top: int | None = None) -> DataFrame:
        """(ride, clip, top30, floor, peak): rides by their best twelve seconds together, the mean of their best thirty or their
        median, chapters joined in order first; the unknown last."""
        chapters = self.table("assets").where(gates.long_enough(F.col("duration_s"))).select(ASSET, F.coalesce("ride_id", ASSET).alias("ride"), F.coalesce("chapter", F.lit(0)).alias("chapter"))
        own = self.composed().join(chapters, ASSET).withColumn("roll", series.full_trailing_mean("ride", ["chapter", ASSET, "t"], "composite"))
        nth = F.row_number().over(W.partitionBy("ride").orderBy(F.desc("composite")))
        best = own.withColumn("__n", nth)
        out = best.groupBy("ride").agg(F.max("roll").alias("clip"), F.avg(F.when(F.col("__n") <= 30, F.col("composite"))).alias("top30"), F.percentile("composite", F.lit(0.5)).alias("floor"), F.max("composite").alias("peak"))
        out = out.orderBy(F.desc_nulls_last(by), "ride")
        return out.limit(top) if top else out

    def inventory(self) -> DataFrame:
        """(content_hash, filename, duration_s, lacks): the recordings and what they lack."""
        lacks = gates.shortcomings(F.col("has_gpmd"), F.col("streams"), F.col("duration_s"))
        return self.table("assets").select(ASSET, "filename", "ride_id", "chapter", "duration_s", F.array_join(lacks, ", ").alias("lacks")).orderBy("ride_id", "chapter", "filename")

    def buckets(self) -> DataFrame:
        """(key, n, share): how the library's seconds divide by the features they have."""
        levels = self.spark.read.parquet(self.path("calibration/levels")).where("key is not null")
        return levels.select("key", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))  # a row a bucket, 16 at most

    def log(self) -> DataFrame:
        """(status, n) of the segments."""
        return self.table("segments").groupBy("status").agg(F.count("*").alias("n"))

    def label(self, text: str | None, style: str | None = None, mount: str | None = None) -> int:
        assets, changed = catalogue.label(self.table("assets"), text, style, mount)
        if changed:
            self.replace("assets", assets)
        return changed

    def archive(self, folder: str) -> DataFrame:
        """Copy what the archive lacks, each file verified, and note where it is; returns what failed."""
        todo = self.table("assets").where("archived_path is null and source_path is not null").select(ASSET, F.col("source_path").alias("path"))
        done = saved(files.copied(todo, folder, files.archive_file))
        delta = done.where("target is not null").select(ASSET, F.col("target").alias("archived_path"), F.current_timestamp().alias("archived_at"))
        self.replace("assets", catalogue.upsert(self.table("assets"), delta, [ASSET]))
        return done.where("error is not null").select("path", "error")

    def restore(self, folder: str) -> DataFrame:
        """(content_hash, path, target, error): archived recordings in a working folder."""
        return files.copied(self.table("assets").where("archived_path is not null").select(ASSET, F.col("archived_path").alias("path")), folder)


#: What brings a catalogue from each version to the next.
STEPS = [Library.add_columns, Library.fill_rides]
