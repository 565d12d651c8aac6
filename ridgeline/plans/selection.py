"""Selection, the decision log's model, and the ordered kernels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import numbers
from ridgeline.kernels import filters, framing, tracker
from ridgeline.operators import clips, decisions, features, intervals, series
from ridgeline.plans import flagship
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, read
from ridgeline.sources import files

_DOMINANT = "(SELECT asset, CAST(floor(t / 10) AS BIGINT) AS win, max(speed) AS s_speed, max(turn) AS s_turn, max(rough) AS s_rough, max(air_s) * 700 AS s_jump FROM seconds GROUP BY 1, 2)"


def dominant(maxima: list, names: tuple[str, ...]):
    """The name of the greatest of columns, the first of equal ones; unknown if all are null."""
    best = F.greatest(*maxima)
    out = F.lit("unknown")
    for c, name in reversed(list(zip(maxima, names, strict=True))):
        out = F.when(c == best, name).otherwise(out)
    return out


@query("dominant_feature", f"WITH {m.SECONDS} SELECT asset, win, CASE greatest(s_speed, s_turn, s_rough, s_jump) WHEN s_speed THEN 'speed' WHEN s_turn THEN 'turn' WHEN s_rough THEN 'rough' WHEN s_jump THEN 'jump' ELSE 'unknown' END AS dominant FROM {_DOMINANT}")
def dominant_feature(spark, d):
    w = m.seconds(spark, d).groupBy("asset", F.floor(F.col("t") / 10).alias("win")).agg(*[F.max(c).alias(c) for c in ("speed", "turn", "rough")], (F.max("air_s") * 700).alias("jump"))
    return w.select("asset", "win", dominant([F.col(c) for c in clips.KINDS], tuple(clips.KINDS)).alias("dominant"))


@query("diversify", f"WITH {m.SEGMENTS}, n AS (SELECT *, score * pow(0.75, row_number() OVER (PARTITION BY content_hash, lang ORDER BY score DESC, id) - 1) AS adjusted FROM segments), r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY adjusted DESC, id) AS rank FROM n) SELECT content_hash, id, rank, round(adjusted, 6) AS adjusted FROM r WHERE rank <= 6")
def diversify(spark, d):
    out = intervals.diversify(m.segments(spark, d), "content_hash", "lang", "score", "id")
    return out.select("content_hash", "id", F.col("rank").cast("long").alias("rank"), r6("adjusted"))


_CLIPS = f"""WITH RECURSIVE {flagship.APPLIED}, {m.SAMPLES}, sec AS (SELECT asset, CAST(t AS INTEGER) AS i, round(composite, 9) AS y, s_speed AS speed, s_turn AS turn, s_rough AS rough, s_air_d AS jump FROM composed),
ev AS (SELECT asset, min(t) AS ts, min(t) + 0.4 AS te FROM samples WHERE value > 450 GROUP BY asset),
lim AS (SELECT asset, count(*)::INTEGER AS n, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.7) AS h, quantile_cont(y, 0.95) AS u FROM sec GROUP BY asset HAVING max(abs(y)) > 0),
nb AS (SELECT sec.*, n, greatest(h, m + 0.3 * (u - m)) AS least_y, greatest(0.55, m + 0.15 * (u - m)) AS bar, lag(y) OVER w AS was, lead(y) OVER w AS will FROM sec JOIN lim USING (asset) WINDOW w AS (PARTITION BY asset ORDER BY i)),
pk AS (SELECT asset, i, y, n, bar FROM nb WHERE y >= least_y AND (was IS NULL OR y > was) AND (will IS NULL OR CASE WHEN was IS NULL THEN y > will ELSE y >= will END)),
st AS (SELECT p.*, coalesce((SELECT max(s.i) + 1 FROM sec s WHERE s.asset = p.asset AND s.i < p.i AND s.y < p.y * 0.55), 0) AS f, coalesce((SELECT min(s.i) FROM sec s WHERE s.asset = p.asset AND s.i > p.i AND s.y < p.y * 0.55), n) - 1 AS l FROM pk p),
tried AS (SELECT asset, i, unnest(CASE WHEN least(i, l - 29) < greatest(f, i - 26) THEN [greatest(f, least(i, l - 29))] ELSE range(greatest(f, i - 26), least(i, l - 29) + 1) END) AS s FROM st WHERE l + 1 - f > 30),
means AS (SELECT w.asset, w.i, w.s, avg(x.y) AS mean FROM tried w JOIN sec x ON x.asset = w.asset AND x.i >= w.s AND x.i < w.s + 30 GROUP BY 1, 2, 3),
best AS (SELECT *, max(mean) OVER (PARTITION BY asset, i) AS top FROM means),
chosen AS (SELECT asset, i, min({{'o': abs(i - s - 1.5), 's': s}}).s AS s FROM best WHERE mean >= top - 0.01 * abs(top) GROUP BY asset, i),
e0 AS (SELECT st.*, coalesce(s, f) - 1.5::DOUBLE AS a0, coalesce(s + 29, l) + 1::DOUBLE AS b0 FROM st LEFT JOIN chosen USING (asset, i)),
e1 AS (SELECT *, greatest(0, 10 - (b0 - a0)) / 2 AS short FROM e0),
e2 AS (SELECT *, CASE WHEN b0 + short - i < 4 THEN least(n, i + 4) ELSE b0 + short END::DOUBLE AS b1 FROM e1),
e3 AS (SELECT e2.*, greatest(a0 - short, b1 - 30, 0) AS a2, least(n, b1) AS b2, ts, te FROM e2 LEFT JOIN ev USING (asset)),
e4 AS (SELECT asset, i, y, n, bar, CASE WHEN ts < a2 AND a2 < te THEN greatest(0, ts - 0.5) ELSE a2 END AS a, CASE WHEN ts < b2 AND b2 < te THEN te + 0.5 ELSE b2 END AS b FROM e3),
e5 AS (SELECT *, floor(a) AS lo, greatest(least(n, ceil(b)), floor(a) + 1) AS hi FROM e4 WHERE b - a >= 8),
sc AS (SELECT e.asset, e.i, e.y, e.n, e.bar, e.a, e.b, avg(x.y) AS score, max(x.speed) AS speed, max(x.turn) AS turn, max(x.rough) AS rough, max(x.jump) AS jump FROM e5 e JOIN sec x ON x.asset = e.asset AND x.i >= e.lo AND x.i < e.hi GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY y DESC, CASE WHEN i = 0 THEN 1 WHEN i = n - 1 THEN 2 ELSE 0 END, i) AS rn FROM sc WHERE score >= bar - 1e-9),
rec AS (SELECT asset, rn, [{{'a': round(a, 2), 'b': round(b, 2)}}] AS kept, true AS free FROM ok WHERE rn = 1
  UNION ALL SELECT asset, rn, CASE WHEN free THEN list_append(kept, {{'a': round(a, 2), 'b': round(b, 2)}}) ELSE kept END, free FROM (SELECT o.asset, o.rn, o.a, o.b, r.kept, len(r.kept) < 18 AND len(list_filter(r.kept, lambda k: o.a < k.b + 9 AND k.a - 9 < o.b)) = 0 AS free FROM rec r JOIN ok o ON o.asset = r.asset AND o.rn = r.rn + 1)),
kind AS (SELECT ok.*, CASE greatest(speed, turn, rough, jump) WHEN speed THEN 'speed' WHEN turn THEN 'turn' WHEN rough THEN 'rough' WHEN jump THEN 'jump' ELSE 'unknown' END AS dominant FROM ok JOIN rec USING (asset, rn) WHERE free),
adj AS (SELECT *, score * pow(0.75, row_number() OVER (PARTITION BY asset, dominant ORDER BY score DESC, rn) - 1) AS adjusted FROM kind),
placed AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY adjusted DESC, rn) AS rank FROM adj)
SELECT asset, rank::INTEGER AS rank, round(a, 2) AS t_in, round(b, 2) AS t_out, i::DOUBLE AS peak_t, round(y, 6) AS peak, round(score, 6) AS score, round(adjusted, 6) AS adjusted, dominant FROM placed WHERE rank <= 6"""


@query("clip_candidates", _CLIPS)
def clip_candidates(spark, d):
    scores = flagship.composed(spark, d).select("asset", "t", F.round("composite", 9).alias("composite"), "s_speed", "s_turn", "s_rough", "s_air_d")
    events = m.samples(spark, d).where("value > 450").groupBy("asset").agg(F.min("t").alias("t_start")).withColumn("t_end", F.col("t_start") + 0.4)
    found = clips.clip_candidates(scores, events, "asset")
    return found.select("asset", "rank", "t_in", "t_out", "peak_t", r6("peak"), r6("score"), r6("adjusted"), "dominant")


_BUDGET = f"""WITH RECURSIVE {m.SEGMENTS}, o AS (SELECT content_hash, id, t_out - t_in AS len, row_number() OVER (PARTITION BY content_hash ORDER BY t_in, id) AS n FROM segments WHERE status = 'approved'),
f AS (SELECT content_hash, id, n, 1 AS part, len AS used FROM o WHERE n = 1 UNION ALL SELECT o.content_hash, o.id, o.n, CASE WHEN f.used + o.len > 175 THEN f.part + 1 ELSE f.part END, CASE WHEN f.used + o.len > 175 THEN o.len ELSE f.used + o.len END FROM f JOIN o ON o.content_hash = f.content_hash AND o.n = f.n + 1)
SELECT content_hash, id, part FROM f"""


@query("budget_split", _BUDGET)
def budget_split(spark, d):
    own = m.segments(spark, d).where("status = 'approved'").select("content_hash", "t_in", "id", (F.col("t_out") - F.col("t_in")).alias("len"))
    return intervals.budget_split(own, "content_hash", ["t_in", "id"], "len", 175.0).select("content_hash", "id", "part")


_SUPPRESS = f"""WITH RECURSIVE {m.SEGMENTS}, o AS (SELECT content_hash, t_in, t_out, row_number() OVER (PARTITION BY content_hash ORDER BY score DESC, id) AS n FROM segments),
f AS (SELECT content_hash, n, t_in, t_out, true AS free, [{{'a': t_in, 'b': t_out}}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT content_hash, n, t_in, t_out, free, CASE WHEN free THEN list_append(kept, {{'a': t_in, 'b': t_out}}) ELSE kept END FROM (SELECT o.*, f.kept, len(list_filter(f.kept, lambda k: o.t_in < k.b + 9 AND k.a - 9 < o.t_out)) = 0 AS free FROM f JOIN o ON o.content_hash = f.content_hash AND o.n = f.n + 1))
SELECT content_hash, t_in, t_out FROM f WHERE free"""


@query("suppress_overlaps", _SUPPRESS)
def suppress_overlaps(spark, d):
    own = m.segments(spark, d)
    return intervals.suppress(own, "content_hash", [-F.col("score"), F.col("id")], "t_in", "t_out", 9.0).select("content_hash", "t_in", "t_out")


_LOG = m.SEGMENTS + ", log AS (SELECT id, content_hash AS grp, score, CASE status WHEN 'approved' THEN 1 ELSE 0 END AS label FROM segments WHERE status <> 'candidate')"


def log(spark, d):
    return m.segments(spark, d).where("status <> 'candidate'").select("id", F.col("content_hash").alias("grp"), "score", "n_chars", "t_in", "slot", (F.col("status") == "approved").cast("int").alias("label"))


@query("fit_matrix", f"WITH {_LOG}, f AS (SELECT l.id, l.label, CASE WHEN l.id % 7 > 0 THEN l.score END AS speed, s.slot * 1.0 AS turn, CASE WHEN l.id % 11 > 0 THEN 0.5 ELSE 0.0 END AS jump FROM log l JOIN segments s ON l.id = s.id) SELECT id, label, round(speed, 6) AS speed, turn, jump, speed IS NOT NULL AS usable FROM f")
def fit_matrix(spark, d):
    own = log(spark, d)
    i = F.col("id")
    # NaN and a missing key are both absent
    speed = F.when(i % 14 == 0, F.lit(float("nan"))).when(i % 7 > 0, F.col("score"))
    f = F.map_filter(F.create_map(F.lit("speed"), speed, F.lit("turn"), F.col("slot") * 1.0, F.lit("jump"), F.when(i % 11 > 0, F.lit(0.5))), lambda k, v: v.isNotNull())
    out = decisions.fit_matrix(own.withColumn("features", f), ["speed", "turn", "jump"])
    return out.select("id", "label", r6("speed"), "turn", "jump", "usable")


@query("auc_pooled", f"WITH {_LOG}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM log), s AS (SELECT sum(label) AS p, count(*) - sum(label) AS q, sum(mid * label) AS r FROM r) SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc, p::BIGINT AS n_pos, q::BIGINT AS n_neg FROM s")
def auc_pooled(spark, d):
    return decisions.auc_pooled(log(spark, d), "score", "label").withColumn("auc", F.round("auc", 6))


@query("auc_within", f"WITH {_LOG} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, count(*) AS pairs, count(DISTINCT a.grp) AS groups FROM log a JOIN log b ON a.grp = b.grp AND a.label = 1 AND b.label = 0")
def auc_within(spark, d):
    return decisions.auc_within(log(spark, d), "grp", "score", "label").withColumn("auc", F.round("auc", 6))


@query("stratified_folds", f"WITH {_LOG} SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) - 1) % 5 AS INTEGER) AS fold FROM log")
def stratified_folds(spark, d):
    return decisions.folds(log(spark, d), "id", "label").select("id", "label", "fold")


@query("fit_evaluate")
def fit_evaluate(spark, d):
    matrix = log(spark, d).withColumn("usable", F.lit(True)).withColumn("n_chars", F.log1p("n_chars"))
    scored, weights = decisions.out_of_fold(matrix, ["n_chars", "t_in"], "label", "id")
    fit, within, held = decisions.auc_pooled(scored, "p", "label"), decisions.auc_within(scored, "grp", "p", "label"), decisions.auc_pooled(scored, "score", "label")
    # one row each
    both = fit.select(F.col("auc").alias("fit")).join(F.broadcast(within.select(F.col("auc").alias("within"), "pairs"))).join(F.broadcast(held.select(F.col("auc").alias("incumbent"))))
    out = both.withColumn("verdict", decisions.verdict(F.col("fit"), F.col("within"), F.col("pairs"), F.col("incumbent"), F.col("incumbent"), F.lit(0.05)))
    stable = decisions.weight_stability(weights).agg(F.bool_and("stable").alias("stable"))
    return out.join(F.broadcast(stable))


_VERDICT = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN 0.5 + p_size / 200.0 END AS fit, CASE WHEN p_partkey % 3 > 0 THEN 0.5 + p_partkey % 30 / 200.0 END AS win, p_size * 2 AS pairs, 0.5 + p_partkey % 17 / 100.0 AS inc, 0.5 + p_partkey % 23 / 100.0 AS incw, 0.05 AS spread FROM part"


@query(
    "fit_verdict",
    f"""WITH v AS ({_VERDICT}) SELECT id, CASE WHEN pairs >= 40 AND coalesce(incw > win + 0.05, false) THEN 'keep current' WHEN win IS NOT NULL AND pairs < 40 THEN 'too few comparisons' WHEN coalesce(fit >= 0.58, false) AND win IS NULL THEN 'unverifiable'
      WHEN coalesce(fit >= 0.58, false) AND win < 0.56 THEN 'confounded' WHEN NOT coalesce(fit >= 0.58, false) THEN 'no signal' WHEN fit - inc < greatest(0.03, spread / 2) THEN 'no better' ELSE 'use it' END AS verdict FROM v""",
)
def fit_verdict(spark, d):
    k = F.col("p_partkey")
    dec = lambda c: F.lit(0.5) + c
    v = decisions.verdict(
        F.when(k % 5 > 0, dec(F.col("p_size") / 200.0)), F.when(k % 3 > 0, dec(k % 30 / 200.0)), F.col("p_size") * 2, dec(k % 17 / 100.0), dec(k % 23 / 100.0), F.lit(0.05)
    )
    return read(spark, d, "part").select(k.alias("id"), v.alias("verdict"))


@query("content_fingerprint", "SELECT doc_id, 's3s2_' || left(sha256(octet_length(encode(text)) || '|' || text), 32) AS fingerprint FROM documents")
def content_fingerprint(spark, d):
    body = F.concat(F.octet_length("text").cast("string"), F.lit("|"), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("s3s2_"), F.left(F.sha2(body, 256), F.lit(32))).alias("fingerprint"))


@query("sampled_hash")
def sampled_hash(spark, d):
    """The file hash over texts as files, with windows of 100 bytes so that most texts are sampled."""
    return read(spark, d, "documents").select("doc_id", files.hash_column(F.col("text").cast("binary"), 100).alias("hash"))


@query("track_follow")
def track_follow(spark, d):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = F.struct((0.4 + v(0)).alias("x0"), (0.4 + v(1)).alias("y0"), (0.45 + v(0)).alias("x1"), (0.5 + v(1)).alias("y1"), F.abs(v(2) * 4).alias("score"))
    rows = read(spark, d, "embeddings").select("label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) / 5.0).alias("t"), F.array(box).alias("boxes"), F.lit(0).alias("rejected"))
    return tracker.track(rows, "label")


@query("deadzone_path")
def deadzone_path(spark, d):
    own = m.gappy(spark, d).select("asset", (F.col("t") / 10).alias("t"), (F.col("v") / 500).alias("z"))
    aims = series.hold_then_ease(own, "asset", "t", "z", 0.5)
    return framing.crop_paths(aims, "asset", 0.1, 0.9).drop("violation")


@query("roughness")
def roughness(spark, d):
    by = F.col("t") / 100
    imu = m.samples(spark, d).select("asset", by.alias("t"), (F.col("value") / 50).alias("accl_0"), (F.col("k") / 10).cast("double").alias("accl_1"), F.lit(9.8).alias("accl_2"))
    return filters.roughness(imu, "asset")


@query("turn_rate")
def turn_rate(spark, d):
    imu = m.samples(spark, d).select("asset", (F.col("t") / 30).alias("t"), *[((F.col("value") - 245) / (100 + 50 * i)).alias(f"gyro_{i}") for i in range(3)], F.lit(0.1).alias("grav_0"), F.lit(0.95).alias("grav_1"), F.lit(0.2).alias("grav_2"))
    return filters.turn_rate(imu, "asset")


@query("spectral_bands")
def spectral_bands(spark, d):
    own = m.samples(spark, d).select("asset", (F.col("t") / 100).alias("t"), "value")
    return filters.bands(own, "asset", "value", [(0.5, 3.0), (3.0, 12.0), (12.0, 45.0)])


def _spread_sql(name: str, source: str) -> str:
    """A common table expression with the spread of the directions x, y, z of a table by label."""
    return f"""{name}_u AS (SELECT label, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM {source}) WHERE n > 1e-9),
{name}_m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {name}_u GROUP BY label),
{name} AS (SELECT label, avg(degrees(acos(greatest(-1, least(1, (x * mx + y * my + z * mz) / sqrt(mx * mx + my * my + mz * mz)))))) AS {name} FROM {name}_u JOIN {name}_m USING (label) GROUP BY label HAVING count(*) > 1)"""


def _turned_sql(sign: str) -> str:
    return f"""SELECT label, (w*w+a*a-b*b-c*c)*x + 2*(a*b-({sign}w)*c)*y + 2*(a*c+({sign}w)*b)*z AS x, 2*(a*b+({sign}w)*c)*x + (w*w-a*a+b*b-c*c)*y + 2*(b*c-({sign}w)*a)*z AS y, 2*(a*c-({sign}w)*b)*x + 2*(b*c+({sign}w)*a)*y + (w*w-a*a-b*b+c*c)*z AS z FROM own"""


_LEVEL_SQL = f"""WITH raw AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 0.3 AS z, 1.0 AS w0, embedding[4]::DOUBLE * 0.2 AS a0, embedding[5]::DOUBLE * 0.2 AS b0, embedding[6]::DOUBLE * 0.2 AS c0 FROM embeddings),
own AS (SELECT label, x, y, z, w0 / n AS w, a0 / n AS a, b0 / n AS b, c0 / n AS c FROM (SELECT *, sqrt(w0*w0 + a0*a0 + b0*b0 + c0*c0) AS n FROM raw)),
one_r AS ({_turned_sql('-')}), two_r AS ({_turned_sql('')}), {_spread_sql('body', 'own')}, {_spread_sql('one', 'one_r')}, {_spread_sql('two', 'two_r')}
SELECT label, round(body, 6) AS spread, round(least(one, two), 6) AS image_spread, CASE WHEN body > 0.5 THEN round(1 - least(one, two) / body, 6) END AS suppression, CASE WHEN body > 0.5 THEN 1 - least(one, two) / body > 0.5 END AS locked FROM body JOIN one USING (label) JOIN two USING (label)"""


@query("roll_suppression", _LEVEL_SQL)
def roll_suppression(spark, d):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    turn = numbers.normalised([F.lit(1.0), v(3) * 0.2, v(4) * 0.2, v(5) * 0.2])
    own = read(spark, d, "embeddings").select("label", v(0).alias("grav_0"), v(1).alias("grav_1"), (v(2) + 0.3).alias("grav_2"), *[c.alias(f"iori_{x}") for c, x in zip(turn, "wxyz", strict=True)])
    out = features.roll_suppression(own, "label")
    return out.select("label", r6("spread"), r6("image_spread"), r6("suppression"), "locked")


@query("visible_roll", f"WITH {m.SAMPLES}, r AS (SELECT asset, t, degrees(atan2(value - 245, k + 1)) AS roll FROM samples), q AS (SELECT asset, quantile_cont(roll, 0.5) AS mid FROM r GROUP BY asset) SELECT asset, t, round(0.4 * (roll - mid) + 2, 6) AS visible FROM r JOIN q USING (asset)")
def visible_roll(spark, d):
    r = m.samples(spark, d).select("asset", "t", numbers.roll_angle(F.col("value") - 245, F.col("k") + 1).alias("roll"))
    mid = r.groupBy("asset").agg(F.percentile("roll", F.lit(0.5)).alias("mid"))
    return r.join(mid, "asset").select("asset", "t", r6(0.4 * (F.col("roll") - F.col("mid")) + 2, "visible"))
