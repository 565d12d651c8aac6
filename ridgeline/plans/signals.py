"""Pictures' tilt, body roll and averaged spectra over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.kernels import tilt
from ridgeline.operators import features, spectra
from ridgeline.plans import mapping as m
from ridgeline.plans.registry import query, r6, read


@query(
    "frame_tilt",
    """WITH px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
    bell AS (SELECT o, exp(-o * o / 2.0) / (SELECT sum(exp(-o * o / 2.0)) FROM range(-3, 4) r(o)) AS w FROM range(-3, 4) r(o)),
    wide AS (SELECT p.vec_id, p.y, p.x, sum(q.v * bell.w) AS v FROM px p JOIN bell ON true JOIN px q ON q.vec_id = p.vec_id AND q.y = p.y AND q.x = p.x + bell.o GROUP BY 1, 2, 3),
    soft AS (SELECT p.vec_id, p.y, p.x, sum(q.v * bell.w) AS v FROM wide p JOIN bell ON true JOIN wide q ON q.vec_id = p.vec_id AND q.x = p.x AND q.y = p.y + bell.o GROUP BY 1, 2, 3),
    near AS (SELECT vec_id, v, lag(v) OVER r AS l, lead(v) OVER r AS r, lag(v) OVER c AS u, lead(v) OVER c AS d FROM soft WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
    slope AS (SELECT vec_id, CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM near),
    edge AS (SELECT vec_id, sqrt(gx * gx + gy * gy) AS n, atan2(gy, gx) AS a FROM slope),
    least AS (SELECT vec_id, quantile_cont(n, 0.8) AS q FROM edge GROUP BY vec_id),
    spun AS (SELECT vec_id, count(*) AS k, sum(n) AS n, sum(n * cos(4 * a)) AS c, sum(n * sin(4 * a)) AS s FROM edge JOIN least USING (vec_id) WHERE n >= q GROUP BY vec_id)
    SELECT vec_id, CASE WHEN k >= 8 THEN round(degrees(atan2(s, c)) / 4, 5) END AS tilt, CASE WHEN k >= 8 THEN round(sqrt(s * s + c * c) / n, 6) ELSE 0 END AS strength FROM spun""",
)
def frame_tilt(spark, d):
    own = tilt.frame_tilts(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8, least=8)
    return own.select("vec_id", F.round("tilt", 5).alias("tilt"), r6("strength"))


_GRAV = "g AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), u AS (SELECT label, vec_id, a / n AS a, b / n AS b FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM g) WHERE n > 1e-6)"


@query(
    "body_roll",
    f"""WITH {_GRAV}, m AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM u GROUP BY label)
    SELECT u.label, vec_id AS t, 2 AS axis, round(degrees(CASE WHEN abs(ma) >= abs(mb) THEN atan2(b, sign(ma) * a) ELSE atan2(a, sign(mb) * b) END), 6) AS roll FROM u JOIN m ON m.label = u.label WHERE n >= 10""",
)
def body_roll(spark, d):
    own = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("t"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"grav_{i}") for i in range(3)])
    return features.body_roll(own, asset="label").select("label", "t", "axis", r6("roll"))


def _power_sql(points: int, keys: str, where: str = "true") -> str:
    """Common table expressions up to power(keys, k, hz, power): a discrete Fourier transform as it is defined."""
    return f"""{m.SAMPLES}, own AS (SELECT {keys}, t / 100 AS t, value AS v FROM samples WHERE {where}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys.replace(" AS part", "").split(", ")[0]}{", part" if "part" in keys else ""} ORDER BY t) - 1 AS j FROM own),
rates AS (SELECT asset{", part" if "part" in keys else ""}, (count(*) - 1) / (max(t) - min(t)) AS rate FROM own GROUP BY ALL),
cut AS (SELECT *, j // {points} AS seg, j % {points} AS i, count(*) OVER w AS n, avg(v) OVER w AS mean FROM numbered WINDOW w AS (PARTITION BY asset{", part" if "part" in keys else ""}, j // {points})),
windowed AS (SELECT *, (v - mean) * (0.5 - 0.5 * cos(2 * pi() * i / {points - 1})) AS x FROM cut WHERE n = {points}),
each AS (SELECT asset{", part" if "part" in keys else ""}, seg, k, sum(x * cos(2 * pi() * k * i / {points})) ** 2 + sum(x * sin(2 * pi() * k * i / {points})) ** 2 AS p FROM windowed, range({points // 2 + 1}) r(k) GROUP BY ALL),
power AS (SELECT asset{", part" if "part" in keys else ""}, k, rate * k / {points} AS hz, avg(p) AS power FROM each JOIN rates USING (asset{", part" if "part" in keys else ""}) GROUP BY ALL)"""


@query(
    "spectral_peaks",
    f"""WITH {_power_sql(32, "asset")}, inside AS (SELECT * FROM power WHERE hz BETWEEN 0.5 AND 48),
    soft AS (SELECT asset, hz, avg(power) OVER (PARTITION BY asset ORDER BY hz ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM inside),
    near AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, sum(p) OVER (PARTITION BY asset) AS total FROM soft WINDOW w AS (PARTITION BY asset ORDER BY hz)),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY p DESC, hz) AS INTEGER) AS rank FROM near WHERE p > a AND p >= b)
    SELECT asset, rank, round(hz, 6) AS hz, round(p / total, 6) AS share FROM top WHERE rank <= 3""",
)
def spectral_peaks(spark, d):
    own = m.samples(spark, d).select("asset", (F.col("t") / 100).alias("t"), "value")
    found = spectra.peaks(spectra.averaged(own, ["asset"], "value", points=32), ["asset"], most=3, low=0.5, high=48.0)
    return found.select("asset", "rank", r6("hz"), r6("share"))


@query(
    "band_changes",
    f"""WITH {_power_sql(16, "asset, CASE WHEN t < 32 THEN 0 ELSE 1 END AS part")}, bands(band, lo, hi) AS (VALUES (0, 0.5, 10.0), (1, 10.0, 30.0), (2, 30.0, 51.0)),
    shares AS (SELECT asset, part, band, sum(CASE WHEN hz >= lo AND hz < hi THEN power ELSE 0 END) AS p FROM power, bands GROUP BY ALL),
    whole AS (SELECT *, sum(p) OVER (PARTITION BY asset, part) AS total FROM shares),
    pair AS (SELECT a.asset, a.band, a.p / a.total AS before, b.p / b.total AS after, greatest(a.total, b.total) / least(a.total, b.total) < 1.5 AS comparable FROM whole a JOIN whole b ON a.asset = b.asset AND a.band = b.band AND a.part = 0 AND b.part = 1)
    SELECT asset, band, CASE WHEN comparable THEN round(before, 6) END AS share_before, CASE WHEN comparable THEN round(after, 6) END AS share_after, CASE WHEN comparable THEN round(after - before, 6) END AS change, comparable FROM pair""",
)
def band_changes(spark, d):
    own = m.samples(spark, d).select("asset", (F.col("t") / 100).alias("t"), "value", (F.col("t") >= 32).alias("late"))
    found = spectra.band_changes(own, ["asset"], "value", F.col("late"), [(0.5, 10.0), (10.0, 30.0), (30.0, 51.0)], points=16, ratio=1.5)
    return found.select("asset", "band", *[r6(c) for c in ("share_before", "share_after", "change")], "comparable")
