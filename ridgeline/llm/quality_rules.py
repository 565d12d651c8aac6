"""Quality rules: base limits, then robust multivariate outliers for each language and source.

Five statistics of a document (words, their mean length, symbols, lines and words that are no
repeats), on logarithmic scales, make a vector. For each (lang, source) the minimum covariance
determinant estimate is approached by concentration steps: from medians and absolute deviations,
take the share H of rows with the smallest Mahalanobis distances, recompute mean and covariance from
them as long as the determinant falls: a group whose own does not keeps its estimate, so the steps
come to an end; more than MOST_STEPS are an error. There is one start, so the estimate is the one that it leads to. A document whose squared distance
exceeds CUTOFF is rejected.

Only built-in functions are used. The vectors are fixed-point integers and the sums are exact, so the
estimates do not depend on the order of rows. Medians and distance quantiles are taken over quantized
values, of which there are a few thousand at most however many rows a group has; everything is summed
before it is exchanged. Cholesky factors are columns of the small table of groups, which Spark
broadcasts only if its size allows. Groups of fewer than LEAST rows are pooled by language, and
pools that are still smaller in one last pool; if that is too small as well, it rejects nothing.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, drop_table, materialize

H = 0.75
#: Makes the covariance of the H closest of normal rows in five dimensions consistent: H / P(chi2_7 < q), q the H quantile of chi2_5.
CONSISTENT = 1.41
CUTOFF = 50.0
LEAST = 50
MOST_STEPS = 100
FALL = 0.01  # the least fall of a determinant's logarithm that counts
#: Tables with a row a group are broadcast up to so many groups (a few hundred bytes each); beyond, they are joined by exchange.
BROADCAST_GROUPS = 50_000
FIXED = 1024  # fixed-point units
_NAMES = ("x0", "x1", "x2", "x3", "x4")
#: The least standard deviation of each statistic: most documents have no symbol or repeat at all. With CUTOFF these let
#: each statistic reject by itself: 32 symbols in 1000 words, 88 % of lines repeated, 43 % of words in repeated windows.
#: A third of the words in repeats, as one repeated licence line may make in a short document, does not.
FLOORS = (0.25, 0.1, 0.5, 0.3, 0.08)
_PAIRS = tuple(combinations_with_replacement(range(5), 2))
_FEW = 32


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words stand in a window of three that the text has twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:  # of ascending window places
        widths = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda s, w: s + w)

    def few(h: Column, double: Column) -> Column:
        places = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(double, x), i)), lambda i: i.isNotNull())
        return _let(places, covered)

    def many(h: Column) -> Column:
        def places(sorted_: Column) -> Column:
            same = F.filter(sorted_, lambda x, i: F.coalesce(F.get(sorted_, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False)))
            return _let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def of(h: Column) -> Column:
        double = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        some = _let(double, lambda d: F.when(F.size(d) <= _FEW, few(h, d)).otherwise(many(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(windows, of))


def statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return _let(
        F.array_remove(F.split(text, SPACE, -1), ""),
        lambda w: _let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
            ),
        ),
    )


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log1p(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(1000 * F.col("n_symbols") / n),
        F.log((1 + F.col("n_lines")) / (1 + F.col("n_lines") - F.col("n_dup_lines"))),
        F.log((1 + n) / (1 + n - F.col("n_repeat_words"))),
    )
    return [F.round(v * FIXED).cast("long").alias(name) for v, name in zip(values, _NAMES, strict=True)]


def _label(lang: Column, source: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.concat_ws("\x1f", part(lang), part(source))


def _groups(fit: DataFrame) -> DataFrame:
    """(lang, source, group): the group that each pair of the table belongs to, null if too small."""
    pairs = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = pairs.where(F.col("n") < LEAST)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    last = pools.where(F.col("pool") < LEAST).agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("rest"))
    return (
        pairs.join(pools.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left")
        .join(F.broadcast(last))  # one row
        .select(
            "lang",
            "source",
            F.when(F.col("n") >= LEAST, F.concat(F.lit("s"), _label(F.col("lang"), F.col("source"))))
            .when(F.col("pool") >= LEAST, F.concat(F.lit("l"), _label(F.col("lang"), F.lit(None))))
            .when(F.col("rest") >= LEAST, F.lit("r"))
            .alias("group"),
        )
    )


def _factors(moments: DataFrame) -> DataFrame:
    """(group, m0.., l00.., det): mean and Cholesky factor, in fixed-point units, of groups with (n, s0.., p00..)."""
    n = F.col("n").cast("double")
    out = moments.select("group", "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(5)], *[(F.col(f"p{i}{j}") / n).alias(f"p{i}{j}") for i, j in _PAIRS])
    cov = {(i, j): (F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT for i, j in _PAIRS}
    # floors are added to the diagonal, so that it is positive definite
    out = out.select("group", *[f"m{i}" for i in range(5)], *[(c + ((FLOORS[i] * FIXED) ** 2 if i == j else 0)).alias(f"c{i}{j}") for (i, j), c in cov.items()])
    return _cholesky(out)


def _cholesky(out: DataFrame) -> DataFrame:
    for j in range(5):
        for i in range(j, 5):
            rest = reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{j}{i}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda s, k: s + 2 * F.log(F.col(f"l{k}{k}")), range(5), F.lit(0.0))
    return out.select("group", *[f"m{i}" for i in range(5)], *[f"l{i}{j}" for j in range(5) for i in range(j, 5)], det.alias("det"))


def _distance(rows: DataFrame, factors: DataFrame, name: str, few: bool = False) -> DataFrame:
    """rows with the squared Mahalanobis distance; null where the group has no estimate. few: the groups may be broadcast."""
    keep = rows.columns
    out = rows.join(F.broadcast(factors) if few else factors, "group", "left")
    for i in range(5):
        rest = reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(_NAMES[i]) - F.col(f"m{i}"))
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.select(*keep, reduce(lambda s, k: s + F.col(f"y{k}") * F.col(f"y{k}"), range(5), F.lit(0.0)).alias(name))


def estimates(fit: DataFrame, few: bool = False) -> DataFrame:
    """Minimum covariance determinant estimates of the groups of fit(group, x0..x4). few: the groups may be broadcast."""
    small = F.broadcast if few else lambda df: df
    # start: medians, and standard deviations from median absolute deviations, over values quantized to 1/64
    coarse = lambda c: F.round(c / (FIXED // 64)).cast("int")
    middle = fit.groupBy("group").agg(*[(F.percentile(coarse(F.col(x)), F.lit(0.5)) * (FIXED // 64)).alias(f"m{i}") for i, x in enumerate(_NAMES)])
    off = fit.join(small(middle), "group").select("group", *[coarse(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(_NAMES)])
    spread = off.groupBy("group").agg(*[(F.percentile(f"d{i}", F.lit(0.5)) * (FIXED // 64) * 1.4826).alias(f"w{i}") for i in range(5)])
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i, j in _PAIRS if i != j]
    start = middle.join(spread, "group").select("group", *[f"m{i}" for i in range(5)], *zero, *[(F.col(f"w{i}") ** 2 + (FLOORS[i] * FIXED) ** 2).alias(f"c{i}{i}") for i in range(5)])
    factors = materialize(_cholesky(start).withColumn("det", F.lit(float("inf"))), "start")
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_NAMES)], *[F.sum(F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"p{i}{j}") for i, j in _PAIRS]]
    for _ in range(MOST_STEPS):
        far = _distance(fit, factors, "d", few).withColumn("q", F.round(F.log1p("d") * 64).cast("int"))
        near = far.groupBy("group").agg(F.percentile("q", F.lit(H)).alias("most"))
        moments = far.join(small(near), "group").where("q <= most").groupBy("group").agg(*sums)
        was = factors.select("group", F.struct(*factors.columns).alias("__was"))
        both = _factors(moments).join(was, "group")
        falls = F.col("det") < F.col("__was.det") - FALL
        after = both.select("group", *[F.when(falls, F.col(c)).otherwise(F.col(f"__was.{c}")).alias(c) for c in factors.columns if c != "group"], falls.alias("__falls"))
        after = materialize(after, "factors")
        settled = not after.where("__falls").limit(1).count()
        drop_table(factors)
        factors = after.drop("__falls")
        if settled:
            return factors
    raise RuntimeError(f"estimates did not settle in {MOST_STEPS} steps")


def quality(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(*carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row.

    carry names columns of docs(text, lang, source, ...) to take along, doc_id if not given. base_failed:
    fewer than 50 words, or over half of them in repeated windows. Rows that fail are no part of the
    estimates. A null text is empty and fails; null langs and sources are groups of their own; equal rows
    get equal results; a table in which all fail, or an empty one, has no estimates and rejects no more.
    """
    carry = ["doc_id"] if carry is None else carry
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], "lang", "source", statistics(F.col("text")).alias("__s")).select("*", "__s.*").drop("__s")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = materialize(rows.select("*", *_vector()), "statistics")
    groups = materialize(_groups(rows.where("not base_failed")), "groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    named = groups.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "group")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    grouped = rows.join(F.broadcast(named) if few else named, same, "left").drop("__lang", "__source")
    fit = materialize(grouped.where("not base_failed and group is not null").select("group", *_NAMES), "vectors")
    judged = _distance(grouped, estimates(fit, few), "__d", few)
    kept = ~F.col("base_failed") & (F.coalesce("__d", F.lit(0.0)) <= CUTOFF)
    return judged.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
