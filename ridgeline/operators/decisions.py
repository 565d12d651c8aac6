"""The decision log: rates, confounding, ranking quality, and a model of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators import ordering
from ridgeline.session import saved


def attribute_rates(decided: DataFrame, attributes: dict[str, Column], group: str) -> DataFrame:
    """(attribute, value, ok, n, groups, rate) of each attribute with more than one value, in one pass over decided(approved, group)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), c.cast("string").alias("value")) for k, c in attributes.items()])
    rows = decided.select(group, "approved", F.inline(pairs))
    rates = rows.groupBy("attribute", "value").agg(F.count_if("approved").alias("ok"), F.count("*").alias("n"), F.countDistinct(group).alias("groups"))
    several = F.count("*").over(W.partitionBy("attribute"))
    return rates.withColumn("__k", several).where("__k > 1").drop("__k").withColumn("rate", F.col("ok") / F.col("n"))


def confounded(decided: DataFrame, attributes: dict[str, Column], group: str) -> DataFrame:
    """(attributes, buckets): attributes that divide the groups in exactly the same way are one variable.

    A set is known by its size and two hash sums over its members, so no list of groups is made.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), c.cast("string").alias("value")) for k, c in attributes.items()])
    rows = decided.select(F.col(group).cast("string").alias("__g"), F.inline(pairs)).distinct()

    def of_set(*member: str) -> list[Column]:
        return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(*member)).alias("x"), F.sum(F.xxhash64(F.lit("sum"), *member).cast("decimal(38,0)")).alias("s")]

    buckets = rows.groupBy("attribute", "value").agg(*of_set("__g"))
    # values that hold the same groups are one bucket
    parts = buckets.select("attribute", "n", "x", "s").distinct().withColumnsRenamed({"n": "bn", "x": "bx", "s": "bs"})
    parts = parts.groupBy("attribute").agg(*of_set("bn", "bx", "bs")).where("n > 1")
    same = parts.groupBy("n", "x", "s").agg(F.array_sort(F.collect_list("attribute")).alias("attributes")).where(F.size("attributes") > 1)
    return same.select(F.array_join("attributes", ",").alias("attributes"), F.col("n").alias("buckets"))


def auc_pooled(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, n_pos, n_neg) by mid-ranks. Ranks come from counts per distinct score, so equal scores are one row, and from
    running totals over those, dealt by range."""
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = own.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    ranked = ordering.running(counts, [score], {"before": F.col("n")}).withColumn("mid", F.col("before") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("mid") * F.col("pos")).alias("r"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), F.col("p").cast("long").alias("n_pos"), F.col("q").cast("long").alias("n_neg"))


def auc_within(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(auc, pairs, groups): the share of same-group pairs in order, ties half; from counts per score, without forming the pairs."""
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = own.groupBy(group, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(group).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    per = wins.groupBy(group).agg(F.sum("won").alias("won"), (F.sum("pos") * F.sum("neg")).alias("pairs")).where("pairs > 0")
    return per.agg(F.try_divide(F.sum("won"), F.sum("pairs")).alias("auc"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), F.count("*").alias("groups"))


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold 0..k-1: each label's rows dealt round robin in a seeded order of md5. Rows are numbered over all labels in
    tasks of equal size, and counted from their label's first one."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = ordering.numbered(df.withColumn("__md5", order), [label, "__md5", key], "__n")
    firsts = placed.groupBy(F.col(label).alias("__label")).agg(F.min("__n").alias("__first"))  # a row a label
    both = placed.join(F.broadcast(firsts), F.col(label).eqNullSafe(F.col("__label")))
    return both.select(*df.columns, ((F.col("__n") - F.col("__first")) % k).cast("int").alias("fold"))


def fit_matrix(segments: DataFrame, features: list[str], optional: tuple[str, ...] = ("jump",)) -> DataFrame:
    """Rows of segments(features map or JSON) with a column a feature and usable: all there, but for the optional ones, which are 0."""
    f = F.col("features")
    if dict(segments.dtypes)["features"] == "string":
        f = F.from_json(f, "map<string,double>", {"allowNonNumericNumbers": "true"})
    own = segments.withColumn("__f", f)
    values = {k: F.nanvl(F.try_element_at("__f", F.lit(k)), F.lit(None).cast("double")) for k in features}
    values = {k: F.coalesce(v, F.lit(0.0)) if k in optional else v for k, v in values.items()}
    out = own.select("*", *[v.alias(k) for k, v in values.items()]).drop("__f")
    usable = F.lit(True)
    for k in features:
        usable = usable & F.col(k).isNotNull()
    return out.withColumn("usable", usable)


def fit_ridge(matrix: DataFrame, features: list[str], label: str, l2: float = 1.0):
    """Ridge logistic regression: the sum of log losses plus l2 times the squared weights, the intercept free."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = matrix.count()
    vectors = VectorAssembler(inputCols=features, outputCol="__x").transform(matrix)
    return LogisticRegression(featuresCol="__x", labelCol=label, regParam=2 * l2 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=200).fit(vectors)


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """z-scores by population deviation; a deviation of nothing counts as 1."""
    stats = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])  # one row
    out = df.join(F.broadcast(stats))
    scaled = {f: (F.col(f) - F.col(f"__m_{f}")) / F.when(F.col(f"__s_{f}") <= 1e-9, F.lit(1.0)).otherwise(F.col(f"__s_{f}")) for f in features}
    return out.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def out_of_fold(matrix: DataFrame, features: list[str], label: str, key: str, k: int = 5, seed: int = 0, l2: float = 1.0):
    """(scored, weights): each row's probability from the model of the other folds, and (fold, feature, weight) of each model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = matrix.sparkSession
    dealt = folds(standardise(matrix.where("usable"), features), key, label, k, seed)
    dealt = saved(dealt)  # read by every model and every held-out fold
    scored, weights = None, []
    for i in range(k):  # k is a parameter, 5
        model = fit_ridge(dealt.where(F.col("fold") != i), features, label, l2)
        held = VectorAssembler(inputCols=features, outputCol="__x").transform(dealt.where(F.col("fold") == i))
        out = model.transform(held).withColumn("p", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")
        scored = out if scored is None else scored.unionByName(out)
        weights += [(i, f, float(w)) for f, w in zip(features, model.coefficients, strict=True)]
    return scored, spark.createDataFrame(weights, "fold int, feature string, weight double")


def weight_stability(weights: DataFrame) -> DataFrame:
    """(feature, mean, sd, stable): a weight that changes sign between folds is not measured."""
    return weights.groupBy("feature").agg(F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("sd"), (F.countDistinct(F.signum("weight")) == 1).alias("stable"))


def suggested_weights(stability: DataFrame) -> DataFrame:
    """Positive mean weights, normalised; negative ones get none."""
    positive = F.greatest(F.col("mean"), F.lit(0.0))
    return stability.select("feature", F.coalesce(F.try_divide(positive, F.sum(positive).over(W.partitionBy())), F.lit(0.0)).alias("weight"), (F.col("mean") < 0).alias("negative"))


def verdict(fit: Column, within: Column, pairs: Column, incumbent: Column, incumbent_within: Column, spread: Column) -> Column:
    """What the log supports. The order of the cases matters: a check that cannot run never passes."""
    useful = F.coalesce(fit >= 0.58, F.lit(False))
    return (
        F.when((pairs >= 40) & F.coalesce(incumbent_within > within + 0.05, F.lit(False)), "keep current")
        .when(within.isNotNull() & (pairs < 40), "too few comparisons")
        .when(useful & within.isNull(), "unverifiable")
        .when(useful & F.coalesce(within < 0.56, F.lit(False)), "confounded")
        .when(~useful, "no signal")
        .when(F.coalesce(fit - incumbent < F.greatest(F.lit(0.03), spread / 2), F.lit(False)), "no better")
        .otherwise("use it")
    )
