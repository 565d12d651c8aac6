"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree of domains, languages and sources. Every node's children share its
budget by weight, and no node gets more than its leaves can give (their tokens, times the epochs
allowed). What a child cannot take goes to its siblings by weight, and only what a whole family
cannot take goes to the family's siblings. That is water filling: sorted by capacity over weight,
the first children are full and the others share the rest, so it takes windows over siblings and no
iteration. Leaves are read in seeded epochs, each a new order of the leaf's documents; a leaf's
budget takes whole epochs and then a prefix of the next.

A prefix sum over a leaf, which may hold a third of all rows, is taken in two steps: tokens of each
of 4096 slices of the order, then exact sums only within the one slice that the budget ends in.
All arithmetic is on integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, materialize

SLICE = 3  # hexadecimal digits of the order that name a slice


def tokens(text: Column) -> Column:
    """White-space words, the unit of budgets; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE, -1), "")), F.lit(0)).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(children: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """children(*order, weight, capacity, given) with budget: each family's given budget, shared."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    # by capacity over weight; compared as scaled integers, a weight of zero last
    ratio = F.when(F.col("weight") > 0, _div(big("capacity") * 1_000_000, F.greatest(F.col("weight"), F.lit(1)).cast("decimal(38,0)")))
    by = W.partitionBy(*family).orderBy(F.col("__ratio").asc_nulls_last(), *order)
    ranked = children.withColumn("__ratio", ratio)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("long").alias("__taken"),
        (F.sum("weight").over(W.partitionBy(*family)) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("long").alias("__weights"),
    )
    left = F.greatest(F.least(big("given"), F.sum(big("capacity")).over(W.partitionBy(*family))) - big("__taken"), F.lit(0))
    ranked = ranked.withColumn("__left", left.cast("decimal(38,0)"))
    full = (F.col("__weights") > 0) & (big("capacity") * big("__weights") <= F.col("__left") * big("weight"))
    ranked = ranked.withColumn("__full", full)
    # the first child that is not full sets the level for it and all after it
    ranked = ranked.withColumn("__level", F.first(F.when(~F.col("__full"), F.struct("__left", "__weights")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    part = F.when(F.col("__level").isNull(), F.col("capacity")).when(F.col("__level")["__weights"] <= 0, F.lit(0)).otherwise(
        _div(F.col("__level")["__left"] * big("weight"), F.greatest(F.col("__level")["__weights"], F.lit(1)).cast("decimal(38,0)"))
    )
    return ranked.withColumn("budget", F.least(part.cast("long"), F.col("capacity"))).drop("__ratio", "__taken", "__weights", "__left", "__full", "__level")


def budgets(leaves: DataFrame, total: int | Column, epochs: int) -> DataFrame:
    """leaves(domain, lang, source, w_domain, w_lang, w_source, available) with budget."""
    own = leaves.withColumn("capacity", (F.col("available") * epochs).cast("long"))
    langs = own.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("w_domain").alias("w_domain"), F.max("w_lang").alias("weight"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("w_domain").alias("weight"))
    given = total if isinstance(total, Column) else F.lit(total)
    first = _share(domains.withColumn("given", given.cast("long")).withColumn("__all", F.lit(0)), ["__all"], ["domain"])
    second = _share(langs.join(first.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], ["domain", "lang"])
    third = own.withColumn("weight", F.col("w_source")).join(second.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"])
    return _share(third, ["domain", "lang"], ["domain", "lang", "source"]).select("domain", "lang", "source", "available", "budget")


def leaf_columns(domain: Column) -> list[Column]:
    """The leaf of a document; nulls are a language or source of their own."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return [F.coalesce(domain, F.lit("(none)")).alias("__domain"), none("lang").alias("__lang"), none("source").alias("__source")]


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Column],
    share: tuple[int, int] = (6, 10),
    epochs: int = 2,
    seed: int = 17,
    budget: int | None = None,
) -> DataFrame:
    """The columns of docs(doc_id, text, lang, source, ...) and epoch, a row for each time a document is read.

    domain gives a document's domain; weights has integer columns for "domain", "lang" and "source" over
    __domain, __lang and __source. budget is in tokens, or else the given share of all there are. A leaf
    reads its documents in the order of md5(seed:epoch:doc_id), whole epochs first and then as many as
    its budget holds; documents with equal doc_ids are read together. Null texts have no tokens and are
    read like others; null languages and sources are leaves; an empty table gives no rows; an input
    column named epoch is replaced.
    """
    names = [c for c in docs.columns if c != "epoch"]
    leaf = ["__domain", "__lang", "__source"]
    keyed = docs.select(*names, *leaf_columns(domain), tokens(F.col("text")).alias("__n"))
    rows = materialize(keyed.select("doc_id", *leaf, "__n"), "tokens")
    leaves = rows.groupBy(*leaf).agg(F.sum("__n").alias("available"))
    weighted = leaves.select(
        F.col("__domain").alias("domain"),
        F.col("__lang").alias("lang"),
        F.col("__source").alias("source"),
        *[weights[k].cast("long").alias(f"w_{k}") for k in ("domain", "lang", "source")],
        "available",
    )
    if budget is None:
        budget = (rows.agg(F.sum("__n")).first()[0] or 0) * share[0] // share[1]
    given = budgets(weighted, budget, epochs).where("available > 0")
    plan = materialize(given.select("domain", "lang", "source", _div(F.col("budget"), F.col("available")).alias("__whole"), (F.col("budget") % F.col("available")).alias("__rest")), "plan")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    named = plan.select(*[F.col(c[2:]).alias(c) for c in leaf], "__whole", "__rest")
    placed = rows.join(named, leaf).select(*leaf, "__rest", "__n", order.alias("__order"), F.substring(order, 1, SLICE).alias("__slice"))
    slices = placed.groupBy(*leaf, "__rest", "__slice").agg(F.sum("__n").alias("__in"))
    before = F.coalesce(F.sum("__in").over(W.partitionBy(*leaf).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = slices.withColumn("__before", before).where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__in") > F.col("__rest"))).select(*leaf, "__slice", "__before")
    cut = materialize(cut, "cut")  # a row a leaf
    # the slice is part of the key, so a hot leaf's rows are dealt by its 4096 slices
    inside = placed.join(cut, [*leaf, "__slice"])
    so_far = F.sum("__n").over(W.partitionBy(*leaf, "__slice").orderBy("__order").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = inside.withColumn("__sum", F.col("__before") + so_far).where("__sum <= __rest").groupBy(*leaf).agg(F.max("__order").alias("__last"))
    ends = materialize(named.join(cut, leaf, "left").join(last, leaf, "left").select(*leaf, "__whole", F.coalesce("__last", "__slice").alias("__last")), "ends")
    # without a last document in the slice all before the slice is taken; its name is less than any order in it
    copies = F.col("__whole") + (F.col("__last").isNotNull() & (order <= F.col("__last"))).cast("long")
    read = keyed.join(ends, leaf).withColumn("__copies", copies).where("__copies > 0")
    return read.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("epoch"))
