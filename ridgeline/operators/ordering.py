"""Numbers and running totals in a global order, without a window that puts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.session import saved


def running(df: DataFrame, order: list[str | Column], totals: dict[str, Column]) -> DataFrame:
    """df with a column for each of totals: its sum over all rows before, in the given order, which must be total.

    The rows are dealt by range and written, so a row's part stays what it is. Sums within a part and the sums of the parts
    before, a row a part, make the whole.
    """
    dealt = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part"), *[c.alias(f"__v_{k}") for k, c in totals.items()])
    dealt = saved(dealt)
    parts = dealt.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in totals])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # of a row a part
    starts = parts.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__s_{k}") for k in totals])
    before = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.select("*", *[F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in totals])
    both = inside.join(F.broadcast(starts), "__part")
    return both.select(*[F.col(c) for c in df.columns], *[(F.col(f"__s_{k}") + F.col(f"__b_{k}")).alias(k) for k in totals])


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the given order."""
    return running(df, order, {name: F.lit(1).cast("long")})
