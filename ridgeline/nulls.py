"""The NaN to NULL boundary: series arrive with NaN for absent, every operator expects NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities of all float columns with NULL."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}

    def clean(name: str):
        c = F.col(name)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    return df.select(*[clean(c) if c in floats else F.col(c) for c in df.columns])


def finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
