"""The registered queries: operators over the driver's tables, each with the DuckDB SQL that must agree."""

from ridgeline.plans import flagship, gates, relational, reports, selection, signals, timeseries
from ridgeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "gates", "relational", "reports", "selection", "signals", "timeseries"]
