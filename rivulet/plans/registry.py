"""All engine queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans import channel_plans, geometry_plans, model_plans, network_plans, residual_plans, series_plans, topology_plans
from rivulet.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "channel_plans", "flagship", "geometry_plans", "model_plans", "network_plans", "residual_plans", "series_plans", "topology_plans"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to daily means, weighted areal means and routed flow, held against the unrouted one by fit metrics."""
    return series_plans.routed_fit(spark, sf_dir)
