"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.plans import (  # noqa: F401
    aggregate_queries,
    calibration_queries,
    experiment_queries,
    join_queries,
    order_queries,
    scalar_queries,
    source_queries,
    stream_queries,
)
from tamis.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a05_rule_metrics"](spark, sf_dir)
