"""Names every query of the library and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import stratalens.functions.code
import stratalens.operators.aggregates
import stratalens.operators.decisions
import stratalens.operators.evidence
import stratalens.operators.graph
import stratalens.operators.joins
import stratalens.operators.paths
import stratalens.operators.reports
import stratalens.operators.resolve
import stratalens.operators.scan
import stratalens.operators.windows
import stratalens.plans.compositions
import stratalens.sources.publish
import stratalens.streaming.sessions  # noqa: F401
from stratalens.plans.registry import REGISTERED, Query, Tables


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Change risk of each commit with its percentile."""
    return stratalens.plans.compositions.k03_change_risk(Tables(spark, folder))
