"""All registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import analysis, base, gates, jobs, models, predicates, rendering, scoring, steps, texts, transforms, trees

MODULES = (predicates, transforms, gates, scoring, analysis, texts, rendering, trees, steps, models, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
