"""What the jobs share: config files, the log and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from populace.operators.gates import Polygon, Rect

log = logging.getLogger("populace.jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, read by Spark, so that it may lie where the tables lie."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def gates_of(given: dict) -> dict:
    """Gates by category: four numbers are a rectangle (x_min, x_max, y_min, y_max), a list of
    points is a polygon."""
    return {c: Rect(*map(float, g)) if not isinstance(g[0], list) else Polygon(tuple(map(tuple, g))) for c, g in given.items()}


def columns_of(given: dict[str, str]) -> list[Column]:
    """Named SQL expressions of a config as columns."""
    return [F.expr(e).alias(name) for name, e in given.items()]


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(doc: str, run: Callable[..., object], **paths: str) -> None:
    """The command line: one option for each path of ``run``, and its session."""
    parser = argparse.ArgumentParser(description=doc.strip().splitlines()[0])
    for name, what in paths.items():
        parser.add_argument(f"--{name.replace('_', '-')}", required=True, help=what)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
