"""The registry, and the tables that queries use as cells.

``cells``: line items as points, (l_quantity, l_extendedprice), with two label
columns that hold missing values. ``ev``: events with a single-column key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None):
    """Registers a function under its name. operators: the inventory ids it covers."""

    def add(f):
        QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = operators
        if sql:
            SQL[f.__name__] = PREFIX + sql if not sql.lstrip().upper().startswith("WITH") else PREFIX + ", " + sql.lstrip()[4:]
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("dataset"), F.pmod("l_suppkey", F.lit(7)).alias("sample"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), "l_discount", "l_tax",
        F.nullif("l_linestatus", F.lit("F")).alias("Step01_a|b"), F.nullif("l_returnflag", F.lit("N")).alias("Step02_c|d"),
        F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("row_id"),
    )


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select("event_id", "ts", "user_id", "event_type", "value", F.asinh(F.col("value") / 5).alias("x"), F.pmod("user_id", F.lit(100)).cast("double").alias("y"))


PREFIX = """WITH cells AS (
  SELECT l_returnflag AS dataset, l_suppkey % 7 AS sample, l_quantity AS x, l_extendedprice AS y, l_discount, l_tax,
         nullif(l_linestatus, 'F') AS "Step01_a|b", nullif(l_returnflag, 'N') AS "Step02_c|d",
         md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))) AS row_id
  FROM lineitem
), ev AS (
  SELECT event_id, ts, user_id, event_type, value, asinh(value / 5) AS x, (user_id % 100)::DOUBLE AS y FROM events
)
"""
