"""Frames of code facts, derived from the test tables, for the graph, rule and verdict queries.

Parts stand for functions and successive lines of an order for calls between them. The same frames are here in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.plans.registry import table


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, alike: all pairs of successive lines of an order with different parts, and whether both are taxed alike; parallel edges stay."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_tax", F.lead("l_partkey").over(w).alias("dst"), F.lead("l_tax").over(w).alias("tax"))
    return rows.filter(F.col("dst") != F.col("l_partkey")).select(F.col("l_partkey").alias("src"), "dst", (F.col("l_tax") == F.col("tax")).alias("alike"))


def every_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of all pairs: the multigraph that degrees are counted in."""
    return successors(spark, sf_dir).select("src", "dst")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a call is a pair that is taxed alike. All pairs would make one component in which everything reaches everything in three steps."""
    return successors(spark, sf_dir).filter("alike").select("src", "dst")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, name, file, is_public, complexity, doc, trait_impl, is_test."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("node"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.when(F.col("p_size") % 7 == 0, "_test.rs").otherwise(".rs")).alias("file"),
        (F.col("p_size") % 3 == 0).alias("is_public"),
        F.col("p_size").cast("double").alias("complexity"),
        F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("doc of "), F.col("p_name"))).alias("doc"),
        F.when(F.col("p_size") % 11 == 0, "Display").alias("trait_impl"),
        F.lit(False).alias("is_test"),
    )


_SUCC = """succ AS (SELECT l_partkey AS src, l_tax AS t0, lead(l_partkey) OVER w AS dst, lead(l_tax) OVER w AS t1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""
EVERY_CALL_SQL = f"{_SUCC}, calls AS (SELECT src, dst FROM succ WHERE src <> dst)"
CALLS_SQL = f"{_SUCC}, calls AS (SELECT src, dst FROM succ WHERE t0 = t1 AND src <> dst)"


FUNCTIONS_SQL = """functions AS (SELECT p_partkey AS node, replace(p_name, ' ', '_') AS name,
  'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || CASE WHEN p_size % 7 = 0 THEN '_test.rs' ELSE '.rs' END AS file,
  p_size % 3 = 0 AS is_public, p_size::DOUBLE AS complexity, CASE WHEN p_retailprice > 1500 THEN 'doc of ' || p_name END AS doc,
  CASE WHEN p_size % 11 = 0 THEN 'Display' END AS trait_impl, false AS is_test FROM part)"""
FAN_SQL = """fan AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) GROUP BY node)"""
