"""Queries of the code pipeline and the streamed ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import analyze
from tesserae.operators.iterate import new_path, ship
from tesserae.plans.registry import query
from tesserae.plans.state_queries import MUTATIONS, mutations
from tesserae.sources import code
from tesserae.streaming import ledger


@query()
def parse_pages_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of pages as JavaScript files: their calls by kind and name."""
    ship(spark)
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    script = F.concat(F.lit("function page"), F.col("page_id").cast("string"), F.lit("() {\n"), F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1), F.lit("\n}\n"))
    files = p.select(F.concat(F.lit("src/page"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), script.alias("source"))
    return code.call_sites(code.functions(code.parsed(files))).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("caller").alias("n_callers"))


@query(f"""WITH {MUTATIONS} SELECT id, CASE kind WHEN 'analyse' THEN 'Pending' WHEN 'remove' THEN 'Removed' WHEN 'keep' THEN 'Kept' ELSE 'FalsePositive' END AS outcome, confidence, n_mutations FROM l""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the events, streamed from files to completion."""
    top = new_path(spark, "stream")
    mutations(spark, sf_dir).repartition(4, "id").write.parquet(f"{top}/in")
    q = ledger.follow(ledger.mutations(spark, f"{top}/in", files_a_batch=2), f"{top}/log", f"{top}/ledger", f"{top}/checkpoint")
    q.awaitTermination()
    return ledger.latest(spark, f"{top}/ledger").select("id", "outcome", "confidence", "n_mutations")


@query()
def analyze_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis over files made from parts: each brand's parts as functions that call the next part of the brand."""
    ship(spark)
    return analyze.verdicts_of(analyze.made_files(spark.read.parquet(f"{sf_dir}/part.parquet")))
