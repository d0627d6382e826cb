"""Queries of rules, signals and verdicts, over parts as functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import rules
from tesserae.functions import text as t
from tesserae.operators import graph, verdict
from tesserae.plans.frames import CALLS_SQL, FAN_SQL, FUNCTIONS_SQL, calls, functions
from tesserae.plans.graph_queries import ROOTS_SQL, roots
from tesserae.plans.registry import query, table

STATE_SQL = "CASE WHEN dead_score >= 0.8 THEN 'DefinitelyDead' WHEN dead_score >= 0.8 * 0.8::DOUBLE THEN 'ProbablyDead' WHEN dead_score <= 0.15 THEN 'DefinitelyAlive' WHEN dead_score <= 1.5::DOUBLE * 0.15 THEN 'ProbablyAlive' ELSE 'Unknown' END"
VERDICT_SQL = f"""{CALLS_SQL}, {ROOTS_SQL}, {FAN_SQL}, r0 AS (SELECT node FROM roots),
reached AS (SELECT node FROM r0 UNION SELECT dst FROM reached JOIN calls ON src = node),
f AS (SELECT functions.*, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out, node IN (SELECT node FROM reached) AS reachable, node % 13 = 0 AS dynamic, CASE WHEN node % 2 = 0 THEN (node % 11) / 10.0::DOUBLE END AS ml_dead FROM functions LEFT JOIN fan USING (node)),
s AS (SELECT *, greatest(least(least(greatest(((CASE WHEN fan_in = 0 THEN 0.4::DOUBLE ELSE -0.4::DOUBLE * least(fan_in / 10.0::DOUBLE, 1) END + CASE WHEN reachable THEN -0.3::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN is_public THEN -0.2::DOUBLE ELSE 0.2::DOUBLE END) / 0.9::DOUBLE + 1) / 2, 0), 1)
  - (CASE WHEN trait_impl IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN complexity > 10 THEN 0.1::DOUBLE * least(complexity / 50, 1) ELSE 0 END + CASE WHEN doc IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN dynamic THEN 0.4::DOUBLE ELSE 0 END) / 0.75::DOUBLE * 0.5::DOUBLE, 1), 0) AS static_score FROM f),
g AS (SELECT *, CASE WHEN dynamic THEN 0.1::DOUBLE WHEN ml_dead IS NOT NULL THEN static_score * 0.6::DOUBLE + ml_dead * 0.4::DOUBLE ELSE static_score END AS dead_score FROM s),
h AS (SELECT *, {STATE_SQL} AS state, (dynamic AND coalesce(ml_dead > 0.7, false))::INTEGER AS n_critical, (dynamic AND coalesce(ml_dead > 0.7, false))::INTEGER + (static_score > 0.7 AND coalesce(ml_dead < 0.3, false))::INTEGER AS n_conflicts FROM g),
v AS (SELECT *, CASE WHEN dynamic OR n_critical > 0 THEN 'DoNotDelete' WHEN state = 'DefinitelyDead' AND n_conflicts = 0 THEN 'SafeToDelete' WHEN state IN ('DefinitelyDead', 'ProbablyDead', 'Unknown') THEN 'ReviewRequired' ELSE 'DoNotDelete' END AS recommendation FROM h)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    reached = graph.reach(e, roots(spark, sf_dir)).withColumn("hit", F.lit(True))
    f = functions(spark, sf_dir).join(graph.fan(e), "node", "left").join(reached, "node", "left")
    return f.select(
        "node", "name", "file", "is_public", "complexity", "doc", "trait_impl", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("hit", F.lit(False)).alias("reachable"),
        (F.col("node") % 13 == 0).alias("dynamic"), F.when(F.col("node") % 2 == 0, (F.col("node") % 11) / 10.0).alias("ml_dead"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.verdicts(facts(spark, sf_dir))


@query(f"WITH RECURSIVE {VERDICT_SQL} SELECT node, round(static_score, 6) AS static_score, round(dead_score, 6) AS dead_score, state, n_conflicts FROM v")
def signals_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("node", F.round("static_score", 6).alias("static_score"), F.round("dead_score", 6).alias("dead_score"), "state", F.size("conflicts").alias("n_conflicts"))


@query(f"""WITH RECURSIVE {VERDICT_SQL} SELECT node, recommendation, CASE WHEN complexity > 20 THEN 'High' WHEN fan_in = 0 AND is_public THEN 'High' WHEN complexity > 10 OR fan_in > 0 THEN 'Medium' ELSE 'Low' END AS overall_risk,
CASE WHEN complexity * 3 > 100 OR complexity > 20 THEN 'High (1-2 days)' WHEN complexity * 3 > 50 OR complexity > 10 THEN 'Medium (2-4 hours)' ELSE 'Low (30 min - 1 hour)' END AS effort FROM v""")
def deletion_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("node", "recommendation", F.col("risk.overall").alias("overall_risk"), verdict.effort(F.col("complexity") * 3, F.col("complexity")).alias("effort"))


@query(f"""WITH RECURSIVE {VERDICT_SQL} SELECT node, row_number() OVER (ORDER BY round(dead_score, 6) DESC, node)::BIGINT AS place FROM v WHERE state IN ('DefinitelyDead', 'ProbablyDead')""")
def removal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.removal_order(verdicts(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH RECURSIVE {VERDICT_SQL} SELECT count(*)::BIGINT AS total, sum((state = 'DefinitelyDead')::BIGINT)::BIGINT AS definitely_dead, sum((state = 'ProbablyDead')::BIGINT)::BIGINT AS probably_dead, sum((state = 'Unknown')::BIGINT)::BIGINT AS unknown,
sum((state = 'ProbablyAlive')::BIGINT)::BIGINT AS probably_alive, sum((state = 'DefinitelyAlive')::BIGINT)::BIGINT AS definitely_alive, round(avg((state IN ('DefinitelyDead', 'ProbablyDead'))::INTEGER), 6) AS dead_ratio, sum((recommendation = 'SafeToDelete')::BIGINT)::BIGINT AS safe FROM v""")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.stats(verdicts(spark, sf_dir)).withColumn("dead_ratio", F.round("dead_ratio", 6))


@query(f"WITH RECURSIVE {VERDICT_SQL}, g1 AS (SELECT sum((state IN ('DefinitelyDead', 'ProbablyDead'))::BIGINT)::BIGINT AS n_dead, avg((state IN ('DefinitelyDead', 'ProbablyDead'))::INTEGER) AS r FROM v) SELECT n_dead, round(r, 6) AS ratio, n_dead <= 100 AND r <= 0.1 AS passed FROM g1")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.gate(verdicts(spark, sf_dir), 100, 0.1).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH RECURSIVE {VERDICT_SQL}, tail AS (SELECT src AS node, sum(0.1::DOUBLE * complexity) AS t FROM calls JOIN functions ON dst = functions.node GROUP BY src)
SELECT v.node, round(complexity + coalesce(t, 0), 6) AS impact FROM v LEFT JOIN tail USING (node) WHERE state IN ('DefinitelyDead', 'ProbablyDead')""")
def function_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = verdicts(spark, sf_dir).filter(F.col("state").isin("DefinitelyDead", "ProbablyDead")).select("node")
    return verdict.impact(dead, calls(spark, sf_dir), functions(spark, sf_dir).select("node", "complexity")).withColumn("impact", F.round("impact", 6))


@query(f"""WITH {FUNCTIONS_SQL} SELECT node, CASE WHEN file LIKE '%\\_test.rs' ESCAPE '\\' THEN 'Protected' WHEN trait_impl IS NOT NULL THEN 'Protected' WHEN is_public THEN 'LikelyAlive' WHEN starts_with(name, 'get_') THEN 'LikelyAlive' ELSE 'Candidate' END AS level FROM functions""")
def protection_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return functions(spark, sf_dir).select("node", rules.protection(c("name"), c("file"), c("is_test"), c("trait_impl"), c("is_public"), c("doc")).alias("level"))


@query(f"""WITH {FUNCTIONS_SQL}, k AS (SELECT node, CASE WHEN file LIKE '%\\_test.rs' ESCAPE '\\' THEN 'test' WHEN is_public THEN 'export' END AS kind FROM functions) SELECT kind, count(*)::BIGINT AS n, min(node) AS first FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def roots_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kinds = functions(spark, sf_dir).select("node", rules.root_kind(c("is_test"), c("name"), c("file"), c("is_public"), c("doc")).alias("kind")).filter("kind is not null")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))


@query("""WITH r AS (SELECT page_id, 'href' AS kind, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages UNION ALL SELECT page_id, 'call', unnest(regexp_extract_all(html, '([a-z]+)\\([0-9]+\\)', 1)) FROM pages),
n AS (SELECT page_id, kind, target, count(*)::BIGINT AS n FROM r GROUP BY ALL) SELECT * FROM n""")
def dynamic_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that patterns find in pages, each once with its count."""
    p = table(spark, sf_dir, "pages")
    found = [p.select("page_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("target")) for kind, pattern in (("href", 'href="/([^"]*)"'), ("call", "([a-z]+)\\([0-9]+\\)"))]
    return found[0].unionAll(found[1]).groupBy("page_id", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FUNCTIONS_SQL} SELECT node, split_part(file, '/', 2) AS layer, 'rust' AS language, 'crate::' || replace(regexp_replace(substr(file, 5), '\\.rs$', ''), '/', '::') AS module FROM functions")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file")
    return functions(spark, sf_dir).select("node", rules.layer_of(f).alias("layer"), rules.language_of(f).alias("language"), t.module_path(f).alias("module"))
